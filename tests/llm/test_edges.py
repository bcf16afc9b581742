"""Edge cases and brute-force checks of each corpus operator on small tables."""

import hashlib
import json
import math
import random
import re

import numpy as np
import pytest
import public_tokenizers
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from conftest import same

from gridstride.llm import decontam, html, langid, lines, packing, queries, simhash, substring, token_counts, topk, toxicity
from gridstride.llm.components import components
from gridstride.llm.queries import tokenizer_file

LONG = " ".join(f"word{i % 97}x{i}" for i in range(9000))
WORDS = "the of and ein der la le un une der ist that with was for not have this from they she will would there".split()


def texts():
    r = random.Random(4)
    body = [" ".join(r.choice(WORDS) + str(r.randrange(60)) for _ in range(r.randrange(1, 160))) for _ in range(30)]
    shared = " ".join(f"shared{i}" for i in range(60))
    near = " ".join(f"near{i} token" for i in range(200))
    return [None, "", "  \n ", LONG, *body, body[0], body[0], f"{body[1]} {shared} tail", f"head {shared}\n{body[2]}", near, near.replace("near7 ", "far7 "), near + " end", "Ünïcode ÄÖ\r\n\t tabs  two <|endoftext|> 'll", "x" * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    """Texts with nulls, empties, ties, repeats and columns whose names clash with internal ones."""
    rows = [(i, t, "l", i, "p", i % 3) for i, t in enumerate(texts())]
    return spark.createDataFrame(rows + [rows[5]], "doc_id long, text string, id string, part int, fp string, root int")


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("false")


def pairs(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_token_counts(docs, none):
    spec = tokenizer_file("byte_bpe_50k.json")
    library = Tokenizer.from_str(spec)
    want = sorted((i, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in [*enumerate(texts()), (5, texts()[5])])
    assert pairs(token_counts.token_counts(docs, spec), "doc_id", "n_bytes", "n_tokens") == want
    assert token_counts.token_counts(none, spec).count() == 0


def test_token_counts_of_odd_texts():
    spec = tokenizer_file("byte_bpe_50k.json")
    library, counter = Tokenizer.from_str(spec), token_counts.Counter(spec, token_counts.whole_tokens(spec))
    r = random.Random(1)
    odd = ["".join(r.choice(list("ab'sdé1 \n\t\r\x0b\x1c\x85\xa0 ​!.😀日本ßΣ\n") + ["<|endoftext|>", "'ll"]) for _ in range(r.randrange(30))) for _ in range(2000)]
    assert counter.count(odd) == [len(library.encode(t, add_special_tokens=False).ids) for t in odd]


def test_packing(docs, none):
    import zlib

    spec = tokenizer_file("word_bpe_49k.json")
    library = Tokenizer.from_str(spec)
    rows = packing.pack_documents(docs, spec).collect()
    whole = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate(texts())}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.doc_tokens == len(whole[r.doc_id]) and r.ids_crc32 == zlib.crc32(whole[r.doc_id][r.start : r.start + r.length].tobytes())
    assert {i: sum(r.length for r in rs) for i, rs in by_doc.items()} == {i: len(w) * (2 if i == 5 else 1) for i, w in whole.items()}
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
    assert packing.pack_documents(none, spec).count() == 0


def test_packing_plan_is_tight():
    r = random.Random(2)
    histogram = {}
    for _ in range(20_000):
        n = min(2048, int(r.expovariate(1 / 600)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    rows = packing.plan(histogram)
    assert sum(x[2] for x in rows) == 20_000
    assert max(x[3] + x[2] for x in rows) * 2048 < 1.01 * sum(n * c for n, c in histogram.items())
    full = {}
    for n, _, copies, sequence, _ in rows:
        for k in range(sequence, sequence + copies):
            full[k] = full.get(k, 0) + n
    assert sum(v == 2048 for v in full.values()) > 0.95 * len(full)


def test_least_squares_place_most_pieces(monkeypatch):
    r = random.Random(5)
    histogram = {}
    for _ in range(10_000):
        n = min(2048, int(r.expovariate(1 / 500)) + 1)
        histogram[n] = histogram.get(n, 0) + 1
    solved = []
    real = packing.repeats_of
    monkeypatch.setattr(packing, "repeats_of", lambda combos, counts: solved.append(int(counts.sum())) or real(combos, counts))
    packing.plan(histogram)
    left = solved[-1]
    print(f"pieces left to the greedy end after {len(solved)} rounds: at most {left} of 10000")
    assert left < 5_000


def test_fingerprints_and_components(docs, none):
    def brute(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)])] if w else []
        return sum(1 << b for b in range(64) if sum(v >> b & 1 for v in h) * 2 > len(h)) if h else 0

    fps = {i: brute(t) for i, t in enumerate(texts())}
    root = {i: i for i in fps}
    for _ in fps:
        for a in fps:
            for b in fps:
                if (fps[a] ^ fps[b]).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
    want = sorted((i, f"{fps[i]:016x}", root[i]) for i in [*fps, 5])
    assert pairs(simhash.near_duplicates(docs), "doc_id", "fingerprint", "component_id") == want
    assert simhash.near_duplicates(none).count() == 0


def test_one_of_each_stays(spark):
    near = " ".join(f"near{i} token" for i in range(200))
    rows = [(1, "first text of some words", "x"), (1, "quite another text that shares no word", "y"), (2, near, "a"), (3, near, "b"), (2, near, "c"), (None, near, "d"), (None, "only here and without id", "e"), (5, None, "f"), (4, "", "g"), (9, near + " end", "h")]
    got = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _row string")).collect()
    assert sorted((r.doc_id or 0, r._row in "ac" or r._row) for r in got) == [(0, "e"), (1, "x"), (1, "y"), (2, True), (4, "g")]


def test_near_pairs_are_all_found_once(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    values = {b ^ sum(1 << k for k in r.sample(range(64), r.randrange(7))) for b in base for _ in range(8)}
    df = spark.createDataFrame([(v - (1 << 64) if v >> 63 else v,) for v in values], "fp long")
    mask = (1 << 64) - 1
    want = {(a, b) for (a,) in df.collect() for (b,) in df.collect() if a < b and ((a ^ b) & mask).bit_count() <= 4}
    for agree in (3, 4):
        got = [(r_.a, r_.b) for r_ in simhash.near_pairs(df, agree=agree).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert simhash.agreeing(10**6) == 3 and simhash.agreeing(10**8) == 4


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, 900 + i) for i in range(50)] + [(5, 5), (None, 3), (900, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {900 + i: 7 for i in range(50)} | {7: 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("window", [5, 35])
def test_repeated_passages(docs, none, window):
    rows = [(i, t) for i, t in [*enumerate(texts()), (5, texts()[5])]]
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    seen = {}
    for w in words:
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            seen[key] = seen.get(key, 0) + 1
    want = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = [any(seen.get(tuple(w[s : s + window]), 0) > 1 and s + window <= len(w) for s in range(max(0, k - window + 1), k + 1)) for k in range(len(w))]
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    assert pairs(substring.repeated_passages(docs, window), "doc_id", "n_words", "n_removed", "kept_sha256", "kept") == sorted(want)
    assert substring.repeated_passages(none, window).count() == 0


def test_line_dedup(spark, none):
    long = " ".join(f"a line of many words {i}" for i in range(12))
    rows = [(1, f"{long}\nshort\n\n  "), (2, f"{long} more\nshort\nother line here"), (3, None), (4, ""), (5, "short"), (None, f"{long}x"), (6, "other line here!\nabc"), (7, "abd")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[None] == (f"{long}x", 1, 0)  # null ids come first
    assert got[1] == ("short\n\n  ", 4, 1)
    assert got[2] == ("other line here", 3, 2)
    assert got[3] == (None, 0, 0) and got[4] == ("", 1, 0) and got[5] == ("", 1, 1)
    assert got[6] == ("abc", 2, 1) and got[7] == ("abd", 1, 0)
    out = lines.deduplicate(none)
    assert out.count() == 0 and out.columns == [*none.columns, "n_lines", "n_removed"]


def test_intersections_are_exact():
    r = random.Random(16)
    base = "".join(r.choice("abcd ") for _ in range(200))
    sets = [lines._sets(base[: r.randrange(60, 200)] + "".join(r.choice("ab") for _ in range(r.randrange(30)))) for _ in range(60)]
    rows = np.arange(0, 60, 7)
    got = lines.intersections(sets, rows)
    assert all(got[k, j] == len(sets[i] & sets[j]) for k, i in enumerate(rows) for j in range(60) if i != j)


def test_line_links_equal_brute_force():
    r = random.Random(6)
    base = ["".join(r.choice("abcd ") for _ in range(r.randrange(3, 90))) for _ in range(25)]
    some = [x[: len(x) // 2] + r.choice("abz") + x[len(x) // 2 + r.randrange(2) :] for x in base for _ in range(5)] + base
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} or {x} for x in some]
    root = list(range(len(some)))
    for _ in range(4):
        for a in range(len(some)):
            for b in range(len(some)):
                if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                    root[a] = root[b] = min(root[a], root[b])
    got = list(range(len(some)))
    for a, b in lines.links_within(some) * 4:
        got[a] = got[b] = min(got[a], got[b])
    for _ in range(len(some)):
        for a, b in lines.links_within(some):
            got[a] = got[b] = min(got[a], got[b])
    assert got == root


def test_bands_and_sketches_keep_pairs():
    r = random.Random(12)
    kept = whole = 0
    for n in (8, 14, 34, 66, 90, 130, 150, 180, 240, 400):
        base = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n)) for _ in range(600)]
        more = [x + "".join(r.choice("0123456789") for _ in range((n - 4) // 4)) for x in base]
        sets = [(lines._sets(x), lines._sets(y)) for x, y in zip(base, more, strict=True)]
        real = [k for k, (a, b) in enumerate(sets) if len(a & b) >= 0.8 * len(a | b)]
        one, two = [base[k] for k in real], [more[k] for k in real]
        keys = [{} for _ in range(2)]
        for side, part in enumerate((one, two)):
            for key, owner in zip(*lines.band_keys(part), strict=True):
                keys[side].setdefault(int(owner), set()).add(int(key))
        near = np.zeros(len(real), bool)
        for (i, a), (j, b) in zip(lines.sketches(one), lines.sketches(two), strict=True):
            both, x, y = np.intersect1d(i, j, return_indices=True)
            near[both] |= lines.alike(a[x], b[y])
        whole += len(real)
        kept += sum(bool(keys[0][k] & keys[1][k]) and bool(near[k]) for k in range(len(real)))
        for (i, a), (j, b) in zip(lines.sketches(one), lines.sketches(["".join(r.choice("0123456789") for _ in range(n)) for _ in real]), strict=True):
            _, x, y = np.intersect1d(i, j, return_indices=True)
            assert not lines.alike(a[x], b[y]).any()
    print(f"recall of pairs at a similarity of just 0.8: {kept / whole:.4f} of {whole}")
    assert whole > 5000 and kept >= 0.99 * whole


def test_line_dedup_equals_brute_force(spark, monkeypatch):
    r = random.Random(31)
    base = [" ".join(r.choice(WORDS) + str(r.randrange(30)) for _ in range(r.randrange(1, 60))) for _ in range(60)]
    some = []
    for x in base:
        for _ in range(r.randrange(1, 12)):
            k = r.randrange(len(x))
            x = x[:k] + r.choice(["", "q", "zz"]) + x[k + r.randrange(3) :]
            some.append(x)
    some += [f"Page {i} of 700 of this long book of many pages" for i in range(60)]
    r.shuffle(some)
    rows = [(i // 2, "\n".join(some[k] for k in range(i, len(some), 120))) for i in range(120)]  # ids come twice
    order = sorted((i, k, x) for i, t in rows for k, x in enumerate(t.split("\n")))
    sets = {x: lines._sets(x) for x in some}
    names = sorted(sets)
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, x in enumerate(names):
        for y in names[:n]:
            if len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]) - 1e-9:
                root[find(x)] = find(y)
    groups = len({find(x) for x in names})
    for block, hot, sure in ((1500, 20_000, 64), (5, 20_000, 64), (5, 3, 1)):  # then families are large, then keys are common too
        monkeypatch.setattr(lines, "BLOCK", block)
        monkeypatch.setattr(lines, "CHUNK", block)
        monkeypatch.setattr(lines, "HOT", hot)
        monkeypatch.setattr(lines, "SURE", sure)
        table = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_gone", F.lit(1)).withColumn("_row", F.lit(2))
        got = lines.deduplicate(table).collect()
        kept = [x for r_ in got for x in r_.text.split("\n") if x]
        assert sum(r_.n_lines - r_.n_removed for r_ in got) == len(kept) and sum(r_.n_lines for r_ in got) == len(order)
        classes = [find(x) for x in kept]
        assert len(set(classes)) == groups  # every component keeps a line
        print(f"lines kept {len(kept)}, components {groups}")
        assert len(kept) - groups <= 0.01 * len(names)  # links that were missed keep more
    least = {}
    for i, _, x in order:
        least.setdefault(find(x), i)
    assert all(r_._gone == 1 and r_._row == 2 for r_ in got)
    assert sum(least[find(x)] == r_.doc_id for r_ in got for x in r_.text.split("\n") if x) >= 0.99 * len(kept)


def test_unlike_lines_under_one_key_take_little_time(capsys):
    import time

    r = np.random.default_rng(1)
    unlike = r.integers(0, 256, (50_000, lines.WIDTH), dtype=np.uint8)
    start = time.time()
    found = lines.joined(unlike)
    took = time.time() - start
    with capsys.disabled():
        print(f"\n  50,000 unlike lines under one key: {took:.2f} s, {len(found)} links")
    assert took < 20 and not found


def test_sketches_join_as_all_pairs_would():
    r = np.random.default_rng(2)
    for n in [500] * 8 + [150] * 8 + list(range(1, 30)):
        own = r.integers(0, 256, (12, lines.WIDTH), dtype=np.uint8)[r.integers(0, 12, n)]
        edited = r.random(own.shape) < r.uniform(0.05, 0.3)
        own[edited] = r.integers(0, 256, edited.sum(), dtype=np.uint8)
        own[: n // 12] = own[n // 12 : n // 12 * 2]
        pairs_ = [(i, j) for i in range(n) for j in (i + 1 + np.flatnonzero(lines.alike(own[i], own[i + 1 :]))).tolist()]
        classes = []
        for links in (pairs_, lines.joined(own)):
            parent = np.arange(n)
            for a, b in links:
                a, b = lines.find(parent, a), lines.find(parent, b)
                parent[max(a, b)] = min(a, b)
            classes.append([lines.find(parent, x) for x in range(n)])
        assert classes[0] == classes[1]


def test_rows_that_share_an_id_are_told_apart(spark):
    rows = [(7, "dup line of some words\nAlpha"), (7, "unique line with other words\nBeta"), (8, "dup line of some words\nGamma"), (9, "again and again"), (9, "again and again")]
    got = sorted((r.doc_id, r.text, r.n_removed) for r in lines.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(7, "dup line of some words\nAlpha", 0), (7, "unique line with other words\nBeta", 0), (8, "Gamma", 1), (9, "again and again", 0), (9, "again and again", 0)]


def distance(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, e in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return min(row)


def test_decontamination(spark, docs, none):
    r = random.Random(8)
    items = [(i, " ".join(r.choice(WORDS) + r.choice("abcdé") for _ in range(20))) for i in range(4)] + [(8, None), (9, ""), (10, "tiny")]
    rows = []
    for i in range(40):
        x = list(items[i % 4][1])
        for _ in range(r.randrange(24)):
            k = r.randrange(len(x))
            x[k : k + 1] = r.choice(["", "q", "zz"])
        rows.append((i, "é pre " * r.randrange(5) + "".join(x).upper() + "\n post" * r.randrange(5)))
    rows += [(90, None), (91, ""), (92, "a tiny thing"), (0, rows[0][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    table = spark.createDataFrame(rows, "doc_id long, text string")
    want = []
    for i, t in rows:
        for j, p in items:
            if p and (d := distance(decontam.normal(p), decontam.normal(t))) <= int(0.1 * len(decontam.normal(p))):
                want.append((i, j, d))
    got = pairs(decontam.contaminated(table, benchmark), "doc_id", "item_id", "distance")
    assert got == sorted(want) and len({i for i, _, _ in want}) > 5
    assert decontam.contaminated(none, benchmark).count() == 0
    assert decontam.contaminated(table, benchmark.where("false")).count() == 0
    assert decontam.decontaminate(docs, benchmark).columns == docs.columns
    kept = decontam.decontaminate(spark.createDataFrame([(1, items[0][1], "a"), (1, "clean", "b"), (None, items[1][1], "c"), (None, None, "d")], "doc_id long, text string, _hit string"), benchmark)
    assert sorted(r._hit for r in kept.collect()) == ["b", "d"]  # by text, whatever the id


def test_decontamination_of_items_with_repeated_phrases(spark):
    r = random.Random(21)
    phrases = ["".join(r.choice("abcé ") for _ in range(r.randrange(4, 14))) for _ in range(5)]
    items = [(f"item {i}", "".join(r.choice(phrases[:3]) for _ in range(r.randrange(3, 9)))) for i in range(12)]
    rows = []
    for i in range(1500):
        x = list(r.choice(items)[1])
        for _ in range(r.randrange(10)):
            k = r.randrange(len(x) + 1)
            x[k : k + r.randrange(2)] = r.choice(["", "q", "zz", "é"])
        rows.append((f"d{i}", "".join(r.choice(phrases) for _ in range(r.randrange(4))) + "".join(x) + "".join(r.choice(phrases) for _ in range(r.randrange(4)))))
    got = pairs(decontam.contaminated(spark.createDataFrame(rows, "doc_id string, text string"), spark.createDataFrame(items, "item_id string, text string")), "doc_id", "item_id", "distance")
    want = []
    for i, t in rows:
        for j, p in items:
            p = decontam.normal(p)
            if p and (d := decontam.least_distance(p, decontam.normal(t))) <= int(0.1 * len(p)):
                want.append((i, j, d))
    assert len(want) > 500 and got == sorted(want)
    assert all(decontam.least_distance(p, t) == distance(p, t) for p, t in ((decontam.normal(items[k % 12][1]), decontam.normal(rows[k][1])) for k in range(60)) if p)


def test_top_products(spark):
    r = np.random.default_rng(5)
    vectors = r.normal(0, 0.3, (300, 8)) * r.gamma(1, 1, (300, 1))
    vectors[50:120] = vectors[40]  # a common vector
    rows = [(i, [float(x) for x in v], "c") for i, v in enumerate(vectors)] + [(400, None, "c"), (420, [1.0, None] + [0.0] * 6, "c"), (440, [float("nan")] * 8, "c"), (460, [float("inf")] * 8, "c"), (480, [1e30] * 8, "c"), (500, [1.0, 2.0], "c"), (520, [], "c"), (None, [1.0] * 8, "c")]
    got = pairs(topk.top_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>, v string"), 5), "query_id", "rank", "vec_id", "score")
    whole = {i: [math.floor(64 * x) for x in v] for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = []
    for q, x in whole.items():
        if q % 20 == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(x, y, strict=True)), -(2**63)), 2**63 - 1), i) for i, y in whole.items() if i != q and len(y) == len(x))
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scores[:5], 1)]
    assert [g for g in got if g[0] != 480 and g[2] != 480] == [w for w in sorted(want) if w[0] != 480 and w[2] != 480]
    twins = [(3, [1.0, 0.0]), (3, [1.0, 0.0]), (3, [0.5, 0.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0]), (20, [0.0, 1.0])]
    got = pairs(topk.top_products(spark.createDataFrame(twins, "vec_id long, embedding array<double>"), 4), "query_id", "rank", "vec_id", "score")
    long = [(20, 1, 3, 4096), (20, 2, 3, 4096), (20, 3, 20, 4096), (20, 4, 3, 2048)]
    assert got == sorted([*long, *long, (20, 1, 3, 0), (20, 2, 3, 0), (20, 3, 3, 0), (20, 4, 20, 0)])
    assert topk.top_products(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_buckets_prune_and_keep_the_best(spread):
    r = np.random.default_rng(3)
    centres = r.normal(0, 1, (20, 16))
    rows = np.floor(64 * (centres[r.integers(0, 20, 3000)] + r.normal(0, spread, (3000, 16))) * r.gamma(2, 1, (3000, 1))).astype(np.int64)
    queries = rows[::50]
    best, checked = topk.Best(queries, np.full(len(queries), -np.inf), 5), 0
    order = np.argsort(-np.sqrt((rows**2).sum(1)), kind="stable")
    for lo in range(0, 3000, 500):
        part = order[lo : lo + 500]
        bucket = topk.Bucket(rows[part], part, lo)
        bucket.search(best)
        checked += bucket.verified
    scores = queries @ rows.T
    want = np.array([np.lexsort((np.arange(3000), -s))[:5] for s in scores])
    assert np.array_equal(best.held[3].reshape(-1, 5), want) and np.array_equal(best.held[2].reshape(-1, 5), np.take_along_axis(scores, want, 1))
    print(f"verified {checked / scores.size:.2f} of all products at spread {spread}")
    assert checked < (0.5 if spread < 1 else 0.9) * scores.size


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(name, spark, sf_dir, duck):
    same(queries.QUERIES[name](spark, sf_dir).toPandas(), duck.sql(queries.ORACLE_SQL[name]).df())


CONTRACT = {
    "op1": "doc_id bigint, held_out boolean, score double, predicted int", "op2": "doc_id bigint, held_out boolean, lang_pred string, score double", "op3": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op4": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean", "op5": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op6": "page_id bigint, url string, text string, n_chars bigint", "op7": "query_id bigint, rank int, vec_id bigint, score bigint", "op8": "doc_id bigint, n_lines bigint, n_removed bigint, kept_sha256 string",
    "op9": "doc_id bigint, fingerprint string, component_id bigint", "op10": "doc_id bigint, item_id bigint, distance int",
    "op11": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string", "op12": "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string",
    "op13": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_of_queries(name, spark, sf_dir):
    found = queries.QUERIES[name](spark, sf_dir)
    kinds, rows = dict(found.dtypes), found.count()
    for column in CONTRACT[name.split("_")[0]].split(", "):
        column, kind = column.split()
        assert kinds[column] == kind, (column, kinds)
    docs, pages = (spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "pages"))
    if name.split("_")[0] in ("op1", "op2", "op3", "op4", "op8", "op9", "op11", "op12"):
        assert rows == docs
    assert name != "op6_main_text" or rows == pages
    assert rows > 0


def test_main_text(spark):
    page = lambda k, extra="": f"""<html><head><title>T</title><style>p{{}}</style></head><body><header><h1>Site</h1></header><nav><ul><li>menu</li></ul></nav><div class="ad">buy</div>
        <div class="box"><div class="post"><h2>Title {k}</h2><p>First <b>para</b>&amp;graph {k}.<br>next</p><p>Second {k} {'text ' * k}</p><p class="foot">Share this story</p>{extra}</div></div>
        <div id="comments"><p>reader says {k}</p></div><script>var x = "<p>no</p>";</script><footer>&copy; site {k}</footer></body>"""  # noqa: E731
    rows = [(k, f"https://a.example/{k}", page(k, "<ul><li>one<li>two</ul>" if k % 2 else "")) for k in range(1, 9)] + [(20, None, None), (21, "nonsense", ""), (22, "https://b.example/", "<p>alone <p>two"), (1, "https://a.example/1", page(1, "<ul><li>one<li>two</ul>"))]
    got = [(r.page_id, r.text, r.n_chars) for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()]
    texts = {i: t for i, t, _ in got}
    assert len(got) == len(rows) and all(n == len(t) for _, t, n in got)
    assert texts[3] == "Title 3\nFirst para&graph 3. next\nSecond 3 text text text\none\ntwo"
    assert texts[20] == "" and texts[21] == "" and texts[22] == "alone\ntwo"
    assert html.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_long_notices_go_and_classes_of_the_page_do_not_hide_it(spark):
    notice = "We keep records of visits as the law demands. " * 6
    page = lambda k: f'<html class="no-sidebar"><body class="has-sidebar"><main class="menu-open"><article class="post has-comments"><p>Story {k} {"told " * (200 + k)}</p><p class="legal">{notice}</p><article class="comment"><p>reader {k}</p></article></article></main></body></html>'
    rows = [(k, f"https://c.example/{k}", page(k)) for k in range(8)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {k} {'told ' * (200 + k)}".strip() for k in range(8)}, got


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body><form id="aspnetForm"><div><p>One long text of the page.</p><p>Two</p></div></form></body>', "One long text of the page.\nTwo"),
        ('<body><nav>menu</nav><article class="search-article"><p>Found it</p><p>here</p></article></body>', "Found it\nhere"),
        ('<body><article><p>Start</p><section class="comment-on-the-law"><p>On the law</p></section></article></body>', "Start\nOn the law"),
        ('<body><p title="a > b">Hello</p><p>World</p></body>', "Hello\nWorld"),
        ('<body><p>An <span class="ad-hoc">improvised</span> talk, <a class="share" href="x">shared</a> by all</p></body>', "An improvised talk, shared by all"),
        ("<body><p>Some<![CDATA[ <b>x</b> > y ]]> text</p></body>", "Some text"),
        ("<body>" + "<div>" * 3000 + "deep<p>deeper" + "</div>" * 3000 + "</body>", "deep\ndeeper"),
        ("<body><p>kept<noscript>no end <p>more</body>", "kept\nno end\nmore".replace("kept\nno end", "keptno end")),
        ("<body><div class=comments><p>reader</p></div><div><p>The text of the page is long enough</p><p>and has parts</p></div></body>", "The text of the page is long enough\nand has parts"),
        ('<p a="unclosed>x</p><p>y</p>', "x\ny"),
        ("a < b and c<d>e", "a < b and c\ne"),
    ],
)
def test_odd_pages(page, text):
    assert html.main_text(page, None) == text


def test_the_wrapper_tells_template_from_content(spark):
    # no tag or class hints: only the host's other pages tell the menu, the notice and the footer from the text
    page = lambda k: f'<html><body><div class="a1"><ul>{"".join(f"<li><a href=x{j}>{w}</a></li>" for j, w in enumerate(WORDS[k : k + 6]))}</ul></div><div class="b2"><h2>Title {k}</h2><p>Told {k} {"times " * (40 + k)}</p><p class="c3">This page is kept for you.</p><p>End {k}</p></div><div class="d4"><p>Made by us.</p></div></body></html>'
    rows = [(k, f"https://t.example/{k}", page(k)) for k in range(9)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Title {k}\nTold {k} {'times ' * (40 + k)}".strip() + f"\nEnd {k}" for k in range(9)}
    assert "This page is kept for you." in html.main_text(page(1), None)  # one page alone cannot tell


def unhinted(r, host):
    """Eight pages of a host whose names tell nothing: menu, notice and footer among the text, in an order of the host's own."""
    a, b, c, d = (f"{x}{host}" for x in "abcd")
    menu = "".join(f"<li><a href=x{j}>{r.choice(WORDS)} {j}</a></li>" for j in range(5))
    parts = [f'<div class="{a}"><ul>{menu}</ul></div>', f'<div class="{c}"><p>All rights of house {host} are kept.</p></div>', "{}"]
    r.shuffle(parts)
    pages, texts = [], []
    for k in range(8):
        lines_ = [" ".join(r.choice(WORDS) for _ in range(r.randrange(12, 60))) for _ in range(r.randrange(2, 6))]
        if r.random() < 0.5:
            lines_.insert(1, f"Extra {k}")
        notice = f'<div class="{d}">House {host} asks you to write.</div>'
        body = f'<div class="{b}"><h2>Title {host} {k}</h2>{"".join(f"<p>{x}</p>" for x in lines_)}{notice}</div>'
        pages.append("<html><body>" + "".join(parts).format(body) + "</body></html>")
        texts.append("\n".join([f"Title {host} {k}", *lines_]))
    return pages, texts


def test_wrappers_do_not_depend_on_order_or_partitions(spark, capsys):
    r = random.Random(6)
    hosts = [unhinted(r, h) for h in range(60)]
    rows = [(h * 8 + k, f"https://h{h}.example/{k}", p) for h, (pages, _) in enumerate(hosts) for k, p in enumerate(pages)]
    want = {h * 8 + k: t for h, (_, texts_) in enumerate(hosts) for k, t in enumerate(texts_)}
    for parts in (1, 3, 7):
        r.shuffle(rows)
        table = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(parts)
        assert {x.page_id: x.text for x in html.extract(table).collect()} == want
    changed = sum(html.main_text(p, None) != want[i] for i, _, p in rows)
    with capsys.disabled():
        print(f"\n  {changed} of {len(rows)} pages of unhinted hosts have another text without their wrapper")
    assert changed == len(rows)


def test_alignment_equals_counting(spark):
    """Brute force: what an aligned expression says of each place is counted page by page."""
    r = random.Random(2)

    def some(depth):
        out = ""
        for _ in range(r.randrange(4)):
            out += r.choice(["one ", "two ", "<br>"]) if depth > 2 or r.random() < 0.4 else f"<{(t := r.choice(['div', 'section', 'p']))} class={r.choice('xy')}>{some(depth + 1)}</{t}>"
        return out

    for _ in range(60):
        pages = [html.expression(html.parse(some(0)), n) for n in range(4)]
        orders = [list(range(4)), [3, 1, 0, 2]]
        made = []
        for order in orders:
            held = {}
            for n in order:
                held = html.align(held, json.loads(json.dumps(pages[n])))
            made.append(held)
        left, right = (html.align({}, json.loads(json.dumps(pages[n]))) for n in (0, 2))
        html.align(left, json.loads(json.dumps(pages[1])))
        html.align(right, json.loads(json.dumps(pages[3])))
        made.append(html.align(left, right))
        assert made[0] == made[1] == made[2]

        def check(aligned, own):
            assert set(aligned) == {k for p in own for k in p}
            for k, (seen, repeated, chars, linked, content) in aligned.items():
                there = [p[k] for p in own if k in p]
                assert (seen, repeated, chars, linked) == (len(there), any(x[1] for x in there), sum(x[2] for x in there), sum(x[3] for x in there))
                if k[0] != "#":
                    check(content, [x[4] for x in there])
                elif len({x[4][0] for x in there}) == 1 and there[0][4][0] is not None:
                    assert content == [there[0][4][0], sorted({n for x in there for n in x[4][1]})[: html.SEEN]]
                else:
                    assert content == [None, []]

        check(made[0], pages)


def test_wrapper_as_text():
    pages = ["<div><h1>A</h1><p>x</p><p>y</p><b>same</b></div>", "<div><h1>B</h1><p>x</p><b>same</b></div><section>s</section>"]
    held = {}
    for n, p in enumerate(pages):
        html.align(held, html.expression(html.parse(p), n))
    assert html.regular(held) == "div('same' h1(...) p(...)+) section('s')?"


def test_copies_of_a_page_are_no_template(spark):
    text = "<body><div class=q><p>One long text that stands on four pages of the host alike.</p></div></body>"
    rows = [(k, f"https://m.example/{k}", text) for k in range(4)]
    assert {x.text for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()} == {"One long text that stands on four pages of the host alike."}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<body><article><p>Life</p><section class="social-history"><p>Of the town</p></section><div class="share-price"><p>It rose.</p></div></article></body>', "Life\nOf the town\nIt rose."),
        ('<body><main><p>Start</p><div class="search-theory"><p>of search</p></div></main></body>', "Start\nof search"),
        ("<body><p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi><msup><mi>c</mi><mn>2</mn></msup><annotation>E=mc^2</annotation></math> holds</p></body>", "Energy E=mc2 holds"),
        ('<body><article class="a"><p>The first of the two long articles</p></article><article class="b"><p>The second one of two articles</p></article><aside>no</aside></body>', "The first of the two long articles\nThe second one of two articles"),
        ('<body><article><p>Text</p><div class="social-share">Tell all</div><div class="post-comments">reader</div></article></body>', "Text"),
    ],
)
def test_names_that_hint_in_part(page, text):
    assert html.main_text(page, None) == text


def test_a_name_that_hints_in_part_counts_where_the_wrapper_agrees(spark):
    page = lambda k: f'<html><body><article><p>Story {k} {"told " * (30 + k)}</p><div class="share-prices"><a href=1>Tell</a> <a href=2>all</a></div><div class="search-theory"><p>Theory {k} of search</p></div></article></body></html>'
    rows = [(k, f"https://w.example/{k}", page(k)) for k in range(4)]
    got = {x.page_id: x.text for x in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"Story {k} {'told ' * (30 + k)}".strip() + f"\nTheory {k} of search" for k in range(4)}


@pytest.mark.parametrize("piece", ["<a b", "<noscript>", '<a b="x>"', "<", "</p", "<!--", "<![CDATA[", "<div>", "<p a='", "< a", '<a href="x">', "<a b=\"", "<!a", "<svg>", "<div class='a b'>"])
def test_a_million_characters_of_bad_markup_take_linear_time(piece):
    import time

    start = time.time()
    html.main_text(piece * (1_000_000 // len(piece)), None)
    assert time.time() - start < 10  # 1.4 s at most on a free core


def labelled(spark, n=160):
    r = random.Random(9)
    syllables = {"xx": ["ka", "ro", "mi", "tu"], "yy": ["sch", "ein", "ung", "der"], "zz": ["ça", "lé", "ou", "eau"]}
    rows = []
    for i in range(n):
        lang = list(syllables)[i % 3]
        words = ["".join(r.choice(syllables[lang]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(20, 90))]
        if i % 4 == 0:
            for _ in range(3):
                words.insert(r.randrange(len(words)), "vil" + r.choice(["ain", "est", "ish"]))
        rows.append((i, " ".join(words), lang, int(i % 4 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int")


def test_language_id(spark, docs, none):
    table = labelled(spark)
    model = langid.train(table.where("doc_id % 5 != 0"))
    found = langid.identify(table.where("doc_id % 5 = 0"), model)
    assert found.where("lang_pred = lang").count() >= 0.9 * found.count()
    odd = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(docs, model).collect()}
    assert odd[0] == odd[1] == odd[2] == ("und", 0.0) and all(0 <= s <= 1 for _, s in odd.values())
    assert langid.identify(none, model).count() == 0
    nothing = langid.train(table.where("false"))
    assert {r.lang_pred for r in langid.identify(table, nothing).collect()} == {"und"}
    one = langid.train(table.where("lang = 'xx'"))
    assert {r.lang_pred for r in langid.identify(table, one).collect()} == {"xx"}


def test_language_id_of_marks_and_many_languages(spark):
    rows = [(i, " ".join(chr(0x4E00 + 40 * (i % 70) + (i * k) % 37) * 2 for k in range(1, 30)), f"l{i % 70}", "mine") for i in range(70 * 12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, _language string")
    model = langid.train(table.where("doc_id div 70 != 3"))
    assert len(model.languages) == 70 and np.abs(model.code).min() == 1
    found = langid.identify(table, model)
    assert found.where("lang_pred = lang and _language = 'mine'").count() >= 0.9 * len(rows)
    again = langid.train(table.where("doc_id div 70 != 3").repartition(7))
    assert np.array_equal(model.weights, again.weights)
    odd = spark.createDataFrame([(1, "½ ①"), (2, "²3 _ Ⅷ"), (3, "ß")], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred == "und" for r in langid.identify(odd, model).collect()} == {1: True, 2: True, 3: False}


def test_codewords_are_far_apart():
    code = langid.codewords(4)
    assert min((code[a] != code[b]).sum() for a in range(4) for b in range(a)) >= 7


def test_toxicity(spark, docs, none):
    table = labelled(spark)
    net = toxicity.train(table, table.select("doc_id", "toxic").where("doc_id % 5 != 0"))
    found = toxicity.toxicity(table.where("doc_id % 5 = 0"), net).join(table.select("doc_id", "toxic"), "doc_id")
    assert found.where("predicted = toxic").count() >= 0.9 * found.count()
    odd = {r.doc_id: r.score for r in toxicity.toxicity(docs, net).collect()}
    assert odd[0] == odd[1] == odd[2] == toxicity.EMPTY_SCORE and all(0 <= s <= 1 for s in odd.values())
    assert toxicity.toxicity(none, net).count() == 0
    assert toxicity.toxicity(docs, toxicity.fit([], [])).where("predicted = 0").count() == docs.count()


def test_long_texts_are_learnt_in_parts(monkeypatch):
    r = random.Random(3)
    texts = [[("bad" if k % 2 and j == 150 else r.choice(WORDS)).encode() for j in range(200)] for k in range(12)]
    whole = toxicity.fit(texts, [k % 2 for k in range(12)], epochs=1)
    monkeypatch.setattr(toxicity, "WINDOWS_AT_ONCE", 5)
    parts = toxicity.fit(texts, [k % 2 for k in range(12)], epochs=1)
    scores = [toxicity.Scorer(net).score([" ".join(map(bytes.decode, t)) for t in texts]) for net in (whole, parts)]
    assert np.allclose(*scores, atol=0.05) and all((s >= 0.5) == bool(k % 2) for k, s in enumerate(scores[0]))


def test_gradient_of_the_network():
    net = toxicity.Network()
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    ids, grams, counts = toxicity.word_inputs([b"foo", b"barbaz", b"q"])
    idx, weight = np.array([[1, 2, 3, 0], [2, 2, 1, 3]]), np.array([1.0, -2.0])
    value = lambda: float((net.logits(net.gates(net.vectors(ids, grams, counts).astype(float)), idx) * weight).sum())
    tape = {}
    net.logits(net.gates(net.vectors(ids, grams, counts)), idx, tape)
    grad, _ = net.gradient(tape, weight, 4)
    for k in ("state_f", "state_b", "attend", "query", "out"):
        flat = net.p[k].reshape(-1)
        at, old = len(flat) // 2, flat[len(flat) // 2]
        flat[at] = old + 1e-3
        high = value()
        flat[at] = old - 1e-3
        low = value()
        flat[at] = old
        assert math.isclose((high - low) / 2e-3, grad[k].reshape(-1)[at], rel_tol=0.05, abs_tol=1e-5)


def test_windows_cover_all_words():
    for n in range(1, 200):
        starts = toxicity.windows_of(n)
        assert starts[0] == 0 and starts[-1] + toxicity.LENGTH >= n and all(b - a == toxicity.STRIDE for a, b in zip(starts, starts[1:], strict=False))


def test_toxicity_reads_long_runs_to_their_end():
    words = toxicity.words_of
    assert words("don't a_b") == [b"dont", b"ab"] and words(",".join(["word"] * 20)) == [b"word"] * 20
    r = random.Random(1)
    for letters in ("abcdefgh", "漢字毒物文é"):
        for n in (13, 14, 40, 41, 64, 65, 500):
            run = "".join(r.choice(letters) for _ in range(n))
            pieces = [w.decode() for w in words(run)]
            assert all(len(w.encode()) <= toxicity.WORD_BYTES for w in pieces)
            assert all(any(run[k : k + 4] in w for w in pieces) for k in range(n - 3))
    scorer = toxicity.Scorer(toxicity.Network())
    for run in ("漢" * 60, "x" * 200, "some,words_" * 20):
        plain, ended = scorer.score([run, run + "毒物"])
        assert plain != ended


def test_tokenizer_files_are_not_copied():
    assert public_tokenizers.path("word_bpe_49k.json").startswith("/")
