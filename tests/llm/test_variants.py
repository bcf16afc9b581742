"""Operators 11 to 13: byte pairs, periodic runs, spelling variants."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest

from conftest import same

from gridstride.llm import bytepairs, queries, runs, spelling, substring

RANKS = queries.tokenizer_file("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "\n\n  x", "it's  we'll\t\n 12ab <|endoftext|>", "a" * 30000, "日本語 текст é́ 🙂🙂", "word " * 9000, " " * 50000 + "end", "x " + "\n" * 45000, "same text", "same text"]


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture(scope="module")
def library():
    return bytepairs.Codec(RANKS, public_tokenizers.PATTERN)


def test_byte_pairs(spark, library):
    rows = [(i, t, "i", b"d", [1]) for i, t in enumerate(TEXTS)] + [(None, "id is null", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string, decoded binary, IDS array<int>")
    done = bytepairs.decode(bytepairs.encode(docs, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert done.columns == ["doc_id", "row", "ids", "decoded"]
    got = {r["doc_id"]: r for r in done.collect()}
    assert len(got) == len(rows)
    for i, t, row, *_ in rows:
        assert (got[i]["ids"], bytes(got[i]["decoded"]), got[i]["row"]) == (library.whole.encode_ordinary(t or ""), (t or "").encode(), row)
    assert bytepairs.encode(docs.where("false"), RANKS, public_tokenizers.PATTERN).count() == 0


def test_cuts_change_no_token(library):
    r = random.Random(3)
    parts = ["a", "B", "'s", "'", "1", "12", " ", "  ", "\n", "\t", " ", " ", "é", "日", "🙂", ".", "--", "\x1c", "​", "word", "\U0001e4d0"]
    for _ in range(4000):
        text = "".join(r.choice(parts) * r.choice([1, 1, 1, 2, 7]) for _ in range(r.randrange(40)))
        for block in (1, 2, 5, 16):
            assert library.encode(text, block).tolist() == library.whole.encode_ordinary(text), (text, block)


def test_runs_of_white_space_that_stop_the_library(library):
    text = "start" + " " * 1_500_000 + "end " + "\n" * 1_200_000
    with pytest.raises(BaseException, match="StackOverflow"):
        library.whole.encode_ordinary(text)
    assert library.decode(library.encode(text).tolist()) == text.encode()
    # the run but its last space is one match, as it is where the library can still look ahead
    short = "start" + " " * 60_000 + "end " + "\n" * 50_000
    assert library.encode(short).tolist() == library.whole.encode_ordinary(short)


def test_part_of_a_character_decodes_to_its_bytes(spark, library):
    ids = library.whole.encode_ordinary("🙂")
    assert len(ids) > 1
    tokens = spark.createDataFrame([(1, ids[:1]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r["doc_id"]: bytes(r["decoded"]) for r in bytepairs.decode(tokens, RANKS, public_tokenizers.PATTERN).collect()}
    assert got == {1: "🙂".encode()[: len(got[1])], 2: b"", 3: b""} and 0 < len(got[1]) < 4


def test_byte_pair_query(spark, sf_dir, library):
    got = {r["doc_id"]: r for r in queries.op11_bytepairs(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        ids, row = library.whole.encode_ordinary(r["text"] or ""), got[r["doc_id"]]
        assert (row["n_tokens"], row["ids_sha256"], row["decoded_sha256"]) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((r["text"] or "").encode()))


def plain_runs(words):
    """Every lag, every stretch: (start, length, smallest period)."""
    n, out = len(words), {}
    for p in range(1, n // 2 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(12, 2 * p):
                out.setdefault((i, j - i + p), p)
            i = j + 1
    return sorted((i, size, p) for (i, size), p in out.items())


def test_runs_equal_brute_force():
    r = random.Random(1)
    for _ in range(1500):
        words = [r.randrange(r.choice([1, 2, 3, 5, 30])) for _ in range(r.randrange(110))]
        for _ in range(r.randrange(4)):
            if len(words) > 20:
                a, p = r.randrange(len(words)), r.randrange(1, len(words) // 3)
                for i in range(a, min(len(words), a + r.randrange(12, 70))):
                    words[i] = words[a + (i - a) % p]
        codes = np.array(words, np.int64)
        assert runs.runs_of(codes, runs.gram_hashes(codes)) == plain_runs(words), words


def test_long_sequences_take_little_time():
    for codes, most in ((np.zeros(300_000, int), 1), (np.arange(300_000) % 777, 1), (np.random.default_rng(1).integers(0, 2, 30_000), 3000)):
        assert len(runs.runs_of(codes, runs.gram_hashes(codes))) <= most


def test_periodic_runs(spark, monkeypatch):
    monkeypatch.setattr(runs, "HELD", 40)
    words = [None, [], ["a"] * 11, ["a"] * 12, ["x", *"ab" * 8, "y"], ["a", None] * 9, [*"abcdefg" * 2, *"hh" * 8], *[["a"] * 12] * 2]
    docs = spark.createDataFrame([(i, w, "k", "r") for i, w in enumerate(words)], "doc_id long, words array<string>, kept string, row string")
    got = sorted(runs.periodic_runs(docs).collect())
    assert runs.periodic_runs(docs.where("false")).count() == 0
    for (i, row, found, kept), w in zip(got, words, strict=True):
        want = plain_runs(w or [])
        gone = {j for a, size, p in want for j in range(a + p, a + size)}
        assert (row, [tuple(r) for r in found], kept) == ("r", want, [x for j, x in enumerate(w or []) if j not in gone])


def plain_op12(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = plain_runs(words)
    gone = {j for a, size, p in found for j in range(a + p, a + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    report = "".join(f"{a},{size},{p}\n" for a, size, p in found)
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], sha(report.encode()), sha(" ".join(w for i, w in enumerate(words) if i not in gone).encode()))


def test_run_query(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice("uvwxyz") for _ in range(r.randrange(150)))) for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "\t \x1c a　b \r\n" * 20), (1003, "same " * 400)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(tuple(x) for x in queries.op12_periodic_runs(spark, str(tmp_path)).collect())
    assert got == [plain_op12(*x) for x in rows]
    assert sum(x[1] > 0 for x in got) > 15


def edit(a, b):
    """Whether one insertion, deletion or replacement of a code point makes one of the other."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


@pytest.mark.parametrize("letters", ["ab", "aé", "abcdefgh"])
def test_near_words_equal_brute_force(spark, letters):
    r = random.Random(8)
    words = {"".join(r.choice(letters) for _ in range(r.randrange(6, 10))) for _ in range(150)}
    for w in sorted(words)[:60]:
        i = r.randrange(len(w))
        words |= {w[:i] + r.choice(letters) + w[i:], w[:i] + r.choice(letters) + w[i + 1 :]}
    got = sorted(tuple(x) for x in spelling.near_pairs(spark.createDataFrame([(w,) for w in words], "word string")).collect())
    assert got == sorted((a, b) for a in words for b in words if edit(a, b))


def test_variants(spark):
    rows = [("colour", 1000), ("colur", 9), ("colours", 100), ("coloors", 20), ("colourz", 1), ("ties12", 5), ("ties13", 25), ("ties14", 25), (None, 7)]
    got = {r["word"]: tuple(r)[1:] for r in spelling.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {
        "colour": (None, "colour", 1000, 3, None), "colur": ("colour", "colour", 9, 1, 1000), "colours": ("colour", "colour", 100, 3, 1000), "coloors": ("colours", "colour", 20, 1, 100),
        "colourz": ("colour", "colour", 1, 2, 1000), "ties12": ("ties13", "ties13", 5, 2, 25), "ties13": (None, "ties13", 25, 2, None), "ties14": (None, "ties14", 25, 2, None),
    }
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).count() == 0


def test_long_chains_of_forms(spark):
    chain = [("abcdef" + "xyz"[k % 3] * k, 5**k) for k in range(12)]
    words = spark.createDataFrame([("q" * 8 + "r" * k, 5**k) for k in range(20)] + chain, "word string, n long")
    got = {r["word"]: r["root"] for r in spelling.variants(words).collect()}
    assert all(got["q" * 8 + "r" * k] == "q" * 8 + "r" * 19 for k in range(20))


def test_word_counts(spark):
    words = ["letter"] * 5 + ["letters"] * 4 + ["éèéèéè"] * 6 + ["short"] * 9 + [None] * 7
    assert sorted(map(tuple, spelling.word_counts(spark.createDataFrame([(w,) for w in words], "word string")).collect())) == [("letter", 5), ("éèéèéè", 6)]


def test_altered_runs(spark):
    rows = [(i, "Wörter ÀÉ×ßreihe letters-lettersX a1bcdefg") for i in range(400)] + [(None, "Letters"), (7, None), (8, "")]
    got = sorted(r["word"] for r in queries.altered_runs(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = []
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want += [run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] if len(run) >= 6 else []
    assert got == sorted(want) and len(set(got)) > 5


def test_spelling_query_equals_sql(spark, sf_dir, duck):
    same(queries.op13_spelling_variants(spark, sf_dir).toPandas(), duck.sql(queries.ORACLE_SQL["op13_spelling_variants"]).df())


def thue_morse(n, swap):
    return "".join("ab"[bin(i).count("1") % 2 ^ swap] for i in range(n))


def test_words_that_collide_modulo_two_to_the_64_are_told_apart(spark):
    """Polynomials modulo 2**64 take complementary Thue-Morse words of 1,024 letters for one word, whatever the base."""
    tail = " ".join(f"w{i}" for i in range(34))
    words = " ".join("xy"[bin(i).count("1") % 2] for i in range(64)), " ".join("yx"[bin(i).count("1") % 2] for i in range(64))
    rows = [(0, f"{thue_morse(1024, 0)} {tail}"), (1, f"{thue_morse(1024, 1)} {tail}"), (2, f"{words[0]} p"), (3, f"{words[1]} q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["n_removed"] for r in substring.repeated_passages(docs, 35).collect()}
    assert got[0] == got[1] == 0


@pytest.mark.parametrize("window", [1, 2, 3, 5, 35, 36, 64])
@pytest.mark.parametrize("step", [7, 1 << 15])
def test_polynomials(window, step, monkeypatch):
    monkeypatch.setattr(substring, "STEP", step)
    r, prime = random.Random(1), (1 << 61) - 1
    for modulus, base, by in ((prime, substring.BASES[0], substring.times), (1 << 64, substring.BASES[1], np.multiply)):
        values = [r.randrange(modulus) for _ in range(120)] + [0, 1, modulus - 1]
        for some in (values, values[:window], values[: window - 1]):
            got = substring.polynomials(np.array(some, np.uint64), window, base, by, modulus == prime)
            assert got.tolist() == [sum(v * pow(base, window - 1 - j, modulus) for j, v in enumerate(some[i : i + window])) % modulus for i in range(len(some) - window + 1)]


def test_a_collision_of_the_first_count_removes_nothing(spark, monkeypatch):
    monkeypatch.setattr(substring.Part, "first", lambda part: [np.full(b - a, 7, np.uint64) for a, b in part._spans()])
    shared = " ".join(f"s{i}" for i in range(8))
    rows = [(0, " ".join(f"a{i}" for i in range(30))), (1, " ".join(f"b{i}" for i in range(30))), (2, f"{shared} left"), (3, f"right {shared}")]
    got = sorted(tuple(r) for r in substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), 8, with_text=False, parts=3).select("doc_id", "n_removed").collect())
    assert got == [(0, 0), (1, 0), (2, 8), (3, 8)]


def test_parts_follow_the_bytes_of_the_texts(spark, monkeypatch, capsys):
    sizes = []
    monkeypatch.setattr(substring, "PART_BYTES", 20_000)
    docs = spark.createDataFrame([(i, f"{i} " * 700) for i in range(200)], "doc_id long, text string")
    size = sum(len(f"{i} " * 700) for i in range(200))
    parts = -(-size // substring.PART_BYTES)
    held = docs.selectExpr(f"pmod(xxhash64(doc_id, text), {parts}) as part", "octet_length(text) as n").groupBy("part").sum("n").collect()
    sizes = [r[1] for r in held]
    with capsys.disabled():
        print(f"\n  {parts} parts of {substring.PART_BYTES} bytes: the largest holds {max(sizes)}")
    assert max(sizes) < 4 * substring.PART_BYTES
    assert substring.repeated_passages(docs, 35).count() == 200
