"""Line dedup does less work than it did: few passes over texts, sets as numbers, joins of lines by Arrow, all against plain loops."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridstride.llm import lines
from gridstride.llm.components import HUB, components


def test_texts_are_read_four_times(spark):
    """For band keys, for sketches, for places together with texts of families, and for the result."""
    r = random.Random(3)
    rows = [(k, "\n".join("".join(r.choice("abcdefgh ") for _ in range(60)) for _ in range(3)) + f"\nthe same line with one number {k % 10} in it, as others have it too") for k in range(40)]
    docs, read = spark.createDataFrame(rows, "doc_id long, text string").repartition(2).localCheckpoint(), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def text(x):
        read.add(1)
        return x

    got = lines.deduplicate(docs.withColumn("text", text("text")))
    assert sum(x.n_removed for x in got.collect()) > 30
    assert read.value == 4 * len(rows)


def test_sets_as_numbers(monkeypatch):
    """Shingles as numbers have the sizes and intersections of sets of strings, and give the same links."""
    r = random.Random(5)
    base = "".join(r.choice("abcdef é漢\U0001f600") for _ in range(400))
    some = ["", "a", "abcd", "abcde", "é" * 9, "漢字漢字漢字", base, base[:200] + "x" + base[200:]] + [base[: r.randrange(300, 400)] for _ in range(20)]
    codes, sets = lines._codes(some), [lines._sets(x) for x in some]
    assert [len(c) for c in codes] == [len(x) for x in sets]
    assert all(lines._common(codes[i], codes[j]) == len(sets[i] & sets[j]) for i in range(len(some)) for j in range(i))
    asked = np.arange(len(some))
    assert (lines.intersections(codes, asked) == lines.intersections(sets, asked)).all()
    assert lines._codes(["".join(map(chr, range(0x4E00, 0x4E00 + 5000)))]) is None  # too many characters: sets of strings
    found = [lines.links_within(some[:n]) for n in (0, 1, 2, 7, len(some))]
    monkeypatch.setattr(lines, "_codes", lambda lines_: None)
    assert found == [lines.links_within(some[:n]) for n in (0, 1, 2, 7, len(some))]


def test_small_keys_at_once():
    """The keys of few lines get the components that one by one they get."""
    r = np.random.default_rng(9)
    sizes = r.integers(2, lines.SMALL + 1, 200)
    starts = np.cumsum(sizes) - sizes
    own = r.integers(0, 256, (int(sizes.sum()), lines.WIDTH), dtype=np.uint8)
    for lo, n in zip(starts.tolist(), sizes.tolist(), strict=True):  # near copies of rows before, chains too
        for i in range(1, n):
            if r.random() < 0.6:
                own[lo + i] = own[lo + r.integers(0, i)]
                own[lo + i, r.integers(0, lines.WIDTH, 25)] = r.integers(0, 256, 25)
    want = np.arange(len(own))
    for lo, n in zip(starts.tolist(), sizes.tolist(), strict=True):
        parent = np.arange(n)
        for i, j in lines.joined(own[lo : lo + n]):
            a, b = lines.find(parent, i), lines.find(parent, j)
            parent[max(a, b)] = min(a, b)
        want[lo : lo + n] = lo + np.array([lines.find(parent, i) for i in range(n)])
    got = np.arange(len(own))
    row, least = lines.joined_small(own, starts, sizes).T
    got[row] = least
    assert (got == want).all() and 0 < len(row) < len(own)
    assert lines.joined_small(own, starts[:0], sizes[:0]).shape == (0, 2)


def test_signatures_against_plain_loops():
    """Least hashes of each kind; an empty bin has the next filled one's, around the end too."""
    r = random.Random(6)
    some = ["".join(r.choice("abcdefghij ") for _ in range(r.choice([3, 8, 60, 130, 150, 300]))) for _ in range(60)] + ["ab" * 400]
    h, counts = lines._hashes(some)
    ends = np.cumsum(counts)
    (short, few), (long, many) = lines.signatures(some)
    assert len(short) and len(long) and set(short) | set(long) == set(range(len(some)))
    for i, row in zip(short.tolist(), few, strict=True):
        low = (h[ends[i] - counts[i] : ends[i]] >> np.uint32(16)).astype(np.uint16)
        assert row.tolist() == [int((low * a + b).min()) for a, b in zip(lines._TIMES, lines._PLUS, strict=True)]
    for i, row in zip(long.tolist(), many, strict=True):
        bins: dict[int, int] = {}
        for x in h[ends[i] - counts[i] : ends[i]].tolist():
            at, value = (x >> 16) * lines.WIDTH >> 16, x * 0x27D4EB2F & 0xFFFFFFFF
            bins[at] = min(bins.get(at, value), value)
        assert row.tolist() == [next(bins[(k + d) % lines.WIDTH] for d in range(lines.WIDTH) if (k + d) % lines.WIDTH in bins) for k in range(lines.WIDTH)]


def test_texts_without_lines(monkeypatch):
    """Nulls, empty texts, slices of arrays and small slices of bytes."""
    r = random.Random(2)
    texts = [None, "", "a", "a\nb", "\n", "\n\n", None, "é\n\x85 q\r\nz", *["\n".join(r.choice(["x", "yy", ""]) for _ in range(r.randrange(1, 9))) for _ in range(200)], None, "end\nx"]
    gone = [None if t is None or r.random() < 0.2 else r.sample(range(t.count("\n") + 1), r.randrange(t.count("\n") + 2)) for t in texts]
    want = [None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in (g or ())) for t, g in zip(texts, gone, strict=True)]
    for size in (1 << 20, 20):
        monkeypatch.setattr(lines, "SLICE", size)
        for a, b in ((0, len(texts)), (3, 150), (0, 1), (0, 0), (6, 7)):
            assert lines.without(pa.array(texts, pa.string()).slice(a, b - a), pa.array(gone, pa.list_(pa.int64())).slice(a, b - a)).to_pylist() == want[a:b]


def test_components_with_and_without_hubs(spark):
    """Nodes of few links, and one of over ``HUB``."""
    chain = [(k, k + 1) for k in range(100, 140)]
    for links in (chain, [*chain, *[(5000, 5001 + k) for k in range(HUB + 10)], (139, 5001)]):
        got = {x.node: x.root for x in components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {n: 100 for link in links for n in link}
