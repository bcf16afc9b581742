"""Packing documents into training sequences by non-negative least squares (operator 5).

1. Each text becomes ids; full windows are cut off, the rest is one shorter piece.
2. A histogram of piece lengths (bounded by the window) goes to the driver. There,
   shallow combinations of up to four lengths that fill a window are enumerated and
   their repeat counts solved by non-negative least squares against the histogram,
   on ever fewer combinations, so that counts are large enough to round. What
   rounding leaves is solved again a few times; the rest is packed greedily, still
   as counts.
3. The resulting table of (length, ranks from..to, sequence) is bounded by the
   window too. Pieces get ranks within their length from per-bucket counts, so a
   common length is never gathered in one task, and look their place up.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstride.llm.bpe import LONGEST, Merges
from gridstride.llm.common import durable, partitions, released, slices

#: Fixed value: the pre-token pattern of the word vocabulary, but for letters, of which runs are pre-tokens.
NO_LETTERS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^\s\p{L}\p{N}]+"
#: Characters but those for which the fast path equals the library: Latin scripts and common marks.
UNUSUAL = r"[^\t\n\r\x20-\x7e\x{a1}-\x{ac}\x{ae}-įĲ-ž‐-‧€]"
MEMO = 150_000
#: Places of nothing and of a text's end in the memo; pre-tokens that are left to the library have none.
NONE, END, LEFT = 0, 1, -1
WINDOW = 2048
#: Least buckets of a length; more with more shuffle partitions.
BUCKETS = 512
#: Times that least squares are solved on what is left.
ROUNDS = 6


class Encoder:
    """Ids of whole texts, with a memo of pre-tokens."""

    def __init__(self, spec: str, merges: Merges, end_id: int):
        self.spec, self.merges, self.end_id, self.library = spec, merges, end_id, None
        self.specials = [t["content"] for t in json.loads(spec)["added_tokens"]]
        self._clear()

    def _clear(self) -> None:
        self.memo: dict[str, int] = {"": NONE}
        self.starts = np.array([0, 0, 1])  # in ids, of the memo's places: of nothing, and of the end
        self.ids = np.array([self.end_id], np.uint32)

    def _learn(self, new: list[str]) -> None:
        if not new:
            return
        ids, sizes = self.merges.encode([p.encode() for p in new])
        self.memo.update(zip(new, range(len(self.starts) - 1, len(self.starts) - 1 + len(new)), strict=True))
        self.starts = np.concatenate((self.starts, self.starts[-1] + np.cumsum(sizes)))
        self.ids = np.concatenate((self.ids, ids))

    def _by_library(self, text: str) -> np.ndarray:
        if self.library is None:  # most tasks never need it
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_str(self.spec)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, without special tokens but each with the end id behind, and where those of each text end. Null counts as empty."""
        texts = pc.fill_null(texts, "")
        other = pc.match_substring_regex(texts, UNUSUAL)
        for s in self.specials:
            other = pc.or_(other, pc.match_substring(texts, s))
        plain = pc.utf8_lower(pc.if_else(other, "", texts))  # in NFC, as all that UNUSUAL lets through
        split = pc.ascii_split_whitespace(pc.replace_substring_regex(plain, NO_LETTERS, r" \0 "))
        counts, found = np.diff(split.offsets.to_numpy()), split.flatten().dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()  # quicker than to_pylist
        if len(self.memo) > MEMO:
            self._clear()
        self._learn([p for p in distinct if p not in self.memo and len(p) <= LONGEST // 4])
        get = self.memo.get
        at = np.array([get(p, LEFT) for p in distinct], np.int64)[found.indices.to_numpy()]
        other = other.to_numpy(zero_copy_only=False)
        if other.any() or (at == LEFT).any():
            owner = np.repeat(np.arange(len(texts)), counts)
            other = other | (np.bincount(owner[at == LEFT], minlength=len(texts)) > 0)
            at[other[owner]] = NONE
        last = np.cumsum(counts + 1) - 1  # each text's end, among its pre-tokens and those before
        places = np.full(len(at) + len(texts), END)
        places[np.delete(np.arange(len(places)), last)] = at
        taken = pa.ListArray.from_arrays(pa.array(self.starts, pa.int32()), pa.array(self.ids)).take(pa.array(places))
        ids, ends = taken.flatten().to_numpy(), taken.offsets.to_numpy()[last + 1].astype(np.int64)
        by_library = np.flatnonzero(other)
        if len(by_library):
            more = np.zeros(len(texts), np.int64)
            rest = [self._by_library(texts[i].as_py()) for i in by_library.tolist()]
            more[by_library] = [len(x) for x in rest]
            ids, ends = np.insert(ids, np.repeat(ends - 1, more), np.concatenate(rest)), ends + np.cumsum(more)
        return ids, ends


def pieces(docs: DataFrame, spec: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: id, start, length, ids_crc32, doc_tokens. Null text counts as empty."""
    shared = docs.sparkSession.sparkContext.broadcast((spec, Merges(spec)))  # a tokenizer's file, and its merges as tables

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(*shared.value, end_id)
        for batch in batches:
            for part in slices(batch, 1):
                ids, ends = encoder.encode(part.column(1))
                ids, sizes = np.ascontiguousarray(ids, "<u4"), np.diff(ends, prepend=0)
                n = -(-sizes // window)
                row = np.repeat(np.arange(len(n)), n)
                start = window * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
                length = np.minimum(window, sizes[row] - start)
                at = (ends - sizes)[row] + start
                sums = [zlib.crc32(ids[a:b]) for a, b in zip(at.tolist(), (at + length).tolist(), strict=True)]
                columns = [pa.array(c, pa.int64()) for c in (start, length, sums, sizes[row])]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *columns], names=["id", "start", "length", "ids_crc32", "doc_tokens"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def combinations(have: np.ndarray, window: int = WINDOW, depth: int = 4) -> np.ndarray:
    """Rows of up to ``depth`` lengths that fill the window, 0 where unused.

    ``have`` are the lengths at hand. All pairs are taken, and deeper ones by
    splitting a pair's shorter part again into every eighth share, so the number
    of rows is bounded by the window and the shares, not by the data.
    """
    there = np.zeros(window + 1, bool)
    there[have] = True
    rows = [[window] + [0] * (depth - 1)] if there[window] else []
    shares = np.arange(1, 8)
    for a in have[have < window][::-1].tolist():
        rest = window - a
        if rest <= a and there[rest]:
            rows.append([a, rest] + [0] * (depth - 2))
        for b in {*(rest * shares // 8).tolist()} if depth > 2 else ():
            c = rest - b
            if 0 < b <= c <= a and there[b]:
                if there[c]:
                    rows.append([a, c, b] + [0] * (depth - 3))
                if depth > 3:
                    for d in {*(c * shares // 8).tolist()}:
                        if 0 < d <= c - d and there[d] and there[c - d]:
                            rows.append([a, c - d, d, b])
    return np.array(rows, np.int64).reshape(-1, depth)


def nnls(combos: np.ndarray, counts: np.ndarray, steps: int = 150) -> np.ndarray:
    """Repeat counts x >= 0 with least squared error of sum(x * combo) against the histogram (accelerated projected gradient)."""
    n, size = len(counts), len(combos)
    at, which = combos.ravel(), np.repeat(np.arange(size), combos.shape[1])
    at, which = at[at > 0], which[at > 0]
    forward = lambda x: np.bincount(at, x[which], n)
    backward = lambda r: np.bincount(which, r[at], size)
    step = 1.0 / max(1.0, float(backward(forward(np.ones(size))).max(initial=1.0)))  # bounds the norm
    x = y = np.zeros(size)
    t = 1.0
    for _ in range(steps):
        to = np.maximum(0.0, y - step * backward(forward(y) - counts))
        nxt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = to, to + (t - 1) / nxt * (to - x), nxt
    return x


def repeats_of(combos: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Whole repeat counts of the combinations: least squares, on the larger half of them again and again until they are as few as the lengths, rounded."""
    out, at = np.zeros(len(combos), np.int64), np.arange(len(combos))
    few = max(8, int((counts > 0).sum()) // 2)
    while len(at):
        x = nnls(combos[at], counts)
        if len(at) <= few:
            out[at] = np.rint(x).astype(np.int64)
            break
        at = at[np.sort(np.argsort(-x, kind="stable")[: max(few, len(at) // 2)])]
    return out


def plan(histogram: dict[int, int], window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, copies, first sequence, offset): copies of one slot, in consecutive sequences.

    Every rank of every length is in exactly one row. The number of rows is
    bounded by the window, whatever the counts.
    """
    left = np.zeros(window + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    used, rows, sequence = np.zeros_like(left), [], 0

    def place(lengths: list[int], copies: int) -> None:
        nonlocal sequence
        offset = 0
        for length in lengths:
            rows.append((length, int(used[length]), copies, sequence, offset))
            used[length] += copies
            left[length] -= copies
            offset += length
        sequence += copies

    for _ in range(ROUNDS):
        combos = combinations(np.flatnonzero(left), window)
        repeats = repeats_of(combos, left.astype(float))
        before = left.sum()
        for k in np.argsort(-repeats, kind="stable"):  # lengths repeat within a combination, so it is applied slot by slot
            lengths = [int(v) for v in combos[k] if v]
            need = {v: lengths.count(v) for v in lengths}
            copies = min([int(repeats[k]), *(int(left[v]) // c for v, c in need.items())])
            if copies > 0:
                place(lengths, copies)
        if left.sum() == before:
            break
    while left.any():  # best fit, longest first, many copies of the same pattern at once
        lengths, room, rest = [], window, left.copy()
        while room and (fit := np.flatnonzero(rest[: room + 1])).size:
            lengths.append(int(fit[-1]))
            rest[fit[-1]] -= 1
            room -= fit[-1]
        need = {v: lengths.count(v) for v in lengths}
        place(lengths, min(int(left[v]) // c for v, c in need.items()))
    return rows


def pack(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """Give each piece (columns of :func:`pieces`) a sequence_id and an offset."""
    spark = found.sparkSession
    bucket = F.pmod(F.xxhash64("id", "start"), F.lit(max(BUCKETS, 4 * partitions(spark))))
    found = durable(found.withColumn("bucket", bucket))  # ids are made once; both uses below read it
    sums = durable(found.groupBy("length", "bucket").count())
    histogram = {r["length"]: r["n"] for r in sums.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most a window of rows
    rows = plan(histogram, window)
    places = spark.createDataFrame(rows, "length long, first long, copies long, sequence long, offset long")
    table = F.broadcast(places.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first", "copies", "sequence", "offset"))).alias("places")))  # bounded by the window
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    within = Window.partitionBy("length", "bucket").orderBy("id", "start", "ids_crc32")
    ranked = found.withColumn("within", F.row_number().over(within) - 1).join(bases, ["length", "bucket"]).withColumn("rank", F.col("within") + F.col("base"))
    return (
        ranked.join(table, "length")
        .withColumn("place", F.expr("filter(places, p -> rank >= p.first and rank < p.first + p.copies)[0]"))
        .select("id", "start", "length", "ids_crc32", "doc_tokens", (F.col("place.sequence") + F.col("rank") - F.col("place.first")).alias("sequence_id"), F.col("place.offset").alias("offset"))
    )


def pack_documents(docs: DataFrame, spec: str, end_id: int = 1, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every row of ``docs``: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null and empty texts hold the end id alone. Repeated rows are packed like
    any others; other columns are not read; an empty table gives no rows.
    """
    return pack(pieces(docs, spec, end_id, window, id_col, text_col), window).withColumnRenamed("id", id_col)
