"""Periodic runs of words by bit-parallel lags (operator 12).

A document's words become numbers, and bit b of all numbers becomes one big integer,
a plane. XOR of a plane with itself shifted by p shows where words p apart differ in
bit b; OR over the planes shows where they differ at all. A run of period p and length
l is a stretch of l - p zeros there, and only stretches of max(p, 12 - p) zeros or more
count: AND of the inverse with itself, shifted by doubling distances, keeps those alone.

Most lags hold no run, and which ones may is known beforehand. A stretch of z equal
pairs at lag p holds a gram of ``GRAM`` words that comes again p words later, and one that
starts at any chosen multiple of z - ``GRAM`` + 1. So lags are taken by doubling ranges,
the grams at such multiples looked up within the range, and only lags with a hit shifted. No lag is
tried beyond the longest row of grams that come again, nor below the least distance of two. Grams are
compared by hash, which can add a lag but lose none. Hits inside a run of a period that divides the
lag are left out: there a run of the lag itself would have the shorter period too.
Documents are independent, so nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST = 12
#: Every run has this many equal pairs in a row, whatever its period.
GRAM = LEAST // 2
#: Words of a batch of results.
HELD = 1_000_000
#: Odd factors of a gram's words, from the golden ratio.
FACTORS = np.array([(0x9E3779B97F4A7C15 * (2 * j + 1)) % (1 << 64) | 1 for j in range(GRAM)], np.uint64)


def pairs_needed(lag: int) -> int:
    """Equal pairs in a row that a run of this period has."""
    return max(lag, LEAST - lag)


def _positions(bits: int, n: int) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(np.frombuffer(bits.to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little"))


def stretches(planes: list[int], n: int, lag: int) -> Iterator[tuple[int, int]]:
    """(first, last) word of each maximal stretch with this lag that is long enough for a run."""
    differ, need, have = 0, pairs_needed(lag), 1
    for plane in planes:
        differ |= plane ^ plane >> lag
    equal = ~differ & (1 << n - lag) - 1
    while have < need and equal:
        step = min(have, need - have)
        equal &= equal >> step
        have += step
    if equal:
        for first, last in zip(_positions(equal & ~(equal << 1), n), _positions(equal & ~(equal >> 1), n), strict=True):
            yield int(first), int(last) + need + lag - 1


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the gram that starts at each place."""
    grams, codes = max(len(codes) - GRAM + 1, 0), codes.astype(np.uint64) + np.uint64(1)
    mixed = np.zeros(grams, np.uint64)
    for j in range(GRAM):
        mixed += codes[j : j + grams] * FACTORS[j]
    return mixed


def lags(hashes: np.ndarray, found: list[tuple[int, int, int]]) -> Iterator[int]:
    """Lags that may hold a run, ascending; ``found`` is read again before each range of lags."""
    grams, n = len(hashes), len(hashes) + GRAM - 1
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    if not same.any():
        return
    # a run's grams but the last period's come again: so many in a row, no nearer than the nearest two
    nearest, again = int((order[1:] - order[:-1])[same].min()), np.sort(order[:-1][same])
    row = int(np.diff(np.flatnonzero(np.concatenate(([True], np.diff(again) != 1, [True])))).max())
    most = min(n // 2, row + GRAM - 1)
    if nearest > most:
        return
    rank = np.concatenate(([0], np.cumsum(~same)))
    keys = rank * (n + 1) + order  # ascending: by gram, then place
    rank_of = np.empty(grams, np.int64)
    rank_of[order] = rank
    low = 1
    while low <= most:
        high = min(2 * low, most + 1)
        if high <= nearest:
            low = 2 * low
            continue
        at = np.arange(0, grams, min(map(pairs_needed, range(low, min(high, LEAST)))) - GRAM + 1 if low < LEAST else low - GRAM + 1)
        base = rank_of[at] * (n + 1)
        start, stop = np.searchsorted(keys, base + np.minimum(at + low, n)), np.searchsorted(keys, base + np.minimum(at + high, n))
        many = stop - start
        at = np.repeat(at, many)
        hit = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start, many)
        lag = order[hit] - at
        known = np.zeros(len(lag), bool)
        for first, last, period in found:
            a, b = np.searchsorted(at, (first, last + 1))
            known[a:b] |= (lag[a:b] % period == 0) & (at[a:b] + lag[a:b] + GRAM <= last + 1)
        yield from np.unique(lag[~known]).tolist()
        low = 2 * low


def runs_of(codes: np.ndarray, hashes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs in a sequence of numbers, by start, then period."""
    n, found, spans, planes = len(codes), [], set(), []
    for lag in lags(hashes, found) if n >= LEAST else ():
        if not planes:
            dense = np.unique(codes, return_inverse=True)[1]
            planes = [int.from_bytes(np.packbits(dense >> b & 1, bitorder="little").tobytes(), "little") for b in range(int(dense.max()).bit_length())]
        for first, last in stretches(planes, n, lag):
            if (first, last) not in spans:  # else its smallest period, a divisor of the lag, was there before
                spans.add((first, last))
                found.append((first, last, lag))
    return sorted((first, last - first + 1, lag) for first, last, lag in found)


def periodic_runs(docs: DataFrame, words_col: str = "words", runs_out: str = "runs", kept_out: str = "kept") -> DataFrame:
    """``docs`` with its words replaced by their runs, array<struct<start, length, period>>, and the words that are kept, array<string>.

    A run is a longest stretch of words with smallest period q and at least max(12, 2 q)
    words; words after the first q of any run are not kept. Null or empty arrays have no runs
    and keep nothing; a null word is a word of its own, equal to other nulls, and is kept as null.
    Repeated rows give repeated results; the other columns pass, but those named as the
    results are replaced; an empty table gives no rows.
    """
    others = [c for c in docs.columns if c.lower() not in (words_col.lower(), runs_out.lower(), kept_out.lower())]
    rows = docs.select(F.col(words_col).alias("words"), F.struct(F.lit(0).alias("_"), *others).alias("row"))
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def some(words: pa.ListArray, row: pa.Array) -> pa.RecordBatch:
        flat = words.flatten()
        ends = np.concatenate(([0], np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))))
        codes = flat.dictionary_encode(null_encoding="encode").indices.to_numpy()
        hashes, keep, all_runs = gram_hashes(codes), np.ones(len(flat), bool), []
        for i in range(len(words)):
            runs = runs_of(codes[ends[i] : ends[i + 1]], hashes[ends[i] : ends[i + 1] - GRAM + 1]) if ends[i + 1] - ends[i] >= LEAST else []
            for start, length, period in runs:
                keep[ends[i] + start + period : ends[i] + start + length] = False
            all_runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs])
        left = np.concatenate(([0], np.cumsum(keep)))[ends].astype(np.int32)
        return pa.RecordBatch.from_arrays([row, pa.array(all_runs, kind), pa.ListArray.from_arrays(pa.array(left), flat.filter(pa.array(keep)))], names=["row", "runs", "kept"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, sizes = 0, np.cumsum(batch.column("words").value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            while at < batch.num_rows:
                held = sizes[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(sizes, held + HELD, "right")))
                yield some(batch.column("words").slice(at, to - at), batch.column("row").slice(at, to - at))
                at = to

    schema = f"row {rows.schema['row'].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, kept array<string>"
    return rows.mapInArrow(run, schema).select(*[F.col("row")[c].alias(c) for c in others], F.col("runs").alias(runs_out), F.col("kept").alias(kept_out))
