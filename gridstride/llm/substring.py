"""Removal of repeated passages by Rabin-Karp window hashes (operator 3).

A word becomes two 64-bit hashes; a window of consecutive words becomes two polynomials of its words'
numbers, one modulo the prime 2**61 - 1 and one modulo 2**64, built by doubling. A part
holds the texts of about ``PART_BYTES``.

A part sends the cheaper polynomial of each of its distinct windows once, sorted and as
differences, to the hash range that counts them; the range answers with one bit
for each: found in another part too. A part thus sends a common passage once, however
often it holds it, and no task sees all of its occurrences. Windows found twice are
then counted again by both polynomials, in the same way, so that a chance
collision of the first, or words made to collide modulo 2**64, remove nothing. Last, parts merge the repeated windows into
maximal intervals and drop the words these cover.

With n windows about n*n / 2**65 of them pass the first count by chance: none in a gigabyte of
text, some ten millions in 100 TB; of those one in 2**64 / n may pass the second.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstride.llm.common import partitions

WINDOW = 35
#: Bytes of text of a part, about; a part takes some 15 times that memory. Fewer, larger ones suit larger executors.
PART_BYTES = 16 << 20
PRIME = np.uint64((1 << 61) - 1)
#: Windows that are hashed at once.
STEP = 1 << 15
#: From the golden ratio and from the square root of two, below the prime.
BASES = (0x9E3779B97F4A7C15 >> 4, 0xB504F333F9DE6485)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _reduced(x: np.ndarray) -> np.ndarray:
    x = (x & PRIME) + (x >> np.uint64(61))
    return np.where(x >= PRIME, x - PRIME, x)


def times(a: np.ndarray, b: np.uint64) -> np.ndarray:
    """a * b modulo the prime, for numbers below it, by halves of 32 bits."""
    half, low = np.uint64(32), np.uint64((1 << 32) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    mid, least = a1 * b0 + a0 * b1, a0 * b0
    # 2**61 is 1: 2**64 is 8, and 2**32 times the upper bits of ``mid`` is those bits
    return _reduced((a1 * b1 << np.uint64(3)) + (mid >> np.uint64(29)) + ((mid & np.uint64((1 << 29) - 1)) << half) + (least & PRIME) + (least >> np.uint64(61)))


def polynomials(values: np.ndarray, window: int, base: int, by: Callable[[np.ndarray, np.uint64], np.ndarray], prime: bool) -> np.ndarray:
    """The polynomial of each ``window`` consecutive values, the first of them of the highest power, modulo the prime or 2**64; by doubling, ``STEP`` at a time."""
    if len(values) > STEP + window:
        return np.concatenate([polynomials(values[lo : lo + STEP + window - 1], window, base, by, prime) for lo in range(0, len(values) - window + 1, STEP)])
    plus = (lambda a, b: _reduced(a + b)) if prime else np.add
    modulus = int(PRIME) if prime else 1 << 64
    done, reach, doubled, length = None, 0, values, 1
    while length <= window:
        power = np.uint64(pow(base, length, modulus))
        if window & length:
            # what is done so far, then the next ``length`` values
            done, reach = (doubled, length) if done is None else (plus(by(done[: max(len(doubled) - reach, 0)], power), doubled[reach:]), reach + length)
        if 2 * length <= window:
            doubled = plus(by(doubled[: max(len(doubled) - length, 0)], power), doubled[length:])
        length *= 2
    return done


class Part:
    """The hashes of the words of some texts, and those of their windows."""

    def __init__(self, texts: list[bytes], window: int):
        self.texts, self.window, sizes, hashes = texts, window, [0], []
        for text in texts:
            words = text.split()
            sizes.append(len(words))
            hashes.append(b"".join(map(xxhash.xxh3_128_digest, words)))
        self.hashes = np.frombuffer(b"".join(hashes), ">u8").reshape(-1, 2)
        self.starts = np.cumsum(sizes)
        # over all texts at once; windows that span two are left out when they are dealt to the texts
        self.low = polynomials(self.hashes[:, 1].astype(np.uint64), window, BASES[1], np.multiply, False)

    def _spans(self) -> list[tuple[int, int]]:
        return [(a, max(a, b - self.window + 1)) for a, b in zip(self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)]

    def first(self) -> list[np.ndarray]:
        """A hash of each window of each text."""
        mixed = _mix(self.low)
        return [mixed[a:b] for a, b in self._spans()]

    def second(self, wanted: list[np.ndarray]) -> list[np.ndarray]:
        """Another hash of the wanted windows of each text."""
        out = []
        for (a, b), at in zip(self._spans(), wanted, strict=True):
            if not at.any():
                out.append(np.zeros(0, np.uint64))
                continue
            high = polynomials(_reduced(self.hashes[a : b + self.window - 1, 0].astype(np.uint64)), self.window, BASES[0], times, True)
            out.append(_mix(_mix(self.low[a:b][at]) + high[at]))
        return out


def covered(repeated: np.ndarray, words: int, window: int) -> np.ndarray:
    """True for the words in the union of the repeated windows' intervals."""
    edges = np.zeros(words + 1, np.int64)
    edges[: len(repeated)] += repeated
    edges[window : window + len(repeated)] -= repeated
    return np.cumsum(edges)[:words] > 0


def _planes(values: np.ndarray) -> bytes:
    """Sorted values as byte planes of their differences; the high planes are zeros and compress away."""
    return np.diff(values, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _values(planes: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(planes, np.uint8).reshape(8, -1).T.copy().view("<u8").ravel(), dtype=np.uint64)


def _distinct(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The values in order, once each, and which of them come twice."""
    values = np.sort(np.concatenate([*lists, np.zeros(0, np.uint64)]))
    first = np.concatenate(([True], values[1:] != values[:-1])) if len(values) else np.zeros(0, bool)
    return values[first], np.diff(np.append(np.flatnonzero(first), len(values))) > 1


def _within(values: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(values), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, values), len(sorted_) - 1)] == values


def repeated_passages(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True, parts: int | None = None) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256 and, if ``with_text``, kept) for every row of ``docs``.

    A word goes if a window of ``window`` words that covers it occurs anywhere
    else in the table, the same text included; windows are judged on the input.
    ``kept`` is the remaining words joined by one space. Null text has no words;
    repeated rows are occurrences of each other; rows shorter than a window keep
    all; other columns are not read; an empty table gives no rows. ``parts`` is taken
    from the texts' bytes (``PART_BYTES``) if it is not given, and never below the shuffle partitions.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if parts is None:
        size = rows.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
        parts = max(partitions(docs.sparkSession), -(-size // PART_BYTES))
    kind = rows.schema["id"].dataType.simpleString()
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "text"), F.lit(parts)).cast("int"))
    edges = np.array([(1 << 64) * k // parts for k in range(1, parts)], np.uint64)  # of the hash ranges

    def part_of(group: pa.Table) -> Part:
        return Part([(t.as_py() or "").encode() for t in group.column("text")], window)

    def sent(part: int, values: np.ndarray) -> pa.Table:
        full = [(k, _planes(p)) for k, p in enumerate(np.split(values, np.searchsorted(values, edges))) if len(p)]
        return pa.table({"part": pa.array([part] * len(full), pa.int32()), "range": pa.array([k for k, _ in full], pa.int32()), "planes": pa.array([p for _, p in full], pa.binary())})

    def answer(group: pa.Table) -> pa.Table:
        lists = [_values(p.as_py()) for p in group.column("planes")]
        merged = np.sort(np.concatenate(lists))
        twice = np.unique(merged[1:][merged[1:] == merged[:-1]])
        bits = [np.packbits(np.isin(v, twice, assume_unique=True)).tobytes() for v in lists]
        return pa.table({"part": group.column("part"), "range": group.column("range"), "bits": pa.array(bits, pa.binary())})

    def repeated(lists: list[np.ndarray], answers: pa.Table) -> np.ndarray:
        """The values, in order, that come twice here or in another part too."""
        values, again = _distinct(lists)
        bits = dict(zip(answers.column("range").to_pylist(), answers.column("bits").to_pylist(), strict=True))
        lo = 0
        for k, hi in enumerate([*np.searchsorted(values, edges).tolist(), len(values)]):
            if hi > lo:
                again[lo:hi] |= np.unpackbits(np.frombuffer(bits[k], np.uint8), count=hi - lo).astype(bool)
            lo = hi
        return values[again]

    def candidates(part: Part, answers: pa.Table) -> list[np.ndarray]:
        """For each text, which windows passed the first count."""
        first = part.first()
        twice = repeated(first, answers)
        return [_within(h, twice) for h in first]

    def send(group: pa.Table) -> pa.Table:
        return sent(group.column("part")[0].as_py(), _distinct(part_of(group).first())[0])

    def send_candidates(group: pa.Table, answers: pa.Table) -> pa.Table:
        part = part_of(group)
        return sent(group.column("part")[0].as_py() if len(group) else 0, _distinct(part.second(candidates(part, answers)))[0])

    def remove(group: pa.Table, answers: pa.Table) -> pa.Table:
        part = part_of(group)
        first, second = (answers.filter(pc.equal(answers.column("turn"), k)) for k in (1, 2))
        held = candidates(part, first)
        hashed = part.second(held)
        twice = repeated(hashed, second)
        out = []
        for text, size, values, at in zip(part.texts, np.diff(part.starts).tolist(), hashed, held, strict=True):
            at[at] = _within(values, twice)
            gone = covered(at, size, window)
            kept = b" ".join(compress(text.split(), (~gone).tolist()) if gone.any() else text.split())
            out.append((size, int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode() if with_text else None))
        columns = list(zip(*out, strict=True)) or [[], [], [], []]
        return pa.table({"id": group.column("id"), "n_words": pa.array(columns[0], pa.int64()), "n_removed": pa.array(columns[1], pa.int64()), "kept_sha256": pa.array(columns[2], pa.string()), "kept": pa.array(columns[3], pa.string())})

    def counted(values: DataFrame, turn: int) -> DataFrame:
        return values.groupBy("range").applyInArrow(answer, "part int, range int, bits binary").withColumn("turn", F.lit(turn))

    schema = "part int, range int, planes binary"
    first = counted(rows.groupBy("part").applyInArrow(send, schema), 1)  # two steps read it; Spark reuses its exchange and that of the rows
    second = counted(rows.groupBy("part").cogroup(first.groupBy("part")).applyInArrow(send_candidates, schema), 2)
    out = rows.groupBy("part").cogroup(first.union(second).groupBy("part")).applyInArrow(remove, f"id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    return (out if with_text else out.drop("kept")).withColumnRenamed("id", id_col)
