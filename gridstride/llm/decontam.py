"""Benchmark decontamination by pigeonhole edit matching (operator 10).

A document is contaminated by a test item if some part of it is within the item's
error budget of edits (insert, delete, substitute a character), both lower-cased
with white space runs made one space. A budget of k edits cannot touch all of
k + 1 pieces of the item, so one piece occurs unchanged: piece hits are found by a
table lookup of every position's first bytes, and each hit's surroundings are
verified with Myers' bit-parallel distance.

Items go to the scan in blocks whose size is bounded, so the broadcast is bounded
whatever the benchmark's size; the usual benchmark is one block.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Allowed edits as a share of an item's characters.
ERRORS = 0.1
#: Bytes of a piece that the table holds, and bits of the table's index.
SEED_BYTES, TABLE_BITS = 8, 22
#: Characters of the disjoint grams by which a window is tried before its distance is computed.
GRAM = 5
#: Characters of items that one scan takes.
BLOCK_CHARS = 4_000_000
SPACES = re.compile(r"\s+")
SLICE = 1 << 20
GAP = b"\x00" * 8


def normal(text: str | None) -> str:
    return SPACES.sub(" ", (text or "").lower()).strip()


def least_distance(pattern: str, text: str) -> int:
    """The least edit distance of the pattern to any part of the text (Myers' bit vectors in long integers)."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1)
    plus, minus, score, least = full, 0, len(pattern), len(pattern)
    for c in text:
        eq = masks.get(c, 0)
        vertical = eq | minus
        across = (((eq & plus) + plus) ^ plus) | eq
        up, down = minus | ~(across | plus) & full, plus & across
        if up & top:
            score += 1
        elif down & top:
            score -= 1
            least = min(least, score)
        up, down = up << 1, down << 1
        plus, minus = (down | ~(vertical | up)) & full, up & vertical
    return least


class Pieces:
    """The items of a block, their pieces, and a table to find pieces in bytes."""

    def __init__(self, items: list[tuple[int, str]], errors: float):
        self.items = [(i, normal(t)) for i, t in items]
        self.items = [(i, t) for i, t in self.items if t]
        self.budget = [int(errors * len(t)) for _, t in self.items]
        by_seed: dict[bytes, list[tuple[int, int, bytes]]] = {}
        self.short: list[tuple[int, int, bytes]] = []
        for n, (_, t) in enumerate(self.items):
            k = self.budget[n] + 1
            edges = [round(len(t) * j / k) for j in range(k + 1)]
            for a, b in zip(edges, edges[1:], strict=False):
                piece = t[a:b].encode()
                if len(piece) >= SEED_BYTES:
                    by_seed.setdefault(piece[:SEED_BYTES], []).append((n, a, piece))
                else:
                    self.short.append((n, a, piece))  # only of very short items or large budgets
        self.by_seed = by_seed
        self.grams = [[t[i : i + GRAM].encode() for i in range(0, len(t) - GRAM + 1, GRAM)] for _, t in self.items]
        self.table = np.zeros(1 << TABLE_BITS, bool)
        if by_seed:
            self.table[self._slot(np.array([int.from_bytes(s, "little") for s in by_seed], np.uint64))] = True

    @staticmethod
    def _slot(seeds: np.ndarray) -> np.ndarray:
        return (seeds * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - TABLE_BITS)

    def hits(self, data: bytes) -> Iterator[tuple[int, int, int]]:
        """(item, position of the piece in the item, byte position in data) of every exact piece hit."""
        n = len(data) - len(GAP)
        if n > 0:
            words = np.ndarray((n,), "<u8", data, 0, (1,))
            for at in np.flatnonzero(self.table[self._slot(words)]).tolist():
                for item, offset, piece in self.by_seed.get(data[at : at + SEED_BYTES], ()):
                    if data.startswith(piece, at):
                        yield item, offset, at
        for item, offset, piece in self.short:
            at = data.find(piece)
            while at >= 0:
                yield item, offset, at
                at = data.find(piece, at + 1)

    def _windows(self, text: bytes, item: int, places: list[tuple[int, int]]) -> list[list[int]]:
        """Byte ranges around the hits, as wide as any match through them, where enough grams of the item occur."""
        size, k = len(self.items[item][1]), self.budget[item]
        found: list[tuple[int, int]] = []
        for at, offset in places:
            before, after = offset + k, size - offset + k
            if not text[max(0, at - 4 * before) : at + 4 * after].isascii():
                before, after = 4 * before, 4 * after  # bytes of a character, at most
            found.append((max(0, at - before), at + after))
        out: list[list[int]] = []
        for lo, hi in sorted(set(found)):  # by their starts: a later hit of a later piece may start earlier
            part, missing = text[lo:hi], k  # an edit touches one of the disjoint grams, at most
            for g in self.grams[item]:
                if g not in part:
                    missing -= 1
                    if missing < 0:
                        break
            else:
                if out and lo <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], hi)
                else:
                    out.append([lo, hi])
        return out

    def match(self, texts: list[str | None]) -> list[tuple[int, int, int]]:
        """(row, item id, least distance) for every text and item within the budget."""
        found: dict[tuple[int, int], int] = {}
        encoded = [normal(t).encode() for t in texts]
        data = GAP.join(encoded) + GAP
        sizes = np.fromiter((len(e) + len(GAP) for e in encoded), np.int64, len(encoded))
        ends = np.cumsum(sizes)
        near: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for item, offset, at in self.hits(data):
            row = int(np.searchsorted(ends, at, side="right"))
            near.setdefault((row, item), []).append((at - int(ends[row] - sizes[row]), offset))
        for (row, item), places in near.items():
            text, k = encoded[row], self.budget[item]
            best = k + 1
            for lo, hi in self._windows(text, item, places):
                best = min(best, least_distance(self.items[item][1], text[lo:hi].decode(errors="ignore")))
            if best <= k:
                key = (row, self.items[item][0])
                found[key] = min(best, found.get(key, best))
        return [(row, item, d) for (row, item), d in found.items()]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The items, in lists of bounded size; only one is on the driver at a time."""
    held, size = [], 0
    for r in benchmark.select(F.col(item_col).alias("item"), F.col(text_col).alias("text")).where("item is not null and text is not null").distinct().toLocalIterator():
        if held and size + len(r["text"]) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append((r["item"], r["text"]))
        size += len(r["text"])
    yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, distance): each row of ``docs`` with each item that a part of its text matches, and the least distance.

    Null and empty texts and items match nothing; null ids match like others;
    repeated rows give repeated results; an empty table of either gives no rows.
    Ids of both tables may have any type. Items of under 1 / ``errors``
    characters have no budget: they match where they occur unchanged, within
    longer words too.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind, item_type = rows.schema["id"].dataType.simpleString(), benchmark.schema[item_col].dataType
    out, item_kind = None, to_arrow_type(item_type)
    for items in _blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_CHARS and one item

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            pieces = Pieces(shared.value, errors)
            for batch in batches:
                lo, size = 0, 0
                texts = batch.column(1).to_pylist()
                for hi, t in enumerate(texts, 1):
                    size += len(t or "")
                    if size > SLICE or hi == len(texts):
                        got = pieces.match(texts[lo:hi])
                        row = pa.array([lo + r for r, _, _ in got], pa.int64())
                        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), pa.array([i for _, i, _ in got], item_kind), pa.array([d for _, _, d in got], pa.int32())], names=["id", "item_id", "distance"])
                        lo, size = hi, 0

        part = rows.mapInArrow(run, f"id {kind}, item_id {item_type.simpleString()}, distance int")
        out = part if out is None else out.union(part)
    return out.withColumnRenamed("id", id_col)


def _matcher(shared: Broadcast, errors: float) -> Callable[[Column], Column]:
    """Whether a text matches an item of the block."""

    @F.pandas_udf("boolean")
    def matches(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        pieces = Pieces(shared.value, errors)
        for texts in batches:
            hit, lo, size = np.zeros(len(texts), bool), 0, 0
            for hi, t in enumerate(texts, 1):
                size += len(t or "")
                if size > SLICE or hi == len(texts):
                    hit[[lo + r for r, _, _ in pieces.match(texts.iloc[lo:hi].tolist())]] = True
                    lo, size = hi, 0
            yield pd.Series(hit)

    return matches


def decontaminate(docs: DataFrame, benchmark: DataFrame, errors: float = ERRORS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose texts match no item, with all their columns.

    Each row is judged by its own text, so rows that share an id, or have none,
    are told apart. Nothing is shuffled: each block of items is one more filter.
    """
    for items in _blocks(benchmark, item_col, item_text_col):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # at most BLOCK_CHARS and one item
        docs = docs.where(~_matcher(shared, errors)(F.col(text_col)))
    return docs
