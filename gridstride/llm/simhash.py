"""SimHash near-duplicates by segment popcounts (operator 9).

A fingerprint is cut into 32 segments of two bits; its embedding is each
segment's bit count, written in unary in place, so that the Manhattan distance of
two embeddings is the popcount of their exclusive or. That distance is a lower
bound of the Hamming distance.

The grid: segments form seven groups. At a Manhattan distance of 4 or less at
most four groups differ, so at least three agree. A cell is one choice of three
groups (35 in all) with their coordinates; links are found by an equi-join on
cells, bounded by the Manhattan distance and then verified on the bits. A pair
is kept only in the first cell in which it meets, so no link is emitted twice.
Cells are finer for more fingerprints: of eight groups four agree (70 cells), of
nine five, so that chance meetings stay few. Exact copies are one fingerprint
before the join.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstride.llm.common import durable, fresh, released
from gridstride.llm.components import components

SHINGLE, SEED, DISTANCE = 4, 42, 4
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
STEP = 1 << 15
#: Fingerprints from which on cells have a group more.
FINER = 1 << 24


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _votes(words: list[bytes], size: int) -> tuple[np.ndarray, int]:
    """How many shingle hashes have each bit, and how many shingles there are."""
    votes, n = np.zeros(64, np.int64), max(1, len(words) - size + 1)
    digest = xxhash.xxh64_intdigest
    for lo in range(0, n, STEP):  # long texts in steps
        hi = min(n, lo + STEP)
        part = words[lo : hi + size - 1]
        text = b" ".join(part)
        ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))[: hi - lo].tolist()
        hashes = np.array([digest(text[s:e], SEED) for s, e in zip(starts, ends[min(size, len(part)) - 1 :].tolist(), strict=True)], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return votes, n


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The unsigned 64-bit fingerprint of a whole text; zero without words."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    votes, n = _votes(words, size)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the fingerprint as a signed long, one row per row."""

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([_signed(fingerprint(t.as_py(), size)) for t in batch.column(1)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), fps], names=["id", "fp"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


def group_masks(groups: int = 7) -> list[int]:
    """Bit masks of the groups of two-bit segments."""
    edges = [2 * round(32 * g / groups) for g in range(groups + 1)]
    return [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]


def agreeing(n: int) -> int:
    """How many groups a cell has, for so many fingerprints."""
    return 3 if n < FINER else 4 if n < 64 * FINER else 5


def near_pairs(fps: DataFrame, distance: int = DISTANCE, agree: int = 3) -> DataFrame:
    """(a, b), a < b: all pairs of distinct values of ``fp`` within the Hamming distance, each once, whatever ``agree``."""
    masks = group_masks(distance + agree)
    cells = list(combinations(range(len(masks)), agree))
    odd = 0x5555555555555555
    embedding = f"((fp | shiftrightunsigned(fp, 1)) & {odd}L) | shiftleft((fp & shiftrightunsigned(fp, 1)) & {odd}L, 1)"
    keys = "array(" + ", ".join(f"{_signed(sum(masks[g] for g in cell))}L" for cell in cells) + ")"
    grid = fps.select("fp", F.expr(embedding).alias("e")).select("fp", "e", F.expr(f"posexplode({keys})").alias("cell", "mask")).select("fp", "e", "cell", (F.col("e").bitwiseAND(F.col("mask"))).alias("at"))
    x, y = grid.alias("x"), grid.alias("y")
    differ = "(x.e ^ y.e)"
    # groups before the cell's last one that are not of the cell must differ: the first common cell
    early = []
    for number, combo in enumerate(cells):
        others = [g for g in range(combo[-1]) if g not in combo]
        early.append(" and ".join(f"{differ} & {_signed(masks[g])}L != 0" for g in others) or "true")
    first = "case x.cell " + " ".join(f"when {n} then {e}" for n, e in enumerate(early)) + " end"
    on = f"x.cell = y.cell and x.at = y.at and x.fp < y.fp and bit_count{differ} <= {distance} and bit_count(x.fp ^ y.fp) <= {distance} and {first}"
    return x.join(y, F.expr(on)).select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b"))


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id) for every row.

    Rows whose fingerprints differ in at most ``distance`` bits are linked;
    component_id is the smallest id reachable over links, the row's own included.
    Null and empty texts have fingerprint zero and link like others. Null ids
    take part but name no component. Repeated rows give repeated results.
    """
    fps = durable(fingerprints(docs, size, id_col, text_col))
    rooted = _rooted(fps.groupBy("fp").agg(F.min("id").alias("least")), distance)
    named = durable(rooted.groupBy("root").agg(F.min("least").alias("component_id")))  # written, so that Spark can split the join of a large component
    names = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return fps.join(names, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _rooted(classes: DataFrame, distance: int) -> DataFrame:
    """Add the component (root) of each distinct fingerprint."""
    classes = durable(classes)
    roots = components(near_pairs(classes.select("fp"), distance, agreeing(classes.count()))).withColumnRenamed("node", "fp")
    return durable(classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")))


def one_of_each(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without those that nearly repeat another: of each component one row stays, that of the smallest id, nulls last.

    Rows are told apart by id and text; of rows that agree in both, one stays.
    """
    row = F.xxhash64(F.lit("row"), F.col(id_col), F.col(text_col))
    keyed = docs.select(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), row.alias("row")).alias("place"), F.col(text_col).alias("text"))
    fps = durable(fingerprints(keyed, size, "place", "text").withColumnRenamed("id", "place"))
    rooted = _rooted(fps.groupBy("fp").agg(F.min("place").alias("least")), distance)
    keep = durable(rooted.groupBy("root").agg(F.min("least").alias("keep")))
    roots = rooted.select("fp", "root").join(keep, "root").select("fp", "keep")
    key = fresh(docs, "_row")
    judged = fps.join(roots, "fp").groupBy(F.col("place.row").alias(key)).agg(F.count("*").alias("n"), F.bool_and(F.col("place") == F.col("keep")).alias("stays"))
    judged = durable(judged.where("not stays or n > 1"))  # few: the others stay
    kept = docs.withColumn(key, row).join(judged.where("not stays").select(key), key, "left_anti")
    again = judged.where("stays").select(key)
    rank = fresh(kept, "_rank")
    several = kept.join(again, key, "left_semi").withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(F.lit(1)))).where(F.col(rank) == 1).drop(rank)
    return kept.join(again, key, "left_anti").unionByName(several).drop(key)
