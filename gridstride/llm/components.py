"""Connected components of a link table, by alternating star contraction on Spark.

Each round replaces a node's links by links to the smallest node it knows: first
from its larger neighbours (large star), then from its smaller ones (small star).
The tables stay distributed; only whether a round was the last reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstride.llm.common import durable


#: Links that a task joins at once, and parts into which a node's links are dealt where they meet its least neighbour.
CHUNK, SALTS = 200_000, 8
#: Up to so many links of any node, they meet the least neighbour as one group.
HUB = 1000


def _reduced(links: list[tuple[int, int]]) -> pa.RecordBatch:
    """Union-find within a task: as many links as nodes, at most."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while (up := parent.setdefault(root, root)) != root:
            root = up
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    kept = [(x, find(x)) for x in parent if find(x) != x]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in kept], pa.int64()) for i in (0, 1)], names=["u", "v"])


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[int, int]] = []
    for batch in batches:
        held += zip(*(c.to_pylist() for c in batch.columns), strict=True)
        if len(held) > CHUNK:
            yield _reduced(held)
            held = []
    yield _reduced(held)


def _with_least(rows: DataFrame, least: DataFrame) -> DataFrame:
    """Join (u, v) with (u, m) in several parts of each u, so that a hub's links are not one task."""
    salted = least.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.withColumn("part", F.pmod("v", F.lit(SALTS).cast("long"))).join(salted, ["u", "part"]).drop("part")


def components(links: DataFrame, rounds: int = 60, reduce: bool = True) -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns); root is the smallest node of its component.

    Nulls and links of a node to itself are ignored, repeated links are one, and
    an empty table gives no rows. The number of rounds grows with the logarithm of
    the nodes; more than ``rounds`` of them are an error. ``reduce``: union-find within
    tasks first, which links from groups that are forests already do without.
    """
    a, b = links.columns
    edges = links.where(f"{a} is not null and {b} is not null and {a} != {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    edges = durable((edges.mapInArrow(_forest, "u long, v long") if reduce else edges).distinct())
    for _ in range(rounds):
        # settled: every node has one link, and none leads on
        ends = edges.select("u", F.lit(1).alias("out")).union(edges.select("v", F.lit(0)))
        nodes = ends.groupBy("u").agg(F.sum("out").alias("out"), F.min("out").alias("low"), F.count("*").alias("n"))
        seen = nodes.agg(F.max(F.expr("out > 1 or out = 1 and low = 0")).alias("open"), F.max("n").alias("most")).first()
        if not seen["open"]:
            roots = edges.select("v").distinct()
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        if seen["most"] > HUB:
            least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
            large = _with_least(both.where("v > u"), least)
        else:
            large = both.withColumn("m", F.least("u", F.min("v").over(Window.partitionBy("u")))).where("v > u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node has few links to smaller ones now
        small = large.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u != v").distinct()
        edges = durable(small)
    raise RuntimeError(f"components did not settle in {rounds} rounds")
