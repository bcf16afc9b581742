"""Operators on paths, points and sampled grids."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstride.functions.geo import haversine
from gridstride.operators.blocks import durable


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def steps(path: DataFrame, key: str) -> DataFrame:
    """Add the previous point (plat, plng) and the metres from it."""
    w = Window.partitionBy(key).orderBy("i")
    rows = path.withColumn("plat", F.lag("lat").over(w)).withColumn("plng", F.lag("lng").over(w))
    return rows.withColumn("step_m", F.when(F.col("plat").isNull(), 0.0).otherwise(haversine("plat", "plng", "lat", "lng")))


def length(path: DataFrame, key: str) -> DataFrame:
    return steps(path, key).groupBy(key).agg(F.sum("step_m").alias("length_m"))


def resampled(path: DataFrame, key: str, every_m: float = 30.0) -> DataFrame:
    """A point each ``every_m`` metres along each path, by linear interpolation within the step that reaches it."""
    w = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = steps(path, key).withColumn("upto", F.sum("step_m").over(w)).withColumn("since", F.col("upto") - F.col("step_m")).where("step_m > 0")
    first, last = F.floor(F.col("since") / every_m) + 1, F.floor(F.col("upto") / every_m)
    hits = rows.where(last >= first).withColumn("n", F.explode(F.sequence(first, last)))
    t = (F.col("n") * every_m - F.col("since")) / F.col("step_m")
    return hits.select(key, "n", (F.col("plat") + (F.col("lat") - F.col("plat")) * t).alias("lat"), (F.col("plng") + (F.col("lng") - F.col("plng")) * t).alias("lng"))


#: Samples of a path that one task reduces to their turning points.
CHUNK = 4096


def turning_points(values: Iterable[float], least: float) -> list[float]:
    """The ends of a series' rises and falls, without those of at most ``least`` that lie within larger ones.

    Such a swing has no part in the climb of the whole, wherever the series stands
    in a longer one, so parts can be reduced first and their results together again.
    """
    out: list[float] = []
    for v in values:
        if len(out) > 1 and (out[-1] - out[-2]) * (v - out[-1]) >= 0:
            out[-1] = v  # the same direction goes on
        elif not out or v != out[-1]:
            out.append(v)
        while len(out) > 3:
            a, b, c, d = out[-4:]
            if abs(b - c) > min(least, abs(a - b), abs(c - d)):
                break
            out[-4:] = [a, d] if a != d else [a]
    return out


def climb(values: list[float], least: float) -> float:
    """The sum of the rises between turning points, those of at most ``least`` at either end left out."""
    swings = np.diff(values)
    large = np.flatnonzero(np.abs(swings) > least)
    return float(np.maximum(swings[large[0] : large[-1] + 1], 0).sum()) if len(large) else 0.0


def ascent(samples: DataFrame, key: str, order: str, value: str, hysteresis: float = 8.0) -> DataFrame:
    """Metres climbed along each path's samples: only swings larger than the hysteresis count; nulls are skipped.

    Stretches of ``CHUNK`` samples become turning points first, so that a long path
    is no single group.
    """
    rows = samples.where(F.col(value).isNotNull()).select(F.col(key).alias("key"), F.floor(F.col(order) / CHUNK).alias("chunk"), F.col(order).cast("double").alias("at"), F.col(value).cast("double").alias("e"))
    kind = rows.schema["key"].dataType.simpleString()

    def reduce(group: pa.Table) -> pa.Table:
        ordered = group.sort_by("at").column("e").to_pylist()
        return pa.table({"key": group.column("key")[:1], "chunk": group.column("chunk")[:1], "turns": pa.array([turning_points(ordered, hysteresis)], pa.list_(pa.float64()))})

    def total(group: pa.Table) -> pa.Table:
        turns = [v for part in group.sort_by("chunk").column("turns").to_pylist() for v in part]
        return pa.table({"key": group.column("key")[:1], "ascent_m": pa.array([climb(turning_points(turns, hysteresis), hysteresis)], pa.float64())})

    parts = rows.groupBy("key", "chunk").applyInArrow(reduce, f"key {kind}, chunk long, turns array<double>")
    return parts.groupBy("key").applyInArrow(total, f"key {kind}, ascent_m double").withColumnRenamed("key", key)


def sampled(path: DataFrame, key: str, every_m: float = 30.0) -> DataFrame:
    """(key, n, lat, lng): a path's first point, a point each ``every_m`` metres, and its last point, in the order of ``n``."""
    ends = path.groupBy(key).agg(F.min_by(F.struct("lat", "lng"), "i").alias("a"), F.max_by(F.struct("lat", "lng"), "i").alias("b"), F.count("*").alias("points"))
    first = ends.select(key, F.lit(0).cast("long").alias("n"), "a.lat", "a.lng")
    last = ends.where("points > 1").select(key, F.lit(1 << 62).alias("n"), "b.lat", "b.lng")
    return first.union(resampled(path, key, every_m)).union(last)


#: Fixed value: how far from zero a cross product may be on a straight line.
STRAIGHT = 1e-6


def without_collinear(path: DataFrame, key: str, tolerance: float = STRAIGHT) -> DataFrame:
    """Drop points (x, y) at which a path goes straight on from the last point kept; its ends and points where it turns back stay.

    Points are judged from the one before them first, then all of them from the last one kept; of each path the first that is
    judged otherwise then is turned, until there is none. On straight lines both judge alike, so there is rarely a second round.
    """
    kept, ahead = fresh(path, "_kept"), Window.partitionBy(key).orderBy("i")
    x, y = F.col("x").cast("double"), F.col("y").cast("double")

    def straight(rows: DataFrame, before: F.Column) -> F.Column:
        ux, uy = x - before["x"], y - before["y"]
        vx, vy = F.lead("x").over(ahead) - x, F.lead("y").over(ahead) - y
        return F.coalesce((F.abs(ux * vy - uy * vx) <= tolerance) & (ux * vx + uy * vy > 0), F.lit(False))

    here = F.struct(x.alias("x"), y.alias("y"))
    rows = durable(path.withColumn(kept, ~straight(path, F.lag(here).over(ahead))))
    while True:
        last = F.last(F.when(F.col(kept), here), ignorenulls=True).over(ahead.rowsBetween(Window.unboundedPreceding, -1))
        wrong = rows.withColumn("_wrong", F.col(kept) == straight(rows, last)).where("_wrong").groupBy(key).agg(F.min("i").alias("_turn"))
        wrong = durable(wrong)
        if wrong.isEmpty():
            return rows.where(F.col(kept)).drop(kept)
        turned = F.coalesce(F.col("i") == F.col("_turn"), F.lit(False))
        rows = durable(rows.join(wrong, key, "left").withColumn(kept, F.col(kept) != turned).drop("_turn"))


def simplified(path: DataFrame, key: str, tolerance: float) -> DataFrame:
    """(key, i, x, y): the points that Douglas and Peucker's rule keeps, by distance to segments; the first of equally far ones.

    All segments of all paths are judged in one round: the farthest point of each that lies beyond the tolerance
    stays and splits it, the points of the others go. So rounds grow with the depth of the splits, and a long path is no
    single group. Without a tolerance above zero all points stay.
    """
    points = path.select(key, "i", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    if not tolerance > 0:
        return points
    at = lambda c: F.struct(F.col("i"), F.col("x"), F.col("y")).alias(c)
    ends = points.groupBy(key).agg(F.min_by(at("p"), "i").alias("a"), F.max_by(at("p"), "i").alias("b"))
    inner = durable(points.join(ends, key).where("i > a.i and i < b.i"))
    kept = [ends.select(key, F.explode(F.array_distinct(F.array("a", "b"))).alias("p")).select(key, "p.*")]
    vx, vy, px, py = F.col("b.x") - F.col("a.x"), F.col("b.y") - F.col("a.y"), F.col("x") - F.col("a.x"), F.col("y") - F.col("a.y")
    size, along = vx * vx + vy * vy, px * vx + py * vy
    to_b = F.pow(F.col("x") - F.col("b.x"), 2) + F.pow(F.col("y") - F.col("b.y"), 2)
    off = F.when((size == 0) | (along <= 0), px * px + py * py).when(along >= size, to_b).otherwise(F.pow(px * vy - py * vx, 2) / F.nullif(size, F.lit(0.0)))
    while True:
        far = inner.groupBy(key, F.col("a.i").alias("s")).agg(F.max_by(at("p"), F.struct(off, -F.col("i"))).alias("m"), F.max(off).alias("d")).where(F.col("d") > tolerance * tolerance)
        far = durable(far.select(key, "s", "m"))
        if far.isEmpty():
            break
        kept.append(far.select(key, "m.*"))
        split = inner.withColumn("s", F.col("a.i")).join(far, [key, "s"]).where("i != m.i")
        before = F.col("i") < F.col("m.i")
        inner = durable(split.select(key, "i", "x", "y", F.when(before, F.col("a")).otherwise(F.col("m")).alias("a"), F.when(before, F.col("m")).otherwise(F.col("b")).alias("b")))
    out = kept[0]
    for more in kept[1:]:
        out = out.union(more)
    return out


def without_repeats(path: DataFrame, key: str, cell: str) -> DataFrame:
    """Drop points in the same cell as the one before."""
    first = F.row_number().over(Window.partitionBy(key).orderBy("i")) == 1
    same = F.col(cell).eqNullSafe(F.lag(cell).over(Window.partitionBy(key).orderBy("i")))
    name = fresh(path, "_same")
    return path.withColumn(name, same & ~first).where(~F.col(name)).drop(name)


def farthest(path: DataFrame, key: str) -> DataFrame:
    """The first of the points that are farthest (in degrees) from each path's first point."""
    w = Window.partitionBy(key).orderBy("i")
    rows = path.withColumn("_d", F.pow(F.col("lat") - F.first("lat").over(w), 2) + F.pow(F.col("lng") - F.first("lng").over(w), 2))
    return rows.groupBy(key).agg(F.max_by("i", F.struct("_d", -F.col("i"))).alias("turn"))


def nearest_on_path(path: DataFrame, points: DataFrame, key: str, more: Sequence[str] = ()) -> DataFrame:
    """Of each path, the point nearest to the path's own query point (lat0, lng0), longitudes scaled by its latitude; the first wins. ``more`` tells several points of a path apart."""
    dx = (F.col("lng") - F.col("lng0")) * F.cos(F.radians("lat0"))
    d = dx * dx + F.pow(F.col("lat") - F.col("lat0"), 2)
    return path.join(points, key).groupBy(key, *more).agg(F.min_by("i", F.struct(d, "i")).alias("nearest"))


def bilinear(points: DataFrame, grid: DataFrame, value: str, height: int, width: int, by: Sequence[str] = ()) -> DataFrame:
    """Sample a grid at (id, px, py), cell centres at halves: the known corners' weighted mean, null outside or if none is known. Grids and points may be told apart by ``by``."""
    u, v = F.col("px") - 0.5, F.col("py") - 0.5
    rows = points.where((F.col("px") >= 0) & (F.col("px") < width) & (F.col("py") >= 0) & (F.col("py") < height)).select(*by, "id", F.floor(u).alias("x0"), F.floor(v).alias("y0"), (u - F.floor(u)).alias("fx"), (v - F.floor(v)).alias("fy"))
    fx, fy = F.col("fx"), F.col("fy")
    inside = lambda c, d, n: F.greatest(F.lit(0).cast("long"), F.least(F.lit(n - 1).cast("long"), F.col(c) + d))
    corners = F.explode(F.array(*[F.struct(inside("x0", dx, width).alias("x"), inside("y0", dy, height).alias("y"), ((fx if dx else 1 - fx) * (fy if dy else 1 - fy)).alias("w")) for dy in (0, 1) for dx in (0, 1)]))
    hit = rows.select(*by, "id", corners.alias("c")).select(*by, "id", "c.x", "c.y", "c.w").join(grid.where(F.col(value).isNotNull()).select(*by, "x", "y", value), [*by, "x", "y"])
    found = hit.groupBy(*by, "id").agg((F.sum(F.col("w") * F.col(value)) / F.sum("w")).alias(value))
    return points.select(*by, "id").join(found, [*by, "id"], "left")


def near_labels(path: DataFrame, labels: DataFrame, key: str, reach: int | F.Column, by: Sequence[str] = ()) -> DataFrame:
    """Per path, how many distinct labels lie within the square of ``reach`` cells around any of its cells (y, x)."""
    reach = F.lit(reach) if isinstance(reach, int) else reach
    offsets = F.sequence(-reach.cast("long"), reach.cast("long"))
    keys = list(dict.fromkeys([key, *by]))
    around = path.select(*keys, "y", "x", offsets.alias("o")).distinct().withColumn("dy", F.explode("o")).withColumn("dx", F.explode("o"))
    around = around.select(*keys, (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x")).distinct()
    return around.join(labels, [*by, "y", "x"]).groupBy(key).agg(F.countDistinct("label").alias("labels"))


def nearest_open(points: DataFrame, cells: DataFrame, reach: int, by: Sequence[str] = (), most: str | None = None) -> DataFrame:
    """Snap each (id, cx, cy) to an open cell (y, x): the nearest square ring first, then the Euclidean distance, then the order in which the ring is walked (its top and bottom by x, then its sides by y).

    Points meet only cells of their own and the neighbouring blocks of ``reach``
    cells, within the same ``by``. A column ``most`` narrows the reach of each point.
    """
    block = lambda c: F.floor(F.col(c) / max(1, reach))
    home = points.select(*by, "id", "cx", "cy", (F.col(most) if most else F.lit(reach)).alias("most"), F.floor(F.col("cx") + 0.5).alias("hx"), F.floor(F.col("cy") + 0.5).alias("hy"))
    home = home.withColumn("bx", F.explode(F.sequence(block("hx") - 1, block("hx") + 1))).withColumn("by_", F.explode(F.sequence(block("hy") - 1, block("hy") + 1)))
    near = home.join(cells.select(*by, "y", "x", block("x").alias("bx"), block("y").alias("by_")), [*by, "bx", "by_"])
    ring = F.greatest(F.abs(F.col("x") - F.col("hx")), F.abs(F.col("y") - F.col("hy")))
    d = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)
    flat = F.abs(F.col("y") - F.col("hy")) == ring
    walk = F.struct(ring.alias("r"), d.alias("d"), F.when(flat, 0).otherwise(1).alias("side"), F.when(flat, F.col("x")).otherwise(F.col("y")).alias("a"), F.when(flat, F.col("y")).otherwise(F.col("x")).alias("b"))
    return near.where((ring <= reach) & (ring <= F.col("most"))).groupBy(*by, "id").agg(F.min_by(F.struct("y", "x"), walk).alias("c")).select(*by, "id", "c.y", "c.x")


def shares(rows: DataFrame, key: str, kind: str) -> DataFrame:
    """(key, kind, share): how much of each key's rows each kind has."""
    counts = rows.groupBy(key, kind).agg(F.count("*").alias("n"))
    return counts.select(key, kind, (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("share"))


def cell_length(path: DataFrame, key: str, order: str, cell_m: float | F.Column, near: F.Column) -> DataFrame:
    """(key, edge_m, length_m) of a path of cells (y, x): its length, and that of the steps that end where ``near`` holds."""
    w = Window.partitionBy(key).orderBy(order)
    dy, dx = F.col("y") - F.lag("y").over(w), F.col("x") - F.lag("x").over(w)
    step, beside = fresh(path, "_step"), fresh(path, "_near")
    rows = path.withColumn(step, F.coalesce(F.sqrt(dy * dy + dx * dx) * cell_m, F.lit(0.0))).withColumn(beside, near)
    return rows.groupBy(key).agg(F.sum(F.when(F.col(beside), F.col(step)).otherwise(0.0)).alias("edge_m"), F.sum(step).alias("length_m"))
