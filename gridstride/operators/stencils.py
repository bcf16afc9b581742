"""Neighbourhood operators on grids.

Grids are (y, x, value) tables, or many grids in one table told apart by the columns
``by``. Separable stencils are two windows, one along rows and one along columns;
nothing gathers a grid in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridstride.operators import blocks

By = Sequence[str]


def along_x(by: By = ()) -> WindowSpec:
    return Window.partitionBy(*by, "y").orderBy("x")


def along_y(by: By = ()) -> WindowSpec:
    return Window.partitionBy(*by, "x").orderBy("y")


def _box(cells: DataFrame, value: str, combine, reach: int, by: By = ()) -> DataFrame:  # noqa: ANN001
    """Combine a value over the (2 reach + 1)-square around each cell of a dense grid, clipped at the border."""
    once = cells.withColumn(value, combine(value).over(along_x(by).rowsBetween(-reach, reach)))
    return once.withColumn(value, combine(value).over(along_y(by).rowsBetween(-reach, reach)))


def erode(cells: DataFrame, mask: str, by: By = ()) -> DataFrame:
    return _box(cells, mask, F.min, 1, by)


def dilate(cells: DataFrame, mask: str, by: By = ()) -> DataFrame:
    return _box(cells, mask, F.max, 1, by)


def opened(cells: DataFrame, mask: str, by: By = ()) -> DataFrame:
    return dilate(erode(cells, mask, by), mask, by)


def closed(cells: DataFrame, mask: str, by: By = ()) -> DataFrame:
    return erode(dilate(cells, mask, by), mask, by)


def near_large(cells: DataFrame, flag: str, reach: int = 2, by: By = ()) -> DataFrame:
    """Whether any cell of the square has the flag."""
    return _box(cells, flag, F.max, reach, by)


def smoothed(cells: DataFrame, value: str, by: By = ()) -> DataFrame:
    """The mean of the known values of the 3 x 3 square; null if there is none."""
    both = cells.withColumn("_s", F.coalesce(F.col(value), F.lit(0.0))).withColumn("_n", F.col(value).isNotNull().cast("int"))
    both = _box(_box(both, "_s", F.sum, 1, by), "_n", F.sum, 1, by)
    return both.withColumn(value, F.when(F.col("_n") > 0, F.col("_s") / F.col("_n"))).drop("_s", "_n")


def slope(cells: DataFrame, value: str, pixel_m: float | Column, by: By = ()) -> DataFrame:
    """Horn's gradient with replicated edges; null where a neighbour is unknown."""
    rows = cells
    for name, window, step in (("w", along_x(by), -1), ("e", along_x(by), 1)):
        edge = F.lag(F.struct(value), -step).over(window)
        rows = rows.withColumn(f"_{name}", F.when(edge.isNull(), F.col(value)).otherwise(edge[value]))
    rows = rows.withColumn("_row", F.struct(F.col("_w").alias("w"), F.col(value).alias("c"), F.col("_e").alias("e")))
    rows = rows.withColumn("_n", F.coalesce(F.lag("_row").over(along_y(by)), "_row")).withColumn("_s", F.coalesce(F.lead("_row").over(along_y(by)), "_row"))
    n, m, s = F.col("_n"), F.col("_row"), F.col("_s")
    dx = (n["e"] + 2 * m["e"] + s["e"] - (n["w"] + 2 * m["w"] + s["w"])) / (8 * pixel_m)
    dy = (s["w"] + 2 * s["c"] + s["e"] - (n["w"] + 2 * n["c"] + n["e"])) / (8 * pixel_m)
    return rows.withColumn("slope", F.sqrt(dx * dx + dy * dy)).drop("_w", "_e", "_row", "_n", "_s")


def distance_to_mask(cells: DataFrame, mask: str, cell_m: float, reach_m: float = math.inf, by: By = ()) -> DataFrame:
    """Add ``dist`` to the cells of dense grids: chamfer 3-4 distance in metres to the nearest mask cell, null beyond ``reach_m`` or without a mask cell.

    Two scans of each block and news across borders, so the work is that of the cells, whatever the reach.
    """
    name = by[0] if by else None
    if len(by) > 1:
        raise ValueError("grids are told apart by one column")
    rows = cells.select((F.col(name) if name else F.lit(0)).cast("long").alias("req"), "y", "x", F.lit(1.0).alias("cost"), F.when(F.col(mask) == 1, 0.0).otherwise(math.inf).alias("value"))
    field = blocks.Field(rows, blocks.chamfer, most=3 * reach_m / cell_m)
    found = field.cells().select(*[F.col("req").alias(n) for n in by], "y", "x", (F.col("value") / 3 * cell_m).alias("dist")).where(F.col("dist") <= reach_m).where(F.col("dist") < math.inf)
    return cells.join(found, [*by, "y", "x"], "left")


def closeness(dist: str, reach_m: float) -> F.Column:
    """1 at distance 0, falling to 0 at the reach; 0 where the distance is null."""
    return F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - F.col(dist) / reach_m)), F.lit(0.0))


def road_widths(depths: DataFrame, road: DataFrame, down: int, pixel_m: float) -> DataFrame:
    """(req, y, x, width): twice the largest depth in each cell of ``down`` pixels, in metres; 0 off road cells.

    ``depths`` is (req, y, x, dist) of pixels, ``road`` (req, y, x, road_cell) of cells.
    """
    widest = depths.groupBy("req", F.floor(F.col("y") / down).alias("y"), F.floor(F.col("x") / down).alias("x")).agg((F.max("dist") * 2 / 3 * pixel_m).alias("width"))
    found = road.select("req", "y", "x", "road_cell").join(widest, ["req", "y", "x"], "left")
    return found.select("req", "y", "x", F.when(F.col("road_cell") == 1, F.coalesce("width", F.lit(0.0))).otherwise(0.0).alias("width"))


def median(values: DataFrame, by: By, value: str) -> DataFrame:
    """(by, median): the exact median of each group's known values, the mean of the middle two of an even number.

    Values are counted first, so a task holds a group's distinct values as counts in order, not its rows.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n"))
    ordered = Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    rows = counts.withColumn("upto", F.sum("n").over(ordered)).withColumn("all", F.sum("n").over(Window.partitionBy(*by)))
    low, high = F.floor((F.col("all") + 1) / 2), F.floor(F.col("all") / 2) + 1
    first = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    return rows.groupBy(*by).agg(((first(low) + first(high)) / 2).alias("median"))


def thin_roads(walk: DataFrame, zoom: int, by: By = ()) -> DataFrame:
    """Add ``thin`` to walk cells (kind, width): 1 on minor roads that are narrow for their grid.

    From zoom 16 on, narrow is up to 1.2 times the median width of the grid's minor
    roads; below, or where that is 0 or unknown, it is having no larger road within two cells.
    """
    from gridstride.functions import fixed

    minor, large = F.col("kind") == fixed.KINDS["MINOR"], F.col("kind").isin(fixed.KINDS["SECONDARY"], fixed.KINDS["MAJOR"])
    rows = _box(walk.withColumn("_large", large.cast("int")), "_large", F.max, 2, by)
    alone = minor & (F.col("_large") == 0)
    if zoom < 16:
        return rows.withColumn("thin", alone.cast("int")).drop("_large")
    middle = median(walk.where(minor), by, "width")
    rows = rows.join(middle, list(by), "left") if by else rows.crossJoin(F.broadcast(middle))  # one row
    narrow = F.when(F.coalesce(F.col("median"), F.lit(0.0)) > 0, minor & (F.col("width") <= fixed.THIN_FACTOR * F.col("median"))).otherwise(alone)
    return rows.withColumn("thin", narrow.cast("int")).drop("_large", "median")


def box_mean(cells: DataFrame, value: str, reach: int, out: str, by: By = ()) -> DataFrame:
    """The mean over the clipped square around each cell, from sums and counts along rows, then columns."""
    both = cells.withColumn("_s", F.col(value)).withColumn("_n", F.lit(1))
    both = _box(_box(both, "_s", F.sum, reach, by), "_n", F.sum, reach, by)
    return both.withColumn(out, F.col("_s") / F.col("_n")).drop("_s", "_n")


def summed_area(cells: DataFrame, value: str, by: By = ()) -> DataFrame:
    """Summed-area table: cumulative sums along rows, then columns."""
    upto = (Window.unboundedPreceding, 0)
    once = cells.withColumn("sat", F.sum(value).over(along_x(by).rowsBetween(*upto)))
    return once.withColumn("sat", F.sum("sat").over(along_y(by).rowsBetween(*upto)))


def summed_areas(cells: DataFrame, values: list[str], by: By = ()) -> DataFrame:
    """The same for several columns at once, each replaced by its table."""
    upto = (Window.unboundedPreceding, 0)
    once = cells.withColumns({v: F.sum(v).over(along_x(by).rowsBetween(*upto)) for v in values})
    return once.withColumns({v: F.sum(v).over(along_y(by).rowsBetween(*upto)) for v in values})


def beside(cells: DataFrame, mask: str, other: str, by: By = ()) -> DataFrame:
    """Cells of the mask with a 4-neighbour in the other mask."""
    flags = [F.coalesce(f(other).over(w), F.lit(0)) for f in (F.lag, F.lead) for w in (along_x(by), along_y(by))]
    return cells.withColumn("_near", F.greatest(*flags)).where((F.col(mask) == 1) & (F.col("_near") == 1)).drop("_near")
