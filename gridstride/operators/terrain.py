"""Elevation: tiles to a field, the field onto another grid's cells, and the climb along lines.

A field is (req, y, x, h) of pixels, null where unknown. How it lies under a map
image is linear: both are pixels of the same projection at other zooms. So cells are put
on it by one scale and offset, without angles, and each cell is joined once with
the square of pixels around it, whose four corners a row holds.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstride.functions import fixed
from gridstride.functions.geo import clamp, metres_per_pixel, world_x, world_y
from gridstride.operators import paths as P
from gridstride.operators import stencils as S
from gridstride.sources import tiles

BY = ["req"]
#: Metres between the samples of a path, metres of a swing that count.
SAMPLE_M, HYSTERESIS_M = 30.0, 8.0


def mosaic(pixels: DataFrame, requests: DataFrame) -> DataFrame:
    """(req, y, x, h): the field of each request (req, field_x0, field_y0, field_px: its first tile, a tile's side) from the pixels of its tiles (req, ty, tx, y, x, r, g, b, a).

    Transparent pixels and those of tiles that are not there are unknown.
    """
    at = lambda tile, first, pixel: ((F.col(tile) - F.col(first)) * F.col("field_px") + F.col(pixel)).cast("long")
    rows = pixels.join(requests.select("req", "field_x0", "field_y0", "field_px"), "req")
    return rows.select("req", at("ty", "field_y0", "y").alias("y"), at("tx", "field_x0", "x").alias("x"), tiles.elevation("r", "g", "b", "a").alias("h"))


def placed(requests: DataFrame) -> DataFrame:
    """Add ``scale``, ``off_y``, ``off_x`` (image pixels to field pixels) and ``field_m`` (a field pixel's metres) to requests.

    Read: lat, zoom, x0, y0, tile_px of the image, and field_zoom, field_x0, field_y0, field_px.
    """
    scale = F.pow(F.lit(2.0), F.col("field_zoom")) * F.col("field_px") / (F.pow(F.lit(2.0), F.col("zoom")) * F.col("tile_px"))
    off = lambda first: F.col(first) * F.col("tile_px") * scale - F.col(f"field_{first}") * F.col("field_px")
    return requests.withColumns({"scale": scale, "off_y": off("y0"), "off_x": off("x0"), "field_m": metres_per_pixel("lat", F.col("field_zoom"), F.col("field_px"))})


def corners(field: DataFrame, values: Sequence[str], by: Sequence[str] = BY) -> DataFrame:
    """(by, y, x, p): each pixel with its values and those of the pixels to its right and below, as p.right, p.down, p.both; null beyond the border."""
    own = F.struct(*values)
    rows = field.withColumn("own", own).withColumn("right", F.lead("own").over(S.along_x(by)))
    rows = rows.withColumn("_row", F.struct("own", "right")).withColumn("_below", F.lead("_row").over(S.along_y(by)))
    return rows.select(*by, "y", "x", F.struct("own", "right", F.col("_below.own").alias("down"), F.col("_below.right").alias("both")).alias("p"))


def sampled(points: DataFrame, field: DataFrame, values: Sequence[str], by: Sequence[str] = BY) -> DataFrame:
    """Add the values of dense fields at points (fx, fy; pixel centres at halves): the known corners' weighted mean, null outside or if none is known.

    One join for all four corners. Beyond the outermost centres the border's pixel counts alone.
    """
    size = field.groupBy(*by).agg((F.max("y") + 1).alias("_h"), (F.max("x") + 1).alias("_w"))
    rows = points.join(size, [*by], "left")
    inside = (F.col("fx") >= 0) & (F.col("fx") < F.col("_w")) & (F.col("fy") >= 0) & (F.col("fy") < F.col("_h"))
    for axis, most in (("x", "_w"), ("y", "_h")):
        u = F.col(f"f{axis}") - 0.5
        low = F.floor(u)
        rows = rows.withColumn(f"_{axis}", F.when(inside, F.greatest(F.lit(0).cast("long"), low))).withColumn(f"_t{axis}", F.when((low < 0) | (low >= F.col(most) - 1), 0.0).otherwise(u - low))
    square = corners(field, values, by).withColumnsRenamed({"y": "_y", "x": "_x"})
    rows = rows.join(square, [*by, "_y", "_x"], "left")
    tx, ty = F.col("_tx"), F.col("_ty")
    weights = {"own": (1 - tx) * (1 - ty), "right": tx * (1 - ty), "down": (1 - tx) * ty, "both": tx * ty}

    def mean(value: str) -> Column:
        known = [(w, F.col(f"p.{c}.{value}")) for c, w in weights.items()]
        total = sum((F.when(v.isNotNull(), w).otherwise(0.0) for w, v in known), F.lit(0.0))
        return F.when(total > 0, sum((F.coalesce(v * w, F.lit(0.0)) for w, v in known), F.lit(0.0)) / total)

    return rows.withColumns({v: mean(v) for v in values}).drop("p", "_h", "_w", "_x", "_y", "_tx", "_ty")


def relief(field: DataFrame, requests: DataFrame, down: int | Column) -> DataFrame:
    """(req, y, x, elev, slope): the smoothed field and its slope at the centre of each cell of ``down`` image pixels.

    ``requests``: as ``placed`` gives them, with gh and gw, their cells. ``slope`` is a share of
    ``SLOPE_NORM``, at most 1. Both are null where the field is unknown or ends.
    """
    smooth = S.smoothed(field.select("req", "y", "x", "h"), "h", BY)
    steep = S.slope(smooth.join(requests.select("req", "field_m"), "req"), "h", F.col("field_m"), BY).select("req", "y", "x", "h", "slope")
    down = F.lit(down) if isinstance(down, int) else down
    sequence = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1))
    cells = requests.where("gh > 0 and gw > 0").select("*", sequence("gh").alias("y")).select("*", sequence("gw").alias("x"))
    on = lambda c: (F.col(c) * down + down / 2) * F.col("scale") + F.col(f"off_{c}")
    points = cells.select("req", "y", "x", on("x").alias("fx"), on("y").alias("fy"))
    found = sampled(points, steep, ["h", "slope"])
    return found.select("req", "y", "x", F.col("h").alias("elev"), F.when(F.col("slope").isNotNull(), clamp(F.col("slope") / fixed.SLOPE_NORM, 0.0, 1.0)).alias("slope"))


def climbed(path: DataFrame, field: DataFrame, requests: DataFrame, every_m: float = SAMPLE_M) -> DataFrame:
    """(req, ascent_m): metres climbed along each request's path (req, i, lat, lng), read from its smoothed field each ``every_m`` metres.

    Samples have their place by the distance along the path, so long paths are no single
    group; swings of up to ``HYSTERESIS_M`` metres do not count. Null where no sample is known.
    """
    samples = P.sampled(path, "req", every_m).join(requests.select("req", "field_zoom", "field_x0", "field_y0", "field_px"), "req")
    zoom, side = F.col("field_zoom"), F.col("field_px")
    points = samples.select("req", "n", (world_x("lng", zoom, side) - F.col("field_x0") * side).alias("fx"), (world_y("lat", zoom, side) - F.col("field_y0") * side).alias("fy"))
    found = sampled(points, S.smoothed(field.select("req", "y", "x", "h"), "h", BY), ["h"])
    return P.ascent(found, "req", "n", "h", HYSTERESIS_M)
