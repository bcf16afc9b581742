"""Pixels to classes to cells."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridstride.functions import fixed

DARK, PALE = 140, (232, 224, 208)
CONFLICT = 255


def palette(spark: SparkSession) -> DataFrame:
    """(n, cls, tol, zooms, r, g, b) of each colour anchor."""
    rows, n = [], 0
    for name, tolerance, zooms, colours in fixed.PALETTE:
        for colour in colours.split():
            r, g, b = bytes.fromhex(colour)
            rows.append((n, fixed.CLASSES[name], tolerance, list(zooms) if zooms else None, r, g, b))
            n += 1
    return spark.createDataFrame(rows, "n long, cls int, tol int, zooms array<int>, r int, g int, b int")


def key(r: str, g: str, b: str) -> F.Column:
    """Seven bits of each channel."""
    return F.shiftright(r, 1) * 16384 + F.shiftright(g, 1) * 128 + F.shiftright(b, 1)


def lookup_table(anchors: DataFrame, zoom: int) -> DataFrame:
    """(key, cls): the class of each seven-bit colour near an anchor; CONFLICT where anchors of one rank disagree.

    Exact anchors outrank the boxes around anchors.
    """
    active = anchors.where(F.col("zooms").isNull() | F.array_contains("zooms", zoom))
    shell = active
    for c in "rgb":
        shell = shell.withColumn(c, F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - F.col("tol")), F.least(F.lit(255), F.col(c) + F.col("tol")))))
    both = active.select(key("r", "g", "b").alias("key"), "cls", F.lit(0).alias("rank")).union(shell.select(key("r", "g", "b").alias("key"), "cls", F.lit(1).alias("rank")))
    one = both.groupBy("key", "rank").agg(F.min("cls").alias("low"), F.max("cls").alias("high"))
    best = one.groupBy("key").agg(F.min_by(F.struct("low", "high"), "rank").alias("best"))
    return best.select("key", F.when(F.col("best.low") == F.col("best.high"), F.col("best.low")).otherwise(CONFLICT).alias("cls"))


def classify(pixels: DataFrame, table: DataFrame) -> DataFrame:
    """Add cls to pixels (r, g, b, a). The table is bounded by the palette and is broadcast."""
    found = pixels.withColumn("key", key("r", "g", "b")).join(F.broadcast(table.withColumnRenamed("cls", "hit")), "key", "left")
    pale = (F.col("r") >= PALE[0]) & (F.col("g") >= PALE[1]) & (F.col("b") >= PALE[2]) & (F.col("r") >= F.col("g")) & (F.col("g") >= F.col("b"))
    cls = F.when((F.col("a") < 128) | (F.greatest("r", "g", "b") < DARK), 0).when(F.col("hit").isNull(), F.when(pale, fixed.CLASSES["LAND"]).otherwise(0)).when(F.col("hit") == CONFLICT, 0).otherwise(F.col("hit"))
    return found.withColumn("cls", cls).drop("key", "hit")


def unknown_colours(classified: DataFrame, width: int, k: int = 10) -> DataFrame:
    """The k most frequent unknown colours of every fourth opaque pixel: colour, n, share."""
    sample = classified.where((F.col("y") * width + F.col("x")) % 4 == 0).where("a >= 128")
    total = sample.agg(F.count("*").alias("total"))
    colour = F.col("r") * 65536 + F.col("g") * 256 + F.col("b")
    top = sample.where("cls = 0").groupBy(colour.alias("colour")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "colour").limit(k)
    return top.crossJoin(F.broadcast(total)).select(F.concat(F.lit("#"), F.lower(F.lpad(F.hex(F.col("colour").cast("long")), 6, "0"))).alias("colour"), "n", (F.col("n") / F.col("total")).alias("share"))


def road_classes(zoom: int) -> list[int]:
    names = ["MAJOR", "MINOR", "PATH"] + (["SEC_CASE", "MINOR_CASE"] if zoom >= 15 else [])
    return sorted(fixed.CLASSES[n] for n in names)


def downsample(zoom: int) -> int:
    return 4 if zoom >= 17 else 3


def road_threshold(zoom: int) -> float:
    return 0.2 if zoom >= 15 else 0.34


def cells(classified: DataFrame, zoom: int, by: Sequence[str] = ()) -> DataFrame:
    """Aggregate pixels to cells: the columns ``by``, y, x, a byte fraction f0..f13 of each class, road (byte) and road_cell."""
    down, n = downsample(zoom), len(fixed.CLASSES)
    counts = classified.groupBy(*by, F.floor(F.col("y") / down).alias("y"), F.floor(F.col("x") / down).alias("x")).agg(F.count("*").alias("area"), *[F.count_if(F.col("cls") == c).alias(f"n{c}") for c in range(n)])
    byte = lambda count: F.floor(count * 255 / F.col("area") + 0.5)
    road = sum((F.col(f"n{c}") for c in road_classes(zoom)), F.lit(0))
    return counts.select(*by, "y", "x", *[byte(F.col(f"n{c}")).alias(f"f{c}") for c in range(n)], byte(road).alias("road"), (road / F.col("area") >= road_threshold(zoom)).cast("int").alias("road_cell"))


def fraction_mask(classes: list[str], least: float = 0.5) -> F.Column:
    return (sum((F.col(f"f{fixed.CLASSES[c]}") for c in classes), F.lit(0)) / 255 >= least).cast("int")


def walk_kind() -> F.Column:
    """The walk kind of a cell, by its class fractions."""
    f = lambda c: F.col(f"f{fixed.CLASSES[c]}")
    k = fixed.KINDS
    road = F.when(f("MAJOR") > 0, k["MAJOR"]).when(f("SEC_CASE") > 0, k["SECONDARY"]).when(f("PATH") > f("MINOR"), k["PATH"]).otherwise(k["MINOR"])
    return F.when(f("TRUNK") >= 0.15 * 255, k["TRUNK"]).when(F.col("road_cell") == 1, road).otherwise(k["NONE"])


def passable() -> F.Column:
    """Whether a walk kind can be walked on: all but no road and trunk roads."""
    return (~F.col("kind").isin(fixed.KINDS["NONE"], fixed.KINDS["TRUNK"])).cast("int")


def classified_share(classified: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, pixels, missing, classified): the share of pixels whose class is known, those of missing tiles (a column ``missing``, if there is one) left out; null if none is left.

    A transparent pixel of a tile that is there is unknown.
    """
    lost = F.coalesce(F.col("missing"), F.lit(False)) if "missing" in classified.columns else F.lit(False)
    known = F.count_if(~lost & (F.col("cls") != 0)) / F.nullif(F.count_if(~lost), F.lit(0))
    return classified.groupBy(*by).agg(F.count("*").alias("pixels"), F.count_if(lost).alias("missing"), known.alias("classified"))


def road_pixels(classified: DataFrame, zoom: int) -> DataFrame:
    """Add ``road``: whether a pixel's class is a road's."""
    return classified.withColumn("road", F.col("cls").isin(road_classes(zoom)).cast("int"))


def first_of(table: DataFrame, by: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return table.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
