"""Views of the driver tables on which the operators' queries run, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, v): one cell for each component of each vector."""
    table = load(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return table.select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v")).select("y", F.col("x").cast("long").alias("x"), F.col("v").cast("double").alias("v"))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(req, y, x, v): the same cells as grids of 64 rows, one for each request."""
    return grid(spark, sf_dir).select(F.floor(F.col("y") / 64).alias("req"), (F.col("y") % 64).alias("y"), "x", "v")


GRID = """grid AS (
    SELECT vec_id AS y, CAST(i - 1 AS BIGINT) AS x, CAST(embedding[i] AS DOUBLE) AS v
    FROM embeddings, range(1, 65) r(i) WHERE i <= len(embedding)
)"""
GRIDS = GRID.replace("vec_id AS y", "vec_id // 64 AS req, vec_id % 64 AS y")


def masks(cells: DataFrame) -> DataFrame:
    return cells.select(*[c for c in ("req",) if c in cells.columns], "y", "x", "v", (F.col("v") > -0.08).cast("int").alias("walk"), (F.col("v") > 0.15).cast("int").alias("green"), (F.col("v") < -0.15).cast("int").alias("water"))


MASKS = "masks AS (SELECT *, CAST(v > -0.08 AS INT) AS walk, CAST(v > 0.15 AS INT) AS green, CAST(v < -0.15 AS INT) AS water FROM grid)"


def dem(cells: DataFrame) -> DataFrame:
    """(y, x, h): elevations, null where missing."""
    return cells.select(*[c for c in ("req",) if c in cells.columns], "y", "x", F.when(~((F.col("y") % 17 == 0) & (F.col("x") % 13 == 0)), 50 + 100 * F.col("v")).alias("h"))


DEM = "dem AS (SELECT * EXCLUDE (v), CASE WHEN NOT (y % 17 = 0 AND x % 13 = 0) THEN 50 + 100 * v END AS h FROM grid)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    return load(spark, sf_dir, "customer").select(key.alias("id"), (33 + (key % 997) * 0.005).alias("lat"), (126 + (key * 7) % 991 * 0.003).alias("lng"))


POINTS = "pts AS (SELECT c_custkey AS id, 33 + (c_custkey % 997) * 0.005::DOUBLE AS lat, 126 + ((c_custkey * 7) % 991) * 0.003::DOUBLE AS lng FROM customer)"


def paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, i, lat, lng): each user's events as a path."""
    from pyspark.sql import Window

    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return load(spark, sf_dir, "events").select("user_id", order.alias("i"), (37.5 + F.col("value") / 10000.0).alias("lat"), (126.9 + F.col("event_id") % 1000 / 10000.0).alias("lng"))


PATHS = """path AS (
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i,
        37.5::DOUBLE + value / 10000::DOUBLE AS lat, 126.9::DOUBLE + (event_id % 1000) / 10000::DOUBLE AS lng
    FROM events
)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate stop for each order with lines: cell, d, bearing, kind, category and the features."""
    lines = load(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("returned"), F.count_if(F.col("l_linestatus") == "O").alias("open_lines"),
        F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"),
    )
    key, cust, n = F.col("o_orderkey"), F.col("o_custkey"), F.col("n").cast("double")
    kinds = F.array(*map(F.lit, ["green", "shore", "built", "road", "icon"]))
    categories = F.array(*map(F.lit, ["park", "mountain", "water", "building", "culture", "shop", "cafe", "transport", "other"]))
    kind = kinds[F.substring("o_orderpriority", 1, 1).cast("int") - 1]
    table = load(spark, sf_dir, "orders").join(lines, key == F.col("l_orderkey"))
    return table.select(
        key.alias("cell"), (F.col("o_totalprice") / 500).alias("d"), F.radians((cust * 37 % 360 - 180).cast("double")).alias("bearing"), kind.alias("kind"),
        F.when(kind == "icon", categories[(cust % 9).cast("int")]).alias("category"),
        (F.col("discount") / 0.1).alias("green"), (F.col("tax") / 0.08).alias("open"), (F.col("returned") / n).alias("water"), F.when(cust % 7 == 0, 1.0).otherwise(0.0).alias("waterNear"),
        F.least(F.col("quantity") / (50 * n), F.lit(1.0)).alias("built"), (key % 11 / 40.0).alias("major"), (key % 13 / 60.0).alias("secondary"), (F.col("open_lines") / n).alias("minor"),
        (key % 2).cast("double").alias("thin"), F.when(cust % 9 == 0, 0.2).otherwise(0.0).alias("path"), F.least(n / 7.0, F.lit(1.0)).alias("minorDensity"), (cust % 10 / 20.0).alias("elevGain"),
        F.when(key % 17 == 0, -1.0).otherwise(key % 19 / 100.0).alias("slope"),
    )


CANDIDATES = """lines AS (
    SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS returned, count(*) FILTER (l_linestatus = 'O') AS open_lines,
        sum(l_quantity) AS quantity, avg(l_discount) AS discount, avg(l_tax) AS tax
    FROM lineitem GROUP BY l_orderkey
), cand AS (
    SELECT o_orderkey AS cell, o_totalprice / 500 AS d, radians(((o_custkey * 37) % 360 - 180)::DOUBLE) AS bearing,
        ['green', 'shore', 'built', 'road', 'icon'][CAST(substr(o_orderpriority, 1, 1) AS INT)] AS kind,
        CASE WHEN substr(o_orderpriority, 1, 1) = '5' THEN
            ['park', 'mountain', 'water', 'building', 'culture', 'shop', 'cafe', 'transport', 'other'][CAST(o_custkey % 9 + 1 AS INT)] END AS category,
        discount / 0.1::DOUBLE AS green, tax / 0.08::DOUBLE AS open, returned / n::DOUBLE AS water, CASE WHEN o_custkey % 7 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS "waterNear",
        least(quantity / (50 * n::DOUBLE), 1.0::DOUBLE) AS built, (o_orderkey % 11) / 40.0::DOUBLE AS major, (o_orderkey % 13) / 60.0::DOUBLE AS secondary, open_lines / n::DOUBLE AS minor,
        (o_orderkey % 2)::DOUBLE AS thin, CASE WHEN o_custkey % 9 = 0 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END AS path, least(n / 7.0::DOUBLE, 1.0::DOUBLE) AS "minorDensity", (o_custkey % 10) / 20.0::DOUBLE AS "elevGain",
        CASE WHEN o_orderkey % 17 = 0 THEN -1.0::DOUBLE ELSE (o_orderkey % 19) / 100.0::DOUBLE END AS slope
    FROM orders JOIN lines ON o_orderkey = l_orderkey
)"""
