"""Queries over the driver tables for each operator, with the same in SQL for DuckDB."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstride.functions import fixed
from gridstride.functions.geo import clamp, half_up, haversine, lat_of, lng_of, metres_per_pixel, world_x, world_y
from gridstride.operators import candidates as C
from gridstride.operators import course
from gridstride.operators import graph as G
from gridstride.operators import paths as P
from gridstride.operators import pixels as X
from gridstride.operators import planning as L
from gridstride.operators import stencils as S
from gridstride.operators import terrain as T
from gridstride.plans import fixtures as V
from gridstride.sources import tiles
from gridstride.streaming import limiter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
PI, R = f"{math.pi!r}::DOUBLE", "6371008.8::DOUBLE"


def query(sql: str | None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n).cast("double"), digits) for n in names})


def with_(*views: str) -> str:
    return "WITH " + ",\n".join(views) + "\n"


# ---- candidates -------------------------------------------------------------------------------


def _sql_score(tag: str) -> str:
    return " + ".join(f'"{f}" * ({w!r}::DOUBLE)' for f, w in fixed.SCORE_WEIGHTS[tag].items())


SQL_MATCH = {
    "nature": "kind = 'green' OR coalesce(category, '') IN ('green', 'mountain') OR green >= 0.12",
    "river": "kind = 'shore' OR coalesce(category, '') = 'water' OR \"waterNear\" > 0",
    "urban": "kind = 'built' OR coalesce(category, '') IN ('building', 'culture') OR built >= 0.1",
    "cafe": "coalesce(category, '') = 'cafe'",
    "hill": "coalesce(category, '') = 'mountain' OR \"elevGain\" >= 0.15",
    "flat": "slope >= 0 AND slope < 0.08",
    "alley": "thin > 0 AND major < 0.1",
    "quiet": "(green >= 0.1 OR path > 0) AND major < 0.08",
    "lively": "coalesce(category, '') IN ('shop', 'culture') OR (built >= 0.1 AND major + secondary > 0)",
    "night": "\"waterNear\" > 0 OR built >= 0.1",
}
TAGGED = "tagged AS (" + " UNION ALL ".join(f"SELECT cell, kind, d, bearing, '{t}' AS tag, {_sql_score(t)} AS score FROM cand WHERE {SQL_MATCH[t]}" for t in fixed.SCORE_WEIGHTS) + ")"
MATCHED = "matched AS (SELECT *, list_filter([" + ", ".join(f"CASE WHEN {m} THEN '{t}' END" for t, m in SQL_MATCH.items()) + "], lambda t: t IS NOT NULL) AS tags FROM cand)"
ORDER = "round(score, 9) DESC, d, cell"


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    return C.scored_by_tag(V.candidates(spark, d)).withColumn("score", F.round("score", 9))


@query(with_(V.CANDIDATES, TAGGED) + f"""SELECT tag, kind, CAST(n AS INT) AS rank, cell, round(d, 6) AS d, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY tag, kind ORDER BY {ORDER}) AS n FROM tagged) WHERE n <= 5""")
def best_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The five best candidates of each tag and kind."""
    best = C.top(_tagged(spark, d), ["tag", "kind"])
    return rounded(best.select("tag", "kind", "rank", "cell", "d", "score"), "d", "score")


@query(with_(V.CANDIDATES, MATCHED) + """SELECT cell, array_to_string(list_sort(tags), ',') AS tags, len(tags) AS n FROM matched""")
def matching_tags(spark: SparkSession, d: str) -> DataFrame:
    return V.candidates(spark, d).select("cell", F.array_sort(C.matching_tags()).alias("t")).select("cell", F.array_join("t", ",").alias("tags"), F.size("t").cast("long").alias("n"))


@query(with_(V.CANDIDATES, MATCHED) + """SELECT cell, array_to_string(list_sort(list_filter(tags, lambda t: t IN ('cafe', 'river'))), ',') AS matched
FROM matched WHERE list_has_any(tags, ['cafe', 'river'])""")
def filtered_candidates(spark: SparkSession, d: str) -> DataFrame:
    return C.filtered(V.candidates(spark, d), ["cafe", "river", "cafe"]).select("cell", F.array_join(F.array_sort("matched"), ",").alias("matched"))


@query(with_(V.CANDIDATES, MATCHED) + """, found AS (SELECT DISTINCT unnest(tags) AS t FROM matched WHERE kind = 'road')
SELECT (SELECT count(*) FROM matched WHERE kind = 'road' AND NOT list_contains(tags, 'cafe')) AS without_cafe, string_agg(w, ',' ORDER BY w) AS missing
FROM (VALUES ('cafe'), ('hill'), ('nowhere')) v(w) WHERE w NOT IN (SELECT t FROM found)""")
def missing_tags(spark: SparkSession, d: str) -> DataFrame:
    roads = V.candidates(spark, d).where("kind = 'road'")
    counts = roads.agg(F.count_if(~F.array_contains(C.matching_tags(), "cafe")).alias("without_cafe"))
    return counts.crossJoin(C.missing_tags(roads, ["cafe", "hill", "nowhere"]).select(F.array_join("missing", ",").alias("missing")))  # one row each


def _sql_band(name: str, target: float, scale: float = 1.0) -> str:
    low, high = C.band(name, target, scale)
    return f"d BETWEEN {low!r}::DOUBLE AND {high!r}::DOUBLE"


SQL_WRAP = f"(bearing - 0.5::DOUBLE - 2 * {PI} * floor((bearing - 0.5::DOUBLE + {PI}) / (2 * {PI})))"


@query(with_(V.CANDIDATES) + f"""SELECT kind, count(*) FILTER ({_sql_band('turn', 2000)}) AS turn, count(*) FILTER ({_sql_band('widen', 2000)}) AS widen,
    count(*) FILTER ({_sql_band('side', 2000, 0.9)} AND {SQL_WRAP} BETWEEN radians(50::DOUBLE) AND radians(110::DOUBLE)) AS side_plus,
    count(*) FILTER ({_sql_band('side', 2000, 0.9)} AND -{SQL_WRAP} BETWEEN radians(50::DOUBLE) AND radians(110::DOUBLE)) AS side_minus,
    count(*) FILTER ({_sql_band('mid', 2000)} AND {SQL_WRAP} BETWEEN radians(10::DOUBLE) AND radians(40::DOUBLE)) AS mid_plus FROM cand GROUP BY kind""")
def band_counts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates in distance bands and bearing sectors."""
    side = C.in_band("side", 2000, 0.9)
    counts = {"turn": C.in_band("turn", 2000), "widen": C.in_band("widen", 2000), "side_plus": side & C.in_sector(0.5, 1, fixed.SIDE_SECTOR), "side_minus": side & C.in_sector(0.5, -1, fixed.SIDE_SECTOR), "mid_plus": C.in_band("mid", 2000) & C.in_sector(0.5, 1, fixed.MID_SECTOR)}
    return V.candidates(spark, d).groupBy("kind").agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


@query(with_(V.CANDIDATES, TAGGED) + f"""SELECT tag, cell FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY upto) AS n FROM (
    SELECT *, sum(w) OVER (PARTITION BY tag ORDER BY {ORDER} ROWS UNBOUNDED PRECEDING) AS upto, sum(w) OVER (PARTITION BY tag) AS whole FROM (
        SELECT *, exp((round(score, 9) - max(round(score, 9)) OVER (PARTITION BY tag)) / 0.5::DOUBLE) AS w FROM (
            SELECT *, row_number() OVER (PARTITION BY tag ORDER BY {ORDER}) AS r FROM tagged) WHERE r <= 5)) WHERE 0.37::DOUBLE * whole < upto) WHERE n = 1""")
def softmax_pick(spark: SparkSession, d: str) -> DataFrame:
    return C.softmax_pick(C.top(_tagged(spark, d), ["tag"]), ["tag"], F.lit(0.37)).select("tag", "cell")


@query(with_(V.CANDIDATES) + f"""SELECT cell FROM cand WHERE kind IN ('green', 'icon') UNION ALL
SELECT cell FROM (SELECT cell, row_number() OVER (ORDER BY round({_sql_score('nature')}, 9) DESC, d, cell) AS n FROM cand WHERE kind NOT IN ('green', 'icon'))
WHERE n <= greatest(0, 9000 - (SELECT count(*) FROM cand WHERE kind IN ('green', 'icon')))""")
def capped_candidates(spark: SparkSession, d: str) -> DataFrame:
    return C.capped(V.candidates(spark, d).withColumn("score", F.round(C.score(["nature"]), 9)), 9000).select("cell")


@query(with_(V.CANDIDATES) + "SELECT kind, cell FROM (SELECT kind, cell, row_number() OVER (PARTITION BY kind ORDER BY cell) - 1 AS n FROM cand) WHERE n % 7 = 0")
def systematic_sample(spark: SparkSession, d: str) -> DataFrame:
    return C.systematic(V.candidates(spark, d), ["kind"], 7).select("kind", "cell")


@query(with_(V.CANDIDATES) + "SELECT kind, arg_min(cell, {'e': abs(d - 0.3::DOUBLE * 2000), 'c': cell}) AS cell FROM cand GROUP BY kind")
def turn_fallback(spark: SparkSession, d: str) -> DataFrame:
    return C.turn_fallback(V.candidates(spark, d), ["kind"], 2000).select("kind", "cell")


@query(with_(V.CANDIDATES) + """SELECT cell, kind FROM (SELECT cell, kind, row_number() OVER (PARTITION BY cell ORDER BY p) AS n FROM (
    SELECT cell % 5000 AS cell, kind, 0 AS p FROM cand WHERE kind = 'icon' UNION ALL SELECT cell, kind, 1 FROM cand WHERE kind = 'green' UNION ALL
    SELECT DISTINCT cell - cell % 3, 'shore', 2 FROM cand WHERE kind = 'shore' UNION ALL SELECT DISTINCT cell - cell % 5, 'built', 3 FROM cand WHERE kind = 'built')) WHERE n = 1""")
def first_generator_wins(spark: SparkSession, d: str) -> DataFrame:
    """Candidate generators in priority order, one row per cell."""
    cand = V.candidates(spark, d).select("cell", "kind")
    parts = [cand.where("kind = 'icon'").withColumn("cell", F.col("cell") % 5000), cand.where("kind = 'green'")]
    parts += [cand.where(F.col("kind") == k).select((F.col("cell") - F.col("cell") % m).alias("cell"), "kind").distinct() for k, m in (("shore", 3), ("built", 5))]
    return C.first_wins(parts)


WEIGHTS = ", ".join(f"('{t}', '{f}', {w!r}::DOUBLE)" for t, ws in fixed.COST_WEIGHTS.items() for f, w in ws.items())


@query(f"""WITH w(tag, field, weight) AS (VALUES {WEIGHTS}), reqs AS (
    SELECT DISTINCT user_id AS id, unnest(['nature', 'unknown', CASE WHEN user_id % 2 = 0 THEN 'alley' ELSE 'night' END, CASE WHEN user_id % 3 = 0 THEN 'flat' ELSE 'lively' END]) AS tag FROM events)
SELECT id, field, round(sum(weight), 6) AS weight FROM reqs JOIN w USING (tag) GROUP BY ALL""")
def theme_cost_weights(spark: SparkSession, d: str) -> DataFrame:
    """Summed cost weights of each request's tags."""
    user = F.col("id")
    tags = F.array(F.lit("nature"), F.lit("unknown"), F.when(user % 2 == 0, "alley").otherwise("night"), F.when(user % 3 == 0, "flat").otherwise("lively"))
    reqs = V.load(spark, d, "events").select(F.col("user_id").alias("id")).distinct().select("id", tags.alias("tags"))
    return rounded(C.summed_weights(reqs, C.weight_table(spark, fixed.COST_WEIGHTS, fixed.COST_FIELDS)), "weight")


LABELS = ", ".join(f"('{t}', '{v}')" for t, v in fixed.TAG_LABELS.items())


@query(f"""WITH l(tag, label) AS (VALUES {LABELS}), reqs AS (SELECT DISTINCT user_id AS id, ['urban', 'unknown', CASE WHEN user_id % 2 = 0 THEN 'hill' ELSE 'river' END, 'cafe'] AS tags FROM events),
one AS (SELECT id, i, label FROM reqs, range(1, 5) r(i) JOIN l ON l.tag = reqs.tags[i])
SELECT id, string_agg(label, ', ' ORDER BY i) AS labels, string_agg(label, ' ' ORDER BY i) FILTER (n <= 2) || ' 산책' AS title
FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM one) GROUP BY id""")
def tag_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the tags in their order, and a title of the first two."""
    user = F.col("id")
    table = spark.createDataFrame(list(fixed.TAG_LABELS.items()), "tag string, label string")
    reqs = V.load(spark, d, "events").select(F.col("user_id").alias("id")).distinct().select("id", F.posexplode(F.array(F.lit("urban"), F.lit("unknown"), F.when(user % 2 == 0, "hill").otherwise("river"), F.lit("cafe"))).alias("i", "tag"))
    joined = reqs.join(F.broadcast(table), "tag").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "label"))), lambda s: s["label"]).alias("l"))
    return joined.select("id", F.array_join("l", ", ").alias("labels"), F.concat(F.array_join(F.slice("l", 1, 2), " "), F.lit(" 산책")).alias("title"))


# ---- projection and planning ------------------------------------------------------------------

REQS = V.POINTS + ", req AS (SELECT id, lat, lng, unnest([15, 30, 60, 120]) AS minutes FROM pts)"
SQL_WX = "((lng + 180) / 360 * pow(2::DOUBLE, z) * {t})"
SQL_WY = f"((0.5::DOUBLE - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * {PI})) * pow(2::DOUBLE, z) * {{t}})"
SQL_MPP = "(156543.03392804097::DOUBLE * cos(radians(lat)) / pow(2::DOUBLE, z) * 0.5::DOUBLE)"


def _requests(spark: SparkSession, d: str) -> DataFrame:
    return V.points(spark, d).withColumn("minutes", F.explode(F.array(*map(F.lit, [15, 30, 60, 120]))))


@query(with_(V.POINTS) + f""", p AS (SELECT *, 16 AS z FROM pts), w AS (SELECT *, {SQL_WX.format(t=512)} AS wx, {SQL_WY.format(t=512)} AS wy FROM p)
SELECT id, round(wx, 4) AS wx, round(wy, 4) AS wy, CAST(floor(wx / 512) AS BIGINT) AS tx, CAST(floor(wy / 512) AS BIGINT) AS ty, round({SQL_MPP}, 8) AS mpp,
    round(wx / (65536 * 512::DOUBLE) * 360 - 180, 6) AS lng2, round(degrees(atan((exp({PI} - 2 * {PI} * wy / (65536 * 512::DOUBLE)) - exp(-({PI} - 2 * {PI} * wy / (65536 * 512::DOUBLE)))) / 2)), 6) AS lat2 FROM w""")
def projection(spark: SparkSession, d: str) -> DataFrame:
    z = F.lit(16)
    w = V.points(spark, d).withColumn("wx", world_x("lng", z, 512)).withColumn("wy", world_y("lat", z, 512))
    out = w.select("id", "wx", "wy", F.floor(F.col("wx") / 512).alias("tx"), F.floor(F.col("wy") / 512).alias("ty"), metres_per_pixel("lat", z, 512).alias("mpp"), lng_of("wx", z, 512).alias("lng2"), lat_of("wy", z, 512).alias("lat2"))
    return rounded(rounded(rounded(out, "wx", "wy", digits=4), "mpp", digits=8), "lng2", "lat2")


PLAN = f"""base AS (SELECT *, CASE minutes WHEN 15 THEN 17 WHEN 30 THEN 16 WHEN 60 THEN 15 ELSE 14 END AS z, 2.2::DOUBLE * (minutes / 60::DOUBLE * 4000) / (2 * {PI}) AS half_m FROM req),
w AS (SELECT *, {SQL_MPP} AS mpp, {SQL_WX.format(t=512)} AS wx, {SQL_WY.format(t=512)} AS wy FROM base),
r AS (SELECT *, greatest(0, floor((wx - half_m / mpp) / 512))::BIGINT AS xlo, least(pow(2, z) - 1, floor((wx + half_m / mpp) / 512))::BIGINT AS xhi,
    greatest(0, floor((wy - half_m / mpp) / 512))::BIGINT AS ylo, least(pow(2, z) - 1, floor((wy + half_m / mpp) / 512))::BIGINT AS yhi FROM w),
s1 AS (SELECT *, xhi - xlo + 1 > 4 AS bx, wx - xlo * 512 > (xhi + 1) * 512 - wx AS lx, yhi - ylo + 1 > 4 AS byy, wy - ylo * 512 > (yhi + 1) * 512 - wy AS ly FROM r),
plan AS (SELECT id, minutes, lat, lng, z, mpp, half_m, wx, wy, CASE WHEN bx AND lx THEN xlo + 1 ELSE xlo END AS x0, CASE WHEN bx AND NOT lx THEN xhi - 1 ELSE xhi END AS x1,
    CASE WHEN byy AND ly THEN ylo + 1 ELSE ylo END AS y0, CASE WHEN byy AND NOT ly THEN yhi - 1 ELSE yhi END AS y1 FROM s1)"""


@query(with_(REQS, PLAN) + """SELECT id, minutes, z, x0, y0, x1 - x0 + 1 AS cols, y1 - y0 + 1 AS rows, round(wx - x0 * 512, 3) AS origin_px, round(wy - y0 * 512, 3) AS origin_py, round(half_m, 4) AS half_m FROM plan""")
def plan_grid(spark: SparkSession, d: str) -> DataFrame:
    out = L.plan_grid(_requests(spark, d)).select("id", "minutes", "z", "x0", "y0", "cols", "rows", "origin_px", "origin_py", "half_m")
    return rounded(rounded(out, "origin_px", "origin_py", digits=3), "half_m", digits=4)


@query(with_(REQS, PLAN) + """SELECT id, minutes, x, y, substr('abcd', CAST((x + y) & 3 AS INT) + 1, 1) || '/base_labels/' || z || '/' || x || '/' || y || '.png' AS key
FROM plan, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS x) a, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) b""")
def tile_keys(spark: SparkSession, d: str) -> DataFrame:
    return L.tiles(L.plan_grid(_requests(spark, d))).select("id", "minutes", "x", "y", L.tile_key("base", True).alias("key"))


@query(with_(REQS, PLAN) + """, t AS (SELECT *, (x * 31 + y * 17) % 11 <> 0 AS there, x = x0 + CAST(floor((wx - x0 * 512) / 512) AS BIGINT) AND y = y0 + CAST(floor((wy - y0 * 512) / 512) AS BIGINT) AS origin
FROM plan, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS x) a, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) b)
SELECT id, minutes, count(*) FILTER (NOT there) AS missing, NOT (count(*) FILTER (NOT there) > 2 OR bool_or(NOT there AND origin)) AS ok FROM t GROUP BY ALL""")
def missing_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Tiles that a store lacks, and whether a request can go on."""
    plan = L.plan_grid(_requests(spark, d))
    return L.expected_tiles(plan, L.tiles(plan).where((F.col("x") * 31 + F.col("y") * 17) % 11 != 0))


@query(with_(REQS, PLAN) + """, t AS (SELECT *, CAST((x + y) & 3 AS INT) AS shard FROM plan, LATERAL (SELECT unnest(range(x0, x1 + 1)) AS x) a, LATERAL (SELECT unnest(range(y0, y1 + 1)) AS y) b)
SELECT id, minutes, count(*) FILTER ((x * 31 + y * 17) % 11 <> 0) AS first, count(*) FILTER ((x * 31 + y * 17) % 11 = 0 AND (x + 2 * y) % 3 = 0) AS second, count(*) FILTER ((x * 31 + y * 17) % 11 = 0 AND (x + 2 * y) % 3 <> 0) AS missing FROM t GROUP BY ALL""")
def tile_attempts(spark: SparkSession, d: str) -> DataFrame:
    """Tiles that come from their own shard, from the next one, or not at all."""
    plan = L.plan_grid(_requests(spark, d))
    there, x, y = L.tiles(plan).select("z", "x", "y", "shard").distinct(), F.col("x"), F.col("y")
    after = F.translate("shard", "abcd", "bcda")
    have = there.where((x * 31 + y * 17) % 11 != 0).union(there.where(((x * 31 + y * 17) % 11 == 0) & ((x + 2 * y) % 3 == 0)).withColumn("shard", after))
    n = lambda c: F.count_if(c)
    return L.attempts(plan, have).groupBy("id", "minutes").agg(n(F.col("attempt") == 1).alias("first"), n(F.col("attempt") == 2).alias("second"), n(F.col("attempt").isNull()).alias("missing"))


@query(with_(V.POINTS) + f""", p AS (SELECT *, 12 AS z FROM pts) SELECT id, least(4094, greatest(0, CAST(floor({SQL_WX.format(t=1)} + 0.5::DOUBLE) AS BIGINT) - 1)) AS tx0, least(4094, greatest(0, CAST(floor({SQL_WY.format(t=1)} + 0.5::DOUBLE) AS BIGINT) - 1)) AS ty0 FROM p""")
def plan_terrain(spark: SparkSession, d: str) -> DataFrame:
    return L.plan_terrain(V.points(spark, d)).select("id", "tx0", "ty0")


def _sql_hav(a: str, b: str, c: str, e: str) -> str:
    return f"(2 * {R} * asin(least(1::DOUBLE, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({e} - {b}) / 2), 2)))))"


@query(with_(V.POINTS) + f"SELECT a.id, round({_sql_hav('a.lat', 'a.lng', 'b.lat', 'b.lng')}, 3) AS metres FROM pts a JOIN pts b ON b.id = a.id + 1")
def haversine_pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b = V.points(spark, d), V.points(spark, d).select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    return rounded(a.join(b, "id").select("id", haversine("lat", "lng", "lat2", "lng2").alias("metres")), "metres", digits=3)


# ---- pixels and cells -------------------------------------------------------------------------

ANCHORS = ", ".join(f"({n}, {cls}, {tol}, {list(zooms) if zooms else 'NULL'}, {r}, {g}, {b})" for n, (cls, tol, zooms, (r, g, b)) in enumerate((fixed.CLASSES[p[0]], p[1], p[2], bytes.fromhex(c)) for p in fixed.PALETTE for c in p[3].split()))
PALETTE = f"pal(n, cls, tol, zooms, r, g, b) AS (VALUES {ANCHORS})"


def _sql_lut(zoom: int) -> str:
    return f"""act AS (SELECT * FROM pal WHERE zooms IS NULL OR list_contains(zooms, {zoom})),
shell AS (SELECT cls, rr // 2 * 16384 + gg // 2 * 128 + bb // 2 AS key FROM act, range(0, 256) a(rr), range(0, 256) b(gg), range(0, 256) c(bb)
    WHERE rr BETWEEN r - tol AND r + tol AND gg BETWEEN g - tol AND g + tol AND bb BETWEEN b - tol AND b + tol),
ranked AS (SELECT r // 2 * 16384 + g // 2 * 128 + b // 2 AS key, cls, 0 AS rank FROM act UNION ALL SELECT key, cls, 1 FROM shell),
one AS (SELECT key, rank, min(cls) AS low, max(cls) AS high FROM ranked GROUP BY ALL),
lut AS (SELECT key, CASE WHEN arg_min(low, rank) = arg_min(high, rank) THEN arg_min(low, rank) ELSE 255 END AS cls FROM one GROUP BY key)"""


# the shell's range joins are small: written with generated offsets
def _sql_lut_fast(zoom: int) -> str:
    return _sql_lut(zoom).replace(
        "FROM act, range(0, 256) a(rr), range(0, 256) b(gg), range(0, 256) c(bb)\n    WHERE rr BETWEEN r - tol AND r + tol AND gg BETWEEN g - tol AND g + tol AND bb BETWEEN b - tol AND b + tol",
        "FROM (SELECT cls, unnest(range(greatest(0, r - tol), least(255, r + tol) + 1)) AS rr, g, b, tol FROM act) x, LATERAL (SELECT unnest(range(greatest(0, x.g - x.tol), least(255, x.g + x.tol) + 1)) AS gg) y, LATERAL (SELECT unnest(range(greatest(0, x.b - x.tol), least(255, x.b + x.tol) + 1)) AS bb) v",
    )


PIXELS = """px AS (SELECT y, x, least(255, greatest(0, r + j)) AS r, least(255, greatest(0, g + j)) AS g, least(255, greatest(0, b + j)) AS b, a FROM (
    SELECT y, x, pal.r, pal.g, pal.b, (7 * y + 13 * x) % 5 - 2 AS j, CASE WHEN (y + x) % 37 = 0 THEN 0 ELSE 255 END AS a FROM grid JOIN pal ON pal.n = (y * 64 + x) % 97))"""
CLASSIFIED = """seen AS (SELECT px.*, CASE WHEN a < 128 OR greatest(r, g, b) < 140 THEN 0 WHEN lut.cls IS NULL THEN
    CASE WHEN r >= 232 AND g >= 224 AND b >= 208 AND r >= g AND g >= b THEN 1 ELSE 0 END WHEN lut.cls = 255 THEN 0 ELSE lut.cls END AS cls
    FROM px LEFT JOIN lut ON lut.key = r // 2 * 16384 + g // 2 * 128 + b // 2)"""
SEEN = with_(V.GRID, PALETTE, _sql_lut_fast(16), PIXELS, CLASSIFIED)
CELLS = "cnt AS (SELECT y // 3 AS y, x // 3 AS x, count(*) AS area, " + ", ".join(f"count(*) FILTER (cls = {c}) AS n{c}" for c in range(14)) + " FROM seen GROUP BY ALL)"
ROADS = " + ".join(f"n{c}" for c in X.road_classes(16))
CELLS += ", cells AS (SELECT y, x, " + ", ".join(f"CAST(floor(n{c} * 255 / area::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS f{c}" for c in range(14)) + f", CAST(floor(({ROADS}) * 255 / area::DOUBLE + 0.5::DOUBLE) AS BIGINT) AS road, CAST(({ROADS}) / area::DOUBLE >= 0.2 AS INT) AS road_cell FROM cnt)"


def _pixels(spark: SparkSession, d: str) -> DataFrame:
    cells = V.grid(spark, d).select("y", "x", ((F.col("y") * 64 + F.col("x")) % 97).alias("n"))
    px = cells.join(F.broadcast(X.palette(spark).select("n", "r", "g", "b")), "n")
    jitter = ((7 * F.col("y") + 13 * F.col("x")) % 5 - 2).cast("int")
    return px.select("y", "x", *[F.least(F.lit(255), F.greatest(F.lit(0), F.col(c) + jitter)).alias(c) for c in "rgb"], F.when((F.col("y") + F.col("x")) % 37 == 0, 0).otherwise(255).alias("a"))


def _classified(spark: SparkSession, d: str) -> DataFrame:
    return X.classify(_pixels(spark, d), X.lookup_table(X.palette(spark), 16))


@query(with_(V.GRID, PALETTE, PIXELS, "shown AS (SELECT r // 2 * 16384 + g // 2 * 128 + b // 2 AS key, count(*) AS n FROM px GROUP BY ALL)", *(_sql_lut_fast(z).replace("act", f"act{z}").replace("shell", f"shell{z}").replace("ranked", f"ranked{z}").replace("one ", f"one{z} ").replace("lut ", f"lut{z} ") for z in (14, 15, 16, 17))) + " UNION ALL ".join(f"SELECT {z} AS zoom, count(cls) AS filled, count(*) FILTER (cls = 255) AS conflicts, CAST(sum(n) FILTER (cls = 255) AS BIGINT) AS pixels FROM shown LEFT JOIN lut{z} USING (key)" for z in (14, 15, 16, 17)))
def lookup_slots(spark: SparkSession, d: str) -> DataFrame:
    """Of the colours of all pixels: how many slots of each zoom's colour table they meet, how many of these conflict, and for how many pixels."""
    shown = _pixels(spark, d).groupBy(X.key("r", "g", "b").alias("key")).agg(F.count("*").alias("n"))
    out = None
    for z in (14, 15, 16, 17):
        met = shown.join(X.lookup_table(X.palette(spark), z), "key", "left")
        clash = F.col("cls") == X.CONFLICT
        one = met.agg(F.lit(z).alias("zoom"), F.count("cls").alias("filled"), F.count_if(clash).alias("conflicts"), F.sum(F.when(clash, F.col("n"))).alias("pixels"))
        out = one if out is None else out.union(one)
    return out


@query(SEEN + "SELECT cls, count(*) AS n FROM seen GROUP BY cls")
def class_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _classified(spark, d).groupBy("cls").agg(F.count("*").alias("n"))


@query(SEEN.rstrip() + ", lost AS (SELECT y // 64 AS tile, y // 64 % 5 = 3 AS missing, CASE WHEN y // 64 % 5 = 3 THEN 0 ELSE cls END AS cls FROM seen), told AS (SELECT tile, count(*) AS n, count(*) FILTER (cls = 0) AS unknown, count(*) FILTER (missing) AS gone FROM lost GROUP BY tile) SELECT tile, n AS pixels, gone AS missing, CASE WHEN n > gone THEN round(1 - greatest(0, unknown - gone) / greatest(1, n - gone)::DOUBLE, 8) END AS classified FROM told")
def classified_fraction(spark: SparkSession, d: str) -> DataFrame:
    """The share of known pixels of each tile; every fifth tile is missing, and other tiles have transparent pixels."""
    tile = F.floor(F.col("y") / 64)
    seen = _classified(spark, d).withColumn("tile", tile).withColumn("missing", tile % 5 == 3)
    seen = seen.withColumn("cls", F.when(F.col("missing"), 0).otherwise(F.col("cls")))
    return rounded(X.classified_share(seen, ["tile"]), "classified", digits=8)


@query(SEEN + "SELECT '#' || lower(lpad(to_hex(r * 65536 + g * 256 + b), 6, '0')) AS colour, count(*) AS n, round(count(*) / (SELECT count(*) FROM seen WHERE (y * 64 + x) % 4 = 0 AND a >= 128)::DOUBLE, 8) AS share FROM seen WHERE (y * 64 + x) % 4 = 0 AND a >= 128 AND cls = 0 GROUP BY r, g, b ORDER BY n DESC, r * 65536 + g * 256 + b LIMIT 10")
def unknown_colours(spark: SparkSession, d: str) -> DataFrame:
    return rounded(X.unknown_colours(_classified(spark, d), 64), "share", digits=8)


@query(SEEN.rstrip() + ", " + CELLS + " SELECT * FROM cells")
def cell_grid(spark: SparkSession, d: str) -> DataFrame:
    return X.cells(_classified(spark, d), 16)


@query(SEEN.rstrip() + ", " + CELLS + """ SELECT y, x, CAST(f5 / 255::DOUBLE >= 0.5 AS INT) AS green, CAST((f3 + f2) / 255::DOUBLE >= 0.5 AS INT) AS built,
    CASE WHEN f8 >= 0.15 * 255 THEN 5 WHEN road_cell = 1 THEN CASE WHEN f9 > 0 THEN 3 WHEN f10 > 0 THEN 2 WHEN f13 > f11 THEN 4 ELSE 1 END ELSE 0 END AS kind FROM cells""")
def walk_grid(spark: SparkSession, d: str) -> DataFrame:
    """Class masks and walk kinds of cells."""
    return X.cells(_classified(spark, d), 16).select("y", "x", X.fraction_mask(["GREEN"]).alias("green"), X.fraction_mask(["BUILT", "URBAN"]).alias("built"), X.walk_kind().alias("kind"))


# ---- stencils ---------------------------------------------------------------------------------


def _sql_box(view: str, value: str, how: str, reach: int, out: str, keep: str = "y, x") -> str:
    by = "req, " if keep.startswith("req") else ""
    return f"""{out}_r AS (SELECT {keep}, {how}({value}) OVER (PARTITION BY {by}y ORDER BY x ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS {value} FROM {view}),
{out} AS (SELECT {keep}, {how}({value}) OVER (PARTITION BY {by}x ORDER BY y ROWS BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS {value} FROM {out}_r)"""


def _masks(spark: SparkSession, d: str) -> DataFrame:
    return V.masks(V.grid(spark, d))


for _name, _steps, _mask in (("erode", ["min"], "walk"), ("dilate", ["max"], "green"), ("opened", ["min", "max"], "walk"), ("closed", ["max", "min"], "water")):
    _views, _at = [V.GRID, V.MASKS], "masks"
    for _k, _how in enumerate(_steps):
        _views.append(_sql_box(_at, _mask, _how, 1, f"m{_k}"))
        _at = f"m{_k}"

    def _morph(spark: SparkSession, d: str, name: str = _name, mask: str = _mask) -> DataFrame:
        return getattr(S, name)(_masks(spark, d).select("y", "x", mask), mask).where(F.col(mask) == 1).select("y", "x")

    _morph.__name__ = f"mask_{_name}"
    query(with_(*_views) + f"SELECT y, x FROM {_at} WHERE {_mask} = 1")(_morph)


@query(with_(V.GRID, V.MASKS, "k AS (SELECT y, x, walk, green AS big FROM masks)", _sql_box("k", "big", "max", 2, "b", "y, x, walk")) + "SELECT y, x FROM b WHERE walk = 1 AND big = 0")
def thin_roads(spark: SparkSession, d: str) -> DataFrame:
    """Walkable cells without a large road in the 5 x 5 square."""
    return S.near_large(_masks(spark, d).select("y", "x", "walk", F.col("green").alias("big")), "big").where("walk = 1 and big = 0").select("y", "x")


@query(with_(V.GRID, V.DEM, "d2 AS (SELECT y, x, coalesce(h, 0) AS s, CAST(h IS NOT NULL AS INT) AS n FROM dem)", _sql_box("d2", "s", "sum", 1, "bs"), _sql_box("d2", "n", "sum", 1, "bn")) + "SELECT y, x, round(s / n, 5) AS h FROM bs JOIN bn USING (y, x) WHERE n > 0")
def smoothed_elevation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.smoothed(V.dem(V.grid(spark, d)), "h").where("h is not null"), "h", digits=5)


@query(with_(V.GRID, V.DEM, """e AS (SELECT y, x, h AS c, CASE WHEN x = 0 THEN h ELSE lag(h) OVER (PARTITION BY y ORDER BY x) END AS w, CASE WHEN x = 63 THEN h ELSE lead(h) OVER (PARTITION BY y ORDER BY x) END AS e FROM dem),
v AS (SELECT *, CASE WHEN y = 0 THEN {'w': w, 'c': c, 'e': e} ELSE lag({'w': w, 'c': c, 'e': e}) OVER (PARTITION BY x ORDER BY y) END AS n,
    CASE WHEN y = (SELECT max(y) FROM e) THEN {'w': w, 'c': c, 'e': e} ELSE lead({'w': w, 'c': c, 'e': e}) OVER (PARTITION BY x ORDER BY y) END AS s FROM e)""") + """SELECT y, x, round(sqrt(pow((n.e + 2 * e + s.e - (n.w + 2 * w + s.w)) / 80, 2) + pow((s.w + 2 * s.c + s.e - (n.w + 2 * n.c + n.e)) / 80, 2)), 5) AS slope FROM v""")
def horn_slope(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.slope(V.dem(V.grid(spark, d)), "h", 10.0).select("y", "x", "slope"), "slope", digits=5)


@query(with_(V.GRID, V.MASKS) + """, spread AS (SELECT y + dy AS y, x + dx AS x, ((greatest(abs(dy), abs(dx)) - least(abs(dy), abs(dx))) + least(abs(dy), abs(dx)) * 4 / 3::DOUBLE) * 3 AS dist
FROM masks, range(-4, 5) a(dy), range(-4, 5) b(dx) WHERE water = 1),
near AS (SELECT y, x, min(dist) AS dist FROM spread WHERE dist <= 12 GROUP BY ALL)
SELECT y, x, round(dist, 6) AS dist, round(coalesce(greatest(0::DOUBLE, least(1::DOUBLE, 1 - dist / 12)), 0), 6) AS near FROM masks LEFT JOIN near USING (y, x)""")
def distance_to_water(spark: SparkSession, d: str) -> DataFrame:
    """Chamfer distance to a mask and its closeness."""
    out = S.distance_to_mask(_masks(spark, d).select("y", "x", "water"), "water", 3.0, 12.0)
    return rounded(out.select("y", "x", "dist", S.closeness("dist", 12.0).alias("near")), "dist", "near")


CLOSED = [_sql_box("masks", "green", "max", 1, "c0", "req, y, x"), _sql_box("c0", "green", "min", 1, "c1", "req, y, x")]


@query(with_(V.GRIDS, V.MASKS, *CLOSED) + """, deep AS (SELECT a.req, a.y, a.x, least(min(greatest(abs(a.y - b.y), abs(a.x - b.x)) * 3 + least(abs(a.y - b.y), abs(a.x - b.x))), any_value(3 * least(a.y + 1, 64 - a.y, a.x + 1, 64 - a.x))) AS dist
    FROM c1 a LEFT JOIN c1 b ON a.req = b.req AND b.green = 0 WHERE a.green = 1 GROUP BY a.req, a.y, a.x),
cell AS (SELECT req, y // 3 AS y, x // 3 AS x, avg(green) >= 0.2 AS road FROM masks GROUP BY ALL), wide AS (SELECT req, y // 3 AS y, x // 3 AS x, max(dist) AS dist FROM deep GROUP BY ALL)
SELECT req, y, x, round(CASE WHEN road THEN coalesce(dist, 0) * 2 / 3::DOUBLE * 1.5::DOUBLE ELSE 0 END, 6) AS width FROM cell LEFT JOIN wide USING (req, y, x)""")
def road_width(spark: SparkSession, d: str) -> DataFrame:
    """Widths of road cells, from the depth of their pixels in the closed road mask."""
    masks = V.masks(V.grids(spark, d))
    road = masks.groupBy("req", F.floor(F.col("y") / 3).alias("y"), F.floor(F.col("x") / 3).alias("x")).agg((F.avg("green") >= 0.2).cast("int").alias("road_cell"))
    deep = G.depth(S.closed(masks.select("req", "y", "x", "green"), "green", ["req"]), "green", 64, 64)
    return rounded(S.road_widths(deep, road, 3, 1.5), "width")


@query(with_(V.GRID, "g2 AS (SELECT y, x, v AS s, 1 AS n FROM grid)", _sql_box("g2", "s", "sum", 3, "bs"), _sql_box("g2", "n", "sum", 3, "bn")) + "SELECT y, x, round(s / n, 6) AS mean FROM bs JOIN bn USING (y, x)")
def box_mean(spark: SparkSession, d: str) -> DataFrame:
    return rounded(S.box_mean(V.grid(spark, d), "v", 3, "mean").select("y", "x", "mean"), "mean")


@query(with_(V.GRID, V.MASKS) + "SELECT y, x, CAST(sum(s) OVER (PARTITION BY x ORDER BY y ROWS UNBOUNDED PRECEDING) AS BIGINT) AS sat FROM (SELECT y, x, sum(green) OVER (PARTITION BY y ORDER BY x ROWS UNBOUNDED PRECEDING) AS s FROM masks)")
def summed_area(spark: SparkSession, d: str) -> DataFrame:
    return S.summed_area(_masks(spark, d).select("y", "x", "green"), "green").select("y", "x", "sat")


@query(with_(V.GRID, V.MASKS) + "SELECT DISTINCT a.y, a.x FROM masks a JOIN (SELECT y + dy AS y, x + dx AS x FROM masks, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx) WHERE green = 1) b USING (y, x) WHERE a.walk = 1")
def beside_green(spark: SparkSession, d: str) -> DataFrame:
    """Mask cells with a 4-neighbour in another mask."""
    return S.beside(_masks(spark, d).select("y", "x", "walk", "green"), "walk", "green").select("y", "x")


@query(with_(V.GRID) + "SELECT y // 8 AS my, x // 8 AS mx, arg_max(y, {'v': v, 'y': -y, 'x': -x}) AS y, arg_max(x, {'v': v, 'y': -y, 'x': -x}) AS x FROM grid GROUP BY ALL")
def macro_cells(spark: SparkSession, d: str) -> DataFrame:
    return C.best_of_macro_cells(V.grid(spark, d), "v", 8).select("my", "mx", "y", "x")


# ---- paths ------------------------------------------------------------------------------------

STEPS = V.PATHS + f", prev AS (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM path WINDOW w AS (PARTITION BY user_id ORDER BY i)), steps AS (SELECT *, CASE WHEN plat IS NULL THEN 0 ELSE {_sql_hav('plat', 'plng', 'lat', 'lng')} END AS step_m FROM prev)"
SAMPLES = STEPS + ", up AS (SELECT *, sum(step_m) OVER (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM steps), res AS (SELECT user_id, k, plat + (lat - plat) * t AS lat, plng + (lng - plng) * t AS lng FROM (SELECT *, (k * 30000 - (upto - step_m)) / step_m AS t FROM up, LATERAL (SELECT unnest(range(CAST(floor((upto - step_m) / 30000) AS BIGINT) + 1, CAST(floor(upto / 30000) AS BIGINT) + 1)) AS k) s WHERE step_m > 0))"


@query(with_(STEPS) + "SELECT user_id, round(sum(step_m), 2) AS length_m FROM steps GROUP BY user_id")
def path_length(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.length(V.paths(spark, d), "user_id"), "length_m", digits=2)


@query(with_(SAMPLES) + "SELECT user_id, k, round(lat, 6) AS lat, round(lng, 6) AS lng FROM res")
def resampled_path(spark: SparkSession, d: str) -> DataFrame:
    return rounded(P.resampled(V.paths(spark, d), "user_id", 30000.0).withColumnRenamed("n", "k"), "lat", "lng")


@query(with_(V.PATHS) + "SELECT user_id, i FROM (SELECT *, lag(cell) OVER (PARTITION BY user_id ORDER BY i) AS before FROM (SELECT *, CAST(floor(lat * 500) AS BIGINT) AS cell FROM path)) WHERE before IS DISTINCT FROM cell")
def path_without_repeats(spark: SparkSession, d: str) -> DataFrame:
    return P.without_repeats(V.paths(spark, d).withColumn("cell", F.floor(F.col("lat") * 500)), "user_id", "cell").select("user_id", F.col("i").cast("long").alias("i"))


@query(with_(V.PATHS) + "SELECT user_id, arg_max(i, {'d': dd, 'i': -i}) AS turn FROM (SELECT *, pow(lat - first(lat) OVER w, 2) + pow(lng - first(lng) OVER w, 2) AS dd FROM path WINDOW w AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY user_id")
def farthest_point(spark: SparkSession, d: str) -> DataFrame:
    return P.farthest(V.paths(spark, d), "user_id").select("user_id", F.col("turn").cast("long").alias("turn"))


@query(with_(V.PATHS) + "SELECT user_id, arg_min(i, {'d': pow((lng - 126.95::DOUBLE) * cos(radians(37.51::DOUBLE)), 2) + pow(lat - 37.51::DOUBLE, 2), 'i': i}) AS nearest FROM path GROUP BY user_id")
def nearest_on_path(spark: SparkSession, d: str) -> DataFrame:
    path = V.paths(spark, d)
    points = path.select("user_id").distinct().select("user_id", F.lit(37.51).alias("lat0"), F.lit(126.95).alias("lng0"))
    return P.nearest_on_path(path, points, "user_id").select("user_id", F.col("nearest").cast("long").alias("nearest"))


@query("WITH RECURSIVE s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, value AS e FROM events), f AS (SELECT user_id, i, e AS low, e AS top, false AS up, 0::DOUBLE AS total FROM s WHERE i = 1 UNION ALL SELECT s.user_id, s.i, CASE WHEN NOT up AND e < low THEN e WHEN up AND e <= top AND top - e > 8 THEN e ELSE low END, CASE WHEN NOT up AND e - low > 8 THEN e WHEN up AND e > top THEN e ELSE top END, CASE WHEN NOT up AND e - low > 8 THEN true WHEN up AND e <= top AND top - e > 8 THEN false ELSE up END, total + CASE WHEN NOT up AND e - low > 8 THEN e - low WHEN up AND e > top THEN e - top ELSE 0 END FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1) SELECT user_id, round(arg_max(total, i), 4) AS ascent_m FROM f GROUP BY user_id")
def ascent(spark: SparkSession, d: str) -> DataFrame:
    """Climb with hysteresis, an ordered fold over each path."""
    from pyspark.sql import Window

    samples = V.load(spark, d, "events").select("user_id", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("i"), "value")
    return rounded(P.ascent(samples, "user_id", "i", "value"), "ascent_m", digits=4)


PTS64 = "pt AS (SELECT event_id AS id, event_id % (SELECT max(req) + 1 FROM grid) AS req, (event_id * 37 % 6400) / 100::DOUBLE AS px, (event_id * 91 % 6400) / 100::DOUBLE AS py FROM events)"


def _points64(spark: SparkSession, d: str) -> DataFrame:
    """Points on the grids of requests."""
    e = F.col("event_id")
    many = V.load(spark, d, "embeddings").agg((F.floor(F.max("vec_id") / 64) + 1).alias("many"))  # one row
    return V.load(spark, d, "events").crossJoin(F.broadcast(many)).select(e.alias("id"), (e % F.col("many")).alias("req"), (e * 37 % 6400 / 100.0).alias("px"), (e * 91 % 6400 / 100.0).alias("py"))


@query(with_(V.GRIDS, V.DEM, PTS64) + """, c AS (SELECT id, req, least(63, greatest(0, CAST(floor(px - 0.5::DOUBLE) AS BIGINT) + dx)) AS x, least(63, greatest(0, CAST(floor(py - 0.5::DOUBLE) AS BIGINT) + dy)) AS y,
    CASE dx WHEN 1 THEN px - 0.5::DOUBLE - floor(px - 0.5::DOUBLE) ELSE 1 - (px - 0.5::DOUBLE - floor(px - 0.5::DOUBLE)) END * CASE dy WHEN 1 THEN py - 0.5::DOUBLE - floor(py - 0.5::DOUBLE) ELSE 1 - (py - 0.5::DOUBLE - floor(py - 0.5::DOUBLE)) END AS w
FROM pt, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) o(dx, dy)), f AS (SELECT id, sum(w * h) / sum(w) AS h FROM c JOIN dem USING (req, y, x) WHERE h IS NOT NULL GROUP BY id) SELECT pt.id, round(h, 5) AS h FROM pt LEFT JOIN f USING (id)""")
def bilinear_sample(spark: SparkSession, d: str) -> DataFrame:
    """Sample grids between cells, ignoring unknown corners."""
    return rounded(P.bilinear(_points64(spark, d), V.dem(V.grids(spark, d)), "h", 64, 64, ["req"]).select("id", "h"), "h", digits=5)


@query(with_(V.GRIDS, V.MASKS, PTS64) + """, h AS (SELECT id, req, px AS cx, py AS cy, CAST(floor(px + 0.5::DOUBLE) AS BIGINT) AS hx, CAST(floor(py + 0.5::DOUBLE) AS BIGINT) AS hy FROM pt),
n AS (SELECT id, y, x, greatest(abs(x - hx), abs(y - hy)) AS ring, pow(x - cx, 2) + pow(y - cy, 2) AS d, abs(y - hy) = greatest(abs(x - hx), abs(y - hy)) AS flat FROM h JOIN masks ON masks.req = h.req AND y BETWEEN hy - 3 AND hy + 3 AND x BETWEEN hx - 3 AND hx + 3 WHERE green = 1)
SELECT id, y, x FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ring, d, NOT flat, CASE WHEN flat THEN x ELSE y END, CASE WHEN flat THEN y ELSE x END) AS k FROM n) WHERE k = 1""")
def nearest_open_cell(spark: SparkSession, d: str) -> DataFrame:
    """Snap points to the nearest open cell, ring by ring."""
    points = _points64(spark, d).select("id", "req", F.col("px").alias("cx"), F.col("py").alias("cy"))
    return P.nearest_open(points, V.masks(V.grids(spark, d)).where("green = 1"), 3, ["req"]).select("id", "y", "x")


@query(with_(V.GRIDS, V.MASKS, PTS64) + """, h AS (SELECT id, req, px AS cx, py AS cy, CAST(floor(px + 0.5::DOUBLE) AS BIGINT) AS hx, CAST(floor(py + 0.5::DOUBLE) AS BIGINT) AS hy FROM pt),
n AS (SELECT id, cx, cy, y, x, greatest(abs(x - hx), abs(y - hy)) AS ring, pow(x - cx, 2) + pow(y - cy, 2) AS d, abs(y - hy) = greatest(abs(x - hx), abs(y - hy)) AS flat FROM h JOIN masks ON masks.req = h.req AND y BETWEEN hy - 4 AND hy + 4 AND x BETWEEN hx - 4 AND hx + 4 WHERE green = 1)
SELECT id, y, x FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ring, d, NOT flat, CASE WHEN flat THEN x ELSE y END, CASE WHEN flat THEN y ELSE x END) AS k FROM n) WHERE k = 1 AND sqrt(d) * 15 <= 60""")
def element_cells(spark: SparkSession, d: str) -> DataFrame:
    """Elements to the open cell nearest to them, if it is within 60 metres."""
    points = _points64(spark, d).select("id", "req", F.col("px").alias("cx"), F.col("py").alias("cy"))
    found = P.nearest_open(points, V.masks(V.grids(spark, d)).where("green = 1"), 4, ["req"]).join(points, ["req", "id"])
    return found.where(F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)) * 15 <= fixed.ELEMENT_M).select("id", "y", "x")


@query(with_(V.GRIDS, V.MASKS, "p AS (SELECT DISTINCT user_id, event_id % (SELECT max(req) + 1 FROM grid) AS req, event_id % 64 AS y, event_id * 7 % 64 AS x FROM events)") + ", a AS (SELECT DISTINCT user_id, req, y + dy AS y, x + dx AS x FROM p, range(-1, 2) u(dy), range(-1, 2) v(dx)) SELECT user_id, count(DISTINCT (masks.req * 64 + masks.y) * 64 + masks.x) AS labels FROM a JOIN masks USING (req, y, x) WHERE green = 1 GROUP BY user_id")
def labels_near_path(spark: SparkSession, d: str) -> DataFrame:
    """Distinct labels in a square around each path's cells."""
    e = F.col("event_id")
    many = V.load(spark, d, "embeddings").agg((F.floor(F.max("vec_id") / 64) + 1).alias("many"))  # one row
    path = V.load(spark, d, "events").crossJoin(F.broadcast(many)).select("user_id", (e % F.col("many")).alias("req"), (e % 64).alias("y"), (e * 7 % 64).alias("x"))
    labels = V.masks(V.grids(spark, d)).where("green = 1").select("req", "y", "x", ((F.col("req") * 64 + F.col("y")) * 64 + F.col("x")).alias("label"))
    return P.near_labels(path, labels, "user_id", 1, ["req"])


@query(with_(V.PATHS) + "SELECT user_id, event_type, round(n / sum(n) OVER (PARTITION BY user_id), 8) AS share FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)")
def kind_share(spark: SparkSession, d: str) -> DataFrame:
    """Shares of each kind along a path."""
    return rounded(P.shares(V.load(spark, d, "events"), "user_id", "event_type"), "share", digits=8)


@query(with_(V.GRIDS, V.MASKS) + "SELECT req, median(v) FILTER (walk = 1) AS median, count(*) FILTER (walk = 1) / count(*)::DOUBLE AS share, coalesce(min(v) FILTER (green = 1), 0) AS least FROM masks GROUP BY req")
def median_and_share(spark: SparkSession, d: str) -> DataFrame:
    """Exact median, conditional share and guarded minimum of each grid."""
    m = V.masks(V.grids(spark, d))
    rest = m.groupBy("req").agg((F.count_if(F.col("walk") == 1) / F.count("*")).alias("share"), F.coalesce(F.min(F.when(F.col("green") == 1, F.col("v"))), F.lit(0.0)).alias("least"))
    return rest.join(S.median(m.where("walk = 1"), ["req"], "v"), "req", "left")


@query(with_(V.GRIDS, V.MASKS, "k AS (SELECT req, y, x, CASE WHEN v > 0.2 THEN 3 WHEN v > 0.15 THEN 2 WHEN v > -0.08 THEN 1 ELSE 0 END AS kind, CASE WHEN req % 2 = 0 THEN abs(v) * 10 ELSE 0 END AS width FROM grid)", "big AS (SELECT *, CAST(kind IN (2, 3) AS INT) AS large FROM k)", _sql_box("big", "large", "max", 2, "b", "req, y, x, kind, width"))
       + ", m AS (SELECT req, median(width) AS med FROM k WHERE kind = 1 GROUP BY req) SELECT req, y, x, CAST(kind = 1 AND CASE WHEN med > 0 THEN width <= 1.2::DOUBLE * med ELSE large = 0 END AS INT) AS thin FROM b LEFT JOIN m USING (req)")
def thin_minor_roads(spark: SparkSession, d: str) -> DataFrame:
    """Minor roads that are narrow for their grid, by the median width or by their neighbours."""
    v = F.col("v")
    kind = F.when(v > 0.2, 3).when(v > 0.15, 2).when(v > -0.08, 1).otherwise(0)
    walk = V.grids(spark, d).select("req", "y", "x", kind.alias("kind"), F.when(F.col("req") % 2 == 0, F.abs(v) * 10).otherwise(0.0).alias("width"))
    return S.thin_roads(walk, 16, ["req"]).select("req", "y", "x", "thin")


KIND_CASE = "CASE WHEN v > 0.2 THEN 5 WHEN v > 0.15 THEN 3 WHEN v > 0.08 THEN 2 WHEN v > 0.05 THEN 4 WHEN v > -0.08 THEN 1 ELSE 0 END"


@query(with_(V.GRID, f"k AS (SELECT *, {KIND_CASE} AS kind FROM grid)") + """SELECT y, x, kind, round(CASE WHEN kind = 5 THEN 15::DOUBLE ELSE CASE kind WHEN 1 THEN 1.0::DOUBLE WHEN 2 THEN 1.1::DOUBLE WHEN 3 THEN 1.3::DOUBLE ELSE 1.6::DOUBLE END
* greatest(0.6::DOUBLE, least(3::DOUBLE, exp(-1.2::DOUBLE * greatest(0::DOUBLE, v) - 1.5::DOUBLE * (x % 4) / 4 - 1.0::DOUBLE * (y % 2) + 1.5::DOUBLE * (x % 5) / 5 + CASE kind WHEN 3 THEN 1.2::DOUBLE WHEN 2 THEN 0.5::DOUBLE ELSE 0 END))) END, 6) AS cost FROM k WHERE kind > 0""")
def cost_grid(spark: SparkSession, d: str) -> DataFrame:
    """Cost per metre: the kind's base times the clamped theme factor; trunk roads without."""
    v = F.col("v")
    kind = F.when(v > 0.2, 5).when(v > 0.15, 3).when(v > 0.08, 2).when(v > 0.05, 4).when(v > -0.08, 1).otherwise(0)
    rows = V.grid(spark, d).withColumn("kind", kind).where("kind > 0")
    rows = rows.select("y", "x", "kind", F.greatest(F.lit(0.0), v).alias("nearGreen"), (F.col("x") % 4 / 4).alias("nearWater"), (F.col("y") % 2).alias("thin"), (F.col("x") % 5 / 5).alias("slope"))
    weights = {"nearGreen": -1.2, "nearWater": -1.5, "major": 1.2, "secondary": 0.5, "thin": -1.0, "slope": 1.5}
    return rounded(rows.select("y", "x", "kind", C.cost(weights).alias("cost")), "cost")


# ---- requests, strings and cards --------------------------------------------------------------


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '[?&]page=([^&#]*)', 1) AS page, regexp_extract(url, '#(.*)$', 1) AS mark FROM pages")
def url_parameters(spark: SparkSession, d: str) -> DataFrame:
    pages = V.load(spark, d, "pages")
    return pages.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.coalesce(F.parse_url("url", F.lit("QUERY"), F.lit("page")), F.lit("")).alias("page"), F.coalesce(F.parse_url("url", F.lit("REF")), F.lit("")).alias("mark"))


@query("SELECT c_custkey, abs(c_acctbal / 50) <= 85 AND abs(c_acctbal / 20) <= 180 AS valid FROM customer")
def valid_locations(spark: SparkSession, d: str) -> DataFrame:
    table = V.load(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 50).alias("lat"), (F.col("c_acctbal") / 20).alias("lng"))
    return table.select("c_custkey", L.valid_location().alias("valid"))


TAGS_OF = "[['nature', 'urban', 'quiet', 'lively', 'river', 'alley', 'night', 'cafe', 'hill', 'flat'][CAST(event_id % 10 + 1 AS INT)], ['nature', 'urban', 'quiet', 'lively', 'river', 'alley', 'night', 'cafe', 'hill', 'flat'][CAST(event_id * 3 % 10 + 1 AS INT)]]"


@query(f"""WITH e AS (SELECT event_id, value * 40 AS m, {TAGS_OF} AS tags, event_id % 2 = 0 AS analysed, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS ascent, event_id % 4 AS green, value AS edge, value / 3 AS off, CASE WHEN event_id % 5 = 0 THEN 120 ELSE 30 END AS minutes FROM events),
l(tag, label) AS (VALUES {LABELS}), n AS (SELECT event_id, string_agg(label, ', ' ORDER BY i) AS names, string_agg(label, ' ' ORDER BY i) || ' 산책' AS title FROM e, range(1, 3) r(i) JOIN l ON l.tag = tags[i] GROUP BY event_id)
SELECT event_id, title, greatest(5, CAST(floor(m / 1000 / 4 * 60 / 5 + 0.5::DOUBLE) AS BIGINT) * 5) AS duration,
CASE WHEN ascent IS NULL THEN CASE WHEN list_contains(tags, 'hill') OR minutes >= 120 THEN '보통' ELSE '쉬움' END WHEN ascent >= 60 THEN '어려움' WHEN ascent >= 25 THEN '보통' ELSE '쉬움' END AS difficulty,
names || ' 분위기에 맞춰 주변 길을 이어 만든 ' || printf('%.1f', floor(m / 100 + 0.5::DOUBLE) / 10) || 'km 순환 코스예요.' || CASE WHEN green > 0 OR edge >= 50 THEN ' ' || concat_ws(', ', CASE WHEN green > 0 THEN '녹지 ' || green || '곳' END, CASE WHEN edge >= 50 THEN '강변 ' || CAST(floor(edge / 10 + 0.5::DOUBLE) AS BIGINT) * 10 || 'm' END) || ' 구간을 지나요.' ELSE '' END
|| CASE WHEN ascent IS NOT NULL THEN ' 오르막은 약 ' || CAST(floor(ascent + 0.5::DOUBLE) AS BIGINT) || 'm예요.' ELSE '' END || ' 가까운 길에서 출발해 같은 지점으로 돌아와요.' AS description,
nullif(concat_ws(' ', CASE WHEN off > 10 THEN '출발점은 현재 위치에서 약 ' || CAST(floor(off + 0.5::DOUBLE) AS BIGINT) || 'm 떨어진 길 위에 있어요.' END, CASE WHEN NOT analysed THEN '아이콘과 장소명 확인 없이 지도에 보이는 지형과 길로 구성했어요.' END, CASE WHEN list_has_any(tags, ['quiet', 'lively', 'night']) THEN '분위기는 지도 형태로 추정하며 소음이나 조명 상태는 확인하지 못해요.' END), '') AS notice FROM e JOIN n USING (event_id)""")
def course_card(spark: SparkSession, d: str) -> DataFrame:
    """Title, minutes in fives, difficulty, description and notices of a course."""
    e, v = F.col("event_id"), F.col("value")
    names = F.array(*map(F.lit, ["nature", "urban", "quiet", "lively", "river", "alley", "night", "cafe", "hill", "flat"]))
    rows = V.load(spark, d, "events").select(
        "event_id", (v * 40).alias("length_m"), F.array(names[(e % 10).cast("int")], names[(e * 3 % 10).cast("int")]).alias("tags"), (e % 2 == 0).alias("analysed"), F.when(e % 3 != 0, v).alias("ascent_m"),
        (e % 4).alias("green_regions"), v.alias("water_edge_m"), (v / 3).alias("start_offset_m"), F.when(e % 5 == 0, 120).otherwise(30).alias("minutes"),
    )
    return course.card(rows).select("event_id", "title", "duration", "difficulty", "description", "notice")


STATIC = ", ".join(f"('{i}', '{t}', {km!r}::DOUBLE, {m}, '{w}', {lat!r}::DOUBLE, {lng!r}::DOUBLE)" for i, t, km, m, w, lat, lng in fixed.COURSES)


@query(with_(V.POINTS, f"c(course, title, km, minutes, difficulty, clat, clng) AS (VALUES {STATIC})") + f"SELECT id, course, title, minutes, round({_sql_hav('lat', 'lng', 'clat', 'clng')}, 2) AS away_m FROM pts, c")
def static_courses(spark: SparkSession, d: str) -> DataFrame:
    """The static courses and how far each is from each customer."""
    courses = spark.createDataFrame(fixed.COURSES, "course string, title string, km double, minutes int, difficulty string, clat double, clng double")
    pairs = V.points(spark, d).join(F.broadcast(courses))  # a few fixed rows
    return rounded(pairs.select("id", "course", "title", "minutes", haversine("lat", "lng", "clat", "clng").alias("away_m")), "away_m", digits=2)


@query(with_(V.PATHS) + ", n AS (SELECT *, lat - lag(lat) OVER w AS uy, lng - lag(lng) OVER w AS ux, lead(lat) OVER w - lat AS vy, lead(lng) OVER w - lng AS vx FROM (SELECT user_id, i, i % 5 // 2 AS lng, i // 3 AS lat FROM path) WINDOW w AS (PARTITION BY user_id ORDER BY i)) SELECT user_id, i FROM n WHERE NOT coalesce(ux * vy - uy * vx = 0 AND ux * vx + uy * vy > 0, false)")
def path_without_collinear(spark: SparkSession, d: str) -> DataFrame:
    """Points at which a path does not go straight on."""
    i = F.col("i")
    path = V.paths(spark, d).select("user_id", "i", F.floor(i % 5 / 2).alias("x"), F.floor(i / 3).alias("y"))
    return P.without_collinear(path, "user_id").select("user_id", i.cast("long").alias("i"))


LINE = "pts AS (SELECT user_id, i, (lng - 126.9::DOUBLE) * 1000 AS x, (lat - 37.5::DOUBLE) * 1000 AS y FROM path)"


@query("WITH RECURSIVE " + ", ".join([V.PATHS, LINE]) + """, seg(user_id, a, b) AS (SELECT user_id, min(i), max(i) FROM pts GROUP BY user_id UNION ALL
    SELECT user_id, unnest([a, m]), unnest([m, b]) FROM (SELECT user_id, a, b, arg_max(i, {'d': d, 'i': -i}) AS m, max(d) AS d FROM (
        SELECT user_id, a, b, i, CASE WHEN l = 0 OR t <= 0 THEN px * px + py * py WHEN t >= l THEN pow(x - bx, 2) + pow(y - by_, 2) ELSE pow(px * vy - py * vx, 2) / l END AS d FROM (
            SELECT s.*, p.i, p.x, p.y, q.x AS bx, q.y AS by_, q.x - o.x AS vx, q.y - o.y AS vy, p.x - o.x AS px, p.y - o.y AS py, pow(q.x - o.x, 2) + pow(q.y - o.y, 2) AS l, (p.x - o.x) * (q.x - o.x) + (p.y - o.y) * (q.y - o.y) AS t
            FROM seg s JOIN pts o ON o.user_id = s.user_id AND o.i = a JOIN pts q ON q.user_id = s.user_id AND q.i = b JOIN pts p ON p.user_id = s.user_id AND p.i > a AND p.i < b)) GROUP BY user_id, a, b) WHERE d > 400)
SELECT user_id, i FROM (SELECT user_id, a AS i FROM seg UNION SELECT user_id, b FROM seg)""")
def simplified_path(spark: SparkSession, d: str) -> DataFrame:
    """The points of each user's path that simplification keeps."""
    path = V.paths(spark, d).select("user_id", "i", ((F.col("lng") - 126.9) * 1000).alias("x"), ((F.col("lat") - 37.5) * 1000).alias("y"))
    return P.simplified(path, "user_id", 20.0).select("user_id", F.col("i").cast("long").alias("i"))


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE (event_id % 256) * 256 + event_id * 7 % 256 + (event_id * 13 % 256) / 256::DOUBLE - 32768 END AS metres FROM events")
def decode_elevation(spark: SparkSession, d: str) -> DataFrame:
    """Elevation from three bytes; null where transparent."""
    e = F.col("event_id")
    px = V.load(spark, d, "events").select("event_id", (e % 256).alias("r"), (e * 7 % 256).alias("g"), (e * 13 % 256).alias("b"), F.when(e % 9 == 0, 0).otherwise(255).alias("a"))
    return px.select("event_id", tiles.elevation("r", "g", "b", "a").alias("metres"))


@query("SELECT user_id, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id, CAST(max(ts) AS VARCHAR) AS ts, count(*) AS superseded FROM events GROUP BY user_id")
def latest_request(spark: SparkSession, d: str) -> DataFrame:
    """A user's newest request supersedes the earlier ones."""
    latest = limiter.latest(V.load(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"])
    return latest.select("user_id", "event_id", F.col("ts").cast("string").alias("ts"), F.col("n").alias("superseded"))


@query("SELECT CAST(time_bucket(INTERVAL 1 HOUR, ts) AS VARCHAR) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def hourly_events(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums in windows of the clock."""
    rows = limiter.counts(V.load(spark, d, "events"), "1 hour", ["event_type"], total=F.sum("value"))
    return rounded(rows.select(F.col("start").cast("string").alias("hour"), "event_type", "n", "total"), "total", digits=4)


@query("SELECT event_id, event_id % 7 <> 0 AND event_id % 1700 + 450 BETWEEN 512 AND 2048 AND event_id % 1500 + 600 BETWEEN 512 AND 2048 AS valid FROM events")
def valid_uploads(spark: SparkSession, d: str) -> DataFrame:
    """Whether a data URL is a PNG of the declared, allowed size (P10)."""
    e = F.col("event_id")
    width, height = e % 1700 + 450, e % 1500 + 600
    told = F.when(e % 7 == 0, width + 1).otherwise(width)  # the header of every seventh says otherwise
    head = F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex(told), 8, "0"), F.lpad(F.hex(height), 8, "0"))
    rows = V.load(spark, d, "events").select("event_id", F.concat(F.lit("data:image/png;base64,"), F.base64(F.unhex(head))).alias("url"), width.alias("w"), height.alias("h"))
    return rows.select("event_id", tiles.valid_upload("url", "w", "h").alias("valid"))


# ---- elevation --------------------------------------------------------------------------------

SMOOTH = ["d2 AS (SELECT req, y, x, coalesce(h, 0) AS s, CAST(h IS NOT NULL AS INT) AS n FROM dem)", _sql_box("d2", "s", "sum", 1, "bs", "req, y, x"), _sql_box("d2", "n", "sum", 1, "bn", "req, y, x"), "sm AS (SELECT req, y, x, CASE WHEN n > 0 THEN s / n END AS h FROM bs JOIN bn USING (req, y, x))"]
SIZE = "size AS (SELECT req, max(y) + 1 AS h, max(x) + 1 AS w FROM dem GROUP BY req)"


def _sql_bilinear(points: str, view: str, values: list[str]) -> str:
    """The known corners' weighted mean at points (k, req, fx, fy)."""
    share = lambda f: f"(f{f} - 0.5::DOUBLE - floor(f{f} - 0.5::DOUBLE))"
    weight = " * ".join(f"CASE WHEN d{f} = 1 THEN {share(f)} ELSE 1 - {share(f)} END" for f in "xy")
    at = lambda f, most: f"least({most} - 1, greatest(0, CAST(floor(f{f} - 0.5::DOUBLE) AS BIGINT) + d{f})) AS {f}"
    means = ", ".join(f"CASE WHEN sum(q) FILTER (v.{v} IS NOT NULL) > 0 THEN sum(q * v.{v}) / sum(q) FILTER (v.{v} IS NOT NULL) END AS {v}" for v in values)
    return f"""corner AS (SELECT k, req, {at('x', 'w')}, {at('y', 'size.h')}, {weight} AS q FROM {points} JOIN size USING (req), (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) o(dx, dy) WHERE fx >= 0 AND fx < w AND fy >= 0 AND fy < size.h),
read AS (SELECT k, {means} FROM corner JOIN {view} v USING (req, y, x) GROUP BY k)"""


#: Elevations as three bytes of a pixel, and as what these decode to.
BYTES = "dem AS (SELECT req, y, x, CASE WHEN NOT (y % 17 = 0 AND x % 13 = 0) THEN floor((50 + 100 * v + 32768) * 256) / 256::DOUBLE - 32768 END AS h FROM grid)"
CELLS_ON = "pt AS (SELECT (req * 90 + y) * 90 + x AS k, req, y, x, (x * 3 + 1.5::DOUBLE) * 0.25::DOUBLE + (39 + req % 3) * 8 - 320 AS fx, (y * 3 + 1.5::DOUBLE) * 0.25::DOUBLE AS fy FROM (SELECT DISTINCT req FROM grid), range(90) a(y), range(90) b(x))"
HORN = """wide AS (SELECT sm.*, coalesce(w.h, CASE WHEN sm.x = 0 THEN sm.h END) AS a, coalesce(e.h, CASE WHEN sm.x = size.w - 1 THEN sm.h END) AS b FROM sm JOIN size USING (req) LEFT JOIN sm w ON w.req = sm.req AND w.y = sm.y AND w.x = sm.x - 1 LEFT JOIN sm e ON e.req = sm.req AND e.y = sm.y AND e.x = sm.x + 1),
horn AS (SELECT c.req, c.y, c.x, c.h, sqrt(pow((n.b + 2 * c.b + s.b - (n.a + 2 * c.a + s.a)) / (8 * m), 2) + pow((s.a + 2 * s.h + s.b - (n.a + 2 * n.h + n.b)) / (8 * m), 2)) AS slope
    FROM wide c JOIN size USING (req) JOIN wide n ON n.req = c.req AND n.x = c.x AND n.y = greatest(c.y - 1, 0) JOIN wide s ON s.req = c.req AND s.x = c.x AND s.y = least(c.y + 1, size.h - 1), metre)"""


def _tile_pixels(spark: SparkSession, d: str) -> DataFrame:
    """Each grid as four elevation tiles of 32 pixels a side."""
    h = V.dem(V.grids(spark, d)).withColumn("m", F.floor((F.coalesce("h", F.lit(0.0)) + 32768) * 256))
    half = lambda c: F.floor(F.col(c) / 32)
    return h.select("req", (20 + half("y")).alias("ty"), (10 + half("x")).alias("tx"), (F.col("y") % 32).alias("y"), (F.col("x") % 32).alias("x"), F.floor(F.col("m") / 65536).alias("r"), F.floor(F.col("m") / 256 % 256).alias("g"), (F.col("m") % 256).alias("b"), F.when(F.col("h").isNull(), 0).otherwise(255).alias("a"))


@query(with_(V.GRIDS, BYTES, *SMOOTH, SIZE, "metre AS (SELECT 156543.03392804097::DOUBLE * cos(radians(37.5::DOUBLE)) / 4096 * 8 AS m)", HORN, CELLS_ON, _sql_bilinear("pt", "horn", ["h", "slope"])) + "SELECT req, y, x, round(h + 1e-7::DOUBLE, 5) AS elev, round(CASE WHEN slope IS NOT NULL THEN greatest(0, least(1, slope / 0.08::DOUBLE)) END + 1e-7::DOUBLE, 5) AS slope FROM pt LEFT JOIN read USING (k)")
def relief_on_cells(spark: SparkSession, d: str) -> DataFrame:
    """Decoded elevation tiles, smoothed, sloped and sampled onto the cells of each request's image, which lies on them at another scale."""
    pixels = _tile_pixels(spark, d)
    whole = {"lat": 37.5, "zoom": 14, "y0": 80, "tile_px": 32, "field_zoom": 12, "field_x0": 10, "field_y0": 20, "field_px": 32, "gh": 90, "gw": 90}
    requests = T.placed(pixels.select("req").distinct().withColumns({k: F.lit(v) for k, v in whole.items()}).withColumn("x0", 39 + F.col("req") % 3))
    found = T.relief(T.mosaic(pixels, requests), requests, 3)
    # many values are short decimals: moved off the middle between two roundings
    return rounded(found.withColumns({c: F.col(c) + 1e-7 for c in ("elev", "slope")}), "elev", "slope", digits=5)


WAYS = V.PATHS + ", many AS (SELECT max(req) + 1 AS n FROM grid), line AS (SELECT user_id % n AS req, row_number() OVER (PARTITION BY user_id % n ORDER BY user_id, i) AS i, lat, lng FROM path, many)"
ALONG = f"""prev AS (SELECT *, lag(lat) OVER w AS plat, lag(lng) OVER w AS plng FROM line WINDOW w AS (PARTITION BY req ORDER BY i)), steps AS (SELECT *, CASE WHEN plat IS NULL THEN 0 ELSE {_sql_hav('plat', 'plng', 'lat', 'lng')} END AS step_m FROM prev),
up AS (SELECT *, sum(step_m) OVER (PARTITION BY req ORDER BY i ROWS UNBOUNDED PRECEDING) AS upto FROM steps),
res AS (SELECT req, k AS n, plat + (lat - plat) * t AS lat, plng + (lng - plng) * t AS lng FROM (SELECT *, (k * 3000 - (upto - step_m)) / step_m AS t FROM up, LATERAL (SELECT unnest(range(CAST(floor((upto - step_m) / 3000) AS BIGINT) + 1, CAST(floor(upto / 3000) AS BIGINT) + 1)) AS k) s WHERE step_m > 0)
    UNION ALL SELECT req, 0, arg_min(lat, i), arg_min(lng, i) FROM line GROUP BY req UNION ALL SELECT req, 1000000000, arg_max(lat, i), arg_max(lng, i) FROM line GROUP BY req HAVING count(*) > 1),
pt AS (SELECT row_number() OVER (ORDER BY req, n) AS k, req, n, (lng + 180) / 360 * 65536 - 1745 * 32 AS fx, (0.5::DOUBLE - ln((1 + sin(radians(lat))) / (1 - sin(radians(lat)))) / (4 * {PI})) * 65536 - 793 * 32 AS fy FROM res)"""


@query("WITH RECURSIVE " + ", ".join([V.GRIDS, V.DEM, *SMOOTH, SIZE, WAYS, ALONG, _sql_bilinear("pt", "sm", ["h"])]) + """, s AS MATERIALIZED (SELECT req, row_number() OVER (PARTITION BY req ORDER BY n) AS i, h AS e FROM pt JOIN read USING (k) WHERE h IS NOT NULL),
f AS (SELECT req, i, e AS low, e AS top, false AS up, 0::DOUBLE AS total FROM s WHERE i = 1 UNION ALL SELECT s.req, s.i, CASE WHEN NOT up AND e < low THEN e WHEN up AND e <= top AND top - e > 8 THEN e ELSE low END, CASE WHEN NOT up AND e - low > 8 THEN e WHEN up AND e > top THEN e ELSE top END, CASE WHEN NOT up AND e - low > 8 THEN true WHEN up AND e <= top AND top - e > 8 THEN false ELSE up END, total + CASE WHEN NOT up AND e - low > 8 THEN e - low WHEN up AND e > top THEN e - top ELSE 0 END FROM f JOIN s ON s.req = f.req AND s.i = f.i + 1)
SELECT req, round(arg_max(total, i), 4) AS ascent_m FROM f GROUP BY req""")
def climb_along_paths(spark: SparkSession, d: str) -> DataFrame:
    """Metres climbed along each request's path, from its smoothed field each 3 km."""
    from pyspark.sql import Window

    grids = V.grids(spark, d)
    many = grids.agg((F.max("req") + 1).alias("many"))  # one row
    path = V.paths(spark, d).crossJoin(F.broadcast(many)).withColumn("req", F.col("user_id") % F.col("many"))
    path = path.select("req", F.row_number().over(Window.partitionBy("req").orderBy("user_id", "i")).alias("i"), "lat", "lng")
    requests = grids.select("req").distinct().select("req", F.lit(11).alias("field_zoom"), F.lit(1745).alias("field_x0"), F.lit(793).alias("field_y0"), F.lit(32).alias("field_px"))
    return rounded(T.climbed(path, V.dem(grids), requests, 3000.0), "ascent_m", digits=4)


# ---- guards, features and attributes ----------------------------------------------------------


@query(with_(V.GRIDS, V.MASKS, PTS64.replace("/ 100::DOUBLE AS px", "// 100 AS x").replace("/ 100::DOUBLE AS py", "// 100 AS y")) + ", size AS (SELECT req, max(y) + 1 AS h FROM grid GROUP BY req) SELECT id, round(sum(green) / ((least(h - 1, any_value(pt.y) + 2) - greatest(0, any_value(pt.y) - 2) + 1) * (least(63, any_value(pt.x) + 2) - greatest(0, any_value(pt.x) - 2) + 1)), 8) AS fraction FROM pt JOIN size USING (req) JOIN masks m ON m.req = pt.req AND m.y BETWEEN pt.y - 2 AND pt.y + 2 AND m.x BETWEEN pt.x - 2 AND pt.x + 2 WHERE pt.y < h GROUP BY id, h")
def box_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Class share around points by a summed-area table."""
    grids = V.masks(V.grids(spark, d))
    high = grids.groupBy("req").agg((F.max("y") + 1).alias("h"))
    points = _points64(spark, d).select("id", "req", F.floor("py").alias("y"), F.floor("px").alias("x")).join(high, "req").where("y < h")
    sat = S.summed_area(grids.select("req", "y", "x", "green"), "green", ["req"]).select("req", "y", "x", "sat")
    return rounded(C.box_fraction(sat, points, 2, F.col("h"), 64, ["req"]).select("id", "fraction"), "fraction", digits=8)


@query(with_(V.CANDIDATES) + """SELECT cell, i - 1 AS n, round([green, open, water, "waterNear", built, major, secondary, minor, thin, path, "minorDensity",
    greatest(0::DOUBLE, least(1::DOUBLE, "elevGain")), CASE WHEN slope < 0 THEN -1 ELSE least(1::DOUBLE, slope) END][i], 6) AS value FROM cand, range(1, 14) r(i)""")
def feature_vectors(spark: SparkSession, d: str) -> DataFrame:
    rows = V.candidates(spark, d).select("cell", F.posexplode(C.feature_vector()).alias("n", "value"))
    return rounded(rows.withColumn("n", F.col("n").cast("long")), "value")


@query("""SELECT user_id, CASE WHEN min(value) < 0.02 THEN 'blank' WHEN count(*) < 50 THEN 'no-road' WHEN count(*) FILTER (event_type = 'purchase') = 0 THEN 'no-match' WHEN abs(sum(value) / 2500 - 1) > 0.3 THEN 'diverged' END AS reason FROM events GROUP BY user_id""")
def guards(spark: SparkSession, d: str) -> DataFrame:
    """The reason why a request stops, in the order of its checks."""
    one = V.load(spark, d, "events").groupBy("user_id").agg(F.min("value").alias("low"), F.count("*").alias("n"), F.count_if(F.col("event_type") == "purchase").alias("bought"), F.sum("value").alias("total"))
    return one.select("user_id", C.guard([("blank", F.col("low") < 0.02), ("no-road", F.col("n") < 50), ("no-match", F.col("bought") == 0), ("diverged", F.abs(F.col("total") / 2500 - 1) > 0.3)]).alias("reason"))


@query(with_(V.CANDIDATES) + """SELECT event_id, coalesce(category, kind) AS label FROM events LEFT JOIN cand ON cand.cell = event_id""")
def waypoint_labels(spark: SparkSession, d: str) -> DataFrame:
    """A stop's label from the candidate of its cell."""
    cand = V.candidates(spark, d).select("cell", F.coalesce("category", "kind").alias("label"))
    return V.load(spark, d, "events").select("event_id").join(cand, F.col("event_id") == F.col("cell"), "left").select("event_id", "label")


@query("""SELECT user_id, round(sum(CASE WHEN near AND prev IS NOT NULL THEN sqrt(pow(y - prev.y, 2) + pow(x - prev.x, 2)) * 3 ELSE 0 END), 4) AS edge_m, round(sum(CASE WHEN prev IS NOT NULL THEN sqrt(pow(y - prev.y, 2) + pow(x - prev.x, 2)) * 3 ELSE 0 END), 4) AS length_m
FROM (SELECT *, lag({'y': y, 'x': x}) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM (SELECT user_id, event_id, event_id % 64 AS y, event_id * 7 % 64 AS x, event_id % 3 = 0 AS near FROM events)) GROUP BY user_id""")
def cell_path_length(spark: SparkSession, d: str) -> DataFrame:
    """Length of a cell path, and of its part beside water."""
    e = F.col("event_id")
    cells = V.load(spark, d, "events").select("user_id", "event_id", (e % 64).alias("y"), (e * 7 % 64).alias("x"))
    return rounded(P.cell_length(cells, "user_id", "event_id", 3, e % 3 == 0), "edge_m", "length_m", digits=4)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')")
def never_urgent(spark: SparkSession, d: str) -> DataFrame:
    """Requested keys without a match: an anti-join."""
    urgent = V.load(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select("o_custkey")
    return V.load(spark, d, "customer").select("c_custkey").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti")
