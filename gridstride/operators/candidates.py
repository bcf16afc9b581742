"""Candidate stops: weights, scores, tags, bands, top-k and sampling."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridstride.functions import fixed
from gridstride.functions.geo import wrap_angle


def weight_table(spark: SparkSession, weights: dict[str, dict[str, float]], fields: list[str]) -> DataFrame:
    """(tag, field, n, weight): one row for each weight of a tag."""
    return spark.createDataFrame([(t, f, fields.index(f), float(w)) for t, ws in weights.items() for f, w in ws.items()], "tag string, field string, n int, weight double")


def summed_weights(requests: DataFrame, weights: DataFrame) -> DataFrame:
    """Per request (id, tags) and field, the sum of its tags' weights; unknown tags add nothing."""
    return requests.select("id", F.explode("tags").alias("tag")).join(F.broadcast(weights), "tag").groupBy("id", "field").agg(F.sum("weight").alias("weight"))


def score(tags: list[str]) -> Column:
    """The score of a candidate for some tags: its features times their summed weights."""
    total = {f: sum(fixed.SCORE_WEIGHTS[t].get(f, 0.0) for t in tags if t in fixed.SCORE_WEIGHTS) for f in fixed.FEATURES}
    return sum((F.col(f) * w for f, w in total.items() if w), F.lit(0.0))


def scored_by_tag(cands: DataFrame) -> DataFrame:
    """Each candidate with each tag that it matches, and its score for that tag."""
    each = F.explode(F.array_compact(F.array(*[F.when(matches(t), F.struct(F.lit(t).alias("tag"), score([t]).alias("score"))) for t in fixed.SCORE_WEIGHTS])))
    return cands.withColumn("t", each).select(*cands.columns, "t.tag", "t.score")


def matches(tag: str) -> Column:
    """Whether a candidate (kind, category and features) fits a tag."""
    c, kind, category = F.col, F.col("kind"), F.coalesce("category", F.lit(""))
    rule = {
        "nature": (kind == "green") | category.isin("green", "mountain") | (c("green") >= 0.12),
        "river": (kind == "shore") | (category == "water") | (c("waterNear") > 0),
        "urban": (kind == "built") | category.isin("building", "culture") | (c("built") >= 0.1),
        "cafe": category == "cafe",
        "hill": (category == "mountain") | (c("elevGain") >= 0.15),
        "flat": (c("slope") >= 0) & (c("slope") < 0.08),
        "alley": (c("thin") > 0) & (c("major") < 0.1),
        "quiet": ((c("green") >= 0.1) | (c("path") > 0)) & (c("major") < 0.08),
        "lively": category.isin("shop", "culture") | (c("built") >= 0.1) & (c("major") + c("secondary") > 0),
        "night": (c("waterNear") > 0) | (c("built") >= 0.1),
    }
    return rule[tag]


def matching_tags() -> Column:
    return F.array_compact(F.array(*[F.when(matches(t), F.lit(t)) for t in fixed.SCORE_WEIGHTS]))


def filtered(cands: DataFrame, tags: list[str]) -> DataFrame:
    """Candidates that match any of the tags (all, if none is asked), with the tags they match."""
    wanted = F.array(*map(F.lit, dict.fromkeys(tags))) if tags else F.array().cast("array<string>")
    rows = cands.withColumn("matched", F.array_intersect(matching_tags(), wanted))
    return rows.where(F.size("matched") > 0) if tags else rows


def missing_tags(cands: DataFrame, tags: list[str]) -> DataFrame:
    """The asked tags that no candidate matches (one row)."""
    wanted = F.array(*map(F.lit, dict.fromkeys(tags)))
    return filtered(cands, tags).agg(F.array_distinct(F.flatten(F.collect_set("matched"))).alias("found")).select(F.array_sort(F.array_except(wanted, "found")).alias("missing"))


def order() -> list[Column]:
    """Best score first; then the nearer, then the smaller cell."""
    return [F.desc("score"), F.col("d"), F.col("cell")]


def top(cands: DataFrame, by: list[str], k: int = fixed.TOP) -> DataFrame:
    return cands.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order()))).where(F.col("rank") <= k)


def band(name: str, target_m: float, scale: float = 1.0) -> tuple[float, float]:
    """A band's limits in metres: its centre moves with the scale, its width stays."""
    low, high = fixed.BANDS[name]
    centre, half = (low + high) / 2 * scale, (high - low) / 2
    return (centre - half) * target_m, (centre + half) * target_m


def in_band(name: str, target_m: float, scale: float = 1.0) -> Column:
    return F.col("d").between(*band(name, target_m, scale))


def in_sector(turn: Column | float, sign: int, sector: tuple[float, float]) -> Column:
    return (wrap_angle(F.col("bearing") - turn) * sign).between(*map(math.radians, sector))


def softmax_pick(pool: DataFrame, by: list[str], draw: Column, tau: float = fixed.TAU) -> DataFrame:
    """The row of each group that a roulette over exp(score / tau) picks, given a draw from 0 to 1."""
    group = Window.partitionBy(*by)
    best = F.max("score").over(group)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    weight = F.when(finite(F.col("score")), F.exp((F.col("score") - best) / tau)).otherwise(0.0)
    rows = pool.withColumn("_w", F.when(finite(best), weight).otherwise(1.0))  # without a finite best all are alike
    rows = rows.withColumn("_upto", F.sum("_w").over(group.orderBy(*order()).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_w").over(group))
    hit = rows.where(draw * F.col("_all") < F.col("_upto"))
    return hit.withColumn("_n", F.row_number().over(group.orderBy("_upto"))).where("_n = 1").drop("_w", "_upto", "_all", "_n")


def capped(cands: DataFrame, most: int = 400) -> DataFrame:
    """All green and icon candidates, and the best others up to ``most`` in all.

    Others are ranked by a global limit (each task keeps its best), not by one window.
    """
    kept = cands.where("kind = 'green' or kind = 'icon'")
    room = F.greatest(F.lit(0), F.lit(most) - F.count("*"))
    best = cands.where("not (kind = 'green' or kind = 'icon')").orderBy(*order()).limit(most)
    ranked = best.withColumn("_n", F.row_number().over(Window.orderBy(*order())))  # at most ``most`` rows
    return kept.unionByName(ranked.crossJoin(kept.agg(room.alias("_room"))).where("_n <= _room").drop("_n", "_room"))


def capped_each(cands: DataFrame, by: list[str], most: int) -> DataFrame:
    """The same cap for each request: its green candidates and elements stay, and the best others up to ``most`` in all."""
    kept = (F.col("kind") == "green") | F.col("category").isNotNull()
    rows = cands.withColumn("_kept", kept)
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "_kept").orderBy(*order()))).withColumn("_all", F.count_if(F.col("_kept")).over(Window.partitionBy(*by)))
    return rows.where("_kept or _n <= greatest(0, %d - _all)" % most).drop("_kept", "_n", "_all")


def systematic(rows: DataFrame, by: Sequence[str], every: int | Column, parts: int = 64) -> DataFrame:
    """Every k-th row of each group in cell order, from its first.

    A group is cut into ``parts`` ranges of cells whose sizes are counted first, so
    that ranks are made within ranges and a large group is no single task.
    """
    ends = rows.groupBy(*by).agg(F.min("cell").alias("_low"), F.max("cell").alias("_high"))
    rows = rows.join(ends, list(by)) if by else rows.crossJoin(F.broadcast(ends))  # one row
    rows = rows.withColumn("_part", F.floor((F.col("cell") - F.col("_low")) * parts / (F.col("_high") - F.col("_low") + 1)))
    sizes = rows.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = sizes.select(*by, "_part", before.alias("_base"))
    rank = F.row_number().over(Window.partitionBy(*by, "_part").orderBy("cell")) - 1 + F.col("_base")
    every = F.lit(every) if isinstance(every, int) else every
    return rows.join(base, [*by, "_part"]).withColumn("_n", rank).where(F.col("_n") % every == 0).drop("_low", "_high", "_part", "_base", "_n")


def shore_stride(half_m: Column, cell_m: Column) -> Column:
    """Cells between samples of a shore: 120 metres, or a fortieth of the window's width if that is more."""
    return F.greatest(F.lit(1), F.floor(F.greatest(F.lit(fixed.SHORE_STRIDE_M), 2 * half_m / 40) / cell_m + 0.5))


def turn_fallback(cands: DataFrame, by: list[str], target_m: float, scale: float = 1.0) -> DataFrame:
    """The candidate of each group whose distance is nearest to the fallback; ties to the smaller cell."""
    goal = fixed.TURN_FALLBACK * scale * target_m
    return cands.groupBy(*by).agg(F.min_by(F.struct("cell", "d"), F.struct(F.abs(F.col("d") - goal), "cell")).alias("c")).select(*by, "c.cell", "c.d")


def first_wins(parts: list[DataFrame], by: Sequence[str] = (), order: Sequence[str] = ()) -> DataFrame:
    """Union in priority order; of rows of one cell the first part's stays."""
    rows = parts[0].withColumn("_p", F.lit(0))
    for p, part in enumerate(parts[1:], 1):
        rows = rows.unionByName(part.withColumn("_p", F.lit(p)))
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "cell").orderBy("_p", *order))).where("_n = 1").drop("_n", "_p")


def best_of_macro_cells(cells: DataFrame, value: str, side: int | Column, by: Sequence[str] = ()) -> DataFrame:
    """Of each side x side block, the cell of the largest value; ties to the first in row order."""
    side = F.lit(side) if isinstance(side, int) else side
    blocks = [F.floor(F.col("y") / side).alias("my"), F.floor(F.col("x") / side).alias("mx")]
    return cells.groupBy(*by, *blocks).agg(F.max_by(F.struct("y", "x", value), F.struct(value, -F.col("y"), -F.col("x"))).alias("c")).select(*by, "my", "mx", "c.y", "c.x", f"c.{value}")


def box_fraction(sat: DataFrame, points: DataFrame, reach: int | Column, height: int | Column, width: int | Column, by: Sequence[str] = (), values: Sequence[str] = ("sat",)) -> DataFrame:
    """Mean of a value over the clipped square around each point (by, id, y, x), from four corners of a summed-area table; ``fraction``, or a column for each of several ``values``."""
    to = lambda v: F.lit(v) if isinstance(v, int) else v
    reach, height, width = to(reach), to(height), to(width)
    low = lambda c: F.greatest(F.lit(0), F.col(c) - reach)
    high = lambda c, n: F.least(n - 1, F.col(c) + reach)
    corner = lambda y, x, s: F.struct(y.cast("long").alias("y"), x.cast("long").alias("x"), F.lit(s).alias("s"))
    y0, y1, x0, x1 = low("y") - 1, high("y", height), low("x") - 1, high("x", width)
    area = (y1 - y0) * (x1 - x0)
    rows = points.select(*by, "id", area.alias("area"), F.explode(F.array(corner(y1, x1, 1), corner(y0, x1, -1), corner(y1, x0, -1), corner(y0, x0, 1))).alias("c")).select(*by, "id", "area", "c.y", "c.x", "c.s")
    sums = rows.join(sat, [*by, "y", "x"], "left").groupBy(*by, "id", "area").agg(*[F.sum(F.col("s") * F.coalesce(v, F.lit(0))).alias(v) for v in values])
    return sums.select(*by, "id", *[(F.col(v) / F.col("area")).alias("fraction" if len(values) == 1 else v) for v in values])


def feature_vector() -> Column:
    """The features of a candidate as one array, unknown gain 0 and unknown slope -1, both kept in their range."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))
    return F.array(*[F.coalesce(unit(f), F.lit(0.0)) if f == "elevGain" else F.when(F.col(f) < 0, -1.0).otherwise(F.coalesce(unit(f), F.lit(-1.0))) if f == "slope" else F.col(f) for f in fixed.FEATURES])


def cost(weights: dict[str, Column | float] | None = None) -> Column:
    """Cost of a metre on a walk cell (kind and the cost fields but major and secondary): its kind's, times the theme's factor within its limits; trunk roads have no factor, null off roads."""
    base = F.create_map(*[F.lit(x) for k, v in fixed.KIND_COST.items() for x in (fixed.KINDS[k], v)])[F.col("kind")]
    w = {f: F.lit(0.0) for f in fixed.COST_FIELDS} | {f: v if isinstance(v, Column) else F.lit(float(v)) for f, v in (weights or {}).items()}
    of_kind = F.when(F.col("kind") == fixed.KINDS["MAJOR"], w["major"]).when(F.col("kind") == fixed.KINDS["SECONDARY"], w["secondary"]).otherwise(0.0)
    sum_ = sum((w[f] * F.col(f) for f in ("nearGreen", "nearWater", "thin", "slope")), of_kind)
    factor = F.greatest(F.lit(fixed.THEME_MIN), F.least(F.lit(fixed.THEME_MAX), F.exp(sum_)))
    return F.when(F.col("kind") == fixed.KINDS["TRUNK"], F.lit(fixed.KIND_COST["TRUNK"])).otherwise(base * factor)


def guard(checks: list[tuple[str, Column]]) -> Column:
    """The first failed check's reason, null if all hold."""
    return F.coalesce(*[F.when(failed, F.lit(reason)) for reason, failed in checks])
