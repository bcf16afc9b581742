"""Requests to map windows and tiles (S01-S03, S11, scalar functions)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridstride.functions import fixed
from gridstride.functions.geo import half_up, metres_per_pixel, world_x, world_y

#: Fixed value: zoom and pixels of elevation tiles.
TERRAIN_ZOOM, TERRAIN_PX = 12, 256


def _trim(low: str, high: str, world: str) -> DataFrame:
    """At most MAX_TILES from low to high, giving up the end that is farther from the origin."""
    # each step drops one tile, so the state (low, high) is folded over the surplus
    step = f"""aggregate(sequence(1, 64), struct({low} as a, {high} as b), (s, k) ->
        if(s.b - s.a + 1 <= {fixed.MAX_TILES}, s,
           if({world} - s.a * {fixed.TILE_PX} > (s.b + 1) * {fixed.TILE_PX} - {world}, struct(s.a + 1L as a, s.b as b), struct(s.a as a, s.b - 1L as b))))"""
    return F.expr(step)


def plan_grid(requests: DataFrame) -> DataFrame:
    """Add the tile window of each request (columns lat, lng, minutes): z, mpp, x0, y0, cols, rows, origin_px, origin_py, half_m."""
    zoom = F.create_map(*[F.lit(v) for kv in fixed.ZOOM.items() for v in kv])
    target = F.col("minutes") / 60.0 * fixed.WALK_KMH * 1000
    base = requests.withColumn("z", zoom[F.col("minutes")]).withColumn("half_m", fixed.WINDOW_FACTOR * target / (2 * math.pi))
    base = base.withColumn("mpp", metres_per_pixel("lat", F.col("z"), fixed.TILE_PX)).withColumn("half_px", F.col("half_m") / F.col("mpp"))
    base = base.withColumn("wx", world_x("lng", F.col("z"), fixed.TILE_PX)).withColumn("wy", world_y("lat", F.col("z"), fixed.TILE_PX))
    last = F.pow(F.lit(2.0), F.col("z")).cast("long") - 1
    for axis, w in (("x", "wx"), ("y", "wy")):
        base = base.withColumn(f"{axis}lo", F.greatest(F.lit(0).cast("long"), F.floor((F.col(w) - F.col("half_px")) / fixed.TILE_PX)))
        base = base.withColumn(f"{axis}hi", F.least(last, F.floor((F.col(w) + F.col("half_px")) / fixed.TILE_PX)))
    base = base.withColumn("tx", _trim("xlo", "xhi", "wx")).withColumn("ty", _trim("ylo", "yhi", "wy"))
    return base.select(
        *requests.columns, "z", "mpp", "half_m", F.col("tx.a").alias("x0"), F.col("ty.a").alias("y0"), (F.col("tx.b") - F.col("tx.a") + 1).alias("cols"), (F.col("ty.b") - F.col("ty.a") + 1).alias("rows"),
        (F.col("wx") - F.col("tx.a") * fixed.TILE_PX).alias("origin_px"), (F.col("wy") - F.col("ty.a") * fixed.TILE_PX).alias("origin_py"),
    )


def tiles(plan: DataFrame) -> DataFrame:
    """One row per tile of each plan: x, y and the shard that serves it."""
    rows = plan.withColumn("x", F.explode(F.sequence("x0", F.col("x0") + F.col("cols") - 1))).withColumn("y", F.explode(F.sequence("y0", F.col("y0") + F.col("rows") - 1)))
    return rows.withColumn("shard", F.substring(F.lit("abcd"), (F.col("x") + F.col("y")).bitwiseAND(F.lit(3)).cast("int") + 1, F.lit(1)))


def tile_key(layer: str, labels: bool = False) -> F.Column:
    """A tile's path: shard, layer, z/x/y."""
    return F.format_string(f"%s/{layer}{'_labels' if labels else ''}/%d/%d/%d.png", "shard", "z", "x", "y")


def plan_terrain(requests: DataFrame) -> DataFrame:
    """The 2 x 2 elevation tiles whose shared corner is nearest: tx0, ty0."""
    most = 2**TERRAIN_ZOOM - 2
    one = lambda w: F.least(F.lit(most).cast("long"), F.greatest(F.lit(0).cast("long"), half_up(w) - 1))
    return requests.withColumn("tx0", one(world_x("lng", F.lit(TERRAIN_ZOOM), 1))).withColumn("ty0", one(world_y("lat", F.lit(TERRAIN_ZOOM), 1)))


def valid_location(lat: str = "lat", lng: str = "lng") -> F.Column:
    return ~F.isnan(lat) & ~F.isnan(lng) & (F.abs(lat) <= 85) & (F.abs(lng) <= 180)


def expected_tiles(plan: DataFrame, have: DataFrame, missing_limit: int = 2) -> DataFrame:
    """Per request: how many of its tiles are missing from ``have`` (z, x, y), and whether it can go on.

    It can if at most ``missing_limit`` are, the tile of the origin not among them.
    """
    wanted = tiles(plan).withColumn("origin", (F.col("x") == F.col("x0") + F.floor(F.col("origin_px") / fixed.TILE_PX)) & (F.col("y") == F.col("y0") + F.floor(F.col("origin_py") / fixed.TILE_PX)))
    joined = wanted.join(have.select("z", "x", "y", F.lit(True).alias("there")).distinct(), ["z", "x", "y"], "left")
    gone = F.col("there").isNull()
    return joined.groupBy("id", "minutes").agg(F.count_if(gone).alias("missing"), (~((F.count_if(gone) > missing_limit) | F.bool_or(gone & F.col("origin")))).alias("ok"))


def attempts(plan: DataFrame, have: DataFrame) -> DataFrame:
    """Each tile of each plan with ``attempt``: 1 if its own shard has it in ``have`` (z, x, y, shard), 2 if the next one has, null if neither."""
    names = "abcd"
    after = F.create_map(*[F.lit(v) for k in range(4) for v in (names[k], names[(k + 1) % 4])])
    tried = tiles(plan).withColumn("t", F.explode(F.array(F.struct(F.col("shard").alias("at"), F.lit(1).alias("n")), F.struct(after[F.col("shard")].alias("at"), F.lit(2).alias("n")))))
    found = tried.join(have.select("z", "x", "y", F.col("shard").alias("at_"), F.lit(True).alias("there")).distinct(), ["z", "x", "y"], "left")
    hit = F.when(F.col("there") & (F.col("at_") == F.col("t.at")), F.col("t.n"))
    return found.groupBy("id", "minutes", "z", "x", "y").agg(F.min(hit).alias("attempt"))
