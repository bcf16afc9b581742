"""From the pixels of map images to round courses, for many requests at once.

Every step is a table operation keyed by the request ``req``; only the search for a
round trip, which draws random numbers in order, is one Arrow group a request.

Tables: ``requests`` (req, lat, lng, zoom, x0, y0, tile_px, mpp, width, height, origin_px,
origin_py, half_m, minutes, tags, seed, analysed), ``pixels`` (req, y, x, r, g, b, a and
perhaps missing: that of a tile that is not there), ``elements`` (req, n, kind,
category, label, x, y, confidence; pixels of the image) and ``terrain`` (req, ty,
tx, y, x, r, g, b, a: pixels of elevation tiles). With terrain, ``requests`` also
has field_zoom, field_x0, field_y0 and field_px, its tiles' zoom, first tile and side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridstride.functions import fixed
from gridstride.functions.geo import half_up, haversine, lat_of, lng_of
from gridstride.operators import candidates as C
from gridstride.operators import graph as G
from gridstride.operators import paths as P
from gridstride.operators import pixels as X
from gridstride.operators import stencils as S
from gridstride.operators import terrain as T

BY = ["req"]
#: Classes whose share around a candidate is a feature.
AROUND = {"green": "GREEN", "open": "OPEN", "water": "WATER", "major": "MAJOR", "secondary": "SEC_CASE", "minor": "MINOR", "path": "PATH"}


def in_cells(metres: float | Column, least: int = 1) -> Column:
    """So many metres as whole cells, rounded."""
    return F.greatest(F.lit(least), half_up((F.lit(metres) if isinstance(metres, float) else metres) / F.col("cell_m")).cast("int"))


def up_to(metres: float | Column) -> Column:
    return F.greatest(F.lit(1), F.ceil((F.lit(metres) if isinstance(metres, float) else metres) / F.col("cell_m")).cast("int"))


@dataclass
class Ground:
    """What a zoom's images show: dense cells with masks and features, and the labelled green cells."""

    requests: DataFrame
    cells: DataFrame
    green: DataFrame
    places: list[DataFrame]  # of green and built regions: req, label, pole and mean position
    width: int
    least_cell_m: float


def clean_mask(cells: DataFrame, classes: list[str]) -> DataFrame:
    """(req, y, x, cell_m, gh, gw, m): cells of the classes, opened (not if cells are over 6 m, to keep thin strips) and closed."""
    raw = cells.select("req", "y", "x", "cell_m", "gh", "gw", X.fraction_mask(classes).alias("m")).withColumn("raw", F.col("m"))
    open_ = S.opened(raw, "m", BY).withColumn("m", F.when(F.col("cell_m") > fixed.OPEN_LEAST_M, F.col("raw")).otherwise(F.col("m")))
    return S.closed(open_.drop("raw"), "m", BY)


def ground(pixels: DataFrame, requests: DataFrame, zoom: int) -> Ground:
    """Classes, cells, masks, regions, walk kinds, widths and features of one zoom's requests."""
    down = X.downsample(zoom)
    requests = requests.withColumn("cell_m", F.col("mpp") * down).withColumn("gw", F.ceil(F.col("width") / down)).withColumn("gh", F.ceil(F.col("height") / down))
    most = requests.agg(F.max("gw").alias("gw"), F.min("cell_m").alias("cell_m")).first()
    width, finest = int(most["gw"]), float(most["cell_m"])
    seen = G.durable(X.classify(pixels.join(requests.select("req", "height", F.col("width").alias("image_width")), "req"), X.lookup_table(X.palette(pixels.sparkSession), zoom)))
    cells = G.durable(X.cells(seen, zoom, BY).join(requests.select("req", "cell_m", "gh", "gw"), "req"))
    built = "BUILT" if zoom >= 15 else "URBAN"
    area = F.col("cell_m") * F.col("cell_m")
    least = lambda m2, n: requests.select("req", F.greatest(F.lit(n), half_up(m2 / area)).alias("least"))
    masks = {name: G.durable(clean_mask(cells, [cls])) for name, cls in (("green", "GREEN"), ("water", "WATER"), ("built", built))}
    labels = {name: G.components(m.where("m = 1"), width, least(m2, n)) for (name, m), m2, n in zip(masks.items(), (fixed.GREEN_LEAST_M2, fixed.WATER_LEAST_M2, fixed.WATER_LEAST_M2), (1, 1, 2), strict=True)}
    labels = {name: G.durable(found) for name, found in labels.items()}
    water = labels["water"].select("req", "y", "x")
    places = []
    for name, other in (("green", water), ("built", None)):
        deep = G.depth(masks[name], "m", F.col("gh"), F.col("gw"))
        places.append(G.durable(G.regions(labels[name], 1.0, deep, other)))

    # walk kinds and widths of their roads
    road = S.closed(X.road_pixels(seen, zoom).select("req", "y", "x", "height", "image_width", "road"), "road", BY)
    widths = S.road_widths(G.depth(road, "road", F.col("height"), F.col("image_width")), cells, down, 1.0)
    walk = cells.withColumn("kind", X.walk_kind()).withColumn("passable", X.passable()).join(widths, ["req", "y", "x"]).withColumn("width", F.col("width") * F.col("cell_m") / down)
    walk = S.thin_roads(walk, zoom, BY)
    wet = walk.join(water.withColumn("water_", F.lit(1)), ["req", "y", "x"], "left").withColumn("m", F.coalesce("water_", F.lit(0)))
    for name, mask, metres in (("nearGreen", masks["green"], fixed.NEAR_GREEN_M), ("nearWater", wet, fixed.NEAR_WATER_M)):
        reach = float(-(-metres // finest))
        near = S.distance_to_mask(mask.select("req", "y", "x", "cell_m", "m"), "m", 1.0, reach, BY).withColumn("metres", F.col("dist") * F.col("cell_m")).select("req", "y", "x", S.closeness("metres", metres).alias(name))
        walk = walk.join(near, ["req", "y", "x"])
    walk = G.durable(walk.join(water.withColumn("wet", F.lit(1)), ["req", "y", "x"], "left").withColumn("wet", F.coalesce("wet", F.lit(0))))
    share = X.classified_share(seen, BY)
    return Ground(requests.join(share, "req", "left"), walk, labels["green"], places, width, finest)


def snapped(points: DataFrame, g: Ground, metres: float) -> DataFrame:
    """(req, id, y, x): the walkable cell nearest to each point (req, id, cx, cy, most) within ``most`` cells."""
    return P.nearest_open(points, g.cells.where("passable = 1"), max(1, int(-(-metres // g.least_cell_m))), BY, "most")


def generated(g: Ground, elements: DataFrame | None = None) -> DataFrame:
    """(req, y, x, kind, category, label): where stops may be, by five generators in order of priority, one for a cell."""
    of = g.requests.select("req", "cell_m", "half_m", F.array_contains("tags", "river").alias("river"))
    put = lambda points, metres: snapped(points, g, metres)
    none = F.lit(None).cast("string")
    parts = []
    if elements is not None:
        sure = elements.where(F.col("confidence") >= fixed.CONFIDENT).join(g.requests.select("req", "cell_m", "mpp"), "req")
        down = F.col("cell_m") / F.col("mpp")
        points = sure.select("req", F.col("n").alias("id"), (F.col("x") / down - 0.5).alias("cx"), (F.col("y") / down - 0.5).alias("cy"), up_to(fixed.ELEMENT_M).alias("most"), "cell_m", "kind", "category", "label")
        found = put(points, fixed.ELEMENT_M).join(points, ["req", "id"])
        near = F.sqrt(F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)) * F.col("cell_m") <= fixed.ELEMENT_M
        kind = F.when(F.col("kind") == "icon", "icon").when(F.col("kind") == "building", "built").when(F.col("category") == "water", "shore").otherwise("green")
        parts.append(found.where(near).select("req", F.col("id").alias("n"), "y", "x", kind.alias("kind"), "category", "label"))
    green, built = (p.join(of, "req") for p in g.places)
    plain = lambda rows, kind: rows.select("req", F.col("id").cast("long").alias("n"), "y", "x", F.lit(kind).alias("kind"), none.alias("category"), none.alias("label"))
    at = lambda rows, cy, cx: rows.select("req", F.col("label").alias("id"), F.col(cx).cast("double").alias("cx"), F.col(cy).cast("double").alias("cy"), up_to(fixed.SNAP_M).alias("most"))
    parts.append(plain(put(at(green, "pole_y", "pole_x"), fixed.SNAP_M), "green"))
    land = g.cells.select("req", "y", "x", (1 - F.col("wet")).alias("land"), "wet")
    shore = S.beside(land, "land", "wet", BY).withColumn("cell", F.col("y") * g.width + F.col("x")).join(of, "req")
    some = C.systematic(shore, BY, C.shore_stride(F.col("half_m"), F.col("cell_m")))
    reach = up_to(F.when(F.col("river"), fixed.SNAP_RIVER_M).otherwise(fixed.SNAP_M))
    parts.append(plain(put(some.select("req", F.col("cell").alias("id"), F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy"), reach.alias("most")), fixed.SNAP_RIVER_M), "shore"))
    first = put(at(built, "pole_y", "pole_x"), fixed.SNAP_M)
    second = put(at(built, "cy", "cx"), fixed.SNAP_M).join(first.select("req", "id"), ["req", "id"], "left_anti")
    parts.append(plain(first.unionByName(second), "built"))
    side = in_cells(F.greatest(F.lit(fixed.MACRO_STRIDE_M), 2 * F.col("half_m") / 18))
    road = C.best_of_macro_cells(g.cells.where("passable = 1").join(of.select("req", "half_m"), "req").withColumn("side", side), "road", F.col("side"), BY)
    parts.append(plain(road.withColumn("id", F.col("y") * g.width + F.col("x")), "road"))
    parts = [p.withColumn("cell", F.col("y") * g.width + F.col("x")) for p in parts]
    return C.first_wins(parts, BY, ["n"])


def features(g: Ground, cands: DataFrame, relief: DataFrame | None = None) -> DataFrame:
    """Add the features of candidates (req, cell, y, x) to them: shares of classes around, closeness, relief."""
    number = fixed.CLASSES
    columns = {name: F.col(f"f{number[cls]}") / 255 for name, cls in AROUND.items()} | {"built": F.col("built_share")}
    dense = g.cells.select("req", "y", "x", *[c.alias(n) for n, c in columns.items()])
    sat = G.durable(S.summed_areas(dense, list(columns), BY))
    of = g.requests.select("req", "cell_m", "gh", "gw")
    points = cands.join(of, "req").withColumn("id", F.col("cell"))
    wide = C.box_fraction(sat, points, in_cells(fixed.FEATURE_M), F.col("gh"), F.col("gw"), BY, list(columns))
    dense_ = C.box_fraction(sat, points, in_cells(fixed.DENSITY_M), F.col("gh"), F.col("gw"), BY, ["minor"]).withColumnRenamed("fraction", "minorDensity")
    here = g.cells.select("req", "y", "x", F.when(F.col("nearWater") > 0, 1.0).otherwise(0.0).alias("waterNear"), F.col("thin").cast("double").alias("thin"))
    out = cands.join(here, ["req", "y", "x"]).join(wide.withColumnRenamed("id", "cell"), ["req", "cell"]).join(dense_.withColumnRenamed("id", "cell"), ["req", "cell"])
    if relief is None:
        return out.withColumn("elevGain", F.lit(0.0)).withColumn("slope", F.lit(-1.0))
    origin = relief.join(g.requests.select("req", F.col("oy").alias("y"), F.col("ox").alias("x")), ["req", "y", "x"]).select("req", F.col("elev").alias("start_m"))
    out = out.join(relief.select("req", "y", "x", "elev", "slope"), ["req", "y", "x"], "left").join(origin, "req", "left")
    gain = (F.col("elev") - F.col("start_m")) / fixed.GAIN_M
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return out.withColumn("elevGain", F.coalesce(unit(gain), F.lit(0.0))).withColumn("slope", F.coalesce(unit(F.col("slope")), F.lit(-1.0))).drop("elev", "start_m")


def _weights(requests: DataFrame, table: dict[str, dict[str, float]], fields: list[str]) -> DataFrame:
    """(req, w): a map from field to the summed weight of the request's tags."""
    spark = requests.sparkSession
    sums = C.summed_weights(requests.select(F.col("req").alias("id"), "tags"), C.weight_table(spark, table, fields))
    return sums.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("field", "weight"))).alias("w")).withColumnRenamed("id", "req")


def _of(field: str) -> Column:
    return F.coalesce(F.try_element_at("w", F.lit(field)), F.lit(0.0))


def scored(requests: DataFrame, cands: DataFrame) -> DataFrame:
    """Add score, and the asked tags that each candidate matches; of all, the best; rows that match none of the asked ones go."""
    rows = cands.join(_weights(requests, fixed.SCORE_WEIGHTS, fixed.FEATURES), "req", "left").join(requests.select("req", F.col("tags").alias("asked")), "req")
    rows = rows.withColumn("score", sum((F.col(f) * _of(f) for f in fixed.FEATURES), F.lit(0.0))).withColumn("tags", F.array_intersect(C.matching_tags(), "asked"))
    return C.capped_each(rows, BY, fixed.MOST_CANDIDATES).where((F.size("asked") == 0) | (F.size("tags") > 0)).drop("w", "asked")


def courses(pixels: DataFrame, requests: DataFrame, elements: DataFrame | None = None, terrain: DataFrame | None = None) -> DataFrame:
    """A course and its facts (``RESULT``), or the reason why there is none, for each request.

    Reasons, in the order of the checks: blank, no-road, vision-unavailable, no-match (no candidates),
    diverged, no-match (a wanted kind is not visited). Images, elements and terrain of other
    requests are not read; a request without terrain has no ascent. An empty table of requests gives no rows.
    """
    out = None
    for zoom in sorted(r["zoom"] for r in requests.select("zoom").distinct().collect()):  # four at most
        one = _courses(pixels, requests.where(F.col("zoom") == zoom), zoom, elements, terrain)
        out = one if out is None else out.unionByName(one)
    return out if out is not None else _named(requests.limit(0).select("req", *[F.lit(None).cast(t).alias(n) for n, t in RESULT.items()]))


POINT = "struct<lat: double, lng: double>"
#: ``path`` and ``stops`` are cells in row order, ``way`` and ``waypoints`` their places on the map; ``turn_index`` is an index of the way.
RESULT = {
    "reason": "string", "length_m": "double", "path": "array<bigint>", "stops": "array<bigint>", "grid_width": "int", "green_regions": "bigint", "water_edge_m": "double", "minor_share": "double", "candidates": "bigint",
    "reached": "bigint", "ascent_m": "double", "way": f"array<{POINT}>", "waypoints": "array<struct<lat: double, lng: double, path_index: bigint, kind: string, label: string, category: string, tags: array<string>>>",
    "turn_index": "bigint", "road_shares": "map<string, double>", "start_offset_m": "double", "classified": "double",
}


def _named(rows: DataFrame) -> DataFrame:
    return rows.select("req", *[F.col(n).cast(t).alias(n) for n, t in RESULT.items()])


def _courses(pixels: DataFrame, requests: DataFrame, zoom: int, elements: DataFrame | None, terrain: DataFrame | None) -> DataFrame:
    down, built = X.downsample(zoom), "BUILT" if zoom >= 15 else "URBAN"
    g = ground(pixels, requests, zoom)
    maps = field = relief = None
    if terrain is not None:
        maps = T.placed(g.requests)
        field = G.durable(T.mosaic(terrain, maps))
        relief = G.durable(T.relief(field, maps, down))
    g.cells = g.cells.withColumn("built_share", F.col(f"f{fixed.CLASSES[built]}") / 255)
    start = g.requests.select("req", F.col("req").alias("id"), (F.col("origin_px") / down).alias("cx"), (F.col("origin_py") / down).alias("cy"), up_to(fixed.SNAP_M).alias("most"))
    origin = G.durable(snapped(start, g, fixed.SNAP_M).select("req", "y", "x"))
    away = G.durable(G.distances(g.cells.where("passable = 1"), origin).join(g.requests.select("req", "cell_m"), "req").select("req", "y", "x", (F.col("metres") * F.col("cell_m")).alias("d")))
    g.requests = g.requests.join(origin.select("req", F.col("y").alias("oy"), F.col("x").alias("ox")), "req", "left").join(away.groupBy("req").agg(F.count("*").alias("reached")), "req", "left")
    bearing = F.atan2((F.col("y") - F.col("oy")).cast("double"), (F.col("x") - F.col("ox")).cast("double"))
    found = generated(g, elements).join(away, ["req", "y", "x"]).join(g.requests.select("req", "oy", "ox"), "req").withColumn("bearing", bearing)
    cands = G.durable(scored(g.requests, features(g, found, relief)))

    # checks before the search
    met = cands.groupBy("req").agg(F.count("*").alias("candidates"), F.array_distinct(F.flatten(F.collect_set("tags"))).alias("met"))
    checked = g.requests.join(met, "req", "left")
    missing = F.array_except(F.array_distinct("tags"), F.coalesce("met", F.array().cast("array<string>")))
    checks = [
        ("blank", F.coalesce(F.col("classified"), F.lit(0.0)) < fixed.LEAST_CLASSIFIED), ("no-road", F.col("oy").isNull() | (F.coalesce("reached", F.lit(0)) < fixed.LEAST_REACHED * F.col("gh") * F.col("gw"))),
        ("vision-unavailable", F.array_contains(missing, "cafe") & ~F.coalesce("analysed", F.lit(False))), ("no-match", F.coalesce("candidates", F.lit(0)) == 0), ("no-match", F.size(missing) > 0),
    ]
    checked = G.durable(checked.withColumn("before", C.guard(checks)))

    # one row of arrays for each request that is left: its image's cells are bounded by the plan
    priced = g.cells.join(_weights(g.requests, fixed.COST_WEIGHTS, fixed.COST_FIELDS), "req", "left").withColumn("slope", F.lit(0.0))
    if relief is not None:
        priced = priced.drop("slope").join(relief.select("req", "y", "x", F.coalesce("slope", F.lit(0.0)).alias("slope")), ["req", "y", "x"], "left").fillna(0.0, ["slope"])
    priced = priced.withColumn("cost", F.when(F.col("passable") == 1, C.cost({f: _of(f) for f in fixed.COST_FIELDS})))
    open_ = checked.where("before is null")
    grids = priced.join(open_.select("req"), "req", "left_semi").groupBy("req").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "x", "cost"))), lambda c: c["cost"]).alias("cost"))
    cell = (F.col("y") * F.col("gw") + F.col("x")).alias("cell")
    stops = cands.join(open_.select("req", "gw"), "req").groupBy("req").agg(F.array_sort(F.collect_list(F.struct(cell, "d", "bearing", "score", "tags"))).alias("cands"))
    asked = open_.join(grids, "req").join(stops, "req").select(
        F.col("req").alias("id"), "seed", (F.col("minutes") / 60.0 * fixed.WALK_KMH * 1000).alias("target_m"), F.create_map(*[F.lit(v) for kv in fixed.STOPS.items() for v in kv])[F.col("minutes")].alias("k"),
        "cell_m", F.col("gh").cast("int").alias("height"), F.col("gw").cast("int").alias("width"), (F.col("oy") * F.col("gw") + F.col("ox")).alias("origin"), "cost", "cands",
    )
    trips = G.durable(G.loops(asked).withColumnRenamed("id", "req").withColumnRenamed("reason", "after"))

    # what the way passes
    way = trips.where("path is not null").join(g.requests.select("req", "gw", "cell_m"), "req").select("req", "gw", "cell_m", F.posexplode("path").alias("i", "cell"))
    way = G.durable(way.select("req", "i", "cell_m", F.floor(F.col("cell") / F.col("gw")).alias("y"), (F.col("cell") % F.col("gw")).alias("x")).join(g.cells.select("req", "y", "x", "kind", "nearWater"), ["req", "y", "x"]))
    greens = P.near_labels(way, g.green, "req", up_to(fixed.SEEN_M), BY).withColumnRenamed("labels", "green_regions")
    edge = P.cell_length(way, "req", "i", F.col("cell_m"), F.col("nearWater") >= 0.5).select("req", F.col("edge_m").alias("water_edge_m"))
    kinds = {k: n.lower() for n, k in fixed.KINDS.items() if n != "NONE"}
    named = F.create_map(*[F.lit(v) for kv in kinds.items() for v in kv])
    share = P.shares(way, "req", "kind").where(F.col("kind") != fixed.KINDS["NONE"])
    roads = share.groupBy("req").agg(F.map_from_entries(F.collect_list(F.struct(F.try_element_at(named, "kind"), "share"))).alias("found"))
    zeros = F.create_map(*[v for n in kinds.values() for v in (F.lit(n), F.lit(0.0))])
    roads = roads.select("req", F.map_zip_with(zeros, "found", lambda _, zero, x: F.coalesce(x, zero)).alias("road_shares"))

    # places on the map
    side = F.col("tile_px")
    centre = lambda c: F.col(c) * down + down / 2
    of = g.requests.select("req", "x0", "y0", "tile_px")
    on_map = lambda rows: rows.join(of, "req").withColumns({"lat": lat_of(F.col("y0") * side + centre("y"), F.lit(zoom), side), "lng": lng_of(F.col("x0") * side + centre("x"), F.lit(zoom), side)}).drop("x0", "y0", "tile_px")
    line = G.durable(on_map(way.select("req", "i", "y", "x")))
    ways = line.groupBy("req").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "lat", "lng"))), lambda p: F.struct(p["lat"].alias("lat"), p["lng"].alias("lng"))).alias("way"))
    stop = trips.select("req", F.posexplode(F.arrays_zip("stops", "kinds")).alias("n", "s")).join(g.requests.select("req", "gw"), "req")
    stop = stop.select("req", "n", F.floor(F.col("s.stops") / F.col("gw")).alias("y"), (F.col("s.stops") % F.col("gw")).alias("x"), F.col("s.kinds").alias("place"))
    about = cands.select("req", "y", "x", "kind", "category", "label", "tags")
    stop = G.durable(on_map(stop.join(about, ["req", "y", "x"], "left")))
    label = F.when(F.coalesce("label", F.lit("")) != "", F.col("label"))
    for kind, text in fixed.PLACE_LABELS.items():
        label = F.coalesce(label, F.when(F.col("kind") == kind, F.lit(text)))
    near = P.nearest_on_path(line.withColumnRenamed("req", "r"), stop.select(F.col("req").alias("r"), "n", F.col("lat").alias("lat0"), F.col("lng").alias("lng0")), "r", ["n"]).withColumnRenamed("r", "req")
    stop = stop.join(near, ["req", "n"]).withColumn("w", F.struct("n", "lat", "lng", F.col("nearest").cast("long").alias("path_index"), F.col("place").alias("kind"), F.coalesce(label, F.lit(fixed.PLACE_LABEL)).alias("label"), "category", "tags"))
    waypoints = stop.groupBy("req").agg(F.transform(F.array_sort(F.collect_list("w")), lambda w: w.dropFields("n")).alias("waypoints"), F.min_by("nearest", F.when(F.col("place") == "turn", F.col("n"))).alias("turn"), F.array_distinct(F.flatten(F.collect_list("tags"))).alias("visited"))
    joined = checked.join(trips, "req", "left")
    start = line.where("i = 0").select("req", F.col("lat").alias("lat1"), F.col("lng").alias("lng1"))
    for more in (greens, edge, roads, ways, waypoints, P.farthest(line, "req").withColumnRenamed("turn", "far"), start):
        joined = joined.join(more, "req", "left")
    joined = joined.withColumn("turn_index", F.coalesce("turn", "far").cast("long")).withColumn("start_offset_m", haversine("lat", "lng", "lat1", "lng1")).withColumn("minor_share", F.col("road_shares")["minor"])
    if terrain is not None:
        joined = joined.join(T.climbed(line.select("req", "i", "lat", "lng"), field, maps), "req", "left")
    else:
        joined = joined.withColumn("ascent_m", F.lit(None).cast("double"))
    unseen = F.size(F.array_except(F.array_distinct("tags"), F.coalesce("visited", F.array().cast("array<string>")))) > 0
    reason = F.coalesce("before", "after", F.when(unseen, "no-match"))
    done = joined.withColumn("reason", reason).withColumn("grid_width", F.col("gw"))
    facts = ("length_m", "path", "stops", "water_edge_m", "minor_share", "ascent_m", "way", "waypoints", "turn_index", "road_shares", "start_offset_m")
    shown = [F.when(F.col("reason").isNull(), F.col(c)).alias(c) for c in facts]
    seen_greens = F.when(F.col("reason").isNull(), F.coalesce("green_regions", F.lit(0))).alias("green_regions")
    return _named(done.select("req", "reason", "grid_width", "candidates", "reached", "classified", seen_greens, *shown))


def card(rows: DataFrame) -> DataFrame:
    """Add a course's title, minutes, difficulty, description and notices.

    Columns read: tags, length_m, minutes, ascent_m, green_regions, water_edge_m, start_offset_m, analysed.
    """
    say = fixed.SENTENCES
    labels = F.create_map(*[F.lit(v) for kv in fixed.TAG_LABELS.items() for v in kv])
    named = F.filter(F.transform("tags", lambda t: F.try_element_at(labels, t)), lambda t: t.isNotNull())
    km = F.col("length_m") / 1000
    rows = rows.withColumn("labels", named)
    title = F.when(F.size("labels") > 0, F.concat(F.array_join(F.slice("labels", 1, 2), " "), F.lit(say["walk"]))).otherwise(say["today"])
    minutes = F.greatest(F.lit(5).cast("long"), half_up(km / fixed.WALK_KMH * 60 / 5) * 5)
    guess = F.when(F.array_contains("tags", "hill") | (F.col("minutes") >= 120), say["medium"]).otherwise(say["easy"])
    difficulty = F.when(F.col("ascent_m").isNull(), guess).when(F.col("ascent_m") >= 60, say["hard"]).when(F.col("ascent_m") >= 25, say["medium"]).otherwise(say["easy"])
    whole = lambda c: c.cast("long").cast("string")
    green = F.when(F.col("green_regions") > 0, F.concat(F.lit(say["green"]), whole(F.col("green_regions")), F.lit(say["places"])))
    water = F.when(F.col("water_edge_m") >= 50, F.concat(F.lit(say["water"]), whole(half_up(F.col("water_edge_m") / 10) * 10), F.lit(say["metres"])))
    tenths = F.format_string("%.1f", half_up(km * 10) / 10)
    facts = F.concat_ws(", ", green, water)
    text = F.concat_ws(
        " ", F.concat(F.array_join("labels", ", "), F.lit(say["mood"]), tenths, F.lit(say["loop"])), F.when(facts != "", F.concat(facts, F.lit(say["passes"]))),
        F.when(F.col("ascent_m").isNotNull(), F.concat(F.lit(say["climb"]), whole(half_up(F.col("ascent_m"))), F.lit(say["climbed"]))), F.lit(say["returns"]),
    )
    offset = F.when(F.col("start_offset_m") > 10, F.concat(F.lit(say["start"]), whole(half_up(F.col("start_offset_m"))), F.lit(say["away"])))
    unread = F.when(~F.col("analysed"), say["unread"])
    mood = F.when(F.arrays_overlap("tags", F.array(*map(F.lit, ("quiet", "lively", "night")))), say["guessed"])
    return rows.select("*", title.alias("title"), minutes.alias("duration"), difficulty.alias("difficulty"), text.alias("description"), F.nullif(F.concat_ws(" ", offset, unread, mood), F.lit("")).alias("notice")).drop("labels")
