"""The whole flow on a lattice of streets, with every reason for having no course."""

import math

import pytest
from pyspark.sql import functions as F

from gridstride.functions import fixed
from gridstride.operators import course, paths
from gridstride.operators import graph as G
from gridstride.operators import pixels as X
from gridstride.operators import stencils as S

KIND = "req long, lat double, lng double, zoom int, x0 int, y0 int, tile_px int, field_zoom int, field_x0 int, field_y0 int, field_px int, mpp double, width int, height int, origin_px double, origin_py double, half_m double, minutes int, tags array<string>, seed long, analysed boolean"
SIDE, MPP = 320, 0.9469
ZOOM, TILE = 16, 512


def world(lat, lng, zoom, tile):
    s = math.sin(math.radians(lat))
    return (0.5 - math.log((1 + s) / (1 - s)) / (4 * math.pi)) * 2**zoom * tile, (lng + 180) / 360 * 2**zoom * tile


def on_map(y, x, zoom=ZOOM, tile=TILE):
    n = math.pi - 2 * math.pi * y / (2**zoom * tile)
    return math.degrees(math.atan(math.sinh(n))), x / (2**zoom * tile) * 360 - 180


Y0, X0 = (int(v // TILE) for v in world(37.5485, 126.9335, ZOOM, TILE))
LAT, LNG = on_map(Y0 * TILE + 196.0, X0 * TILE + 196.0)
FY0, FX0 = (round(v) - 1 for v in world(LAT, LNG, 12, 1))


def lattice(spark, requests):
    p = F.col("p")
    y, x = F.floor(p / SIDE), p % SIDE
    street = (y % 64 < 12) | (x % 64 < 12)
    shown = F.col("req") != 2
    channel = lambda v: F.when(~shown, 0).when(street, 255).otherwise(v).cast("int")
    rows = requests.select("req").crossJoin(spark.range(SIDE * SIDE).withColumnRenamed("id", "p"))
    return rows.select("req", y.alias("y"), x.alias("x"), channel(224).alias("r"), channel(236).alias("g"), channel(211).alias("b"), F.when(shown, 255).otherwise(0).alias("a"))


@pytest.fixture(scope="module")
def made(spark):
    row = lambda req, tags, analysed, seed=42, minutes=15: (req, LAT, LNG, ZOOM, X0, Y0, TILE, 12, FX0, FY0, 256, MPP, SIDE, SIDE, 196.0, 196.0, 150.0, minutes, tags, seed, analysed)
    requests = spark.createDataFrame([row(1, ["nature"], False), row(2, ["nature"], False), row(3, ["cafe"], False), row(4, ["cafe"], True), row(5, ["nature"], False)], KIND)
    elements = spark.createDataFrame([(4, 1, "icon", "shop", "Shop", 70.0, 200.0, 0.9), (4, 2, "icon", "cafe", "far from all", 5000.0, 20.0, 0.95)], "req long, n long, kind string, category string, label string, x double, y double, confidence double")
    # elevation rises to the east, by 0.5 m a pixel of some 30 m
    p = F.col("p")
    tiles = spark.createDataFrame([(5, FY0 + a, FX0 + b) for a in (0, 1) for b in (0, 1)], "req long, ty int, tx int").crossJoin(spark.range(65536).withColumnRenamed("id", "p"))
    metres = (F.col("tx") - FX0) * 256 + p % 256
    tiles = tiles.select("req", "ty", "tx", F.floor(p / 256).alias("y"), (p % 256).alias("x"), F.lit(128).alias("r"), F.floor(metres / 2).cast("int").alias("g"), (metres % 2 * 128).cast("int").alias("b"), F.lit(255).alias("a"))
    return {r.req: r for r in course.courses(lattice(spark, requests), requests, elements, tiles).collect()}


def test_reasons(made):
    assert {k: r.reason for k, r in made.items()} == {1: None, 2: "blank", 3: "vision-unavailable", 4: "no-match", 5: None}


def test_course_is_closed_walkable_and_reproducible(made):
    one = made[1]
    assert one.path == made[5].path and one.length_m == made[5].length_m
    assert 700 <= one.length_m <= 1300 and one.path[0] == one.path[-1] and set(one.stops) <= set(one.path)
    cells = [divmod(c, one.grid_width) for c in one.path]
    assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(cells, cells[1:], strict=False))
    assert math.isclose(sum(math.dist(a, b) for a, b in zip(cells, cells[1:], strict=False)) * 3 * MPP, one.length_m)
    street = lambda v: any((3 * v + k) % 64 < 12 for k in range(3))
    assert all(street(y) or street(x) for y, x in cells)
    assert one.green_regions > 0 and one.minor_share == 1.0 and one.water_edge_m >= 0


def test_facts_of_a_course(made, spark):
    one, hilly = made[1], made[5]
    cells = [divmod(c, one.grid_width) for c in one.path]
    places = [on_map(Y0 * TILE + 3 * y + 1.5, X0 * TILE + 3 * x + 1.5) for y, x in cells]
    assert all(math.dist(a, (b.lat, b.lng)) < 1e-9 for a, b in zip(places, one.way, strict=True))
    assert [w.kind for w in one.waypoints].count("turn") == 1 and {w.kind for w in one.waypoints} <= {"turn", "side", "mid"}
    assert [one.path[w.path_index] for w in one.waypoints] == one.stops
    assert all((w.lat, w.lng) == (one.way[w.path_index].lat, one.way[w.path_index].lng) for w in one.waypoints)
    assert all("nature" in w.tags and w.label in (*fixed.PLACE_LABELS.values(), fixed.PLACE_LABEL) for w in one.waypoints)
    assert one.turn_index == next(w.path_index for w in one.waypoints if w.kind == "turn")
    assert set(one.road_shares) == {"minor", "secondary", "major", "path", "trunk", "park"} and math.isclose(sum(one.road_shares.values()), 1.0) and one.road_shares["minor"] == one.minor_share
    a, b = map(math.radians, (LAT, places[0][0]))
    dlng = math.radians(places[0][1] - LNG)
    metres = 2 * 6371008.8 * math.asin(math.sqrt(math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(dlng / 2) ** 2))
    assert math.isclose(one.start_offset_m, metres, abs_tol=1e-6) and one.start_offset_m < 150
    assert one.ascent_m is None and hilly.ascent_m is not None and one.classified == 1.0
    # the climb of a closed way over a plane that rises eastward: its reach to the east, once or more
    east = [3 * (c % hilly.grid_width) * MPP for c in hilly.path]
    rise = (max(east) - min(east)) * 0.5 / (MPP * 2**16 * 512 / (2**12 * 256))
    assert (hilly.ascent_m == 0 and rise <= 8) or abs(hilly.ascent_m - rise) < 1.0
    fed = [(["nature"], one.length_m, 15, one.ascent_m, one.green_regions, one.water_edge_m, one.start_offset_m, False)]
    asked = spark.createDataFrame(fed, "tags array<string>, length_m double, minutes int, ascent_m double, green_regions long, water_edge_m double, start_offset_m double, analysed boolean")
    (shown,) = course.card(asked).collect()
    assert f"녹지 {one.green_regions}곳" in shown.description and f"{one.length_m / 1000:.1f}km" in shown.description


def test_missing_tiles_are_left_out_of_the_blank_check(spark):
    rows = [(1, cls, False) for cls in (1, 1, 1)] + [(1, 0, False)] * 7 + [(1, 0, True)] * 90 + [(2, 0, True)] * 3
    seen = spark.createDataFrame(rows, "req long, cls int, missing boolean")
    got = {r.req: r for r in X.classified_share(seen, ["req"]).collect()}
    assert (got[1].classified, got[1].missing, got[2].classified) == (0.3, 90, None)
    assert X.classified_share(seen.drop("missing"), ["req"]).where("req = 1").first().classified == 0.03


def test_a_loop_that_is_not_found_has_diverged(spark):
    kind = "id long, seed long, target_m double, k int, cell_m double, height int, width int, origin long, cost array<double>, cands array<struct<cell:long,d:double,bearing:double,score:double,tags:array<string>>>"
    rows = [(1, 1, 100.0, 3, 1.0, 1, 3, 0, [1.0, None, 1.0], [(2, 2.0, 0.0, 1.0, None)])]
    (row,) = G.loops(spark.createDataFrame(rows, kind)).collect()
    assert row.reason == "diverged" and row.path is None and row.kinds is None


def test_card(spark):
    rows = spark.createDataFrame([(["nature", "quiet", "nowhere"], 1920.0, 30, None, 3, 84.0, 12.4, False), ([], 400.0, 120, 61.0, 0, 0.0, 1.0, True)], "tags array<string>, length_m double, minutes int, ascent_m double, green_regions long, water_edge_m double, start_offset_m double, analysed boolean")
    a, b = course.card(rows).collect()
    assert (a.title, a.duration, a.difficulty) == (f"{fixed.TAG_LABELS['nature']} {fixed.TAG_LABELS['quiet']} 산책", 30, "쉬움")
    assert "1.9km" in a.description and "녹지 3곳, 강변 80m" in a.description and "12m" in a.notice
    assert (b.title, b.duration, b.difficulty, b.notice) == ("오늘의 산책", 5, "어려움", None) and "약 61m" in b.description


def test_thin_roads_by_the_median_or_by_neighbours(spark):
    k = fixed.KINDS
    kinds = [[k["MINOR"], k["MINOR"], k["MINOR"], k["NONE"], k["MAJOR"], k["MINOR"]]]
    widths = [[2.0, 2.3, 5.0, 0.0, 9.0, 2.4]]
    rows = [(r, y, x, kinds[y][x], widths[y][x] * (r == 1)) for r in (1, 2) for y in range(1) for x in range(6)]
    cells = spark.createDataFrame(rows, "req long, y long, x long, kind int, width double")
    got = {(r.req, r.x): r.thin for r in S.thin_roads(cells, 16, ["req"]).collect()}
    assert [got[1, x] for x in range(6)] == [1, 1, 0, 0, 0, 1]  # up to 1.2 times 2.35
    assert [got[2, x] for x in range(6)] == [1, 1, 0, 0, 0, 0]  # no widths known
    assert {(r.req, r.x): r.thin for r in S.thin_roads(cells, 15, ["req"]).collect()}[1, 1] == 1


def test_sampled_paths_have_their_ends(spark):
    rows = spark.createDataFrame([(1, 0, 37.5, 126.9), (1, 1, 37.501, 126.9), (2, 0, 37.5, 126.9)], "k int, i int, lat double, lng double")
    got = {}
    for r in sorted(paths.sampled(rows, "k").collect(), key=lambda r: r.n):
        got.setdefault(r.k, []).append(r.lat)
    assert got[2] == [37.5] and got[1][0] == 37.5 and got[1][-1] == 37.501 and len(got[1]) == 5 and got[1] == sorted(got[1])
