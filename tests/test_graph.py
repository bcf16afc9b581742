import math

import numpy as np
import pytest

from gridstride.functions.rng import draws
from gridstride.operators import graph as G
from gridstride.operators import paths, stencils
from gridstride.plans import graph_queries

INF = math.inf


def walk(spark, mask):
    return spark.createDataFrame([(1, y, x) for y, r in enumerate(mask) for x, v in enumerate(r) if v], "req long, y long, x long")


def test_no_corner_is_cut(spark):
    rows = G.distances(walk(spark, [[1, 0], [0, 1]]), (0, 0)).collect()
    assert [(r.y, r.x, r.metres) for r in rows] == [(0, 0, 0.0)]
    assert G.route(np.array([[1, INF], [INF, 1]]), (0, 0), (1, 1)) is None


def test_route_goes_round_a_blocked_cell():
    cost = np.ones((3, 3))
    cost[1, 1] = INF
    path = G.route(cost, (1, 0), (1, 2))
    assert len(path) == 5 and (1, 1) not in path and path[0] == (1, 0) and path[-1] == (1, 2)


def test_used_cells_cost_more():
    cost = np.ones((3, 7))
    used = np.zeros((3, 7), bool)
    used[1] = True
    path = G.route(cost, (1, 0), (1, 6), used)
    assert any(y != 1 for y, _ in path)


def test_draws_equal_the_stream(spark):
    row = spark.createDataFrame([(42,)], "s long").select(draws("s", 6).alias("d")).first()
    draw = G.rng(42)
    assert row.d == [draw() for _ in range(6)]
    assert [round(x, 10) for x in row.d[:3]] == [0.8907801888, 0.4310670437, 0.3220651443]


def lattice():
    cost = np.full((64, 64), INF)
    cost[np.arange(64) % 8 < 2] = 1
    cost[:, np.arange(64) % 8 < 2] = 1
    return cost


def candidates(cost, origin, cell_m):
    out = []
    for y, x in zip(*np.nonzero(np.isfinite(cost)), strict=True):
        if (y * 64 + x) % 5 == 0:
            out.append({"cell": int(y * 64 + x), "d": math.hypot(y - origin[0], x - origin[1]) * cell_m * 1.2, "bearing": math.atan2(y - origin[0], x - origin[1]), "score": 1.0, "tags": ["nature"]})
    return out


def test_loop_is_closed_passable_and_reproducible():
    cost, origin = lattice(), (32, 32)
    cands = candidates(cost, origin, 16.0)
    found = G.loop(cost, origin, cands, 1000.0, 3, 42, 16.0)
    assert found == G.loop(cost, origin, cands, 1000.0, 3, 42, 16.0)
    assert 700 <= found["length_m"] <= 1300
    path = [divmod(c, 64) for c in found["path"]]
    assert path[0] == path[-1] == origin and all(np.isfinite(cost[p]) for p in path)
    assert all(max(abs(a[0] - b[0]), abs(a[1] - b[1])) == 1 for a, b in zip(path, path[1:], strict=False))
    assert set(found["stops"]) <= set(found["path"])


def test_loops_give_reasons(spark):
    kind = "id long, seed long, target_m double, k int, cell_m double, height int, width int, origin long, cost array<double>, cands array<struct<cell: long, d: double, bearing: double, score: double, tags: array<string>>>"
    open_ = [1.0] * 16
    rows = [(1, 1, 100.0, 3, 1.0, 4, 4, 0, [None] * 16, []), (2, 1, 100.0, 3, 1.0, 4, 4, 0, open_, []), (3, 1, 1000.0, 3, 1.0, 4, 4, 0, open_, [(5, 2.0, 0.0, 1.0, None)])]
    got = {r.id: r.reason for r in G.loops(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: "no-road", 2: "no-match", 3: "diverged"}


def test_simplify_keeps_corners():
    line = np.array([[0, 0], [1, 0.01], [2, 0], [2, 1], [2, 2]], float)
    assert G.simplify(line, 0.1).tolist() == [[0, 0], [2, 0], [2, 2]]


def test_simplified_paths_equal_one_by_one(spark):
    random = np.random.default_rng(4)
    lines = {k: np.cumsum(random.integers(-3, 4, (n, 2)), axis=0).astype(float) for k, n in enumerate((1, 2, 3, 40, 90, 200))}
    lines[6] = np.array([[0, 0], [5, 0], [5, 5], [0, 5], [0, 0]], float)  # closed
    lines[7] = np.zeros((6, 2))
    table = spark.createDataFrame([(k, i, float(x), float(y)) for k, line in lines.items() for i, (x, y) in enumerate(line)], "k int, i int, x double, y double")
    for tolerance in (0.5, 3.0, 0.0):
        got = {}
        for r in sorted(paths.simplified(table, "k", tolerance).collect(), key=lambda r: r.i):
            got.setdefault(r.k, []).append([r.x, r.y])
        assert {k: v for k, v in got.items() if k < 7} == {k: G.simplify(v, tolerance).tolist() for k, v in lines.items() if k < 7}
        assert got[7] == [[0.0, 0.0]] * (2 if tolerance else 6)


def test_collinear_points_by_the_last_kept_one(spark):
    def fold(line, eps=1e-6):
        kept, (ax, ay) = [0], line[0]
        for i in range(1, len(line) - 1):
            (bx, by), (cx, cy) = line[i], line[i + 1]
            ux, uy, vx, vy = bx - ax, by - ay, cx - bx, cy - by
            if not (abs(ux * vy - uy * vx) <= eps and ux * vx + uy * vy > 0):
                kept.append(i)
                ax, ay = bx, by
        return kept + [len(line) - 1] * (len(line) > 1)

    random = np.random.default_rng(5)
    lines = {k: np.cumsum(random.integers(0, 2, (60, 2)), axis=0).astype(float).tolist() for k in range(5)}
    lines[5] = [[float(i), 4e-7 * i * i / 2] for i in range(40)]  # bends by less than the tolerance at each point
    lines[6], lines[7] = [[1.0, 2.0]], [[0.0, 0.0], [1.0, 1.0]]
    table = spark.createDataFrame([(k, i, x, y) for k, line in lines.items() for i, (x, y) in enumerate(line)], "k int, i int, x double, y double")
    got = {}
    for r in sorted(paths.without_collinear(table, "k").collect(), key=lambda r: r.i):
        got.setdefault(r.k, []).append(r.i)
    assert got == {k: fold(line) for k, line in lines.items()}


def test_chamfer_closed_form_equals_two_passes(spark):
    random = np.random.default_rng(3)
    mask = random.random((12, 9)) < 0.06
    mask[4, 4] = True
    dist = np.where(mask, 0, 10**6)
    for order in (range(mask.size), range(mask.size - 1, -1, -1)):
        for i in order:
            y, x = divmod(i, 9)
            for dy in (-1, 0, 1):
                for dx in (-1, 0, 1):
                    if 0 <= y + dy < 12 and 0 <= x + dx < 9:
                        dist[y, x] = min(dist[y, x], dist[y + dy, x + dx] + (4 if dy and dx else 3 if dy or dx else 0))
    cells = spark.createDataFrame([(y, x, int(mask[y, x])) for y in range(12) for x in range(9)], "y long, x long, m int")
    got = {(r.y, r.x): r.dist for r in stencils.distance_to_mask(cells, "m", 3.0, 60.0).collect()}
    assert all(got[y, x] == pytest.approx(dist[y, x]) for y in range(12) for x in range(9))


def test_ascent_ignores_small_climbs(spark):
    rows = spark.createDataFrame([(1, i, e) for i, e in enumerate([0.0, 5.0, 0.0, 9.0, 12.0, 1.0, 20.0])] + [(2, 0, None)], "k int, i int, e double")
    assert {r.k: r.ascent_m for r in paths.ascent(rows, "k", "i", "e").collect()} == {1: 31.0}


def fold(values, least):
    low, top, total = None, None, 0.0
    for e in values:
        if low is None:
            low = e
        elif top is None:
            low = min(low, e)
            if e - low > least:
                total, top = total + e - low, e
        elif e > top:
            total, top = total + e - top, e
        elif top - e > least:
            low, top = e, None
    return total


def test_ascent_equals_an_ordered_fold_in_whole_and_in_parts(spark, monkeypatch):
    random = np.random.default_rng(8)
    rows = []
    for k in range(300):
        steps = random.integers(-9, 10, random.integers(1, 90)) if k % 2 else random.normal(0, 5, 60)
        values = np.cumsum(steps).tolist()
        want = fold(values, 8.0)
        assert math.isclose(paths.climb(paths.turning_points(values, 8.0), 8.0), want, abs_tol=1e-9), values
        rows += [(k, i, float(v), want) for i, v in enumerate(values)]
    monkeypatch.setattr(paths, "CHUNK", 7)
    table = spark.createDataFrame(rows, "k int, i int, e double, want double")
    got = {r.k: r.ascent_m for r in paths.ascent(table, "k", "i", "e").collect()}
    assert all(math.isclose(got[k], w, abs_tol=1e-9) for k, _, _, w in rows)


def test_stops_are_distinct_and_in_their_bands():
    cost, origin = lattice(), (32, 32)
    cands = candidates(cost, origin, 16.0)
    for k in (3, 4, 5):
        for seed in range(30):
            found = G.stops(cands, 1000.0, k, 1.0, G.rng(seed))
            kinds = [kind for _, kind in found]
            assert len({c["cell"] for c, _ in found}) == len(found) and kinds.count("turn") == 1 and kinds.count("mid") <= k - 3 and kinds.count("side") <= 2
            (turn,) = (c for c, kind in found if kind == "turn")
            for c, kind in found:
                if kind == "side":
                    assert 49.9 <= abs(math.degrees(math.remainder(c["bearing"] - turn["bearing"], 2 * math.pi))) <= 110.1
    best = [{"cell": 7, "d": 300.0, "bearing": 0.0, "score": math.inf, "tags": None}]
    assert G.stops(best, 1000.0, 3, 1.0, G.rng(1)) == [(best[0], "turn")]


def test_depth_has_no_reach(spark):
    mask = np.ones((150, 140), int)
    mask[70, 60] = 0
    cells = spark.createDataFrame([(1, y, x, int(mask[y, x])) for y in range(150) for x in range(140)], "req long, y long, x long, m int")
    got = {(r.y, r.x): r.dist for r in G.depth(cells, "m", 150, 140).collect()}
    for (y, x), d in got.items():
        a, b = abs(y - 70), abs(x - 60)
        assert d == min(3 * abs(a - b) + 4 * min(a, b), 3 * min(y + 1, 150 - y, x + 1, 140 - x))


def test_without_collinear(spark):
    path = [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2), (3, 3), (4, 4), (3, 3), (3, 3)]
    rows = spark.createDataFrame([(1, i, x, y) for i, (x, y) in enumerate(path)], "k int, i int, x int, y int")
    assert sorted(r.i for r in paths.without_collinear(rows, "k").collect()) == [0, 2, 4, 6, 7, 8]


def test_rows_only_queries_run(spark, sf_dir):
    got = {r.req: r.reason for r in graph_queries.pixel_courses(spark, sf_dir).collect()}
    assert len(got) == 5 and got[0] is None and got[2] == "vision-unavailable"
    assert graph_queries.lattice_loops(spark, sf_dir).where("reason is null").count() > 0


def test_elements(spark):
    import json

    from gridstride.sources.elements import parse

    good = {"kind": "nature", "category": "green", "label": "a", "x": 0.25, "y": 0.5, "width": 0.1, "height": 0.2, "confidence": 0.9}
    items = [good, good, good | {"x": 0.99}, good | {"confidence": 0.2}, good | {"width": -1}, good | {"category": "cafe"}]
    many = [good | {"x": 0.01 * k, "y": 0.02 * k} for k in range(41)]
    edge = [good | {"x": 0.9, "width": 0.1005, "label": "  b "}, good | {"x": 1.0, "width": 0.0005}]
    tables = [{"elements": items}, {"elements": many + many}, {"elements": edge}, {"other": 1}, {"elements": []}]
    rows = spark.createDataFrame([(k, json.dumps(v), 1000, 500) for k, v in enumerate(tables, 1)] + [(6, "nothing", 1, 1), (7, None, 1, 1)], "id int, t string, w int, h int")
    got = {r.id: (r.status, [(e.label, e.x, e.y) for e in r.kept]) for r in parse(rows, "t", "w", "h").collect()}
    assert got[1] == ("analyzed", [("a", 300.0, 300.0)]) and got[5] == ("analyzed", [])
    assert all(got[k] == ("unavailable", []) for k in (2, 4, 6, 7))  # more than 80 are an error
    assert got[3][1] == [("b", pytest.approx(950.0), pytest.approx(300.0))]  # clipped at the image's edge


def test_upload_and_elevation(spark):
    import base64
    import struct

    from gridstride.sources.tiles import elevation, valid_upload

    head = b"\x89PNG\r\n\x1a\n" + struct.pack(">I4sII", 13, b"IHDR", 512, 600)
    url = "data:image/png;base64," + base64.b64encode(head).decode()
    rows = spark.createDataFrame([(1, url, 512, 600), (2, url, 512, 512), (3, "http://x/y.png", 512, 600), (4, None, 512, 600)], "id int, u string, w int, h int")
    assert {r.id: r.ok for r in rows.select("id", valid_upload("u", "w", "h").alias("ok")).collect()} == {1: True, 2: False, 3: False, 4: False}
    px = spark.createDataFrame([(128, 10, 128, 255), (1, 1, 1, 0)], "r int, g int, b int, a int").select(elevation("r", "g", "b", "a").alias("e")).collect()
    assert [r.e for r in px] == [10.5, None]


def test_image_source(spark, tmp_path):
    import struct
    import zlib

    from gridstride.sources.tiles import image_pixels

    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    rows = b"\x00" + bytes([255, 0, 0, 255, 0, 255, 0, 128]) + b"\x00" + bytes([0, 0, 255, 255, 9, 8, 7, 0])
    (tmp_path / "a.png").write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 2, 2, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
    got = sorted((r.y, r.x, r.r, r.g, r.b, r.a) for r in image_pixels(spark, str(tmp_path)).collect())
    assert got == [(0, 0, 255, 0, 0, 255), (0, 1, 0, 255, 0, 128), (1, 0, 0, 0, 255, 255), (1, 1, 9, 8, 7, 0)]


def test_stream_counts_like_the_batch(spark, tmp_path):
    from gridstride.streaming.limiter import counts, counts_stream

    rows = spark.range(400).selectExpr("timestamp_seconds(1700000000 + id * 13) AS ts", "if(id % 3 = 0, 'a', 'b') AS event_type")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = counts_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("counted").collect()))
    assert got == sorted(map(tuple, counts(rows, "1 minute", ["event_type"]).collect())) and sum(r[2] for r in got) == 400


def test_lattice_loops_serve_every_user(spark, sf_dir):
    from gridstride.plans.graph_queries import lattice_loops

    users = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id").distinct()
    assert {r.id for r in lattice_loops(spark, sf_dir).select("id").collect()} == {r.user_id for r in users.collect()}
