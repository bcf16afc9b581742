"""Queries of graph, random, request and element operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridstride.functions.rng import draws, fnv1a
from gridstride.operators import course
from gridstride.operators import graph as G
from gridstride.plans import fixtures as V
from gridstride.plans.queries import query, rounded, with_
from gridstride.sources import elements
from gridstride.streaming import limiter


def _open(spark: SparkSession, d: str) -> DataFrame:
    return V.masks(V.grids(spark, d)).where("walk = 1").select("req", "y", "x")


EDGES = """open AS MATERIALIZED (SELECT req, y, x, (req * 64 + y) * 64 + x AS id FROM masks WHERE walk = 1),
edges AS MATERIALIZED (SELECT a.id AS a, b.id AS b, CASE WHEN dy <> 0 AND dx <> 0 THEN sqrt(2::DOUBLE) ELSE 1::DOUBLE END AS w, dy, dx
    FROM open a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0), (1, 1), (1, -1), (-1, 1), (-1, -1)) o(dy, dx) JOIN open b ON b.req = a.req AND b.y = a.y + dy AND b.x = a.x + dx
    WHERE dy = 0 OR dx = 0 OR (EXISTS (FROM open c WHERE c.req = a.req AND c.y = a.y AND c.x = b.x) AND EXISTS (FROM open c WHERE c.req = a.req AND c.y = b.y AND c.x = a.x)))"""


@query("WITH RECURSIVE " + ", ".join([V.GRIDS, V.MASKS, EDGES]) + """, dist(id, d) USING KEY (id) AS (SELECT min(id), 0::DOUBLE FROM open GROUP BY req UNION
    SELECT e.b, min(dist.d + e.w) FROM dist JOIN edges e ON e.a = dist.id LEFT JOIN recurring.dist r ON r.id = e.b WHERE r.id IS NULL OR dist.d + e.w < r.d - 1e-9 GROUP BY e.b)
SELECT id // 4096 AS req, id // 64 % 64 AS y, id % 64 AS x, round(d, 6) AS metres FROM dist""")
def shortest_paths(spark: SparkSession, d: str) -> DataFrame:
    """Shortest 8-connected distances from each grid's first open cell, without cutting corners."""
    cells = _open(spark, d)
    first = cells.groupBy("req").agg(F.min(F.struct("y", "x")).alias("c")).select("req", "c.y", "c.x")
    return rounded(G.distances(cells, first), "metres")


@query("WITH RECURSIVE " + ", ".join([V.GRIDS, V.MASKS, EDGES]) + """,
priced AS (SELECT (req * 64 + y) * 64 + x AS id, CASE WHEN green = 1 THEN 0.75::DOUBLE WHEN v > 0 THEN 1.5::DOUBLE ELSE 3::DOUBLE END AS c FROM masks WHERE walk = 1),
steps AS MATERIALIZED (SELECT a, b, w * ((p.c + q.c) * 0.5::DOUBLE) AS w FROM edges JOIN priced p ON p.id = a JOIN priced q ON q.id = b),
dist(id, d) USING KEY (id) AS (SELECT min(id), 0::DOUBLE FROM open GROUP BY req UNION
    SELECT e.b, min(dist.d + e.w) FROM dist JOIN steps e ON e.a = dist.id LEFT JOIN recurring.dist r ON r.id = e.b WHERE r.id IS NULL OR dist.d + e.w < r.d GROUP BY e.b),
came AS MATERIALIZED (SELECT b AS id, arg_min(a, {'v': d + w, 'a': a}) AS before FROM dist JOIN steps ON a = id WHERE b NOT IN (SELECT min(id) FROM open GROUP BY req) GROUP BY b),
asked AS (SELECT max(id) AS target FROM open GROUP BY req, y),
way(target, id, k) AS (SELECT target, target, 0 FROM asked JOIN dist ON id = target UNION ALL SELECT target, before, k + 1 FROM way JOIN came USING (id))
SELECT target // 64 AS row, round(d, 6) AS cost, CAST(max(k) OVER (PARTITION BY target) - k AS BIGINT) AS i, way.id // 64 % 64 AS y, way.id % 64 AS x FROM way JOIN dist ON dist.id = target""")
def cheapest_ways(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest way from each grid's first open cell to the last one of each row, cell by cell."""
    cells = V.masks(V.grids(spark, d)).where("walk = 1").select("req", "y", "x", F.when(F.col("green") == 1, 0.75).when(F.col("v") > 0, 1.5).otherwise(3.0).alias("cost"))
    first = cells.groupBy("req").agg(F.min(F.struct("y", "x")).alias("c"))
    last = cells.groupBy("req", "y").agg(F.max("x").alias("tx")).join(first, "req")
    asked = last.select((F.col("req") * 64 + F.col("y")).alias("id"), "req", F.col("c.y").alias("sy"), F.col("c.x").alias("sx"), F.col("y").alias("ty"), "tx")
    return rounded(G.cheapest(cells, asked).withColumnRenamed("id", "row"), "cost")


COMPONENTS = "WITH RECURSIVE " + ", ".join([V.GRIDS, V.MASKS, EDGES]) + """, lab(id, l) USING KEY (id) AS (SELECT id, id FROM open UNION
    SELECT e.b, min(lab.l) FROM lab JOIN edges e ON e.a = lab.id AND (dy = 0 OR dx = 0) JOIN recurring.lab r ON r.id = e.b WHERE lab.l < r.l GROUP BY e.b)"""


@query(COMPONENTS + ", big AS (SELECT l, dense_rank() OVER (PARTITION BY l // 4096 ORDER BY l) AS label FROM lab GROUP BY l HAVING count(*) >= 2) SELECT id // 4096 AS req, id // 64 % 64 AS y, id % 64 AS x, label FROM lab JOIN big USING (l)")
def connected_components(spark: SparkSession, d: str) -> DataFrame:
    """4-connected components of two cells or more, numbered in row order."""
    return G.components(_open(spark, d), 64, 2).select("req", "y", "x", F.col("label").cast("long").alias("label"))


@query(COMPONENTS + """, deep AS (SELECT (a.req * 64 + a.y) * 64 + a.x AS id, least(min(greatest(abs(a.y - b.y), abs(a.x - b.x)) * 3 + least(abs(a.y - b.y), abs(a.x - b.x))), any_value(3 * least(a.y + 1, 64 - a.y, a.x + 1, 64 - a.x))) AS dist
    FROM masks a JOIN masks b ON a.req = b.req AND b.walk = 0 WHERE a.walk = 1 GROUP BY a.req, a.y, a.x),
wet AS (SELECT DISTINCT (a.req * 64 + a.y) * 64 + a.x AS id FROM masks a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx) JOIN masks b ON b.req = a.req AND b.y = a.y + dy AND b.x = a.x + dx AND b.water = 1 WHERE a.walk = 1),
big AS (SELECT l, dense_rank() OVER (PARTITION BY l // 4096 ORDER BY l) AS label FROM lab GROUP BY l)
SELECT id // 4096 AS req, label, count(*) AS cells, count(*) * 9.0::DOUBLE AS area_m2, round(avg(id % 64), 6) AS cx, round(avg(id // 64 % 64), 6) AS cy, min(id % 64) AS x0, max(id % 64) AS x1, min(id // 64 % 64) AS y0, max(id // 64 % 64) AS y1,
    arg_max(id, {'d': dist, 'i': -id}) // 64 % 64 AS pole_y, arg_max(id, {'d': dist, 'i': -id}) % 64 AS pole_x, bool_or(wet.id IS NOT NULL) AS touches FROM lab JOIN big USING (l) JOIN deep USING (id) LEFT JOIN wet USING (id) GROUP BY id // 4096, label""")
def region_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each component, its deepest cell, and whether it touches water."""
    masks = V.masks(V.grids(spark, d))
    deep = G.depth(masks.select("req", "y", "x", "walk"), "walk", 64, 64)
    out = G.regions(G.components(_open(spark, d), 64), 3.0, deep, masks.where("water = 1").select("req", "y", "x"))
    return rounded(out.withColumn("label", F.col("label").cast("long")), "cx", "cy")


#: Fixed by the query: cells of 30 m (3 pixels of 10 m), windows of 900 m to each side; so stops snap to 5 cells (9 on rivers), elements to 2, every 4th shore cell is sampled, macro cells have 5 a side.
PLACED = """kinds AS MATERIALIZED (SELECT 0 AS k, req, y, x FROM masks WHERE green = 1 UNION ALL SELECT 1, req, y, x FROM masks WHERE v > 0.02 AND v <= 0.15),
spot AS MATERIALIZED (SELECT ((k * 1000000 + req) * 64 + y) * 64 + x AS id, * FROM kinds),
side AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM spot a, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx) JOIN spot b ON b.k = a.k AND b.req = a.req AND b.y = a.y + dy AND b.x = a.x + dx),
lab(id, l) USING KEY (id) AS (SELECT id, id FROM spot UNION SELECT side.b, min(lab.l) FROM lab JOIN side ON side.a = lab.id JOIN recurring.lab r ON r.id = side.b WHERE lab.l < r.l GROUP BY side.b),
deep AS (SELECT a.id, least(min(greatest(abs(a.y - b.y), abs(a.x - b.x)) * 3 + least(abs(a.y - b.y), abs(a.x - b.x))), any_value(3 * least(a.y + 1, h - a.y, a.x + 1, 64 - a.x))) AS dist
    FROM spot a JOIN (SELECT req, max(y) + 1 AS h FROM grid GROUP BY req) USING (req) LEFT JOIN masks b ON b.req = a.req AND NOT CASE a.k WHEN 0 THEN b.green = 1 ELSE b.v > 0.02 AND b.v <= 0.15 END GROUP BY a.id),
region AS (SELECT k, req, l, count(*) AS n, avg(x) AS cx, avg(y) AS cy, arg_max(id, {'d': dist, 'i': -id}) AS pole FROM spot JOIN lab USING (id) JOIN deep USING (id) GROUP BY k, req, l),
named AS (SELECT *, dense_rank() OVER (PARTITION BY k, req ORDER BY l) AS label FROM region WHERE n > k),
shore AS (SELECT req, y, x, row_number() OVER (PARTITION BY req ORDER BY y, x) - 1 AS n FROM masks m WHERE water = 0 AND EXISTS (FROM masks w, (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) o(dy, dx) WHERE w.req = m.req AND w.y = m.y + dy AND w.x = m.x + dx AND w.water = 1)),
el AS (SELECT event_id AS n, event_id % (SELECT max(req) + 1 FROM grid) AS req, event_id * 37 % 192 / 3::DOUBLE - 0.5::DOUBLE AS cx, event_id * 91 % 192 / 3::DOUBLE - 0.5::DOUBLE AS cy,
    CASE event_id % 3 WHEN 0 THEN 'icon' WHEN 1 THEN 'building' ELSE 'nature' END AS kind, CASE event_id % 4 WHEN 0 THEN 'cafe' WHEN 1 THEN 'water' ELSE 'green' END AS category, event_type AS label FROM events WHERE event_id % 30 >= 10),
point AS (SELECT 0 AS p, req, n, cx, cy, 2 AS most FROM el UNION ALL SELECT 1, req, label, pole % 64, pole // 64 % 64, 5 FROM named WHERE k = 0
    UNION ALL SELECT 2, req, y * 64 + x, x, y, CASE WHEN req % 2 = 1 THEN 9 ELSE 5 END FROM shore WHERE n % 4 = 0
    UNION ALL SELECT 3, req, label, pole % 64, pole // 64 % 64, 5 FROM named WHERE k = 1 UNION ALL SELECT 4, req, label, cx, cy, 5 FROM named WHERE k = 1),
met AS (SELECT p, point.req, n, cx, cy, y, x, greatest(abs(x - floor(cx + 0.5::DOUBLE)), abs(y - floor(cy + 0.5::DOUBLE))) AS ring, pow(x - cx, 2) + pow(y - cy, 2) AS d, floor(cy + 0.5::DOUBLE) AS hy
    FROM point JOIN masks m ON m.req = point.req AND walk = 1 AND greatest(abs(x - floor(cx + 0.5::DOUBLE)), abs(y - floor(cy + 0.5::DOUBLE))) <= most),
snap AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p, req, n ORDER BY ring, d, abs(y - hy) <> ring, CASE WHEN abs(y - hy) = ring THEN x ELSE y END, CASE WHEN abs(y - hy) = ring THEN y ELSE x END) AS r FROM met) WHERE r = 1),
best AS (SELECT req, arg_max(y, {'v': v, 'y': -y, 'x': -x}) AS y, arg_max(x, {'v': v, 'y': -y, 'x': -x}) AS x FROM masks WHERE walk = 1 GROUP BY req, y // 5, x // 5),
put AS (SELECT 0 AS p, s.req, s.n, y, x, CASE WHEN kind = 'icon' THEN 'icon' WHEN kind = 'building' THEN 'built' WHEN category = 'water' THEN 'shore' ELSE 'green' END AS kind, category, label FROM snap s JOIN el ON el.n = s.n AND p = 0 WHERE sqrt(d) * 30 <= 60
    UNION ALL SELECT p, req, n, y, x, CASE p WHEN 1 THEN 'green' WHEN 2 THEN 'shore' ELSE 'built' END, NULL, NULL FROM snap s WHERE p IN (1, 2, 3) OR p = 4 AND NOT EXISTS (FROM snap f WHERE f.p = 3 AND f.req = s.req AND f.n = s.n)
    UNION ALL SELECT 5, req, y * 64 + x, y, x, 'road', NULL, NULL FROM best),
seen(id) AS (SELECT min(id) FROM open GROUP BY req UNION SELECT edges.b FROM seen JOIN edges ON edges.a = seen.id)"""


@query("WITH RECURSIVE " + ", ".join([V.GRIDS, V.MASKS, EDGES, PLACED]) + """ SELECT req, y, x, kind, category, label FROM (SELECT *, row_number() OVER (PARTITION BY req, y, x ORDER BY least(p, 4) + (p = 5)::INT, n) AS r FROM put)
WHERE r = 1 AND (req * 64 + y) * 64 + x IN (FROM seen)""")
def generated_stops(spark: SparkSession, d: str) -> DataFrame:
    """Where stops may be: elements, green poles, shore samples, built poles or middles, and roads of macro cells, snapped to open cells that the first one reaches."""
    masks = V.masks(V.grids(spark, d)).withColumn("built", ((F.col("v") > 0.02) & (F.col("v") <= 0.15)).cast("int"))
    size = masks.groupBy("req").agg((F.max("y") + 1).alias("gh"))
    masks = G.durable(masks.join(size, "req"))
    requests = size.select("req", F.lit(30.0).alias("cell_m"), F.lit(10.0).alias("mpp"), F.lit(900.0).alias("half_m"), F.when(F.col("req") % 2 == 1, F.array(F.lit("river"))).otherwise(F.array(F.lit("nature"))).alias("tags"))
    places = []
    for mask, least in (("green", 1), ("built", 2)):
        named = G.components(masks.where(F.col(mask) == 1).select("req", "y", "x"), 64, least)
        places.append(G.durable(G.regions(named, 30.0, G.depth(masks, mask, F.col("gh"), 64))))
    cells = masks.select("req", "y", "x", F.col("walk").alias("passable"), F.col("water").alias("wet"), F.col("v").alias("road"), F.lit(30.0).alias("cell_m"))
    e = F.col("event_id")
    many = masks.agg((F.max("req") + 1).alias("many"))  # one row
    elements = V.load(spark, d, "events").crossJoin(F.broadcast(many)).select(
        (e % F.col("many")).alias("req"), e.alias("n"), F.when(e % 3 == 0, "icon").when(e % 3 == 1, "building").otherwise("nature").alias("kind"), F.when(e % 4 == 0, "cafe").when(e % 4 == 1, "water").otherwise("green").alias("category"),
        F.col("event_type").alias("label"), (e * 37 % 192).cast("double").alias("x"), (e * 91 % 192).cast("double").alias("y"), F.when(e % 30 >= 10, 0.9).otherwise(0.5).alias("confidence"),
    )
    ground = course.Ground(requests, cells, None, places, 64, 30.0)
    open_ = cells.where("passable = 1").select("req", "y", "x")
    first = open_.groupBy("req").agg(F.min(F.struct("y", "x")).alias("c")).select("req", "c.y", "c.x")
    reached = G.distances(open_, first).select("req", "y", "x")
    return course.generated(ground, elements).join(reached, ["req", "y", "x"], "left_semi").select("req", "y", "x", "kind", "category", "label")


_M = "4294967295"
_MUL = lambda a, b: f"((({a}) * {b}::UHUGEINT) & {_M})"
_MIX = ", ".join(f"(SELECT xor(u, u >> 15) FROM (SELECT {_MUL('xor(t, t >> 15)', 0x735A2D97)} AS u FROM (SELECT {_MUL('xor(a, a >> 16)', 0x21F0AAAD)} AS t FROM (SELECT ((seed + {k * 0x9E3779B9 & 0xFFFFFFFF}) & {_M})::UHUGEINT AS a)))) AS {n}" for k, n in enumerate("abcd", 1))


@query(f"""WITH RECURSIVE seeds AS (SELECT c_custkey::UHUGEINT AS seed FROM customer), s0 AS (SELECT seed, {_MIX} FROM seeds),
s(seed, k, a, b, c, d, t) AS (SELECT seed, 0, a, b, c, d, 0::UHUGEINT FROM s0 UNION ALL
    SELECT seed, k + 1, xor(b, b >> 9), (c * 9) & {_M}, ((((c << 21) | (c >> 11)) & {_M}) + ((a + b + d) & {_M})) & {_M}, (d + 1) & {_M}, (a + b + d) & {_M} FROM s WHERE k < 17)
SELECT seed::BIGINT AS seed, CAST(k - 12 AS BIGINT) AS n, round(t::DOUBLE / 4294967296, 10) AS draw FROM s WHERE k > 12""")
def random_draws(spark: SparkSession, d: str) -> DataFrame:
    """The first five draws of each seed's stream."""
    seeds = V.load(spark, d, "customer").select(F.col("c_custkey").alias("seed"))
    return rounded(seeds.select("seed", F.posexplode(draws("seed", 5)).alias("n", "draw")).select("seed", (F.col("n") + 1).cast("long").alias("n"), "draw"), "draw", digits=10)


@query("WITH RECURSIVE w AS (SELECT DISTINCT c_mktsegment AS word FROM customer), h AS (SELECT word, 1 AS i, 2166136261::UHUGEINT AS h FROM w UNION ALL SELECT word, i + 1, (xor(h, ascii(substr(word, i, 1))::UHUGEINT) * 16777619) & 4294967295 FROM h WHERE i <= length(word)) SELECT word, arg_max(h, i)::BIGINT AS hash FROM h GROUP BY word")
def string_hash(spark: SparkSession, d: str) -> DataFrame:
    return V.load(spark, d, "customer").select(F.col("c_mktsegment").alias("word")).distinct().select("word", fnv1a("word").alias("hash"))


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, CAST(epoch(ts) AS BIGINT) AS t, row_number() OVER (PARTITION BY user_id ORDER BY CAST(epoch(ts) AS BIGINT), event_id) AS i FROM events),
f AS (SELECT user_id, event_id, i, t AS start, 1 AS n, true AS ok FROM s WHERE i = 1 UNION ALL
    SELECT s.user_id, s.event_id, s.i, CASE WHEN s.t - start > 432000 THEN s.t ELSE start END, CASE WHEN s.t - start > 432000 THEN 1 WHEN n < 10 THEN n + 1 ELSE n END, s.t - start > 432000 OR n < 10
    FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
SELECT user_id, event_id, ok FROM f""")
def rate_limited(spark: SparkSession, d: str) -> DataFrame:
    """Requests admitted by a limit of ten in a window that opens at the first arrival."""
    requests = V.load(spark, d, "events").select("user_id", "event_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts_s"))
    return limiter.admitted(requests, "user_id", 10, 432000)


ELEMENTS = """one AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 83 AS part, event_id AS e, event_type FROM events),
el AS (SELECT user_id, part, row_number() OVER (PARTITION BY user_id, part ORDER BY e) AS i, CASE e % 3 WHEN 0 THEN 'icon' WHEN 1 THEN 'building' ELSE 'nature' END AS kind, CASE e % 4 WHEN 0 THEN 'cafe' WHEN 1 THEN 'green' ELSE 'shop' END AS category,
    event_type AS label, e % 101 / 100::DOUBLE AS x, e % 89 / 100::DOUBLE AS y, 0.7::DOUBLE + e % 30 / 100::DOUBLE AS confidence FROM one),
size AS (SELECT user_id, part, count(*) AS n FROM el GROUP BY ALL),
ok AS (SELECT *, x < 1 AND x + 0.02::DOUBLE <= 1.001::DOUBLE AND confidence >= 0.8::DOUBLE AND confidence <= 1 AND (category <> 'cafe' OR kind <> 'nature') AS good, (x + least(0.02::DOUBLE, 1 - x) / 2) * 1000 AS px, (y + 0.01::DOUBLE) * 500 AS py FROM el JOIN size USING (user_id, part) WHERE n <= 80)"""


@query("WITH RECURSIVE " + ELEMENTS + """, f(user_id, part, i, kept) AS (SELECT user_id, part, 0::BIGINT, []::STRUCT(category VARCHAR, px DOUBLE, py DOUBLE, i BIGINT)[] FROM size WHERE n <= 80 UNION ALL
    SELECT f.user_id, f.part, o.i, CASE WHEN good AND len(list_filter(kept, lambda k: k.category = o.category AND sqrt(pow(k.px - o.px, 2) + pow(k.py - o.py, 2)) < 12)) = 0 THEN list_append(kept, {'category': o.category, 'px': o.px, 'py': o.py, 'i': o.i}) ELSE kept END
    FROM f JOIN ok o ON o.user_id = f.user_id AND o.part = f.part AND o.i = f.i + 1),
last AS (SELECT user_id, part, arg_max(kept, i) AS kept FROM f GROUP BY ALL)
SELECT user_id, part, CASE WHEN n <= 80 THEN 'analyzed' ELSE 'unavailable' END AS status, coalesce(len(kept), 0) AS n, coalesce(list_reduce(list_prepend('', list_transform(kept, lambda k: k.category || ' ' || CAST(floor(k.px) AS BIGINT) || ' ' || CAST(floor(k.py) AS BIGINT))), lambda a, b: a || b || ';'), '') AS kept FROM size LEFT JOIN last USING (user_id, part)""")
def map_elements(spark: SparkSession, d: str) -> DataFrame:
    """Elements of each image's JSON, valid ones without near duplicates; too many are an error."""
    from pyspark.sql import Window

    e = F.col("event_id")
    part = F.floor((F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1) / 83)
    one = F.struct(F.when(e % 3 == 0, "icon").when(e % 3 == 1, "building").otherwise("nature").alias("kind"), F.when(e % 4 == 0, "cafe").when(e % 4 == 1, "green").otherwise("shop").alias("category"), F.concat(F.lit(" "), F.col("event_type")).alias("label"), (e % 101 / 100.0).alias("x"), (e % 89 / 100.0).alias("y"), F.lit(0.02).alias("width"), F.lit(0.02).alias("height"), (0.7 + e % 30 / 100.0).alias("confidence"))
    rows = V.load(spark, d, "events").withColumn("part", part).groupBy("user_id", "part").agg(F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("event_id", one.alias("o")))), lambda s: s["o"]).alias("elements"))).alias("text"))
    kept = elements.parse(rows.withColumn("w", F.lit(1000)).withColumn("h", F.lit(500)), "text", "w", "h")
    whole = lambda c: F.floor(c).cast("string")
    told = F.aggregate("kept", F.lit(""), lambda s, k: F.concat(s, k["category"], F.lit(" "), whole(k["x"]), F.lit(" "), whole(k["y"]), F.lit(";")))
    return kept.select("user_id", "part", "status", F.size("kept").cast("long").alias("n"), told.alias("kept"))


@query("""WITH RECURSIVE s AS (SELECT user_id, event_id, CAST(epoch(ts) AS BIGINT) AS t, CAST(epoch(ts) AS BIGINT) + event_id % 50 * 10000 AS e, row_number() OVER (PARTITION BY user_id ORDER BY CAST(epoch(ts) AS BIGINT), event_id) AS i FROM events),
f(user_id, event_id, i, ends, ok) AS (SELECT user_id, NULL::BIGINT, 0::BIGINT, []::BIGINT[], false FROM s WHERE i = 1 UNION ALL
    SELECT s.user_id, s.event_id, s.i, CASE WHEN len(list_filter(ends, lambda x: x > s.t)) < 2 THEN list_append(list_filter(ends, lambda x: x > s.t), s.e) ELSE list_filter(ends, lambda x: x > s.t) END, len(list_filter(ends, lambda x: x > s.t)) < 2
    FROM f JOIN s ON s.user_id = f.user_id AND s.i = f.i + 1)
SELECT user_id, event_id, ok FROM f WHERE i > 0""")
def requests_in_flight(spark: SparkSession, d: str) -> DataFrame:
    """Requests admitted while fewer than two admitted ones are running."""
    start = F.unix_seconds(F.col("ts").cast("timestamp"))
    requests = V.load(spark, d, "events").select("user_id", "event_id", start.alias("start_s"), (start + F.col("event_id") % 50 * 10000).alias("end_s"))
    return limiter.in_flight(requests, "user_id", 2)


def lattice_loops(spark: SparkSession, d: str) -> DataFrame:
    """Round trips on a lattice of streets, one for each user's seed."""
    side, cell = 64, 16.0
    cells = spark.range(side * side).select(F.col("id").alias("cell"), F.floor(F.col("id") / side).alias("y"), (F.col("id") % side).alias("x"))
    street = (F.col("y") % 8 < 2) | (F.col("x") % 8 < 2)
    cost = cells.agg(F.transform(F.array_sort(F.collect_list(F.struct("cell", F.when(street, 1.0).alias("c")))), lambda s: s["c"]).alias("cost"))
    origin = 32 * side + 32
    dy, dx = F.col("y") - 32, F.col("x") - 32
    cands = cells.where(street & ((F.col("cell") * 7) % 11 == 0)).select(F.struct("cell", (F.greatest(F.abs(dy), F.abs(dx)) * cell + F.least(F.abs(dy), F.abs(dx)) * cell * 0.41).alias("d"), F.atan2(dy.cast("double"), dx.cast("double")).alias("bearing"), (F.col("cell") % 5 / 5.0).alias("score"), F.array(F.lit("nature")).alias("tags")).alias("c"))
    cands = cands.agg(F.array_sort(F.collect_list("c")).alias("cands"))
    users = V.load(spark, d, "events").select("user_id").distinct().select(F.col("user_id").alias("id"), F.col("user_id").alias("seed"))
    one = cost.crossJoin(cands)  # one row: the map and its candidates
    requests = users.crossJoin(F.broadcast(one)).select("id", "seed", F.lit(1000.0).alias("target_m"), F.lit(3).alias("k"), F.lit(cell).alias("cell_m"), F.lit(side).alias("height"), F.lit(side).alias("width"), F.lit(origin).alias("origin"), "cost", "cands")
    return G.loops(requests).select("id", "reason", F.round("length_m", 3).alias("length_m"), F.size("path").alias("cells"), F.size("stops").alias("stops"))


def pixel_courses(spark: SparkSession, d: str) -> DataFrame:
    """Courses on images of streets among green blocks, one for each region."""
    side, p = 320, F.col("p")
    y, x = F.floor(p / side), p % side
    key = F.col("r_regionkey").cast("long")
    tags = F.when(key % 3 == 0, F.array(F.lit("nature"))).when(key % 3 == 1, F.array(F.lit("quiet"), F.lit("nature"))).otherwise(F.array(F.lit("cafe")))
    requests = V.load(spark, d, "region").select(key.alias("req"), F.lit(37.5485).alias("lat"), F.lit(126.9335).alias("lng"), F.lit(16).alias("zoom"), F.lit(55875).alias("x0"), F.lit(25383).alias("y0"), F.lit(512).alias("tile_px"), F.lit(0.9469).alias("mpp"), F.lit(side).alias("width"), F.lit(side).alias("height"), F.lit(196.0).alias("origin_px"), F.lit(196.0).alias("origin_py"), F.lit(150.0).alias("half_m"), F.lit(15).alias("minutes"), tags.alias("tags"), (key + 42).alias("seed"), F.lit(False).alias("analysed"))
    street = (y % 64 < 12) | (x % 64 < 12)
    colour = lambda v: F.when(street, 255).otherwise(v).cast("int")
    pixels = requests.select("req").crossJoin(spark.range(side * side).withColumnRenamed("id", "p")).select("req", y.alias("y"), x.alias("x"), colour(224).alias("r"), colour(236).alias("g"), colour(211).alias("b"), F.lit(255).alias("a"))  # an image for each request
    out = course.courses(pixels, requests)
    return out.select("req", "reason", F.round("length_m", 3).alias("length_m"), F.size("path").alias("cells"), F.size("stops").alias("stops"), "green_regions")


query(None)(pixel_courses)
query(None)(lattice_loops)
