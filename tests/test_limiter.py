"""Rate limits: pointers equal an ordered fold, and the stream's state ends."""

import random

import pytest
from pyspark.sql import functions as F

from gridstride.streaming import limiter

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def plain(rows, limit, window_s):
    start, n, out = {}, {}, {}
    for k, t, e in sorted(r for r in rows if None not in r[:2]):
        if k not in start or t - start[k] > window_s:
            start[k], n[k] = t, 0
        out[k, e] = n[k] < limit
        n[k] += out[k, e]
    return out | {(k, e): False for k, t, e in rows if None in (k, t)}


@pytest.mark.parametrize(("limit", "window_s", "span"), [(3, 60, 2000), (1, 7, 300), (4, 0, 40), (0, 10, 100), (5, 1000, 200)])
def test_admitted_equals_a_fold(spark, limit, window_s, span):
    r = random.Random(window_s)
    rows = [(r.choice([1, 1, 1, 2, 3, -4]), r.randrange(-span, span), e) for e in range(400)] + [(9, 5, 1000), (None, 4, 1001), (1, None, 1002)]
    got = {(x.k, x.event_id): x.ok for x in limiter.admitted(spark.createDataFrame(rows, "k long, ts_s long, event_id long"), "k", limit, window_s).collect()}
    assert got == plain(rows, limit, window_s)


def test_empty_table(spark):
    assert limiter.admitted(spark.createDataFrame([], "k long, ts_s long, event_id long"), "k", 3, 60).count() == 0


def test_a_key_of_many_requests(spark):
    n = 1_000_000
    rows = spark.range(n).select(F.lit(1).alias("k"), F.floor(F.col("id") / 5).alias("ts_s"), F.col("id").alias("event_id"))
    found = limiter.admitted(rows, "k", 10, 599).agg(F.count("*").alias("n"), F.count_if("ok").alias("ok")).first()
    assert tuple(found) == (n, 10 * -(-(n // 5) // 600))


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


def run(spark, tmp_path, batches, schema, **more):
    """The stream's answers, one micro-batch for each list of rows, and the keys that have state at the end."""
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = limiter.admitted_stream(stream, "k", **more).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).start()
    for i, rows in enumerate(batches):
        text = "\n".join(spark.createDataFrame(rows, schema).toJSON().collect())
        (tmp_path / f"next{i}").write_text(text)
        (tmp_path / f"next{i}").rename(tmp_path / "in" / f"{i}.json")
        q.processAllAvailable()
    q.stop()
    state = spark.read.format("statestore").option("stateVarName", "limits").load(str(tmp_path / "c"))
    return {(x.k, x.event_id): x.ok for x in spark.read.parquet(str(tmp_path / "out")).collect()}, {x.key[0] for x in state.select("key").collect()}


def test_stream_equals_the_batch_and_its_state_ends(spark, tmp_path, rocks):
    r = random.Random(4)
    times = sorted(r.randrange(1000) for _ in range(90))
    rows = [(1 + i % 2, 1_700_000_000 + t, i) for i, t in enumerate(times)]
    later = [(7, 1_700_010_000, 500)], [(7, 1_700_010_001, 501)]
    got, held = run(spark, tmp_path, [rows[:30], rows[30:60], rows[60:], *later], "k long, ts_s long, event_id long", limit=3, window_s=60, late="1 second")
    assert got == plain([*rows, *later[0], *later[1]], 3, 60)
    assert held == {7}  # the windows of keys 1 and 2 are over, and so is their state


def test_both_limits_and_late_requests(spark, tmp_path, rocks):
    t = 1_700_000_000
    first = [(1, t, 0, t + 50), (1, t + 1, 1, t + 50), (1, t + 2, 2, t + 3), (1, t + 51, 3, t + 60), (2, t + 51, 4, t + 900)]
    last = [(2, t + 701, 5, t + 702), (2, t + 5, 6, t + 6)]
    got, held = run(spark, tmp_path, [first, [(3, t + 710, 7, t + 711)], last], "k long, ts_s long, event_id long, end_s long", limit=3, window_s=100, late="10 seconds", most=2)
    assert got == {(1, 0): True, (1, 1): True, (1, 2): False, (1, 3): True, (2, 4): True, (2, 5): True, (3, 7): True}  # request 6 is 700 seconds late
    assert held == {2, 3}  # request 4 still runs
