"""Request rate limits per key: in batch by pointers, in a stream by state that ends.

A window opens at a key's first arrival and again at the first arrival more than
``window_s`` seconds after the open one's start; it admits ``limit`` requests.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gridstride.operators.blocks import durable


def openers(times: DataFrame, window_s: int) -> DataFrame:
    """(k, b, ts_s): the times that open a window, of distinct arrivals (k, b, ts_s); b is the time's bucket of ``window_s`` seconds.

    Each time points to the first one after its window. That one lies in the bucket where the window ends,
    or is the first of a later bucket; so a task orders the times of one bucket, never all of a key. The openers
    are the times that pointers lead to from the first one: pointers are doubled until none
    leads on, so rounds grow with the logarithm of a key's windows.
    """
    width = max(window_s, 1)
    after = times.select("k", F.floor((F.col("ts_s") + window_s) / width).alias("b"), (F.col("ts_s") + window_s).alias("at"), F.lit(0).alias("arrives"), F.col("ts_s").alias("of"))
    arrive = times.select("k", "b", F.col("ts_s").alias("at"), F.lit(1).alias("arrives"), F.lit(None).cast("long").alias("of"))
    # backwards in time, a window's end before the arrivals at that very second: these are not after it
    back = Window.partitionBy("k", "b").orderBy(F.desc("at"), "arrives").rowsBetween(Window.unboundedPreceding, 0)
    within = after.union(arrive).withColumn("next", F.min(F.when(F.col("arrives") == 1, F.col("at"))).over(back)).where("arrives = 0").select("k", "b", "of", "next")
    first = times.groupBy("k", "b").agg(F.min("ts_s").alias("least"))
    asked = within.where("next is null").select("k", "b").distinct().withColumn("least", F.lit(None).cast("long"))
    # one row for each bucket of a key
    later = Window.partitionBy("k").orderBy(F.desc("b"), F.col("least").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    beyond = first.union(asked).withColumn("then", F.min("least").over(later)).where("least is null").select("k", "b", "then")
    jumps = durable(within.join(beyond, ["k", "b"], "left").select("k", F.col("of").alias("ts_s"), F.coalesce("next", "then").alias("to")).where("to is not null"))
    found = durable(first.groupBy("k").agg(F.min("least").alias("ts_s")))
    while True:
        new = durable(found.join(jumps, ["k", "ts_s"]).select("k", F.col("to").alias("ts_s")))
        if new.isEmpty():
            return found.select("k", F.floor(F.col("ts_s") / width).alias("b"), "ts_s")
        found = durable(found.union(new))
        jumps = durable(jumps.join(jumps.select("k", F.col("ts_s").alias("to"), F.col("to").alias("further")), ["k", "to"]).select("k", "ts_s", F.col("further").alias("to")))


def admitted(requests: DataFrame, key: str, limit: int, window_s: int) -> DataFrame:
    """(key, event_id, ok) of each request (key, ts_s, event_id): whether its window admits it, in order of time and id.

    Requests of a key in one second are counted first; only those of the second in which a window
    fills are ranked. Requests without a key or time are not admitted; an empty table gives no rows.
    """
    width = max(window_s, 1)
    rows = requests.select(F.col(key).alias("k"), F.col("ts_s").cast("long").alias("ts_s"), "event_id")
    times = durable(rows.dropna(subset=["k", "ts_s"]).groupBy("k", "ts_s").agg(F.count("*").alias("n")).withColumn("b", F.floor(F.col("ts_s") / width)))
    starts = openers(times.select("k", "b", "ts_s"), window_s)
    # at most one window opens in a bucket, and it reaches into the next
    near = starts.select("k", F.explode(F.array(F.col("b"), F.col("b") + 1)).alias("b"), F.col("ts_s").alias("start"))
    placed = times.join(near, ["k", "b"]).where("start <= ts_s").groupBy("k", "ts_s").agg(F.any_value("n").alias("n"), F.max("start").alias("start"))
    upto = Window.partitionBy("k", "start").orderBy("ts_s").rowsBetween(Window.unboundedPreceding, 0)
    placed = durable(placed.withColumn("before", F.sum("n").over(upto) - F.col("n")).select("k", "ts_s", "n", "before"))
    told = rows.join(placed, ["k", "ts_s"], "left")
    fills = F.col("before").isNotNull() & (F.col("before") < limit) & (F.col("before") + F.col("n") > limit)
    rank = F.row_number().over(Window.partitionBy("k", "ts_s").orderBy("event_id"))
    some = told.where(fills).withColumn("ok", F.col("before") + rank <= limit)
    rest = told.where(~fills).withColumn("ok", F.coalesce(F.col("before") + F.col("n") <= limit, F.lit(False)))
    return rest.union(some).select(F.col("k").alias(key), "event_id", "ok")


class Limits(StatefulProcessor):
    """Admits a key's requests (ts_s, event_id and, with ``most``, end_s) as they come: ``limit`` in a window, and ``most`` at a time.

    The state is the window's start and count and the ends of the requests that run. A timer
    at the later of the window's end and the last of these clears it: a request after that meets a fresh key.
    """

    def __init__(self, limit: int, window_s: int, most: int | None):
        self.limit, self.window_s, self.most = limit, window_s, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("limits", "start long, n int, ends array<long>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        start, n, ends = self.state.get() if self.state.exists() else (None, 0, [])
        batch, ok = pd.concat(rows).sort_values(["ts_s", "event_id"]), []
        ends, until = list(ends), batch["end_s"].tolist() if self.most is not None else [0] * len(batch)
        for at, end in zip(batch["ts_s"].tolist(), until, strict=True):
            if start is None or at - start > self.window_s:
                start, n = at, 0
            ends = [e for e in ends if e > at]
            ok.append(n < self.limit and (self.most is None or len(ends) < self.most))
            n += ok[-1]
            ends += [end] * (ok[-1] and self.most is not None)
        self.state.update((int(start), int(n), [int(e) for e in ends]))
        for timer in self.handle.listTimers():
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(1000 * (max([start + self.window_s, *ends]) + 1))
        yield pd.DataFrame({"key": [key[0]] * len(batch), "event_id": batch["event_id"].to_numpy(), "ok": ok})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def admitted_stream(requests: DataFrame, key: str, limit: int, window_s: int, late: str = "10 minutes", most: int | None = None) -> DataFrame:
    """The same over a stream (key, ts_s, event_id; with ``most`` also end_s, and both limits hold).

    Requests of a key are taken in order within a micro-batch; one that arrives later than a newer one of an earlier
    batch is judged against the open window, and one that is ``late`` or more behind the newest of earlier batches gets no row. State lasts
    as long as its window and its running requests. The session's state store must be RocksDB.
    """
    ids, kind = (requests.schema[c].dataType.simpleString() for c in ("event_id", key))
    columns = [F.col(key).alias("key"), F.timestamp_seconds("ts_s").alias("at"), F.col("ts_s").cast("long").alias("ts_s"), "event_id", *([F.col("end_s").cast("long").alias("end_s")] if most is not None else [])]
    rows = requests.select(*columns).withWatermark("at", late)
    out = rows.groupBy("key").transformWithStateInPandas(Limits(limit, window_s, most), f"key {kind}, event_id {ids}, ok boolean", "append", "eventTime")
    return out.withColumnRenamed("key", key)


def in_flight(requests: DataFrame, key: str, most: int) -> DataFrame:
    """(key, event_id, ok) of requests (key, start_s, end_s, event_id): whether fewer than ``most`` admitted ones are running when it comes, in order of arrival.

    A key's requests are folded in order in one Arrow group, which keeps only the ends of those running.
    """
    kind = requests.schema[key].dataType.simpleString()
    ids = requests.schema["event_id"].dataType.simpleString()

    def fold(group: pa.Table) -> pa.Table:
        group = group.sort_by([("start_s", "ascending"), ("event_id", "ascending")])
        running: list[float] = []
        ok = []
        for start, end in zip(group.column("start_s").to_pylist(), group.column("end_s").to_pylist(), strict=True):
            running = [e for e in running if e > start]
            ok.append(len(running) < most)
            running += [end] * ok[-1]
        return pa.table({key: group.column(key), "event_id": group.column("event_id"), "ok": pa.array(ok, pa.bool_())})

    return requests.select(key, "start_s", "end_s", "event_id").groupBy(key).applyInArrow(fold, f"{key} {kind}, event_id {ids}, ok boolean")


def latest(requests: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each key's newest request, which supersedes the earlier ones, and how many there were."""
    rest = [c for c in requests.columns if c != key]
    one = requests.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("one"), F.count("*").alias("n"))
    return one.select(key, *[F.col("one")[c].alias(c) for c in rest], "n")


def counts(events: DataFrame, width: str, by: list[str], **more: Column) -> DataFrame:
    """(start, by, n, more) of windows of the clock; the same over a table or a stream."""
    return events.groupBy(F.window("ts", width).alias("w"), *by).agg(F.count("*").alias("n"), *[c.alias(n) for n, c in more.items()]).select(F.col("w.start").alias("start"), *by, "n", *more)


def counts_stream(events: DataFrame, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Counts per window and type, with a watermark for late rows."""
    return counts(events.withWatermark("ts", late), width, ["event_type"])
