"""Fields over grids that are held as blocks: distances, costs, depths, ways and components.

A block is a square of ``BLOCK`` cells a side as arrays, with a ring of its neighbours' cells. Blocks
lie in parts of a table in the cluster's shared checkpoint folder and stay there. A
round reads the parts that are told news, relaxes the blocks told, and writes those
parts again, with the news for their neighbours; all others are neither read nor written, and what
a round replaces is deleted. Values only fall, and a round without news is the last, so
the rounds grow with the blocks that the longest way crosses, not with its cells.

Components need no such rounds: each block numbers its own, and pairs of numbers that meet at borders
are united within ever larger squares of blocks.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STEPS = [(dy, dx, math.sqrt(2) if dy and dx else 1.0) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
BLOCK = 512
#: Squares of blocks that one step unites have this many times the side of the last.
FAN = 8
Kernel = Callable[[np.ndarray, np.ndarray, np.ndarray], None]


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder; a temporary one only where none is set and all tasks run in this process."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        place = context.getConf().get("spark.checkpoint.dir")
        if place is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that all executors share")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


# ---- kernels: they lower the values of one block ------------------------------------------------


def spread(cell_m: float) -> Kernel:
    """Cheapest ways over open cells: a step costs its length times the mean of both cells' costs, and cuts no corner."""

    def run(cost: np.ndarray, value: np.ndarray, front: np.ndarray) -> None:
        width, c, v = cost.shape[1], cost.ravel(), value.ravel()
        open_ = np.isfinite(c)
        front = front[open_[front]]
        while len(front):
            found, values = [], []
            for dy, dx, length in STEPS:
                to = front + dy * width + dx
                free = open_[to]
                if dy and dx:
                    free &= open_[front + dy * width] & open_[front + dx]
                of, to = front[free], to[free]
                new = v[of] + length * cell_m * ((c[of] + c[to]) * 0.5)
                less = new < v[to]
                found.append(to[less])
                values.append(new[less])
            to = np.concatenate(found)
            np.minimum.at(v, to, np.concatenate(values))
            front = np.unique(to)

    return run


def chamfer(cost: np.ndarray, value: np.ndarray, front: np.ndarray) -> None:
    """Steps of 3 and 4 over a dense rectangle, in two scans: rows downwards and back, each row by a running minimum.

    In a rectangle the moves of a shortest way can be put in any order, so those
    of the first scan come first.
    """
    v = value[1:-1, 1:-1]
    ramp = 3.0 * np.arange(v.shape[1])
    for rows, back in ((range(len(v)), 1), (range(len(v) - 1, -1, -1), -1)):
        last = None
        for y in rows:
            row = v[y]
            if last is not None:
                np.minimum(row, last + 3, out=row)
                np.minimum(row[1:], last[:-1] + 4, out=row[1:])
                np.minimum(row[:-1], last[1:] + 4, out=row[:-1])
            row[::back] = np.minimum.accumulate(row[::back] - ramp) + ramp
            last = row


# ---- blocks -------------------------------------------------------------------------------------

KEYS = ["part", "req", "by", "bx"]
#: A block's row has its corner (oy, ox), its width and its arrays; news have the places and values of cells.
ROW = pa.schema([("kind", pa.string()), ("part", pa.int32()), ("req", pa.int64()), ("by", pa.int64()), ("bx", pa.int64()), ("oy", pa.int64()), ("ox", pa.int64()), ("width", pa.int64()), ("cost", pa.binary()), ("value", pa.binary()), ("ys", pa.binary()), ("xs", pa.binary())])
DDL = "kind string, part int, req long, by long, bx long, oy long, ox long, width long, cost binary, value binary, ys binary, xs binary"


class Block:
    def __init__(self, row: dict, side: int):
        self.row, self.side, self.key = row, side, (row["req"], row["by"], row["bx"])
        self.oy, self.ox = row["oy"], row["ox"]
        self.cost = np.frombuffer(row["cost"]).reshape(-1, row["width"])
        self.value = np.frombuffer(row["value"]).reshape(-1, row["width"]).copy()
        y, x = np.arange(self.cost.shape[0]) + self.oy, np.arange(row["width"]) + self.ox
        self.inner = ((y // side == row["by"])[:, None]) & (x // side == row["bx"])

    def kept(self) -> dict:
        return self.row | {"value": self.value.tobytes()}

    def news(self, before: np.ndarray, part: Callable[[int, int, int], int], most: float) -> Iterator[dict]:
        """The inner cells that fell, for each neighbour whose ring holds them."""
        y, x = np.nonzero((self.value < before) & self.inner & (self.value <= most))
        values, y, x = self.value[y, x], y + self.oy, x + self.ox
        req, by, bx = self.key
        edge = {-1: lambda at: at % self.side == 0, 0: lambda at: np.ones(len(at), bool), 1: lambda at: at % self.side == self.side - 1}
        for dy, dx, _ in STEPS:
            near = edge[dy](y) & edge[dx](x)
            if near.any():
                yield {"kind": "news", "part": part(req, by + dy, bx + dx), "req": req, "by": by + dy, "bx": bx + dx, "value": values[near].tobytes(), "ys": y[near].tobytes(), "xs": x[near].tobytes()}


class Field:
    """Values of the cells of many grids, settled by a kernel; ``rounds`` lists the blocks written in each round."""

    def __init__(self, cells: DataFrame, kernel: Kernel, seeds: DataFrame | None = None, most: float = math.inf, side: int = BLOCK, watch: bool = False):
        """``cells``: req, y, x, cost and, unless ``seeds`` (req, y, x, value) has them, value. News of values over ``most`` are not sent."""
        self.spark, self.side, self.rounds = cells.sparkSession, side, []
        self.folder = f"{shared_folder(self.spark)}/field-{uuid.uuid4()}"
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        self.fs.deleteOnExit(path)
        self.parts = parts = 4 * int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        part = lambda req, by, bx: (req % parts * 31 + by * 17 + bx) % parts

        def first(group: pa.Table) -> pa.Table:
            req, by, bx = (group.column(c)[0].as_py() for c in KEYS[1:])
            y, x, cost, value = (group.column(c).to_numpy() for c in ("y", "x", "cost", "value"))
            oy, ox = int(y.min()) - 1, int(x.min()) - 1  # a closed rim, so that no step leaves the array
            shape = int(y.max()) - oy + 2, int(x.max()) - ox + 2
            costs, values = np.full(shape, np.inf), np.full(shape, np.inf)
            np.fmin.at(costs, (y - oy, x - ox), cost)
            np.fmin.at(values, (y - oy, x - ox), value)
            values[~np.isfinite(costs)] = np.inf
            row = {"kind": "state", "part": group.column("part")[0].as_py(), "req": req, "by": by, "bx": bx, "oy": oy, "ox": ox, "width": shape[1], "cost": costs.tobytes(), "value": values.tobytes()}
            block = Block(row, side)
            if not (block.inner & np.isfinite(costs)).any():
                return ROW.empty_table()  # a ring without a block
            return settled(block, values, np.flatnonzero(np.isfinite(values)))

        def settled(block: Block, told: np.ndarray, front: np.ndarray) -> pa.Table:
            kernel(block.cost, block.value, front)
            return pa.Table.from_pylist([block.kept(), *block.news(told, part, most)], ROW)

        def again(group: pa.Table) -> pa.Table:
            is_state = pc.equal(group.column("kind"), "state")
            state, news = group.filter(is_state), group.filter(pc.invert(is_state))
            if not len(state) or not len(news):
                return state  # no news, or news for cells that are not there
            block = Block(state.to_pylist()[0], side)
            before = block.value.copy()
            y, x = (np.concatenate([np.frombuffer(p.as_py(), np.int64) for p in news.column(c)]) for c in ("ys", "xs"))
            v = np.concatenate([np.frombuffer(p.as_py()) for p in news.column("value")])
            at = (y - block.oy) * block.cost.shape[1] + x - block.ox
            flat = block.value.ravel()
            fell = v < flat[at]
            np.minimum.at(flat, at[fell], v[fell])
            return settled(block, before, np.unique(at[fell]))

        columns = ["req", *[F.col(c).cast("long").alias(c) for c in ("y", "x")]]
        double = lambda c: F.col(c).cast("double").alias(c)
        none = lambda c: F.lit(None).cast("double").alias(c)
        rows = cells.select(*columns, double("cost"), double("value") if seeds is None else none("value"))
        if seeds is not None:
            rows = rows.union(seeds.select(*columns, none("cost"), double("value")))
        self._write(_dealt(rows, side).withColumn("part", part_of(parts)).repartition("part").groupBy(*KEYS).applyInArrow(first, DDL), 0)
        self.latest = {p: 0 for p in self._told(0, "state")}
        done = 0
        while True:
            if watch:
                self.rounds.append(self._read([f"round={done}/kind=state"]).count())
            active = [p for p in self._told(done, "news") if p in self.latest]
            if not active:
                break
            both = self._read([self._path(p) for p in active] + [f"round={done}/kind=news/part={p}" for p in active])
            self._write(both.repartition("part").groupBy(*KEYS).applyInArrow(again, DDL), done + 1)
            for p in active:
                self._delete(self._path(p))
                self.latest[p] = done + 1
            self._delete(f"round={done}/kind=news")
            done += 1

    def _path(self, part: int) -> str:
        return f"round={self.latest[part]}/kind=state/part={part}"

    def _write(self, rows: DataFrame, done: int) -> None:
        rows.write.partitionBy("kind", "part").parquet(f"{self.folder}/round={done}")

    def _read(self, paths: list[str]) -> DataFrame:
        columns = [c for c in DDL.split(", ") if c.split()[0] not in ("kind", "part")]
        read = self.spark.read.schema(", ".join([*columns, "round int, kind string, part int"])).option("basePath", self.folder)
        return read.parquet(*[f"{self.folder}/{p}" for p in paths]).select(*[c.split()[0] for c in DDL.split(", ")])

    def _told(self, done: int, kind: str) -> list[int]:
        """Parts that a round wrote: at most ``parts`` numbers, from the names of folders."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/round={done}/kind={kind}")
        if not self.fs.exists(path):
            return []
        return sorted(int(s.getPath().getName().removeprefix("part=")) for s in self.fs.listStatus(path) if s.isDirectory())

    def _delete(self, path: str) -> None:
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{path}"), True)

    def state(self) -> DataFrame:
        if not self.latest:
            return self.spark.createDataFrame([], DDL)
        return self._read([self._path(p) for p in self.latest])

    def cells(self) -> DataFrame:
        """(req, y, x, value) of the open cells; infinite where nothing reaches them."""

        side = self.side

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    block = Block(row, side)
                    y, x = np.nonzero(block.inner & np.isfinite(block.cost))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), row["req"]), pa.int64()), pa.array(block.oy + y), pa.array(block.ox + x), pa.array(block.value[y, x])], names=["req", "y", "x", "value"])

        return self.state().mapInArrow(own, "req long, y long, x long, value double")

    def ways(self, targets: DataFrame, cell_m: float) -> DataFrame:
        """(req, ty, tx, total, i, y, x): the cells of the cheapest way to each target (req, ty, tx) that is reached, from its source (i = 0) on.

        From a cell the way back goes to the neighbour that gives the least value, the first in row order of
        equal ones. Costs must be positive. A round follows all ways to the borders of their blocks.
        """
        parts, side = self.parts, self.side
        kind = "kind string, req long, by long, bx long, ty long, tx long, y long, x long, back long, total double, ys array<long>, xs array<long>"
        schema = pa.schema([("kind", pa.string()), *[(c, pa.int64()) for c in ("req", "by", "bx", "ty", "tx", "y", "x", "back")], ("total", pa.float64()), ("ys", pa.list_(pa.int64())), ("xs", pa.list_(pa.int64()))])

        def follow(state: pa.Table, at: pa.Table) -> pa.Table:
            if not len(state) or not len(at):
                return schema.empty_table()
            block = Block(state.to_pylist()[0], side)
            width, cost, value = block.cost.shape[1], block.cost.ravel(), block.value.ravel()
            back = _back(block.cost, block.value, cell_m)
            inner, out = block.inner.ravel(), []
            for r in at.to_pylist():
                here = (r["y"] - block.oy) * width + r["x"] - block.ox
                inside = 0 <= here < len(cost) and 0 <= r["x"] - block.ox < width
                if not inside or not np.isfinite(value[here]):
                    continue  # closed, or out of reach
                total, cells = r["total"] if r["total"] is not None else float(value[here]), []
                while inner[here]:
                    cells.append(here)
                    if value[here] == 0:
                        break
                    here = back[here]
                y, x = np.divmod(np.array(cells, np.int64), width)
                key = {c: r[c] for c in ("req", "ty", "tx")} | {"total": total}
                # ``by`` of a way says that it is at its source
                out.append(key | {"kind": "way", "back": r["back"], "ys": (y + block.oy).tolist(), "xs": (x + block.ox).tolist(), "by": int(value[cells[-1]] == 0)})
                if value[cells[-1]] != 0:
                    y, x = int(here // width + block.oy), int(here % width + block.ox)
                    out.append(key | {"kind": "at", "by": y // side, "bx": x // side, "y": y, "x": x, "back": r["back"] + len(cells)})
            return pa.Table.from_pylist(out, schema)

        folder, done = f"{self.folder}/ways-{uuid.uuid4()}", 0
        keyed = targets.select("req", F.col("ty").cast("long").alias("ty"), F.col("tx").cast("long").alias("tx")).distinct()
        at = durable(keyed.select("req", F.floor(F.col("ty") / side).alias("by"), F.floor(F.col("tx") / side).alias("bx"), "ty", "tx", F.col("ty").alias("y"), F.col("tx").alias("x"), F.lit(0).cast("long").alias("back"), F.lit(None).cast("double").alias("total")))
        while True:
            at = at.withColumn("part", part_of(parts))
            active = [r["part"] for r in at.select("part").distinct().collect() if r["part"] in self.latest]  # at most ``parts`` numbers
            if not active:
                break
            state = self._read([self._path(p) for p in active])
            state.groupBy(*KEYS).cogroup(at.groupBy(*KEYS)).applyInArrow(follow, kind).write.partitionBy("kind").parquet(f"{folder}/round={done}")
            read = self.spark.read.schema(kind.replace("kind string, ", "") + ", round int, kind string").option("basePath", folder).parquet(f"{folder}/round={done}")
            at, done = read.where("kind = 'at'").select("req", "by", "bx", "ty", "tx", "y", "x", "back", "total"), done + 1
        if not done:
            return self.spark.createDataFrame([], "req long, ty long, tx long, total double, i long, y long, x long")
        found = self.spark.read.schema(kind.replace("kind string, ", "") + ", round int, kind string").option("basePath", folder).parquet(folder).where("kind = 'way'")
        sizes = found.where("by = 1").select("req", "ty", "tx", (F.col("back") + F.size("ys")).alias("n"))
        each = found.join(sizes, ["req", "ty", "tx"]).select("req", "ty", "tx", "total", "n", "back", F.posexplode(F.arrays_zip("ys", "xs")).alias("j", "c"))
        return each.select("req", "ty", "tx", "total", (F.col("n") - 1 - F.col("back") - F.col("j")).alias("i"), F.col("c.ys").alias("y"), F.col("c.xs").alias("x"))


def part_of(parts: int) -> Column:
    return F.pmod(F.pmod("req", F.lit(parts).cast("long")) * 31 + F.col("by") * 17 + F.col("bx"), F.lit(parts).cast("long")).cast("int")


def _dealt(cells: DataFrame, side: int) -> DataFrame:
    """Add the block (by, bx) of each cell; cells at a block's border come once more for each block whose ring they belong to."""
    block = lambda c, d=0: F.floor((F.col(c) + d) / side)
    own = cells.withColumn("by", block("y")).withColumn("bx", block("x"))
    near = F.array_distinct(F.array(*[F.struct(block("y", dy).alias("by"), block("x", dx).alias("bx")) for dy, dx, _ in STEPS]))
    rest = lambda c: F.pmod(F.col(c), F.lit(side).cast("long")).isin(0, side - 1)
    ring = own.where(rest("y") | rest("x")).withColumn("t", F.explode(near)).where((F.col("t.by") != F.col("by")) | (F.col("t.bx") != F.col("bx")))
    return own.union(ring.select(*cells.columns, "t.by", "t.bx"))


def _back(cost: np.ndarray, value: np.ndarray, cell_m: float) -> np.ndarray:
    """For each cell the neighbour that gives the least value, as a place in the flat array."""
    height, width = cost.shape
    open_, best, came = np.isfinite(cost), np.full(cost.shape, np.inf), np.zeros(cost.shape, np.int64)
    inner = (slice(1, height - 1), slice(1, width - 1))
    at = np.arange(cost.size).reshape(cost.shape)
    for dy, dx, length in STEPS:
        of = (slice(1 + dy, height - 1 + dy), slice(1 + dx, width - 1 + dx))
        free = open_[inner] & open_[of]
        if dy and dx:
            free &= open_[of[0], inner[1]] & open_[inner[0], of[1]]
        with np.errstate(invalid="ignore"):
            new = np.where(free, value[of] + length * cell_m * ((cost[of] + cost[inner]) * 0.5), np.inf)
        less = new < best[inner]
        best[inner][less], came[inner][less] = new[less], at[of][less]
    return came.ravel()


# ---- components ---------------------------------------------------------------------------------


def _numbered(mask: np.ndarray) -> np.ndarray:
    """For each cell of a mask the place of the first cell of its 4-connected component."""
    at = np.arange(mask.size).reshape(mask.shape)
    sides = [(at[:, :-1], at[:, 1:], mask[:, :-1] & mask[:, 1:]), (at[:-1], at[1:], mask[:-1] & mask[1:])]
    return united(np.concatenate([a[m] for a, _, m in sides]), np.concatenate([b[m] for _, b, m in sides]), mask.size).reshape(mask.shape)


def united(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least number linked to each of 0..n-1 by the links (a, b): roots hook onto lesser ones and ways to them are halved."""
    root = np.arange(n)
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    return root


def components(cells: DataFrame, width: int, side: int = BLOCK, watch: list | None = None) -> tuple[DataFrame, DataFrame]:
    """4-connected components of cells (req, y, x): (req, y, x, local) and (req, local, first).

    ``local`` is the first cell, as y * width + x, of the part of a component within a block, ``first``
    that of the component. Each level unites pairs of numbers within squares of ``FAN`` times the last
    side, so levels grow with the logarithm of the blocks; ``watch`` gets the pairs of each.
    """

    def number(group: pa.Table) -> pa.Table:
        y, x = group.column("y").to_numpy(), group.column("x").to_numpy()
        oy, ox = int(y.min()), int(x.min())
        mask = np.zeros((int(y.max()) - oy + 1, int(x.max()) - ox + 1), bool)
        mask[y - oy, x - ox] = True
        first = _numbered(mask)[y - oy, x - ox]
        first = (first // mask.shape[1] + oy) * width + first % mask.shape[1] + ox
        return pa.table({"req": group.column("req"), "y": group.column("y"), "x": group.column("x"), "local": first})

    def unite(group: pa.Table) -> pa.Table:
        names, places = np.unique(np.concatenate([group.column("a").to_numpy(), group.column("b").to_numpy()]), return_inverse=True)
        root = united(places[: len(group)], places[len(group) :], len(names))
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"req": pa.array(np.full(len(moved), group.column("req")[0].as_py()), pa.int64()), "l": names[moved], "r": names[root[moved]]})

    plain = cells.select("req", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"))
    block = lambda c: F.floor(F.col(c) / side)
    found = durable(plain.withColumn("by", block("y")).withColumn("bx", block("x")).groupBy("req", "by", "bx").applyInArrow(number, "req long, y long, x long, local long"))
    # where two blocks meet: the lower and right border of one, the upper and left of the next
    low = lambda c: F.pmod(F.col(c), F.lit(side).cast("long"))
    ends, pairs = found, None
    for along, across in (("y", "x"), ("x", "y")):
        a = ends.where(low(along) == side - 1).select("req", (F.col(along) + 1).alias(along), across, F.col("local").alias("a"))
        b = ends.where(low(along) == 0).select("req", along, across, F.col("local").alias("b"))
        met = a.join(b, ["req", along, across]).select("req", "a", "b", (F.col("y") - int(along == "y")).alias("ay"), (F.col("x") - int(along == "x")).alias("ax"), F.col("y").alias("by"), F.col("x").alias("bx"))
        pairs = met if pairs is None else pairs.union(met)
    names = ["ay", "ax", "by", "bx"]
    pairs = durable(pairs.select("req", "a", "b", *[block(c).alias(c) for c in names]).distinct())
    roots, levels = None, 0
    while not pairs.isEmpty():
        if watch is not None:
            watch.append(pairs.count())
        pairs = pairs.select("req", "a", "b", *[F.floor(F.col(c) / FAN).alias(c) for c in names])
        inside = (F.col("ay") == F.col("by")) & (F.col("ax") == F.col("bx"))
        moved = durable(pairs.where(inside).groupBy("req", "ay", "ax").applyInArrow(unite, "req long, l long, r long"))
        on = lambda rows, c: rows.join(moved.select("req", F.col("l").alias(c), F.col("r").alias("_r")), ["req", c], "left").withColumn(c, F.coalesce("_r", c)).drop("_r")
        pairs = durable(on(on(pairs.where(~inside), "a"), "b").where("a != b").select("req", "a", "b", *names).distinct())
        roots = moved if roots is None else on(roots, "r").select("req", "l", "r").union(moved)
        roots, levels = durable(roots), levels + 1
    locals_ = found.select("req", "local").distinct()
    if roots is None:
        return found, locals_.withColumn("first", F.col("local"))
    return found, locals_.join(roots.withColumnRenamed("l", "local"), ["req", "local"], "left").select("req", "local", F.coalesce("r", "local").alias("first"))
