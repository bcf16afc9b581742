"""Exact top-k inner products by norm-bucketed retrieval (operator 7).

Equal vectors are one, with their k + 1 smallest ids. Distinct vectors are dealt
into ranges of length, and a range into buckets of bounded size. Queries come in
blocks of bounded size, which every task holds: no vector is shuffled for a query.

Each query starts with a threshold, its k-th best product among a sixteenth of the
vectors, and raises it as it goes from longer to shorter buckets. The threshold is
a local cosine in a bucket: beyond 1 the bucket is skipped; where it is high, only
vectors are tried whose values at the query's largest coordinates lie in the
feasible intervals; else only the prefix of vectors that are long enough. What is
left is verified by exact integer products, and each query's best rows are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridstride.llm.common import durable, partitions

#: Vectors of a bucket, queries of a block, queries verified at once, and the share of vectors that gives first thresholds.
BUCKET, QUERIES, AT_ONCE, SAMPLE = 16_384, 16_384, 256, 16
#: From this local cosine on, coordinates prune better than the length; and how many of them are tried.
COSINE, COORDINATES = 0.7, 3
#: Products below these are exact in 32-bit and 64-bit floats.
EXACT32, EXACT64 = 1 << 24, 1 << 52


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int = 64) -> DataFrame:
    """(id, v): floor(scale * x) of each component; vectors with null or non-finite components are left out."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(F.col(id_col).cast("long").alias("id"), whole.alias("v"))


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products, a row for each query; beyond 64 bits they stay at the largest or smallest long."""
    bound = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, rows.shape[1])
    if bound < EXACT32:
        return queries.astype(np.float32) @ rows.astype(np.float32).T
    if bound < EXACT64:
        return queries.astype(np.float64) @ rows.astype(np.float64).T
    exact = queries.astype(object) @ rows.astype(object).T if rows.shape[1] else np.zeros((len(queries), len(rows)), object)
    return np.array([[min(max(int(p), -(1 << 63)), (1 << 63) - 1) for p in line] for line in exact], np.int64).reshape(len(queries), len(rows))


def _lengths(rows: np.ndarray) -> np.ndarray:
    return np.sqrt((rows.astype(float) ** 2).sum(1))


class Best:
    """The k best vectors of each query so far, by product, then least id; a query's threshold is its k-th."""

    def __init__(self, queries: np.ndarray, thresholds: np.ndarray, k: int):
        self.queries, self.k, self.threshold = queries, k, thresholds.copy()
        self.lengths = _lengths(queries)
        self.held = [np.zeros(0, np.int64) for _ in range(4)]  # query, vector, product, least id

    def add(self, query: np.ndarray, vector: np.ndarray, product: np.ndarray, least_id: np.ndarray) -> None:
        query, vector, product, least_id = (np.concatenate(x) for x in zip(self.held, (query, vector, product, least_id), strict=True))
        order = np.lexsort((least_id, ~product, query))
        query = query[order]
        first = np.searchsorted(query, query)  # of each query's entries
        rank = np.arange(len(query)) - first
        use = rank < self.k
        self.held = [query[use], vector[order][use], product[order][use], least_id[order][use]]
        last = np.flatnonzero(rank == self.k - 1)
        self.threshold[query[last]] = np.maximum(self.threshold[query[last]], product[order][last])


class Bucket:
    """Vectors of about one length, longest first, with sorted coordinates made when first asked for."""

    def __init__(self, rows: np.ndarray, least_id: np.ndarray, first: int = 0):
        lengths = _lengths(rows)
        order = np.lexsort((least_id, -lengths))
        self.numbers, self.rows, self.lengths, self.least_id = first + order, rows[order], lengths[order], least_id[order]
        self.unit = self.rows / np.maximum(self.lengths, 1e-300)[:, None]
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.verified = 0

    def feasible(self, query: np.ndarray, length: float, cosine: float) -> np.ndarray:
        """Vectors whose values at the query's largest coordinates allow the cosine."""
        out = None
        reach = math.sqrt(max(0.0, 1 - cosine * cosine))
        for at in np.argsort(-np.abs(query))[:COORDINATES].tolist():
            if at not in self.lists:
                by = np.argsort(self.unit[:, at], kind="stable")
                self.lists[at] = by, self.unit[by, at]
            by, values = self.lists[at]
            x = float(query[at]) / length
            across = reach * math.sqrt(max(0.0, 1 - x * x)) + 1e-7
            low = cosine * x - across if cosine > -x else -1.0
            high = cosine * x + across if cosine > x else 1.0
            some = by[np.searchsorted(values, low - 1e-7) : np.searchsorted(values, high + 1e-7, side="right")]
            out = some if out is None else np.intersect1d(out, some, assume_unique=True)
        return out if out is not None else np.arange(len(self.rows))

    def search(self, best: Best) -> None:
        """Give each query's products that reach its threshold to ``best``."""
        longest = float(self.lengths[0])
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = np.where((best.threshold > 0) & np.isfinite(best.threshold), best.threshold / (best.lengths * longest), 0.0) * (1 - 1e-9)
        cosine = np.nan_to_num(cosine, nan=0.0, posinf=2.0)
        steep = np.flatnonzero((cosine >= COSINE) & (cosine <= 1))
        for q in steep.tolist():
            self._verify(best, np.array([q]), self.feasible(best.queries[q], float(best.lengths[q]), float(cosine[q])))
        flat = np.flatnonzero(cosine < COSINE)
        enough = np.searchsorted(-self.lengths, -longest * np.minimum(cosine[flat], 1.0), side="right")  # how many are long enough
        flat, enough = flat[order := np.argsort(-enough, kind="stable")], enough[order]
        for lo in range(0, len(flat), AT_ONCE):
            self._verify(best, flat[lo : lo + AT_ONCE], slice(0, int(enough[lo])))

    def _verify(self, best: Best, queries: np.ndarray, picked: np.ndarray | slice) -> None:
        scores = products(best.queries[queries], self.rows[picked])
        self.verified += scores.size
        many = scores.shape[1]
        floor = best.threshold[queries]
        if many > best.k:
            floor = np.maximum(floor, np.partition(scores, many - best.k, axis=1)[:, many - best.k])
        q, v = np.nonzero(scores >= floor[:, None])
        at = np.arange(len(self.rows))[picked][v]
        best.add(queries[q], self.numbers[at], scores[q, v].astype(np.int64), self.least_id[at])


def _search(asked: dict[int, tuple], batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Each asked query's best of the vectors (v, ids) in these batches. ``asked``: by width, the queries' keys, vectors and thresholds."""
    bests = {width: Best(rows, thresholds, k) for width, (_, _, rows, thresholds) in asked.items()}
    known: dict[int, list[list[int]]] = {width: [] for width in asked}
    same: dict[int, list[bytes]] = {width: [] for width in asked}
    waiting: dict[int, list[tuple[list[int], list[int]]]] = {width: [] for width in asked}

    def flush(width: int) -> None:
        part, waiting[width] = waiting[width], []
        rows = np.array([v for v, _ in part], np.int64).reshape(len(part), width)
        Bucket(rows, np.array([ids[0] for _, ids in part]), len(known[width])).search(bests[width])
        known[width] += [ids for _, ids in part]
        same[width] += [r.tobytes() for r in rows]

    for batch in batches:
        for v, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if len(v) in asked:
                waiting[len(v)].append((v, ids))
                if len(waiting[len(v)]) >= BUCKET:
                    flush(len(v))
    out: dict[str, list] = {c: [] for c in ("least", "hash", "id", "score", "own")}
    for width, (least, hashes, rows, _) in asked.items():
        if waiting[width]:
            flush(width)
        for q, v, score, _ in zip(*(x.tolist() for x in bests[width].held), strict=True):
            own = same[width][v] == rows[q].tobytes()
            for i in known[width][v]:
                for c, x in zip(out, (least[q], hashes[q], i, score, own), strict=True):
                    out[c].append(x)
    yield pa.RecordBatch.from_arrays([*[pa.array(out[c], pa.int64()) for c in ("least", "hash", "id", "score")], pa.array(out["own"], pa.bool_())], names=list(out))


FOUND = "least long, hash long, id long, score long, own boolean"


def _best_of(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("least", "hash").orderBy(F.desc("score"), "id", "own")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)


def top_products(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for every row whose id is divisible by ``every``.

    Vectors are compared with those of as many components. Null vectors, and
    those with null or non-finite components, take no part, nor do null ids.
    Equal scores rank by id. Repeated rows are rows of their own: each is a
    candidate, and a query if its id is one; only a query's own row is left out.
    Empty vectors score 0; an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = durable(quantised(vectors, id_col, vector_col))
    schema = "query_id long, rank int, vec_id long, score long"
    smallest = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    known = rows.withColumn("n", smallest).where(F.col("n") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    known = known.withColumn("length", length).withColumn("hash", F.xxhash64("v"))
    # ranges of length, longest first; many of one length are told apart by their hash
    known = durable(known.repartitionByRange(partitions(spark), F.desc("length"), "hash").sortWithinPartitions(F.desc("length")))
    if known.isEmpty():
        return spark.createDataFrame([], schema)
    wanted = rows.where(F.col("id") % every == 0)
    queries = durable(known.join(wanted.select("v").distinct(), "v", "left_semi").select("v", F.col("ids")[0].alias("least"), "hash"))
    blocks = -(-queries.count() // QUERIES)
    answers = None
    for block in range(blocks):
        asked: dict[int, list] = {}
        for r in queries.where(F.pmod(F.hash("hash"), F.lit(blocks)) == block).collect():  # about QUERIES rows
            asked.setdefault(len(r["v"]), []).append((r["least"], r["hash"], r["v"]))
        none = {w: np.full(len(q), -np.inf) for w, q in asked.items()}
        packed = {w: ([x[0] for x in q], [x[1] for x in q], np.array([x[2] for x in q], np.int64).reshape(len(q), w)) for w, q in asked.items()}

        def found(part: DataFrame, thresholds: dict[int, np.ndarray], packed: dict = packed) -> DataFrame:
            shared = spark.sparkContext.broadcast({w: (*x, thresholds[w]) for w, x in packed.items()})  # a block of queries
            return part.select("v", "ids").mapInArrow(lambda batches: _search(shared.value, batches, k + 1), FOUND)

        first = _best_of(found(known.where(F.pmod(F.hash("hash", F.lit(1)), F.lit(SAMPLE)) == 0), none), k + 1).where(F.col("n") == k + 1)
        floors = {(r["least"], r["hash"]): float(r["score"]) for r in first.select("least", "hash", "score").collect()}  # one a query of the block
        thresholds = {w: np.array([floors.get(key, -np.inf) for key in zip(least, hashes, strict=True)]) for w, (least, hashes, _) in packed.items()}
        part = durable(_best_of(found(known, thresholds), k + 1))
        answers = part if answers is None else answers.union(part)
    if answers is None:
        return spark.createDataFrame([], schema)
    best = answers.groupBy("least", "hash").agg(F.sort_array(F.collect_list(F.struct("n", "id", "score", "own"))).alias("best"))
    best = durable(queries.join(best, ["least", "hash"]).select("v", "best"))
    mine = F.array_position(F.transform("best", lambda b: b["own"] & (b["id"] == F.col("id"))), True)
    others = F.slice(F.filter("best", lambda b, i: i + 1 != F.col("mine")), 1, k)
    done = wanted.join(best, "v").withColumn("mine", mine).select(F.col("id").alias("query_id"), F.posexplode(others).alias("rank", "b"))
    return done.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").alias("vec_id"), F.col("b.score").alias("score"))
