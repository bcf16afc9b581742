"""Helpers that several corpus operators share."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table are addressed by these folds: remainder 0 is held out.
FOLDS = 5
#: Bytes of texts that a task handles together.
SLICE = 1 << 21


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone (any Hadoop path works)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id) -> F.Column:
    """True where crc32 of the id's decimal text leaves remainder 0."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the folder that the cluster shares.

    The folder is the session's ``spark.checkpoint.dir``. Only where that is unset
    and all tasks run in this process (notebooks, tests) a temporary one is made.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        place = context.getConf().get("spark.checkpoint.dir")
        if place is None and not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("spark.checkpoint.dir is unset: set it to a folder that all executors share")
        context.setCheckpointDir(place or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint(eager=True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def spread(salt: str, *columns: str) -> F.Column:
    """A number from 0 to 1 made from the row, the same in every run."""
    return F.pmod(F.xxhash64(F.lit(salt), *columns), F.lit(1 << 40)) / float(1 << 40)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: int, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in their order, so many together that their texts are about ``size`` bytes."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy().astype(np.int64)
    cuts = [0, *(1 + np.flatnonzero(np.diff(np.cumsum(lengths) // size))).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        if hi > lo:
            yield batch.slice(lo, hi - lo)


def release() -> None:
    """Give memory that is free, but held for later use, back to the system."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of glibc alone
        trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function for mapInArrow after which its worker holds no free memory: Spark keeps workers for later tasks, more than run at a time."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return whole


def released_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for applyInArrow."""

    def whole(group: pa.Table) -> pa.Table:
        out = run(group)
        release()
        return out

    return whole
