"""Helpers that the corpus operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys that count as hot are at most so many: those that hold at least one row in so many.
HOT_KEYS = 2000
#: Rows of a few numbers that are broadcast at most; beyond, they are shuffled.
BROADCAST_ROWS = 500_000
#: Rows of a few numbers that one task groups or joins at most; beyond, they are shuffled.
TASK_ROWS = 1 << 17
#: Rows of a few numbers in a file of an intermediate table, about.
FILE_ROWS = 500_000

#: Tables that :func:`scratch` deletes, innermost block last.
_OPEN: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``.

    Where it is unset, a session on a single machine, as in tests, gets a local folder; a cluster is refused.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="sonority-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has; deleted with the innermost :func:`scratch` block."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(path)
    return path


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives a lost executor.

    :param rows: about how many rows of a few numbers there are, if that is known: a small table then has few files.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))
    out.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders or files through Hadoop's file systems."""
    conf, jvm = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


def forget(df: DataFrame) -> None:
    """Delete the table that :func:`written` gave, when nothing reads it any more."""
    spark = df.sparkSession
    remove(spark, *{f.rsplit("/", 1)[0] for f in df.inputFiles()})


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end of the block, all tables that were written in it; what is read afterwards must be written outside."""
    _OPEN.append([])
    try:
        yield
    finally:
        remove(spark, *_OPEN.pop())


def finished(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, written; all tables that it wrote on the way are deleted."""
    path = new_path(spark, name)
    with scratch(spark):
        found = make()
        found.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(found.schema).parquet(path)


def met(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """Join many ``rows`` to their one row of ``groups`` by ``key``, whatever one key's share of the rows is.

    Groups with at least ``total / HOT_KEYS`` rows, of which there are ``HOT_KEYS`` at most, are broadcast, so their rows stay
    where they are; the rows of other keys are shuffled.

    :param size: the column of ``groups`` with the number of the key's rows; ``total``: the number of all rows.
    """
    least = max(2, total // HOT_KEYS)
    hot = groups.where(F.col(size) >= least)
    some = rows.join(F.broadcast(hot), key)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.where(F.coalesce(size, F.lit(0)) < least), key, how)
    return some.unionByName(rest)


def few(keys: DataFrame) -> DataFrame:
    """Marked for a broadcast if there are ``BROADCAST_ROWS`` at most; as it is, to be shuffled, if there are more."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def small(rows: DataFrame) -> bool:
    """Whether a written table of a few numbers has ``TASK_ROWS`` rows at most."""
    return rows.count() <= TASK_ROWS


def together(rows: DataFrame) -> DataFrame:
    """A written table of a few numbers as one partition if it is small, so that nothing is shuffled to group it; else as it is."""
    return rows.coalesce(1) if small(rows) else rows


def portions(batch: pa.RecordBatch, column: str, size: int) -> Iterator[pa.RecordBatch]:
    """Runs of a batch's rows whose ``column`` has about ``size`` bytes; a longer text is a run of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name).cast("string"), F.lit(""))
