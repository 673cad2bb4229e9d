"""Helpers shared by the operators: reading tables, cutting lineage, checking columns."""

from __future__ import annotations

import ctypes
import re
import tempfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data directory; the path may be in any store that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts: the session's own, else the configured one; on one machine a temporary one.

    A cluster without spark.checkpoint.dir is an error, as a folder of the driver's machine is no use to executors.
    """
    context = spark.sparkContext
    found = context._jsc.sc().getCheckpointDir()
    if found.isDefined():
        return found.get()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="codelattice-"))
    return context._jsc.sc().getCheckpointDir().get()


def drop_folder(spark: SparkSession, path: str) -> None:
    """Deletes a folder that an operator wrote, in whatever store it lies."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def fresh(columns: Iterable[str], *names: str) -> list[str]:
    """The names, each with as many underscores before it as it takes to differ from the columns, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared checkpoint folder, so that a lost executor costs no recomputation."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def released(df: DataFrame) -> DataFrame:
    """df, which cut() made; the shuffle files that only its making needed go now, not when the driver happens to collect its garbage."""
    df.sparkSession._jvm.System.gc()
    return df


def wide(spark: SparkSession, least: int = 1) -> int:
    """Shuffle partitions that the session asks for."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs run inside send at most so many rows to Python at once: texts are long, and a batch is held several times over."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def give_back() -> None:
    """Free memory of this Python worker goes back to the system: workers stay between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)
