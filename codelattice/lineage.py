"""Cutting the lineage of iterative plans through the shared checkpoint folder."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """df computed once and written where every executor can read it again; a lost executor costs no recomputation.

    The session's checkpoint folder is used; where none is set, one machine takes a temporary one and a cluster raises.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="codelattice-"))
    return df.checkpoint(eager=True)


def released(df: DataFrame) -> DataFrame:
    """df, which cut() made; the shuffle files that only its making needed go now, not when the driver happens to collect its garbage."""
    df.sparkSession._jvm.System.gc()
    return df


def numbered(df: DataFrame, *order: Column | str) -> DataFrame:
    """df, in that order, with id: its place from 0 on. The order must be total.

    Rows are dealt by range and sorted there; only a count for each partition goes through the driver, so no task orders all rows.
    """
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(dealt.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}))
    before, at = {}, 0
    for r in placed.groupBy("_part").count().orderBy("_part").collect():
        before[r["_part"]] = at
        at += r["count"]
    start = F.element_at(F.create_map(*[F.lit(x).cast("long") for pair in before.items() for x in pair]), F.col("_part").cast("long")) if before else F.lit(0).cast("long")
    return placed.withColumn("id", start + F.col("_row")).drop("_part", "_row")
