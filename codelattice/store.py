"""A code graph on disk: Parquet snapshots of its tables, and a pointer to the current one.

A write makes a new snapshot folder and moves the pointer last, so readers see all of an update or
none. Replacing and evicting files are one anti-join and one union over each table.
"""

from __future__ import annotations


import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema

POINTER = "CURRENT"
BY_FILE = ("files", "nodes", "imports", "raw_calls")
KEY = {"files": "path"}


def delta(now: DataFrame, before: DataFrame) -> DataFrame:
    """path, state (added, changed, removed) of the paths whose hash differs between two (path, hash) tables."""
    b = before.select(F.col("path"), F.col("hash").alias("old"))
    both = now.select("path", F.col("hash").alias("new")).join(b, "path", "full").where(~F.col("new").eqNullSafe(F.col("old")))
    return both.select("path", F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed").alias("state"))


class Store:
    """Snapshots under a root folder in any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def current(self) -> str | None:
        """The current snapshot's folder."""
        fs, path = self._fs()
        at = path(f"{self.root}/{POINTER}")
        if not fs.exists(at):
            return None
        stream = fs.open(at)
        try:
            return f"{self.root}/{bytes(stream.readAllBytes()).decode()}"
        finally:
            stream.close()

    def _point(self, name: str) -> None:
        fs, path = self._fs()
        new = path(f"{self.root}/{POINTER}.{uuid.uuid4().hex}")
        out = fs.create(new, True)
        out.write(bytearray(name.encode()))
        out.close()
        at = path(f"{self.root}/{POINTER}")
        context = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.OVERWRITE
        context.rename(new, at, options)

    def table(self, name: str) -> DataFrame:
        """A table of the current snapshot; columns that its version lacks are null, a table that it lacks is empty."""
        folder = self.current()
        if folder is not None:
            fs, path = self._fs()
            if fs.exists(path(f"{folder}/{name}")):
                return schema.conform(self.spark.read.parquet(f"{folder}/{name}"), schema.TABLES[name])
        return self.spark.createDataFrame([], schema.TABLES[name])

    def meta(self) -> dict[str, str]:
        folder = self.current()
        if folder is None:
            return {}
        return {r["key"]: r["value"] for r in self.spark.read.schema("key string, value string").json(f"{folder}/metadata").collect()}

    def write(self, tables: dict[str, DataFrame], meta: dict[str, str]) -> None:
        """A new snapshot: these tables, the others as they are; then the pointer moves to it."""
        name = f"snapshot-{uuid.uuid4().hex}"
        folder = f"{self.root}/{name}"
        for t, s in schema.TABLES.items():
            df = tables[t] if t in tables else self.table(t)
            schema.conform(df, s).write.parquet(f"{folder}/{t}")
        rows = sorted(({"schema_version": str(schema.VERSION)} | self.meta() | meta).items())
        self.spark.createDataFrame(rows, "key string, value string").coalesce(1).write.json(f"{folder}/metadata")
        self._point(name)

    def clear(self) -> None:
        self.write({t: self.spark.createDataFrame([], s) for t, s in schema.TABLES.items()}, {})

    def replaced(self, parsed: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
        """The tables of files after new rows came for some files and others went. gone: path of all files whose old rows go."""
        out = {}
        for t in BY_FILE:
            key = KEY.get(t, "file")
            kept = self.table(t).join(gone.select(F.col("path").alias(key)).distinct(), key, "left_anti")
            out[t] = kept.unionByName(schema.conform(parsed[t], schema.TABLES[t])) if t in parsed else kept
        return out

    def counts(self) -> dict[str, int]:
        return {t: self.table(t).count() for t in ("files", "nodes", "edges")}

    def prune(self, keep: int = 2) -> list[str]:
        """Deletes all but the newest `keep` snapshots, never the current one; returns what went."""
        fs, path = self._fs()
        now = self.current()
        found = sorted(((s.getModificationTime(), s.getPath().getName()) for s in fs.listStatus(path(self.root)) if s.getPath().getName().startswith("snapshot-")), reverse=True)
        old = [n for _, n in found[keep:] if f"{self.root}/{n}" != now]
        for n in old:
            fs.delete(path(f"{self.root}/{n}"), True)
        return old


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """One row for each qualified name: the last by line."""
    best = nodes.groupBy("qualified_name").agg(F.max_by(F.struct(*[c for c in nodes.columns if c != "qualified_name"]), F.struct("line_start", "line_end")).alias("n"))
    return best.select("qualified_name", "n.*").select(*nodes.columns)


