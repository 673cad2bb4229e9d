"""Keeping stores fresh: a trigger every second, one update of each root in it, and news only when there are some."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..build import Stats, update
from ..store import Store

INTERVAL_MS = 1000


@dataclass(frozen=True)
class Root:
    path: str
    store: str


@dataclass
class Watcher:
    """Updates roots in turn. A root that fails is reported once, tried again each time, and said to be well when it is."""

    spark: SparkSession
    roots: Sequence[Root]
    say: Callable[[str], None] = print
    run: Callable[[Store, str], Stats] = update
    failing: dict[str, str] = field(default_factory=dict)

    def tick(self) -> dict[str, Stats | Exception]:
        out: dict[str, Stats | Exception] = {}
        for root in self.roots:
            try:
                out[root.path] = self.run(Store(self.spark, root.store), root.path)
            except Exception as e:  # the others go on
                out[root.path] = e
            self._report(root.path, out[root.path])
        return out

    def _report(self, path: str, got: Stats | Exception) -> None:
        if isinstance(got, Exception):
            if self.failing.get(path) != str(got):
                self.failing[path] = str(got)
                self.say(f"warn: {path}: {got}")
            return
        if path in self.failing:
            self.say(f"{path}: recovered ({self.failing.pop(path)})")
        if got.reparsed or got.evicted:
            self.say(f"{path}: {got.reparsed} file(s) parsed, {got.evicted} gone: {got.nodes} nodes, {got.edges} edges")

    def start(self, checkpoint: str, interval_ms: int = INTERVAL_MS) -> StreamingQuery:
        """A streaming query whose batches update the roots; stop() ends it. Batches never overlap."""
        if not self.roots:
            raise ValueError("nothing to watch")
        for root in self.roots:
            self.say(f"watching {root.path} -> {root.store}")
        ticks = self.spark.readStream.format("rate").option("rowsPerSecond", 1).load()

        def batch(_: DataFrame, __: int) -> None:
            self.tick()

        return ticks.writeStream.foreachBatch(batch).trigger(processingTime=f"{interval_ms} milliseconds").option("checkpointLocation", checkpoint).start()
