"""Connected components of a graph that is spread over the cluster, by alternating star contraction.

Large-star and small-star rounds (Kiveris et al., 2014) end when the edges are a star around each
component's smallest node. The edges only shrink, minima are pre-aggregated before each shuffle, and
every round is cut to the shared checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


#: Edges that one task joins by itself (16 bytes each); more are contracted over the cluster, with the same result.
LOCAL_EDGES = 100_000


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union by the smallest node, for at most LOCAL_EDGES edges."""
    root: dict[int, int] = {}

    def find(a: int) -> int:
        while root.setdefault(a, a) != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    joined = sorted((n, find(n)) for n in list(root))
    nodes, ends = [n for n, c in joined if n != c], [c for n, c in joined if n != c]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(ends, pa.int64())], ["node", "component"])


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).head())


def connected(edges: DataFrame, rounds: int = 60, local: int = LOCAL_EDGES) -> DataFrame:
    """node, component (smallest node) for every node of edges (a, b) but the components' smallest nodes.

    Loops, repeated edges and rows with a null end are allowed and change nothing.
    """
    raw = cut(edges.where("a <> b").select("a", "b"))
    if raw.count() <= local:
        return cut(raw.coalesce(1).mapInArrow(_local, "node long, component long"))
    now = cut(raw.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(now.select(F.col("v").alias("n"), F.col("u").alias("m")))
        # written before the joins, so that these have a shuffle on both sides and Spark splits a star's centre
        low = cut(both.groupBy("n").agg(F.min("m").alias("low")).select("n", F.least("n", "low").alias("low")))
        large = both.where("m > n").join(low, "n").select(F.col("m").alias("u"), F.col("low").alias("v")).distinct()
        least = cut(large.groupBy("u").agg(F.min("v").alias("low")))
        small = large.join(least, "u").where("v > low").select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(least.select("u", F.col("low").alias("v")))
        now = cut(small.distinct())
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
