"""Traversals of the edge table. Each is a loop over frontiers, so that a cycle costs nothing and a hop is one join."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..schema import CALLS, TESTED_BY, asserted


def arcs(edges: DataFrame, forward: bool) -> DataFrame:
    """a, b: steps from a to b. Forward follows asserted calls; backward follows every asserted edge against its direction."""
    if forward:
        return asserted(edges, CALLS).select(F.col("source").alias("a"), F.col("target").alias("b")).distinct()
    return asserted(edges).select(F.col("target").alias("a"), F.col("source").alias("b")).distinct()


def reach(steps: DataFrame, seeds: DataFrame, depth: int | None = None, keep_seed: bool = False) -> DataFrame:
    """seed, node, hop: what every seed reaches within depth steps (no limit: until nothing is new), and the least number of steps.

    All seeds walk in one loop. steps: a, b. seeds: seed. The seed itself is left out, even on a
    cycle, unless keep_seed.
    """
    frontier = cut(seeds.select("seed", F.col("seed").alias("node"), F.lit(0).alias("hop")).distinct())
    seen, hop = frontier, 0
    while depth is None or hop < depth:
        hop += 1
        stepped = frontier.join(steps, F.col("node") == F.col("a")).select("seed", F.col("b").alias("node")).distinct()
        frontier = cut(stepped.join(seen, ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if not frontier.take(1):
            break
        seen = seen.unionByName(frontier)
    return seen if keep_seed else seen.where("hop > 0")


def impact(edges: DataFrame, seeds: DataFrame, depth: int = 3, forward: bool = False) -> DataFrame:
    """seed, node, hop: what may break when a seed changes; forward: what it relies on."""
    return reach(arcs(edges, forward), seeds, depth)


def neighbours(edges: DataFrame, kind: str, of: str) -> DataFrame:
    """node, other: distinct asserted neighbours. of: 'source' gives each source its targets, 'target' each target its sources."""
    other = "target" if of == "source" else "source"
    return asserted(edges, kind).select(F.col(of).alias("node"), F.col(other).alias("other")).distinct()


def callers_of(edges: DataFrame) -> DataFrame:
    return neighbours(edges, CALLS, "target")


def callees_of(edges: DataFrame) -> DataFrame:
    return neighbours(edges, CALLS, "source")


def tests_for(edges: DataFrame) -> DataFrame:
    """node, other: the tests that cover a node."""
    return edges.where(F.col("kind") == TESTED_BY).select(F.col("source").alias("node"), F.col("target").alias("other")).distinct()


def without_dependents(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no asserted edge points to."""
    return nodes.join(asserted(edges).select(F.col("target").alias("qualified_name")).distinct(), "qualified_name", "left_anti")


def weighted_adjacency(edges: DataFrame) -> DataFrame:
    """a, b, weight: both directions of asserted calls between different nodes; each call site weighs one."""
    calls = asserted(edges, CALLS).where("source <> target")
    both = calls.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(calls.select(F.col("target").alias("a"), F.col("source").alias("b")))
    return both.groupBy("a", "b").agg(F.count("*").alias("weight"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest name that each node of asserted calls is connected with.

    Labels take the least of their neighbours' and then of their labels' labels, so paths shorten by halves.
    """
    pairs = cut(weighted_adjacency(edges).select("a", "b"))
    labels = cut(pairs.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    while True:
        near = pairs.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("low"))
        lower = labels.join(near, F.col("node") == F.col("a")).select("node", F.least("component", "low").alias("component"))
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("next"))
        new = cut(lower.join(jump, "component", "left").select("node", F.coalesce("next", "component").alias("component")))
        if not new.join(labels, ["node", "component"], "left_anti").take(1):
            return new
        labels = new


def shortest_path(edges: DataFrame, start: str, end: str) -> list[str]:
    """The names of a shortest chain of asserted calls; of several the smallest by name. Empty if there is none."""
    if start == end:
        return [start]
    spark, steps = edges.sparkSession, arcs(edges, True)
    layers = [cut(spark.createDataFrame([(start, None)], "node string, parent string"))]
    seen = layers[0].select("node")
    while True:
        stepped = layers[-1].select(F.col("node").alias("a")).join(steps, "a").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))
        layer = cut(stepped.join(seen, "node", "left_anti"))
        if not layer.take(1):
            return []
        layers.append(layer)
        if layer.where(F.col("node") == end).take(1):
            break
        seen = seen.unionByName(layer.select("node"))
    path = [end]
    for layer in reversed(layers[1:]):
        path.append(layer.where(F.col("node") == path[-1]).head()["parent"])
    return path[::-1]


def hub_order(edges: DataFrame, members: DataFrame) -> DataFrame:
    """module, node, place: nodes of each module in breadth-first order from its hub (most callers), the others by name after them."""
    inside = asserted(edges, CALLS).join(members.select(F.col("node").alias("source"), F.col("module").alias("module")), "source")
    inside = inside.join(members.select(F.col("node").alias("target"), F.col("module").alias("m2")), "target").where("module = m2")
    degree = inside.groupBy("module", F.col("target").alias("node")).agg(F.countDistinct("source").alias("callers"))
    ranked = members.join(degree, ["module", "node"], "left").withColumn("rank", F.row_number().over(Window.partitionBy("module").orderBy(F.desc_nulls_last("callers"), "node")))
    hubs = ranked.where("rank = 1").select(F.col("node").alias("seed"), "module")
    both = inside.select(F.col("source").alias("a"), F.col("target").alias("b")).unionByName(inside.select(F.col("target").alias("a"), F.col("source").alias("b"))).distinct()
    hops = reach(cut(both), hubs.select("seed"), keep_seed=True).join(hubs, "seed").select("module", "node", "hop")
    placed = ranked.join(hops, ["module", "node"], "left")
    return placed.select("module", "node", F.row_number().over(Window.partitionBy("module").orderBy(F.asc_nulls_last("hop"), "rank")).alias("place"))


def module_chords(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """a, b, weight: asserted calls between different top directories, either way."""
    from ..functions.names import module_of

    place = nodes.select("qualified_name", module_of(F.col("file")).alias("module"))
    calls = asserted(edges, CALLS).join(place.select(F.col("qualified_name").alias("source"), F.col("module").alias("m1")), "source").join(place.select(F.col("qualified_name").alias("target"), F.col("module").alias("m2")), "target")
    return calls.where("m1 <> m2").groupBy(F.least("m1", "m2").alias("a"), F.greatest("m1", "m2").alias("b")).agg(F.count("*").alias("weight"))
