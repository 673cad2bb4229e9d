"""Communities, flows, and the overview made of them."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import round2
from ..lineage import cut, numbered
from ..schema import CALLS, asserted
from .graph import arcs, components, reach, weighted_adjacency

SWEEPS = 10
#: Places in which the entries of a component meet its core.
SALTS = 32


def propagate(edges: Sequence[tuple[str, str, int]], sweeps: int = SWEEPS) -> dict[str, str]:
    """Labels of one component's nodes: visited in order of name, each takes at once the label that weighs most around it, the smallest of several."""
    around: dict[str, dict[str, int]] = {}
    for a, b, weight in edges:
        around.setdefault(a, {})[b] = weight
    label = {n: n for n in around}
    for _ in range(sweeps):
        moved = 0
        for n in sorted(around):
            votes: Counter[str] = Counter()
            for m, weight in around[n].items():
                votes[label[m]] += weight
            most = max(votes.values())
            best = min(v for v, w in votes.items() if w == most)
            moved += best != label[n]
            label[n] = best
        if not moved:
            break
    return label


def communities(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(communities, members): groups of two or more by label propagation, numbered by size (largest first), then smallest member.

    Sweeps of a component don't touch others, so each component is one group of rows. A component is
    a task's work: its edges, once for each pair of nodes, must fit in its memory.
    """
    parts = components(edges)
    pairs = weighted_adjacency(edges).join(parts.select(F.col("node").alias("a"), "component"), "a")

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        got = propagate(list(zip(pdf["a"], pdf["b"], pdf["weight"])))
        return pd.DataFrame({"node": list(got), "label": list(got.values())}, dtype="str")

    labels = pairs.groupBy("component").applyInPandas(label, "node string, label string")
    sized = cut(labels).withColumn("file", F.substring_index("node", "::", 1))
    groups = sized.groupBy("label").agg(F.count("*").alias("size"), F.min("node").alias("least")).where("size > 1")
    placed = numbered(groups, F.desc("size"), "least")
    members = sized.join(placed.select("label", "id"), "label")
    named = placed.join(community_names(members), "id")
    repeated = F.count("*").over(Window.partitionBy("base")) > 1
    out = named.select("id", "size", F.when(repeated, F.concat("base", F.lit(" #"), F.col("id").cast("string"))).otherwise(F.col("base")).alias("label"))
    return out, members.select("node", F.col("id").alias("community_id"))


def community_names(members: DataFrame) -> DataFrame:
    """id, base: the only file of a group's members, else the directories that all share, else the commonest directory, else the repository's root.

    members: id, file. The shared start of a group's paths is that of its least and greatest path, as any start that those share lies in all between.
    """
    folder = F.when(F.instr("file", "/") > 0, F.regexp_replace("file", "/[^/]*$", "")).otherwise("")
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    rows = members.select("id", "file", folder.alias("folder"), parts.alias("parts"))
    ends = rows.groupBy("id").agg(F.min("file").alias("f1"), F.max("file").alias("f2"), F.min("parts").alias("p1"), F.max("parts").alias("p2"))
    common = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.size("p1"), F.size("p2")), F.lit(1))), F.struct(F.lit(True).alias("on"), F.array().cast("array<string>").alias("got")),
        lambda s, i: F.when(s["on"] & (F.try_element_at("p1", i) == F.try_element_at("p2", i)), F.struct(F.lit(True).alias("on"), F.concat(s["got"], F.array(F.try_element_at("p1", i))).alias("got"))).otherwise(F.struct(F.lit(False).alias("on"), s["got"].alias("got"))),
        lambda s: s["got"],
    )
    counts = rows.groupBy("id", "folder").agg(F.count("*").alias("n"))
    usual = counts.groupBy("id").agg(F.max(F.struct("n")).alias("most")).join(counts, "id").where(F.col("n") == F.col("most.n")).groupBy("id").agg(F.min("folder").alias("usual"))
    shared = ends.withColumn("common", common).join(usual, "id")
    return shared.select("id", F.when(F.col("f1") == F.col("f2"), F.col("f1")).when(F.size("common") > 0, F.array_join("common", "/")).when(F.col("usual") != "", F.col("usual")).otherwise("(repository root)").alias("base"))


def flow_entries(edges: DataFrame) -> DataFrame:
    """seed: nodes that call and aren't called, not even by themselves."""
    calls = asserted(edges, CALLS)
    return calls.select(F.col("source").alias("seed")).distinct().join(calls.select(F.col("target").alias("seed")).distinct(), "seed", "left_anti")


@dataclass(frozen=True)
class Flows:
    """Flows without a row for each member: in a component of calls, every entry that reaches its centre reaches all that the centre does.

    table: id, entry, size, criticality, component, through (whether it passes the centre). walks: entry, node, for what lies
    outside that core. core: component, node.
    """

    table: DataFrame
    walks: DataFrame
    core: DataFrame

    def members(self) -> DataFrame:
        """flow_id, node: one row for each; a component's core meets its entries in SALTS places."""
        own = self.walks.join(self.table.select(F.col("id").alias("flow_id"), "entry"), "entry").select("flow_id", "node")
        through = self.table.where("through").select(F.col("id").alias("flow_id"), "component", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        core = self.core.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
        return own.unionByName(core.join(through, ["component", "salt"]).select("flow_id", "node"))

    def criticality(self) -> DataFrame:
        """node, criticality: the largest of the flows that a node is in; a core's nodes share one."""
        own = self.walks.join(self.table.select("entry", "criticality"), "entry").select("node", "criticality")
        most = self.table.where("through").groupBy("component").agg(F.max("criticality").alias("criticality"))
        return own.unionByName(self.core.join(most, "component").select("node", "criticality")).groupBy("node").agg(F.max("criticality").alias("criticality"))


def flow_parts(edges: DataFrame) -> Flows:
    """From each entry all that it reaches; numbered by entry; criticality is the size by that of the largest flow.

    A component's centre is its node with the most neighbours, which most entries reach. What it reaches is the component's
    core. An entry that reaches the centre is followed only up to the core, the others stay outside all that leads to it.
    """
    steps = cut(arcs(edges, True).where("a <> b"))
    parts = components(edges)
    degree = steps.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n"))
    centres = cut(parts.join(degree, "node").groupBy("component").agg(F.max_by("node", F.struct("n", "node")).alias("seed")))
    of = centres.withColumnRenamed("component", "c")
    core = cut(reach(steps, centres.select("seed"), keep_seed=True).join(of, "seed").select(F.col("c").alias("component"), "node"))
    leading = cut(reach(steps.select(F.col("b").alias("a"), F.col("a").alias("b")), centres.select("seed"), keep_seed=True).select("node"))
    entries = cut(flow_entries(edges).join(parts.withColumnRenamed("node", "seed"), "seed").join(leading.select(F.col("node").alias("seed"), F.lit(True).alias("through")), "seed", "left").withColumn("through", F.coalesce("through", F.lit(False))))
    outer = cut(steps.join(core.select(F.col("node").alias("b")), "b", "left_anti").unionByName(steps.join(leading.select(F.col("node").alias("a")), "a", "left_anti")).distinct())
    starts = entries.join(core.select(F.col("node").alias("seed")), "seed", "left_anti").select("seed")
    walks = cut(reach(outer, starts, keep_seed=True).join(entries.select("seed", "through"), "seed").join(core.select("node", F.lit(True).alias("inside")), "node", "left").where("inside is null or not through").select(F.col("seed").alias("entry"), "node"))
    size = walks.groupBy(F.col("entry").alias("seed")).agg(F.count("*").alias("own"))
    whole = core.groupBy("component").agg(F.count("*").alias("all"))
    sizes = entries.join(size, "seed", "left").join(whole, "component", "left").select(F.col("seed").alias("entry"), "component", "through", (F.coalesce("own", F.lit(0)) + F.when(F.col("through"), F.col("all")).otherwise(0)).alias("size")).where("size > 1")
    table = numbered(sizes, "entry")
    largest = table.agg(F.max("size")).head()[0] or 1
    return Flows(table.select("id", "entry", "size", round2(F.col("size") / F.lit(largest)).alias("criticality"), "component", "through"), walks, core)


def flows(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(flows, memberships) of flow_parts(), with a row for each member."""
    got = flow_parts(edges)
    return got.table.select("id", "entry", "size", "criticality"), got.members()


def flow_criticality(flow_table: DataFrame, memberships: DataFrame) -> DataFrame:
    """node, criticality: the largest of the flows that a node is in."""
    return memberships.join(flow_table.select(F.col("id").alias("flow_id"), "criticality"), "flow_id").groupBy("node").agg(F.max("criticality").alias("criticality"))


def touched(edges: DataFrame, members: DataFrame) -> DataFrame:
    """node, own, crossing: both ends of every asserted call, its end's community, and whether it leaves a community."""
    calls = asserted(edges, CALLS).select("source", "target")
    with_ids = calls.join(members.select(F.col("node").alias("source"), F.col("community_id").alias("cs")), "source", "left").join(members.select(F.col("node").alias("target"), F.col("community_id").alias("ct")), "target", "left")
    crossing = F.coalesce(F.col("cs") != F.col("ct"), F.lit(False)).cast("int")
    ends = F.explode(F.array(F.struct(F.col("source").alias("node"), F.col("cs").alias("own")), F.struct(F.col("target").alias("node"), F.col("ct").alias("own"))))
    return with_ids.select(ends.alias("end"), crossing.alias("crossing")).select("end.node", "end.own", "crossing")


def coupling(edges: DataFrame, members: DataFrame) -> DataFrame:
    """node, coupling: the share of a node's asserted calls that leave its community, with two decimals."""
    return touched(edges, members).groupBy("node").agg(round2(F.sum("crossing") / F.count("*")).alias("coupling"))


def architecture(community_table: DataFrame, members: DataFrame, edges: DataFrame, top: int = 3) -> DataFrame:
    """id, size, label, external_coupling, top_members (by callers, then name) of each community."""
    from .risk import fan_in

    outside = touched(edges, members).where("crossing = 1").groupBy(F.col("own").alias("id")).agg(F.count("*").alias("external_coupling"))
    ranked = members.join(fan_in(edges), "node", "left").withColumn("place", F.row_number().over(Window.partitionBy("community_id").orderBy(F.desc(F.coalesce("fan_in", F.lit(0))), "node")))
    heads = ranked.where(F.col("place") <= top).groupBy(F.col("community_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("place", "node"))).alias("h"))
    out = community_table.join(outside, "id", "left").join(heads, "id")
    return out.select("id", "size", "label", F.coalesce("external_coupling", F.lit(0)).cast("long").alias("external_coupling"), F.transform("h", lambda x: x["node"]).alias("top_members"))
