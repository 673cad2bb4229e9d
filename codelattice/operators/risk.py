"""Risk of changing a symbol: callers, missing tests and doubt, and in the second version flows, coupling and security."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_security, round2
from ..schema import AMBIGUOUS, ANCHOR, CALLS, FILE, SELECTOR, TESTED_BY, asserted

# The callers that count as most, the score from which a change is risky, and the weights.
FULL_FAN_IN, HIGH_RISK = 10, 0.70
WEIGHTS = {"fan_in": 0.5, "test_gap": 0.3, "ambiguous": 0.2}
WEIGHTS_2 = {"fan_in": 0.35, "test_gap": 0.20, "ambiguous": 0.10, "flow": 0.15, "coupling": 0.10, "security": 0.10}
UNTESTABLE = (SELECTOR, ANCHOR, FILE)


def fan_in(edges: DataFrame) -> DataFrame:
    """node, fan_in: distinct callers, tests included."""
    return asserted(edges, CALLS).groupBy(F.col("target").alias("node")).agg(F.countDistinct("source").alias("fan_in"))


def tested(edges: DataFrame) -> DataFrame:
    """node: what some test covers."""
    return edges.where(F.col("kind") == TESTED_BY).select(F.col("source").alias("node")).distinct()


def ambiguous_touch(edges: DataFrame) -> DataFrame:
    """node, ambiguous, total: calls at either end, row by row; a call of oneself counts twice."""
    ends = edges.where(F.col("kind") == CALLS).select(F.explode(F.array("source", "target")).alias("node"), (F.col("tier") == AMBIGUOUS).cast("long").alias("doubt"))
    return ends.groupBy("node").agg(F.sum("doubt").alias("ambiguous"), F.count("*").alias("total"))


def touched(ends: DataFrame, edges: DataFrame) -> DataFrame:
    """ambiguous_touch() from ambiguous calls that are counted already (node, ambiguous) and asserted edges."""
    calls = asserted(edges, CALLS).select(F.explode(F.array("source", "target")).alias("node"), F.lit(0).cast("long").alias("ambiguous"), F.lit(1).cast("long").alias("total"))
    both = calls.unionByName(ends.select("node", "ambiguous", F.col("ambiguous").alias("total")))
    return both.groupBy("node").agg(F.sum("ambiguous").alias("ambiguous"), F.sum("total").alias("total"))


def scored(nodes: DataFrame, edges: DataFrame, touch: DataFrame | None = None) -> DataFrame:
    """nodes with fan_in, has_tests, fan_in_norm, test_gap, ambiguous_density and score (first version, not rounded). touch: ambiguous_touch(), if edges lack ambiguous ones."""
    joined = nodes.join(fan_in(edges).withColumnRenamed("node", "qualified_name"), "qualified_name", "left")
    joined = joined.join(tested(edges).select(F.col("node").alias("qualified_name"), F.lit(True).alias("has_tests")), "qualified_name", "left")
    touch = ambiguous_touch(edges) if touch is None else touch
    joined = joined.join(touch.withColumnRenamed("node", "qualified_name"), "qualified_name", "left")
    joined = joined.withColumns({"fan_in": F.coalesce("fan_in", F.lit(0)).cast("long"), "has_tests": F.coalesce("has_tests", F.lit(False))})
    excused = F.col("is_test") | F.col("has_tests") | F.col("kind").isin(*UNTESTABLE)
    joined = joined.withColumns({
        "fan_in_norm": F.least("fan_in", F.lit(FULL_FAN_IN)) / FULL_FAN_IN,
        "test_gap": F.when(excused, 0.0).otherwise(1.0),
        "ambiguous_density": F.coalesce(F.try_divide("ambiguous", "total"), F.lit(0.0)),
    }).drop("ambiguous", "total")
    return joined.withColumn("score", WEIGHTS["fan_in"] * F.col("fan_in_norm") + WEIGHTS["test_gap"] * F.col("test_gap") + WEIGHTS["ambiguous"] * F.col("ambiguous_density"))


def scored_2(nodes: DataFrame, edges: DataFrame, criticality: DataFrame, coupling: DataFrame, touch: DataFrame | None = None) -> DataFrame:
    """qualified_name, v1, v2, flow_criticality, community_coupling, security. criticality and coupling: by node."""
    base = scored(nodes, edges, touch).join(criticality.withColumnRenamed("node", "qualified_name"), "qualified_name", "left").join(coupling.withColumnRenamed("node", "qualified_name"), "qualified_name", "left")
    base = base.withColumns({"criticality": F.coalesce("criticality", F.lit(0.0)), "coupling": F.coalesce("coupling", F.lit(0.0)), "security": is_security(F.col("name"), F.col("signature"))})
    w = WEIGHTS_2
    v2 = w["fan_in"] * F.col("fan_in_norm") + w["test_gap"] * F.col("test_gap") + w["ambiguous"] * F.col("ambiguous_density") + w["flow"] * F.col("criticality") + w["coupling"] * F.col("coupling") + w["security"] * F.col("security")
    return base.select("qualified_name", round2(F.col("score")).alias("v1"), round2(v2).alias("v2"), round2(F.col("criticality")).alias("flow_criticality"), round2(F.col("coupling")).alias("community_coupling"), "security")


def top(scores: DataFrame, n: int) -> DataFrame:
    """The n rows with the highest unrounded score, ties by name."""
    return scores.orderBy(F.desc("score"), "qualified_name").limit(n)


def changed(nodes: DataFrame, edges: DataFrame, files: DataFrame, touch: DataFrame | None = None) -> DataFrame:
    """nodes with their scores and `high`, of the symbols in the changed files (file)."""
    return scored(nodes, edges, touch).join(files.select("file").distinct(), "file", "left_semi").withColumn("high", F.col("score") >= HIGH_RISK)


def change_summary(hit: DataFrame, files: int, limit: int) -> DataFrame:
    """files, symbols, high_risk, shown: one row about changed()."""
    return hit.agg(F.lit(files).cast("long").alias("files"), F.count("*").alias("symbols"), F.count_if("high").alias("high_risk"), F.least(F.count("*"), F.lit(limit)).alias("shown"))


def with_impact(hit: DataFrame, edges: DataFrame, depth: int = 3) -> DataFrame:
    """qualified_name, file, line_start, risk, score, fan_in, has_tests, impact, high of rows of changed(): those that are to be shown, as each walks."""
    from ..lineage import cut
    from .graph import impact

    hit = cut(hit)
    blast = impact(edges, hit.select(F.col("qualified_name").alias("seed")), depth).groupBy(F.col("seed").alias("qualified_name")).agg(F.count("*").alias("impact"))
    out = hit.join(blast, "qualified_name", "left")
    return out.select("qualified_name", "file", "line_start", round2(F.col("score")).alias("risk"), "score", "fan_in", "has_tests", F.coalesce("impact", F.lit(0)).cast("long").alias("impact"), "high")
