"""What a reviewer asks for: bounded contexts of symbols and changes, as plain values ready for JSON or markdown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .functions.names import round2
from .lineage import cut
from .operators import graph, risk, structure
from .store import Store

# How many neighbours a context lists, how many risks an overview, and what to ask next.
CAPS = {"minimal": 5, "standard": 25}
TOP_RISKS, CHANGE_LIMIT, DEPTH = 5, 20, 3
HINTS = (
    "search(query): find symbols by words; start here to get an exact symbol",
    "detect_changes(base): risk of a diff",
    "get_review_context(symbol): bounded context of one symbol",
    "query_graph(pattern, symbol): callers_of, callees_of, tests_for, impact_of",
)
MARK = "<!-- codelattice-review -->"


def capped(pairs: DataFrame, cap: int) -> DataFrame:
    """node, total, others: of (node, other) the first `cap` others by name, and how many there are."""
    own = Window.partitionBy("node")
    ranked = pairs.withColumn("place", F.row_number().over(own.orderBy("other"))).withColumn("total", F.count("*").over(own))
    return ranked.where(F.col("place") <= cap).groupBy("node", "total").agg(F.array_sort(F.collect_list("other")).alias("others"))


def meanings(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """symbol, qualified_name, found: what each asked symbol may mean: the node of that very name, else those with that bare name.

    found is Exact for one, Ambiguous for several, None (and a null name) for none. A join by name each: no scan for each symbol.
    """
    asked, known = symbols.select("symbol").distinct(), nodes.select("qualified_name", "name").distinct()
    exact = asked.join(known.select(F.col("qualified_name").alias("symbol")).distinct(), "symbol").withColumn("qualified_name", F.col("symbol"))
    bare = asked.join(exact, "symbol", "left_anti").join(known.select(F.col("name").alias("symbol"), "qualified_name"), "symbol", "left")
    n = F.count("qualified_name").over(Window.partitionBy("symbol"))
    return exact.unionByName(bare).withColumn("found", F.when(n == 0, "None").when(n == 1, "Exact").otherwise("Ambiguous"))


def symbols_named(nodes: DataFrame, symbol: str) -> list[str]:
    """The qualified names that a symbol may mean: itself if it is one, else those with that bare name, sorted."""
    asked = nodes.sparkSession.createDataFrame([(symbol,)], "symbol string")
    return [r["qualified_name"] for r in meanings(nodes, asked).where("qualified_name is not null").orderBy("qualified_name").collect()]


class Review:
    """Answers over one snapshot."""

    def __init__(self, store: Store):
        self.store = store
        self.nodes, self.edges = store.table("nodes"), store.table("edges")

    def overview(self) -> dict:
        """Counts, the highest risks that aren't zero, and what to ask next."""
        rows = risk.top(risk.scored(self.nodes, self.edges), TOP_RISKS).where("score > 0").select("qualified_name", round2(F.col("score")).alias("risk"), "score").orderBy(F.desc("score"), "qualified_name").collect()
        return {"stats": self.store.counts(), "top_risks": [{"symbol": r["qualified_name"], "risk": r["risk"]} for r in rows], "next_tool_suggestions": list(HINTS)}

    def context(self, symbol: str, detail: str = "minimal") -> dict:
        """One symbol's signature, risk and neighbours, never its body."""
        row = risk.scored(self.nodes.where(F.col("qualified_name") == symbol), self.edges).head()
        if row is None:
            return {"error": f"no such symbol: {symbol}"}
        cap = CAPS.get(detail, CAPS["minimal"])

        def near(pairs: DataFrame, most: int | None) -> tuple[list[str], int]:
            own = pairs.where(F.col("node") == symbol)
            if most is None:
                return [r[0] for r in own.select("other").orderBy("other").collect()], 0
            got = capped(own, most).head()
            return (list(got["others"]), got["total"]) if got else ([], 0)

        calling, total = near(graph.callers_of(self.edges), cap)
        return {
            "symbol": symbol, "file": row["file"], "line": row["line_start"], "language": row["language"], "signature": row["signature"], "is_test": row["is_test"],
            "risk": round_half_up(row["score"]), "fan_in": row["fan_in"], "has_tests": row["has_tests"], "callers": calling, "callers_total": total,
            "callees": near(graph.callees_of(self.edges), cap)[0], "tests": near(graph.tests_for(self.edges), None)[0],
        }

    def changes(self, files: Sequence[str], base: str = "HEAD", limit: int = CHANGE_LIMIT) -> dict:
        """Symbols of the changed files by risk: the first `limit`, with counts of all."""
        spark = self.nodes.sparkSession
        hit = cut(risk.changed(self.nodes, self.edges, spark.createDataFrame([(f,) for f in files], "file string")))
        total = risk.change_summary(hit, len(files), limit).head()
        shown = risk.with_impact(risk.top(hit, limit), self.edges, DEPTH).orderBy(F.desc("score"), "qualified_name").collect()
        return {
            "base": base, "changed_files": list(files),
            "changed_symbols": [{"symbol": r["qualified_name"], "file": r["file"], "line": r["line_start"], "risk": r["risk"], "fan_in": r["fan_in"], "has_tests": r["has_tests"], "impact": r["impact"]} for r in shown],
            "truncated": total["symbols"] > limit, "summary": total.asDict(),
        }

    def impact(self, symbol: str, depth: int = DEPTH, forward: bool = False) -> list[str]:
        seeds = self.nodes.sparkSession.createDataFrame([(symbol,)], "seed string")
        return [r[0] for r in graph.impact(self.edges, seeds, depth, forward).select("node").orderBy("node").collect()]

    def neighbours(self, pattern: str, symbol: str) -> list[str]:
        """callers_of, callees_of, tests_for, impact_of, community_of, file_summary of a symbol or file."""
        if pattern == "impact_of":
            return self.impact(symbol)
        if pattern == "community_of":
            members = self.store.table("community_members")
            own = members.where(F.col("node") == symbol).select("community_id")
            out = members.join(own, "community_id", "left_semi").select("node").orderBy("node")
        elif pattern == "file_summary":
            out = self.nodes.where(F.col("file") == symbol).orderBy("line_start", "qualified_name").select("qualified_name")
        else:
            pairs = {"callers_of": graph.callers_of, "callees_of": graph.callees_of, "tests_for": graph.tests_for}
            if pattern not in pairs:
                raise ValueError(f"{pattern!r} is no question about a symbol; there are {', '.join((*pairs, 'impact_of', 'community_of', 'file_summary'))}")
            out = pairs[pattern](self.edges).where(F.col("node") == symbol).select("other").distinct().orderBy("other")
        return [r[0] for r in out.collect()]

    def architecture(self) -> dict:
        table, members = self.store.table("communities"), self.store.table("community_members")
        rows = structure.architecture(table, members, self.edges).orderBy(F.desc("size"), "id").collect()
        return {"communities": [r.asDict() for r in rows], "summary": {"communities": len(rows), "clustered_nodes": members.count()}}

    def risk_v2(self, symbol: str) -> dict | None:
        crit = structure.flow_criticality(self.store.table("flows"), self.store.table("flow_memberships"))
        row = risk.scored_2(self.nodes.where(F.col("qualified_name") == symbol), self.edges, crit, structure.coupling(self.edges, self.store.table("community_members"))).head()
        return row.asDict() if row else None

    def flows(self) -> list[dict]:
        return [r.asDict() for r in self.store.table("flows").orderBy(F.desc("criticality"), "id").collect()]

    def flow(self, flow_id: int) -> list[str]:
        return [r[0] for r in self.store.table("flow_memberships").where(F.col("flow_id") == flow_id).select("node").orderBy("node").collect()]

    def dead(self) -> list[str]:
        return [r[0] for r in graph.without_dependents(self.nodes, self.edges).select("qualified_name").orderBy("qualified_name").collect()]


def round_half_up(x: float) -> float:
    """Two decimals, halves away from zero."""
    import math

    return math.copysign(math.floor(abs(x) * 100 + 0.5) / 100, x)


def changes_markdown(report: dict) -> str:
    """A changes report as a list for reviewers, to be found again by its first line."""
    s, rows = report["summary"], report["changed_symbols"]
    out = [MARK, "### What this change touches", "", f"Compared with `{report['base']}`: {s['symbols']} symbols in {s['files']} files, {s['high_risk']} of them at a risk of {risk.HIGH_RISK:.2f} or more.", ""]
    for r in rows:
        tests = "tested" if r["has_tests"] else "**no test**"
        out.append(f"1. `{r['symbol']}` (line {r['line']}): risk {r['risk']:.2f}, {tests}, called by {r['fan_in']}, may reach {r['impact']}")
    if not rows:
        out.append("The graph knows no symbol in these files.")
    elif report["truncated"]:
        out += ["", f"The {len(rows)} riskiest are listed."]
    return "\n".join([*out, ""])
