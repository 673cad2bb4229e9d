"""Every operator as a query over the driver's tables, and the same rows as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frontends.registry import Registry
from ..functions import names as N
from ..lineage import cut
from ..operators import graph as G
from ..operators import parse
from ..operators import resolve as R
from ..operators import risk, search, structure

from .derived import CTES, graph, inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DERIVED = "WITH RECURSIVE " + CTES.format(part="part", lineitem="lineitem", orders="orders")
#: The resolver's rules in SQL; deep ones not.
EDGES = DERIVED + """,
sites AS (
  SELECT r.*, n.language AS lang, n.is_test AS caller_test FROM raw_calls r JOIN nodes n ON n.qualified_name = r.caller
  WHERE NOT coalesce(regexp_matches(r.qualifier, '^[A-Z]') AND r.qualifier <> 'Self' AND r.qualifier NOT IN (SELECT name FROM nodes WHERE kind = 'Type'), false)),
cands AS (SELECT * FROM nodes WHERE kind <> 'Type'),
local AS (SELECT file, name, count(*) AS n, min(qualified_name) AS one FROM cands GROUP BY ALL),
across AS (SELECT language, name, count(*) AS n, min(qualified_name) AS one FROM cands GROUP BY ALL),
typed AS (
  SELECT c.language, c.name, t.name AS type, min(c.qualified_name) AS one
  FROM cands c JOIN (SELECT DISTINCT name, file FROM nodes WHERE kind = 'Type') t ON t.file = c.file GROUP BY ALL HAVING count(*) = 1),
picked AS (
  SELECT s.caller, s.callee, s.file, s.line, s.ord, s.lang, s.caller_test, l.n AS n_local, a.n AS n_across,
         CASE WHEN l.n = 1 THEN l.one WHEN l.n IS NULL AND a.n = 1 THEN a.one WHEN l.n IS NULL AND a.n > 1 THEN t.one END AS target,
         CASE WHEN l.n = 1 THEN 1.0 WHEN a.n = 1 AND i.name IS NOT NULL THEN 0.9 WHEN a.n = 1 THEN 0.6 ELSE 0.85 END::DOUBLE AS confidence,
         CASE WHEN l.n IS NULL AND a.n = 1 AND i.name IS NULL THEN 'INFERRED' ELSE 'EXTRACTED' END AS tier
  FROM sites s LEFT JOIN local l ON l.file = s.file AND l.name = s.callee LEFT JOIN across a ON a.language = s.lang AND a.name = s.callee
  LEFT JOIN (SELECT DISTINCT file, name FROM imports) i ON i.file = s.file AND i.name = s.callee
  LEFT JOIN typed t ON t.language = s.lang AND t.name = s.callee AND t.type = s.qualifier),
calls AS (
  SELECT caller AS source, target, line, confidence, tier, ord, caller_test FROM picked WHERE target IS NOT NULL
  UNION ALL
  SELECT p.caller, c.qualified_name, p.line, 0.3, 'AMBIGUOUS', p.ord, p.caller_test FROM picked p JOIN cands c ON c.file = p.file AND c.name = p.callee WHERE p.n_local > 1
  UNION ALL
  SELECT p.caller, c.qualified_name, p.line, 0.3, 'AMBIGUOUS', p.ord, p.caller_test FROM picked p JOIN cands c ON c.language = p.lang AND c.name = p.callee
  WHERE p.n_local IS NULL AND p.n_across > 1 AND p.target IS NULL),
every AS (
  SELECT source, target, 'CALLS' AS kind, line, confidence, tier, ord FROM calls
  UNION ALL
  SELECT c.target, c.source, 'TESTED_BY', c.line, 0.7, 'INFERRED', c.ord FROM calls c JOIN nodes t ON t.qualified_name = c.target
  WHERE c.tier <> 'AMBIGUOUS' AND c.caller_test AND NOT t.is_test),
edges AS (
  SELECT source, target, kind, line, confidence, tier FROM (
    SELECT *, row_number() OVER (PARTITION BY source, target, kind, line ORDER BY ord, confidence, tier) AS k FROM every) WHERE k = 1),
sure AS (SELECT * FROM edges WHERE tier IN ('EXTRACTED', 'INFERRED')),
sure_calls AS (SELECT * FROM sure WHERE kind = 'CALLS')"""
FAN_IN = "fan AS (SELECT target AS node, count(DISTINCT source) AS fan_in FROM sure_calls GROUP BY 1)"
SCORED = f""",
{FAN_IN},
cover AS (SELECT DISTINCT source AS node FROM edges WHERE kind = 'TESTED_BY'),
touch AS (
  SELECT node, sum(amb) AS amb, count(*) AS total FROM (
    SELECT source AS node, CASE WHEN tier = 'AMBIGUOUS' THEN 1 ELSE 0 END AS amb FROM edges WHERE kind = 'CALLS'
    UNION ALL SELECT target, CASE WHEN tier = 'AMBIGUOUS' THEN 1 ELSE 0 END FROM edges WHERE kind = 'CALLS') GROUP BY 1),
scored AS (
  SELECT n.*, coalesce(f.fan_in, 0)::BIGINT AS fan_in, c.node IS NOT NULL AS has_tests, least(coalesce(f.fan_in, 0), 10) / 10.0::DOUBLE AS fan_in_norm,
         CASE WHEN n.is_test OR c.node IS NOT NULL OR n.kind IN ('Selector', 'Anchor', 'File') THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS test_gap,
         coalesce(t.amb::DOUBLE / t.total, 0.0::DOUBLE) AS density
  FROM nodes n LEFT JOIN fan f ON f.node = n.qualified_name LEFT JOIN cover c ON c.node = n.qualified_name LEFT JOIN touch t ON t.node = n.qualified_name),
risks AS (SELECT *, 0.5::DOUBLE * fan_in_norm + 0.3::DOUBLE * test_gap + 0.2::DOUBLE * density AS score FROM scored)"""
ROUND = "round(({}) * 100) / 100"
SEEDS = "seeds AS (SELECT qualified_name AS seed FROM nodes WHERE kind <> 'Type')"
#: Walks of every seed: backward against each asserted edge, forward along asserted calls.
WALKS = SEEDS + """,
back AS MATERIALIZED (SELECT DISTINCT target AS a, source AS b FROM sure), fore AS MATERIALIZED (SELECT DISTINCT source AS a, target AS b FROM sure_calls),
walk(seed, node, hop) AS (SELECT seed, seed, 0 FROM seeds UNION SELECT w.seed, s.b, w.hop + 1 FROM walk w JOIN {steps} s ON s.a = w.node WHERE w.hop < {depth})"""
CHANGED = "changed AS (SELECT DISTINCT file FROM nodes WHERE p_partkey % 17 = 0)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seeds(nodes: DataFrame) -> DataFrame:
    """Every symbol but types."""
    return nodes.where("kind <> 'Type'").select(F.col("qualified_name").alias("seed"))


def changed(nodes: DataFrame) -> DataFrame:
    return nodes.where("p_partkey % 17 = 0").select("file").distinct()


# ---- tables and the resolver


@query(DERIVED + " SELECT qualified_name, kind, name, file, line_start, language, is_test FROM nodes")
def nodes_derive(spark, sf_dir):
    return inputs(spark, sf_dir)[0].select("qualified_name", "kind", "name", "file", "line_start", "language", "is_test")


@query(DERIVED + " SELECT file, caller, callee, line, qualifier FROM raw_calls")
def raw_calls_derive(spark, sf_dir):
    return inputs(spark, sf_dir)[1].drop("ord")


@query(DERIVED + " SELECT file, name, module FROM imports")
def imports_derive(spark, sf_dir):
    return inputs(spark, sf_dir)[2]


@query(EDGES + " SELECT * FROM edges")
def resolve_edges(spark, sf_dir):
    return graph(spark, sf_dir).edges()


DEEP = EDGES.replace("\ncalls AS (", """\nkeys AS (
  SELECT language, name, qualified_name, unnest(list_distinct([regexp_extract(file, '([^/]*?)\\.[^./]*$', 1), regexp_extract(file, '([^/]*)/[^/]*$', 1)])) AS key FROM cands),
by_qualifier AS (SELECT language, name, key, min(qualified_name) AS one FROM keys GROUP BY ALL HAVING count(DISTINCT qualified_name) = 1),
by_import AS (
  SELECT i.file, k.language, k.name, min(k.qualified_name) AS one
  FROM (SELECT DISTINCT file, name, regexp_extract(module, '([^./:]+)[./:]*$', 1) AS key FROM imports) i JOIN keys k ON k.name = i.name AND k.key = i.key
  GROUP BY ALL HAVING count(DISTINCT k.qualified_name) = 1),
deep AS (
  SELECT p.* REPLACE (CASE WHEN p.target IS NULL AND p.n_local IS NULL AND p.n_across > 1 THEN coalesce(q.one, m.one) ELSE p.target END AS target)
  FROM (SELECT p.*, r.qualifier FROM picked p JOIN raw_calls r ON r.caller = p.caller AND r.ord = p.ord) p
  LEFT JOIN by_qualifier q ON q.language = p.lang AND q.name = p.callee AND q.key = regexp_extract(p.qualifier, '([^./:]+)[./:]*$', 1)
  LEFT JOIN by_import m ON m.file = p.file AND m.language = p.lang AND m.name = p.callee),
calls AS (""", 1).replace("FROM picked WHERE target", "FROM deep WHERE target").replace("FROM picked p JOIN cands", "FROM deep p JOIN cands")


@query(DEEP + " SELECT * FROM edges")
def resolve_deep(spark, sf_dir):
    return graph(spark, sf_dir).edges(deep=True)


@query(EDGES + " SELECT kind, tier, count(*) AS n_edges, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY kind) AS share FROM edges GROUP BY kind, tier")
def tier_distribution(spark, sf_dir):
    return R.shares(graph(spark, sf_dir).parts.tiers())


@query(EDGES + """, got AS (SELECT DISTINCT source, target FROM sure_calls), want AS (SELECT DISTINCT caller AS source, target FROM picked WHERE n_local = 1 OR confidence = 0.9),
hits AS (SELECT * FROM got INTERSECT SELECT * FROM want)
SELECT (SELECT count(*) FROM got) AS asserted, (SELECT count(*) FROM want) AS truth, (SELECT count(*) FROM hits) AS hits,
       (SELECT count(*) FROM hits)::DOUBLE / (SELECT count(*) FROM got) AS precision, (SELECT count(*) FROM hits)::DOUBLE / (SELECT count(*) FROM want) AS recall""")
def gold_precision(spark, sf_dir):
    g = graph(spark, sf_dir)
    truth = g.parts.calls.where("confidence >= 0.9 AND tier = 'EXTRACTED'").select("source", "target")
    return R.precision_recall(g.asserted, truth)


FEDERATE = DERIVED + """,
fn AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'lib' ELSE 'svc' END AS repo, n.* FROM nodes n JOIN part USING (p_partkey)),
fc AS (SELECT DISTINCT n.repo, r.caller, r.callee, r.line, r.file, n.language FROM raw_calls r JOIN fn n ON n.qualified_name = r.caller),
fi AS (SELECT r.repo, i.file, i.name, regexp_extract(i.module, '([^./:]+)[./:]*$', 1) AS key FROM imports i CROSS JOIN (SELECT DISTINCT repo FROM fn) r),
fits AS (
  SELECT c.repo, c.caller, c.callee, c.line, count(DISTINCT t.qualified_name) AS n, min(t.qualified_name) AS target
  FROM fc c JOIN fi i ON i.repo = c.repo AND i.file = c.file AND i.name = c.callee
  JOIN fn t ON t.name = c.callee AND t.language = c.language AND NOT t.is_test AND (regexp_extract(t.file, '([^/]*?)\\.[^./]*$', 1) = i.key OR regexp_extract(t.file, '([^/]*)/[^/]*$', 1) = i.key)
  WHERE NOT EXISTS (SELECT 1 FROM fn h WHERE h.repo = c.repo AND h.name = c.callee) GROUP BY ALL)
SELECT concat(repo, '/', caller) AS source, concat(CASE repo WHEN 'lib' THEN 'svc' ELSE 'lib' END, '/', target) AS target, line FROM fits WHERE n = 1"""


@query(FEDERATE)
def federate_cross_edges(spark, sf_dir):
    g, part = graph(spark, sf_dir), read(spark, sf_dir, "part")
    repo = F.when(F.col("p_size") % 2 == 0, "lib").otherwise("svc")
    owned = g.nodes.join(part.select("p_partkey", repo.alias("repo")), "p_partkey")
    spaced = owned.withColumns({c: N.namespaced(F.col("repo"), F.col(c)) for c in ("qualified_name", "file")})
    calls = g.raw_calls.join(owned.select("repo", F.col("qualified_name").alias("caller")), "caller").withColumns({c: N.namespaced(F.col("repo"), F.col(c)) for c in ("caller", "file")})
    imports = g.imports.crossJoin(F.broadcast(spark.createDataFrame([("lib",), ("svc",)], "repo string"))).withColumn("file", N.namespaced(F.col("repo"), F.col("file")))
    return R.federated(spaced, calls, imports)


# ---- traversal


def first_callers(edges: DataFrame, of: DataFrame) -> DataFrame:
    """seed, callers_total, callers: how many callers each seed has, and the first five by name."""
    from ..review import capped

    got = capped(G.callers_of(edges), 5)
    return of.join(got, F.col("seed") == F.col("node"), "left").select("seed", F.coalesce("total", F.lit(0)).cast("long").alias("callers_total"), F.coalesce(F.array_join("others", "|"), F.lit("")).alias("callers"))


@query(EDGES + ", " + WALKS.format(steps="back", depth=3) + " SELECT seed, node, min(hop) AS hop FROM walk WHERE node <> seed GROUP BY ALL")
def impact_depth3(spark, sf_dir):
    g = graph(spark, sf_dir)
    return G.impact(g.asserted, seeds(g.nodes), 3)


@query(EDGES + ", " + WALKS.format(steps="fore", depth=3) + " SELECT seed, node, min(hop) AS hop FROM walk WHERE node <> seed GROUP BY ALL")
def impact_forward_depth3(spark, sf_dir):
    g = graph(spark, sf_dir)
    return G.impact(g.asserted, seeds(g.nodes), 3, forward=True)


@query(EDGES + ", " + WALKS.format(steps="back", depth=3) + " SELECT seed, count(DISTINCT node) AS impact FROM walk WHERE node <> seed GROUP BY seed")
def impact_multi_seed(spark, sf_dir):
    g = graph(spark, sf_dir)
    return G.impact(g.asserted, seeds(g.nodes), 3).groupBy("seed").agg(F.count("*").alias("impact"))


@query(EDGES + " SELECT DISTINCT target AS node, source AS other FROM sure_calls")
def callers(spark, sf_dir):
    return G.callers_of(graph(spark, sf_dir).asserted)


@query(EDGES + " SELECT DISTINCT source AS node, target AS other FROM sure_calls")
def callees(spark, sf_dir):
    return G.callees_of(graph(spark, sf_dir).asserted)


@query(EDGES + " SELECT DISTINCT source AS node, target AS other FROM edges WHERE kind = 'TESTED_BY'")
def tests_for(spark, sf_dir):
    return G.tests_for(graph(spark, sf_dir).asserted)


@query(EDGES + " SELECT qualified_name, kind, file FROM nodes WHERE qualified_name NOT IN (SELECT target FROM sure)")
def dead_symbols(spark, sf_dir):
    g = graph(spark, sf_dir)
    return G.without_dependents(g.nodes, g.asserted).select("qualified_name", "kind", "file")


@query(EDGES + " SELECT a, b, count(*) AS weight FROM (SELECT source AS a, target AS b FROM sure_calls WHERE source <> target UNION ALL SELECT target, source FROM sure_calls WHERE source <> target) GROUP BY ALL")
def undirected_adjacency(spark, sf_dir):
    return G.weighted_adjacency(graph(spark, sf_dir).asserted)


ADJACENT = "adj AS (SELECT DISTINCT source AS a, target AS b FROM sure_calls WHERE source <> target UNION SELECT DISTINCT target, source FROM sure_calls WHERE source <> target)"


@query(EDGES + f", {ADJACENT}, " + "walk(node, other) AS (SELECT a, a FROM adj UNION SELECT w.node, j.b FROM walk w JOIN adj j ON j.a = w.other) SELECT node, min(other) AS component FROM walk GROUP BY node")
def connected_components(spark, sf_dir):
    return G.components(graph(spark, sf_dir).asserted)


@query(EDGES + ", " + WALKS.format(steps="fore", depth=6) + " SELECT hop, count(*) AS n FROM (SELECT seed, node, min(hop) AS hop FROM walk GROUP BY ALL) GROUP BY hop")
def path_lengths(spark, sf_dir):
    g = graph(spark, sf_dir)
    return G.reach(G.arcs(g.asserted, True), seeds(g.nodes), 6, keep_seed=True).groupBy("hop").agg(F.count("*").alias("n"))


@query(EDGES + """, place AS (SELECT qualified_name, CASE WHEN contains(file, '/') THEN split_part(file, '/', 1) ELSE '(root)' END AS top, file FROM nodes)
SELECT least(s.file, t.file) AS a, greatest(s.file, t.file) AS b, count(*) AS weight FROM sure_calls e JOIN place s ON s.qualified_name = e.source JOIN place t ON t.qualified_name = e.target
WHERE s.file <> t.file GROUP BY ALL""")
def module_chords(spark, sf_dir):
    """All derived files lie under one directory, so files stand for modules here."""
    g = graph(spark, sf_dir)
    spread = g.nodes.withColumn("file", F.concat(F.replace("file", F.lit("/"), F.lit("|")), F.lit("/x")))
    out = G.module_chords(spread, g.asserted)
    return out.select(*[F.replace(c, F.lit("|"), F.lit("/")).alias(c) for c in ("a", "b")], "weight")


# ---- aggregates and risk


@query(EDGES + f", {FAN_IN} SELECT * FROM fan")
def fan_in(spark, sf_dir):
    return risk.fan_in(graph(spark, sf_dir).asserted)


@query(EDGES + " SELECT DISTINCT source AS node FROM edges WHERE kind = 'TESTED_BY'")
def tested_set(spark, sf_dir):
    return risk.tested(graph(spark, sf_dir).asserted)


@query(EDGES + SCORED + " SELECT node, amb::BIGINT AS ambiguous, total FROM touch")
def ambiguous_touch(spark, sf_dir):
    return graph(spark, sf_dir).touch


@query(EDGES + SCORED + f" SELECT qualified_name, fan_in, has_tests, {ROUND.format('score')} AS risk FROM risks ORDER BY score DESC, qualified_name LIMIT 20")
def risk_v1_top(spark, sf_dir):
    g = graph(spark, sf_dir)
    return risk.top(risk.scored(g.nodes, g.asserted, g.touch), 20).select("qualified_name", "fan_in", "has_tests", N.round2(F.col("score")).alias("risk"))


@query(EDGES + SCORED + f" SELECT qualified_name, {ROUND.format('score')} AS risk, test_gap, round(density, 9) AS density FROM risks")
def risk_v1_all(spark, sf_dir):
    g = graph(spark, sf_dir)
    return risk.scored(g.nodes, g.asserted, g.touch).select("qualified_name", N.round2(F.col("score")).alias("risk"), "test_gap", F.round("ambiguous_density", 9).alias("density"))


CHANGES = EDGES + SCORED + f""", {CHANGED},
hit AS (SELECT r.* FROM risks r JOIN changed USING (file)),
walk(seed, node, hop) AS (
  SELECT qualified_name, qualified_name, 0 FROM hit UNION SELECT w.seed, e.source, w.hop + 1 FROM walk w JOIN (SELECT DISTINCT source, target FROM sure) e ON e.target = w.node WHERE w.hop < 3),
blast AS (SELECT seed, count(DISTINCT node) AS impact FROM walk WHERE node <> seed GROUP BY seed)"""


@query(CHANGES + f" SELECT qualified_name, file, line_start, {ROUND.format('score')} AS risk, fan_in, has_tests, coalesce(impact, 0) AS impact FROM hit LEFT JOIN blast ON seed = qualified_name ORDER BY score DESC, qualified_name LIMIT 20")
def detect_changes_top(spark, sf_dir):
    g = graph(spark, sf_dir)
    return risk.with_impact(risk.top(risk.changed(g.nodes, g.asserted, changed(g.nodes), g.touch), 20), g.asserted).drop("score", "high")


@query(EDGES + SCORED + f", {CHANGED}, hit AS (SELECT r.* FROM risks r JOIN changed USING (file)) SELECT (SELECT count(*) FROM changed) AS files, count(*) AS symbols, count(*) FILTER (score >= 0.70) AS high_risk, least(count(*), 20) AS shown FROM hit")
def changes_summary(spark, sf_dir):
    g = graph(spark, sf_dir)
    files = changed(g.nodes)
    return risk.change_summary(risk.changed(g.nodes, g.asserted, files, g.touch), files.count(), 20)


# ---- flows and communities

FLOWS = EDGES + """, hop1 AS (SELECT DISTINCT source, target FROM sure_calls),
entries AS (SELECT DISTINCT source AS entry FROM hop1 WHERE source NOT IN (SELECT target FROM hop1)),
walk(entry, node) AS (SELECT entry, entry FROM entries UNION SELECT w.entry, h.target FROM walk w JOIN hop1 h ON h.source = w.node),
sizes AS (SELECT entry, count(*) AS size FROM walk GROUP BY entry HAVING count(*) > 1),
flow AS (SELECT row_number() OVER (ORDER BY entry) - 1 AS id, entry, size, round(size / (SELECT max(size) FROM sizes)::DOUBLE * 100) / 100 AS criticality FROM sizes)"""


@query(FLOWS + " SELECT * FROM flow")
def flows(spark, sf_dir):
    return structure.flow_parts(graph(spark, sf_dir).asserted).table.select("id", "entry", "size", "criticality")


@query(FLOWS + " SELECT f.id AS flow_id, w.node FROM flow f JOIN walk w USING (entry)")
def flow_members(spark, sf_dir):
    return structure.flows(graph(spark, sf_dir).asserted)[1]


@query(FLOWS + " SELECT w.node, max(f.criticality) AS criticality FROM flow f JOIN walk w USING (entry) GROUP BY w.node")
def flow_criticality(spark, sf_dir):
    return structure.flow_parts(graph(spark, sf_dir).asserted).criticality()


GROUPED = "groups AS (SELECT qualified_name AS node, p_partkey % 7 AS community_id FROM nodes WHERE p_partkey % 11 <> 0)"
COUPLING = EDGES + f""", {GROUPED},
ends AS (
  SELECT unnest([{{'node': e.source, 'own': s.community_id}}, {{'node': e.target, 'own': t.community_id}}]) AS x, coalesce(s.community_id <> t.community_id, false)::INT AS crossing
  FROM sure_calls e LEFT JOIN groups s ON s.node = e.source LEFT JOIN groups t ON t.node = e.target),
coupled AS (SELECT x.node AS node, round(sum(crossing) / count(*)::DOUBLE * 100) / 100 AS coupling FROM ends GROUP BY 1)"""


def _groups(nodes: DataFrame) -> DataFrame:
    """Communities by a rule that SQL can follow."""
    return nodes.where("p_partkey % 11 <> 0").select(F.col("qualified_name").alias("node"), (F.col("p_partkey") % 7).alias("community_id"))


@query(COUPLING + " SELECT * FROM coupled")
def coupling(spark, sf_dir):
    g = graph(spark, sf_dir)
    return structure.coupling(g.asserted, _groups(g.nodes))


@query(COUPLING + " SELECT x.own AS id, count(*) AS external_coupling FROM ends WHERE crossing = 1 GROUP BY 1")
def external_coupling(spark, sf_dir):
    g = graph(spark, sf_dir)
    return structure.touched(g.asserted, _groups(g.nodes)).where("crossing = 1").groupBy(F.col("own").alias("id")).agg(F.count("*").alias("external_coupling"))


@query(COUPLING + f", {FAN_IN}" + """, ranked AS (SELECT g.community_id AS id, g.node, row_number() OVER (PARTITION BY g.community_id ORDER BY coalesce(f.fan_in, 0) DESC, g.node) AS k FROM groups g LEFT JOIN fan f ON f.node = g.node)
SELECT s.id, s.size, concat('group ', s.id) AS label, coalesce(x.n, 0) AS external_coupling, r.members AS top_members
FROM (SELECT community_id AS id, count(*) AS size FROM groups GROUP BY 1) s LEFT JOIN (SELECT x.own AS id, count(*) AS n FROM ends WHERE crossing = 1 GROUP BY 1) x ON x.id = s.id
JOIN (SELECT id, string_agg(node, '|' ORDER BY k) AS members FROM ranked WHERE k <= 3 GROUP BY id) r ON r.id = s.id""")
def architecture(spark, sf_dir):
    g = graph(spark, sf_dir)
    members = _groups(g.nodes)
    table = members.groupBy(F.col("community_id").alias("id")).agg(F.count("*").alias("size")).withColumn("label", F.concat(F.lit("group "), F.col("id").cast("string")))
    return structure.architecture(table, members, g.asserted).withColumn("top_members", F.array_join("top_members", "|"))


@query()
def communities(spark, sf_dir):
    return structure.communities(graph(spark, sf_dir).asserted)[0]


@query()
def community_members(spark, sf_dir):
    return structure.communities(graph(spark, sf_dir).asserted)[1]


RISK_2 = FLOWS + SCORED + COUPLING[len(EDGES):] + """, crit AS (SELECT w.node, max(f.criticality) AS criticality FROM flow f JOIN walk w USING (entry) GROUP BY w.node),
second AS (
  SELECT r.qualified_name, r.score, coalesce(c.criticality, 0) AS fc, coalesce(k.coupling, 0) AS cc,
         CASE WHEN regexp_matches(lower(concat(r.name, ' ')), 'WORDS') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS security,
         0.35::DOUBLE * fan_in_norm + 0.20::DOUBLE * test_gap + 0.10::DOUBLE * density + 0.15::DOUBLE * coalesce(c.criticality, 0) + 0.10::DOUBLE * coalesce(k.coupling, 0)
           + 0.10::DOUBLE * CASE WHEN regexp_matches(lower(concat(r.name, ' ')), 'WORDS') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v2
  FROM risks r LEFT JOIN crit c ON c.node = r.qualified_name LEFT JOIN coupled k ON k.node = r.qualified_name)
SELECT qualified_name, round(score * 100) / 100 AS v1, round(v2 * 100) / 100 AS v2, round(fc * 100) / 100 AS flow_criticality, round(cc * 100) / 100 AS community_coupling, security FROM second""".replace("WORDS", "|".join(N.SECURITY_WORDS))


@query(RISK_2)
def risk_v2(spark, sf_dir):
    g = graph(spark, sf_dir)
    return risk.scored_2(g.nodes, g.asserted, structure.flow_parts(g.asserted).criticality(), structure.coupling(g.asserted, _groups(g.nodes)), g.touch)


# ---- names, text and vectors


@query("SELECT page_id, url, regexp_matches(lower(url), '" + N.TEST_PATH + "') AS is_test FROM pages")
def path_is_test(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", "url", N.is_test_path(F.col("url")).alias("is_test"))


CLASSES = """refs AS (SELECT page_id, unnest(string_split(c, ' ')) AS class FROM (SELECT page_id, unnest(regexp_extract_all(html, 'class="([^"]*)"', 1)) AS c FROM pages))"""


def _parsed(files: DataFrame) -> dict[str, DataFrame]:
    """files: path, extension, text."""
    made = files.select("path", "extension", F.sha2("text", 256).alias("hash"), F.encode("text", "utf-8").alias("content"))
    return parse.tables(parse.parse_files(made, Registry()))


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("html").alias("extension"), F.col("html").alias("text"))


@query(f"WITH {CLASSES} SELECT page_id, class, count(*) AS n FROM refs WHERE class <> '' GROUP BY ALL")
def html_class_refs(spark, sf_dir):
    calls = _parsed(_pages(spark, sf_dir))["raw_calls"]
    return calls.groupBy(F.regexp_extract("file", r"p(-?\d+)\.html", 1).cast("long").alias("page_id"), F.col("callee").alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {CLASSES}, styles AS (SELECT unnest(['ad', 'card', 'hero', 'title']) AS class) SELECT class FROM styles WHERE class NOT IN (SELECT class FROM refs)")
def html_dead_classes(spark, sf_dir):
    style = spark.createDataFrame([("s.css", "css", ".ad { top: 0 } .card, .hero { top: 1px }\n.title { top: 2px }")], "path string, extension string, text string")
    got = _parsed(_pages(spark, sf_dir).unionByName(style))
    edges = R.resolve(got["nodes"], got["raw_calls"], got["imports"], resolve_map=Registry().families())
    return G.without_dependents(got["nodes"].where("kind = 'Selector'"), edges).select(F.col("name").alias("class"))


WORDS = "list_filter(regexp_split_to_array(lower(regexp_replace({}, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'), lambda w: w <> '')"


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({WORDS.format('p_name')}) AS word FROM part) GROUP BY word")
def words(spark, sf_dir):
    return read(spark, sf_dir, "part").select(F.explode(N.words(F.col("p_name"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


GRAMS = f"""grams AS (SELECT p_partkey, unnest(list_transform(range(1, len(w) + 1), lambda i: substr(concat('^', w, '$'), i, 3))) AS gram FROM (SELECT p_partkey, unnest({WORDS.format('p_name')}) AS w FROM part))"""


@query(f"WITH {GRAMS} SELECT gram, count(*) AS n FROM grams GROUP BY gram")
def trigrams(spark, sf_dir):
    one = read(spark, sf_dir, "part").select(F.explode(N.words(F.col("p_name"))).alias("w"))
    return one.select(F.explode(N.trigrams(F.col("w"))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


BUCKET = "list_reduce(list_prepend(37, list_transform(range(1, len({0}) + 1), lambda i: ascii(substr({0}, i, 1)))), lambda h, b: (xor(h, b) * 179) & 255)"


@query(f"WITH {GRAMS}, feats AS (SELECT p_partkey, gram AS f FROM grams UNION ALL SELECT p_partkey, unnest({WORDS.format('p_name')}) FROM part), counted AS (SELECT p_partkey, {BUCKET.format('f')} AS dim, count(*) AS n FROM feats GROUP BY ALL) SELECT p_partkey, dim::INT AS dim, round(n / sqrt(sum(n * n) OVER (PARTITION BY p_partkey)), 5) AS weight FROM counted")
def vector256(spark, sf_dir):
    v = search.vectors(read(spark, sf_dir, "part"), "p_name", "p_partkey")
    return v.select(F.col("id").cast("long").alias("p_partkey"), F.posexplode("vector").alias("dim", "weight")).where("weight > 0").withColumn("weight", F.round(F.col("weight").cast("double"), 5))


@query("""WITH q AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
s AS (SELECT vec_id, list_reduce(list_transform(list_zip(embedding, q.v), lambda p: (p[1]::FLOAT * p[2]::FLOAT)::FLOAT), lambda a, b: (a + b)::FLOAT) AS score FROM embeddings, q)
SELECT vec_id, score::DOUBLE AS score FROM s WHERE score > 0 ORDER BY score DESC, vec_id LIMIT 20""")
def vector_topk(spark, sf_dir):
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("vector"))
    q = e.where("id = 0").head()  # one row
    return search.rank(e, q["vector"], 20).select(F.col("id").alias("vec_id"), F.col("score").cast("double").alias("score"))


TERMS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


JOINED = f"concat(' ', array_to_string({TERMS}, ' '), ' ')"


def _matched(spark: SparkSession, sf_dir: str, query_text: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("doc"))
    return search.match(docs, query_text, key="doc_id").select(F.col("id").alias("doc_id"))


@query(f"SELECT doc_id FROM documents WHERE list_contains({TERMS}, 'the') AND list_contains({TERMS}, 'thing')")
def fts_match(spark, sf_dir):
    return _matched(spark, sf_dir, '"the" thing')


@query(f"SELECT doc_id FROM documents WHERE contains({JOINED}, ' the thing ') OR contains({JOINED}, ' of thing ')")
def fts_phrase(spark, sf_dir):
    return _matched(spark, sf_dir, '"the thing" OR of + thing')


@query(f"SELECT doc_id FROM documents WHERE contains({JOINED}, ' thin') AND NOT contains({JOINED}, ' the thing ') AND (list_contains({TERMS}, 'of') OR list_contains({TERMS}, 'and'))")
def fts_operators(spark, sf_dir):
    return _matched(spark, sf_dir, '(doc:thin* NOT "the thing") AND (of OR and)')


@query(f"SELECT doc_id FROM documents WHERE contains({JOINED}, ' the thing ')")
def fts_fallback(spark, sf_dir):
    """Text that is no query is a phrase."""
    return _matched(spark, sf_dir, 'the, thing')


BM25 = f"""WITH d AS (SELECT doc_id, {TERMS} AS t FROM documents),
s AS (SELECT count(*) AS n, avg(len(t)) AS mean, count(*) FILTER (list_contains(t, 'the')) AS d1, count(*) FILTER (list_contains(t, 'thing')) AS d2 FROM d),
f AS (SELECT doc_id, len(t) AS size, len(list_filter(t, lambda x: x = 'the')) AS f1, len(list_filter(t, lambda x: x = 'thing')) AS f2 FROM d),
r AS (SELECT doc_id, ln(1 + (n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * f1 * 2.2::DOUBLE / (f1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean))
             + ln(1 + (n - d2 + 0.5::DOUBLE) / (d2 + 0.5::DOUBLE)) * f2 * 2.2::DOUBLE / (f2 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * size / mean)) AS score FROM f, s WHERE f1 > 0 AND f2 > 0)
SELECT doc_id::VARCHAR AS id, round(score, 6) AS score FROM r ORDER BY r.score DESC, id LIMIT 20"""


@query(BM25)
def fts_ranked(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("qualified_name"), F.col("text").alias("doc"))
    return search.match(docs, "the thing", ("doc",)).orderBy(F.desc("score"), "id").limit(20).withColumn("score", F.round("score", 6))


@query("""WITH a AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS k FROM documents ORDER BY n_chars DESC, doc_id LIMIT 40),
b AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id % 101 DESC, doc_id) AS k FROM documents ORDER BY doc_id % 101 DESC, doc_id LIMIT 40)
SELECT doc_id AS id, round(sum(1.0::DOUBLE / (60 + k)), 12) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY doc_id ORDER BY sum(1.0::DOUBLE / (60 + k)) DESC, doc_id LIMIT 20""")
def rrf_fusion(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    a = d.select(F.col("doc_id").alias("id"), F.col("n_chars").alias("score")).orderBy(F.desc("score"), "id").limit(40)
    b = d.select(F.col("doc_id").alias("id"), (F.col("doc_id") % 101).alias("score")).orderBy(F.desc("score"), "id").limit(40)
    return search.fuse(a, b, limit=20).withColumn("score", F.round("score", 12))


@query()
def hybrid_search(spark, sf_dir):
    g = graph(spark, sf_dir)
    return search.hybrid_search(g.nodes, g.asserted, "part 3", 20)


@query("SELECT doc_id, (strlen(text) // 4)::BIGINT AS tokens FROM documents")
def token_estimate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", N.token_estimate(F.col("text")).alias("tokens"))


@query("""WITH now AS (SELECT doc_id, sha256(CASE WHEN doc_id % 7 = 0 THEN concat(text, ' ') ELSE text END) AS hash FROM documents WHERE doc_id % 13 <> 0),
before AS (SELECT doc_id, sha256(text) AS hash FROM documents WHERE doc_id % 5 <> 0)
SELECT doc_id, CASE WHEN b.doc_id IS NULL THEN 'added' WHEN n.doc_id IS NULL THEN 'removed' ELSE 'changed' END AS state
FROM now n FULL JOIN before b USING (doc_id) WHERE n.hash IS DISTINCT FROM b.hash""")
def incremental_delta(spark, sf_dir):
    from ..store import delta

    d = read(spark, sf_dir, "documents")
    text = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" "))).otherwise(F.col("text"))
    now = d.where("doc_id % 13 <> 0").select(F.col("doc_id").alias("path"), F.sha2(text, 256).alias("hash"))
    before = d.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("hash"))
    return delta(now, before).select(F.col("path").alias("doc_id"), "state")


@query(EDGES + f""", {SEEDS}, s AS (SELECT seed FROM seeds),
c AS (SELECT DISTINCT target AS node, source AS other FROM sure_calls), k AS (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY other) AS place, count(*) OVER (PARTITION BY node) AS total FROM c)
SELECT seed, coalesce(max(total), 0) AS callers_total, coalesce(string_agg(other, '|' ORDER BY other) FILTER (place <= 5), '') AS callers FROM s LEFT JOIN k ON node = seed GROUP BY seed""")
def review_callers(spark, sf_dir):
    g = graph(spark, sf_dir)
    return first_callers(g.asserted, seeds(g.nodes))


@query(DERIVED + " SELECT count(DISTINCT file) AS files, count(*) AS nodes FROM nodes")
def counts(spark, sf_dir):
    return graph(spark, sf_dir).nodes.agg(F.countDistinct("file").alias("files"), F.count("*").alias("nodes"))


@query(DERIVED + """, asked AS (SELECT DISTINCT name AS symbol FROM nodes UNION SELECT qualified_name FROM nodes UNION SELECT 'nowhere'),
hits AS (SELECT a.symbol, n.qualified_name FROM asked a LEFT JOIN nodes n ON n.qualified_name = a.symbol OR n.name = a.symbol)
SELECT symbol, qualified_name, CASE WHEN qualified_name IS NULL THEN 'None' WHEN count(*) OVER (PARTITION BY symbol) = 1 THEN 'Exact' ELSE 'Ambiguous' END AS found FROM hits""")
def symbol_lookup(spark, sf_dir):
    """No derived name is another symbol's qualified name, so the two ways to mean one don't mix here."""
    from ..review import meanings

    nodes = graph(spark, sf_dir).nodes
    asked = nodes.select(F.col("name").alias("symbol")).union(nodes.select("qualified_name")).union(spark.createDataFrame([("nowhere",)], "symbol string"))
    return meanings(nodes, asked)


@query(EDGES + f", {FAN_IN} SELECT n.qualified_name, coalesce(f.fan_in, 0) AS size FROM nodes n LEFT JOIN fan f ON f.node = n.qualified_name WHERE contains(lower(n.qualified_name), 'bolt 3') ORDER BY size DESC, n.qualified_name LIMIT 20")
def name_filter(spark, sf_dir):
    g = graph(spark, sf_dir)
    return search.find_name(g.nodes, "Bolt 3", risk.fan_in(g.asserted).withColumnRenamed("fan_in", "size"), 20)


@query(DERIVED + " SELECT qualified_name, regexp_extract(qualified_name, '([^:]*)$', 1) AS label FROM nodes")
def short_labels(spark, sf_dir):
    return graph(spark, sf_dir).nodes.select("qualified_name", N.short_label(F.col("qualified_name")).alias("label"))


# ---- literal sources, whose findings are written out by hand

from . import literal  # noqa: E402

for _name, (_run, _sql) in literal.QUERIES.items():
    QUERIES[_name], SQL[_name] = _run, _sql


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The riskiest symbols, with how much each may break."""
    g = graph(spark, sf_dir)
    best = cut(risk.top(risk.scored(g.nodes, g.asserted, g.touch), 20))
    blast = G.impact(g.asserted, best.select(F.col("qualified_name").alias("seed"))).groupBy(F.col("seed").alias("qualified_name")).agg(F.count("*").alias("impact"))
    return best.join(blast, "qualified_name", "left").select("qualified_name", "kind", "file", "fan_in", "has_tests", N.round2(F.col("score")).alias("risk"), F.coalesce("impact", F.lit(0)).alias("impact"))


