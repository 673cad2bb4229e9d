"""Traversals, the resolver's rules, risk, structure and search on small literal graphs."""

import pytest
from pyspark.sql import functions as F

from codelattice.operators import graph, resolve, risk, search, structure
from codelattice.schema import EDGES, IMPORTS, NODES, RAW_CALLS


def edges(spark, *pairs, kind="CALLS", tier="EXTRACTED"):
    return spark.createDataFrame([(a, b, kind, i, 1.0, tier) for i, (a, b) in enumerate(pairs)], EDGES)


def node(qn, kind="Function", test=False, language="python", signature=""):
    file, name = qn.split("::")
    return (qn, kind, name.split("#")[0], file, 1, 1, language, signature, "", test)


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "seed string")


def reached(df):
    return sorted(r["node"] for r in df.collect())


@pytest.fixture(scope="module")
def chain(spark):
    names = [f"f{i:02}" for i in range(20)]
    return edges(spark, *zip(names, names[1:]), ("f10", "f19")).persist()


def test_bounded_impact(spark, chain):
    assert reached(graph.impact(chain, seeds(spark, "f19"), 3)) == ["f08", "f09", "f10", "f16", "f17", "f18"]
    assert len(reached(graph.impact(chain, seeds(spark, "f19"), 100))) == 19
    assert reached(graph.impact(chain, seeds(spark, "f17"), 3, forward=True)) == ["f18", "f19"]


def test_walks_leave_out_the_seed_and_ambiguous_edges(spark):
    e = edges(spark, ("a", "b"), ("b", "a"), ("c", "a")).unionByName(edges(spark, ("z", "a"), tier="AMBIGUOUS"))
    assert reached(graph.impact(e, seeds(spark, "a"), 5)) == ["b", "c"]


def test_backward_walk_follows_test_edges_too(spark):
    e = edges(spark, ("t", "a"), ("t", "b")).unionByName(edges(spark, ("a", "t"), ("b", "t"), kind="TESTED_BY"))
    assert reached(graph.impact(e, seeds(spark, "a"), 2)) == ["b", "t"]


def test_shortest_path_components_and_hub_order(spark, chain):
    assert graph.shortest_path(chain, "f09", "f19") == ["f09", "f10", "f19"] and graph.shortest_path(chain, "f19", "f00") == []
    two = edges(spark, ("a", "b"), ("b", "c"), ("x", "y"), ("q", "q"))
    assert {r["node"]: r["component"] for r in graph.components(two).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    members = spark.createDataFrame([(n, "m") for n in "abcz"], "node string, module string")
    order = [r["node"] for r in graph.hub_order(edges(spark, ("a", "b"), ("c", "b")), members).orderBy("place").collect()]
    assert order == ["b", "a", "c", "z"]


NODE_ROWS = [
    node("a.py::main"), node("a.py::twice"), node("a.py::twice#L9"), node("lib.py::only"), node("one/x.py::many"), node("two/y.py::many"), node("two/y.py::Kind", "Type"),
    node("test_a.py::test_it", "Test", True), node("w.ts::alien", language="typescript"), node("i.html::<file>", "File", language="html"), node("s.css::card", "Selector", language="css"),
]


def resolved(spark, *calls, imports=(), deep=False):
    raw = spark.createDataFrame([("a.py" if c[0] == "a.py::main" else c[0].split("::")[0], c[0], c[1], 1 + i, c[2] if len(c) > 2 else None, i) for i, c in enumerate(calls)], RAW_CALLS)
    got = resolve.resolve(spark.createDataFrame(NODE_ROWS, NODES), raw, spark.createDataFrame(list(imports), IMPORTS), deep)
    return sorted((r["source"], r["target"], r["kind"], r["confidence"], r["tier"]) for r in got.collect())


def test_rules_in_order(spark):
    m = "a.py::main"
    assert resolved(spark, (m, "main")) == [(m, m, "CALLS", 1.0, "EXTRACTED")]
    assert [x[3:] for x in resolved(spark, (m, "twice"))] == [(0.3, "AMBIGUOUS")] * 2
    assert resolved(spark, (m, "only")) == [(m, "lib.py::only", "CALLS", 0.6, "INFERRED")]
    assert resolved(spark, (m, "only"), imports=[("a.py", "only", None)]) == [(m, "lib.py::only", "CALLS", 0.9, "EXTRACTED")]
    assert resolved(spark, (m, "many", "Kind")) == [(m, "two/y.py::many", "CALLS", 0.85, "EXTRACTED")]
    assert len(resolved(spark, (m, "many"))) == 2
    assert resolved(spark, (m, "only", "Vec")) == [] and resolved(spark, (m, "nothing")) == [] and resolved(spark, (m, "alien")) == []
    assert resolved(spark, (m, "main", "Self"))[0][3] == 1.0
    assert resolved(spark, ("gone.py::x", "only")) == []
    assert resolved(spark, ("i.html::<file>", "card"))[0][:2] == ("i.html::<file>", "s.css::card")


def test_deep_evidence_breaks_ties(spark):
    m = "a.py::main"
    assert resolved(spark, (m, "many", "x"), deep=True) == [(m, "one/x.py::many", "CALLS", 0.85, "EXTRACTED")]
    assert resolved(spark, (m, "many"), imports=[("a.py", "many", "pkg.two")], deep=True) == [(m, "two/y.py::many", "CALLS", 0.85, "EXTRACTED")]
    assert len(resolved(spark, (m, "many"), imports=[("a.py", "many", "pkg.none")], deep=True)) == 2


def test_tests_cover_what_they_call(spark):
    t = "test_a.py::test_it"
    assert (("lib.py::only", t, "TESTED_BY", 0.7, "INFERRED")) in resolved(spark, (t, "only"))


def test_first_call_site_wins_a_key(spark):
    m = "a.py::main"
    nodes = spark.createDataFrame(NODE_ROWS, NODES)
    raw = spark.createDataFrame([("a.py", m, "many", 5, "Kind", 0), ("a.py", m, "many", 5, None, 1)], RAW_CALLS)
    got = {(r["target"], r["tier"]) for r in resolve.resolve(nodes, raw, spark.createDataFrame([], IMPORTS)).collect()}
    assert got == {("two/y.py::many", "EXTRACTED"), ("one/x.py::many", "AMBIGUOUS")}


def test_risk_by_hand(spark):
    nodes = spark.createDataFrame([node(f"m.py::{n}") for n in ("hot", "cold", "a", "b", "c", "d", "login")] + [node("m.py::T", "Type"), node("s.css::x", "Selector", language="css"), node("m.py::t", "Test", True)], NODES)
    e = edges(spark, *[(f"m.py::{c}", "m.py::hot") for c in "abcd"], ("m.py::a", "m.py::cold"), ("m.py::t", "m.py::cold"), ("m.py::a", "s.css::x"), ("m.py::b", "s.css::x")).unionByName(edges(spark, ("m.py::cold", "m.py::t"), kind="TESTED_BY"))
    got = {r["qualified_name"].split("::")[1]: round(r["score"], 6) for r in risk.scored(nodes, e).collect()}
    assert got["hot"] == 0.5 and got["cold"] == 0.1 and got["T"] == 0.3 and got["x"] == 0.1 and got["a"] == 0.3
    none = spark.createDataFrame([], "node string, criticality double"), spark.createDataFrame([], "node string, coupling double")
    v2 = {r["qualified_name"].split("::")[1]: r for r in risk.scored_2(nodes, e, *none).collect()}
    assert v2["login"]["security"] == 1.0 and v2["login"]["v2"] == pytest.approx(0.3) and v2["hot"]["v2"] == pytest.approx(0.34)
    assert [r["qualified_name"] for r in risk.top(risk.scored(nodes, e), 2).collect()] == ["m.py::hot", "m.py::T"]


def test_self_calls_count_twice_in_doubt(spark):
    e = edges(spark, ("a", "a"), tier="AMBIGUOUS").unionByName(edges(spark, ("a", "b")))
    assert {r["node"]: (r["ambiguous"], r["total"]) for r in risk.ambiguous_touch(e).collect()} == {"a": (2, 3), "b": (0, 1)}


def test_two_clusters_and_a_flow(spark):
    e = edges(spark, *[(f"x/m.rs::{a}", f"x/m.rs::{b}") for a, b in ("ab", "bc", "ca")], *[(f"y/n.rs::{a}", f"y/n.rs::{b}") for a, b in ("pq", "qr", "rp")])
    table, members = structure.communities(e)
    assert [(r["size"], r["label"]) for r in table.orderBy("id").collect()] == [(3, "x/m.rs"), (3, "y/n.rs")] and members.count() == 6
    flow, inside = structure.flows(edges(spark, ("main", "s1"), ("s1", "s2"), ("self", "self")))
    assert [(r["entry"], r["size"], r["criticality"]) for r in flow.collect()] == [("main", 3, 1.0)] and inside.count() == 3


def test_propagation_breaks_ties_by_name_and_counts_repeats():
    both = lambda *e: [x for a, b, w in e for x in ((a, b, w), (b, a, w))]
    assert structure.propagate(both(("a", "b", 1), ("b", "c", 5))) == {"a": "c", "b": "c", "c": "c"}


@pytest.mark.parametrize("files,want", [
    (["a/x.py", "a/x.py"], "a/x.py"), (["a/b/x.py", "a/b/y.py"], "a/b"), (["apps/main/x", "apps/mainframe/y"], "apps"),
    (["a/x", "b/y", "b/z"], "b"), (["a/x", "b/y"], "a"), (["x", "y"], "(repository root)"),
])
def test_community_names(spark, files, want):
    rows = spark.createDataFrame([(1, f) for f in files], "id long, file string")
    assert structure.community_names(rows).head()["base"] == want


def test_coupling_and_architecture(spark):
    e = edges(spark, ("a", "b"), ("a", "c"), ("d", "a"))
    members = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "node string, community_id long")
    assert {r["node"]: r["coupling"] for r in structure.coupling(e, members).collect()} == {"a": 0.33, "b": 0.0, "c": 1.0, "d": 0.0}
    table = spark.createDataFrame([(1, 2, "x"), (2, 1, "y")], "id long, size long, label string")
    got = {r["id"]: (r["external_coupling"], r["top_members"]) for r in structure.architecture(table, members, e).collect()}
    assert got == {1: (1, ["a", "b"]), 2: (1, ["c"])}


def test_search_channels(spark):
    nodes = spark.createDataFrame([("auth.py::verify_login", "Function", "verify_login", "auth.py", 1, 1, "python", "def verify_login(user)", "checks a password", False), ("bill.py::charge", "Function", "charge", "bill.py", 1, 1, "python", "def charge(card)", "", False), ("web.py::handle", "Function", "handle", "web.py", 1, 1, "python", "def handle()", "", False)], NODES)
    e = edges(spark, ("web.py::handle", "bill.py::charge"))
    assert [r["id"] for r in search.text_search(nodes, 'password AND "checks').collect()] == []  # every term must be there
    assert [r["id"] for r in search.text_search(nodes, "checks password").collect()] == ["auth.py::verify_login"]
    assert search.vector_search(nodes, "verifyLogin", 1).head()["id"] == "auth.py::verify_login"
    near = [r["id"] for r in search.contextual_search(nodes, e, "charge", 2).collect()]
    assert near == ["bill.py::charge", "web.py::handle"]
    assert search.hybrid_search(nodes, e, "login", 3).head()["id"] == "auth.py::verify_login"
    assert search.text_search(nodes, "?!").count() == 0


def test_words_and_buckets(spark):
    from codelattice.functions import names as N

    def fnv(text):
        h = 0xCBF29CE484222325
        for b in text.encode():
            h = (h ^ b) * 0x100000001B3 & (1 << 64) - 1
        return h % 256

    texts = ["parse_HTTPHeader v2", "", "é", "getUserID"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(N.words(F.col("t")).alias("w"), N.bucket(F.col("t")).alias("b")).collect()
    assert rows[0]["w"] == ["parse", "httpheader", "v2"] and rows[1]["w"] == []
    assert [r["b"] for r in rows] == [fnv(t) for t in texts]


@pytest.mark.parametrize("module,path,want", [("pkg.lib", "a/lib.py", True), ("./lib", "lib.ts", True), ("crate::math", "math/mod.rs", True), ("store", "store/fetch.go", True), ("a.b", "b/c/d.py", False), ("..", "x.py", False)])
def test_module_matches(spark, module, path, want):
    from codelattice.functions.names import module_matches

    assert spark.range(1).select(module_matches(F.lit(module), F.lit(path)).alias("m")).head()["m"] is want
