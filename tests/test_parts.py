"""Edges that stay in parts: ambiguous ones are counted without a row for each, and a query computes only the tables that it asks for."""

import shutil
from collections import Counter

import pytest

from codelattice.operators import resolve, risk, search
from codelattice.plans import derived
from codelattice.plans import queries as Q
from codelattice.schema import IMPORTS, NODES, RAW_CALLS

DIR = "/root/testdata/sf0.001"


def node(qn, kind="Function", test=False):
    file, name = qn.split("::")
    return (qn, kind, name.split("#")[0], file, 1, 1, "python", "", "", test)


@pytest.fixture(scope="module")
def parts(spark):
    nodes = [node(f"f{i}.py::many") for i in range(30)] + [node("f3.py::Kind", "Type"), node("f4.py::Other", "Type"), node("a.py::main"), node("a.py::twice"), node("a.py::twice#L9"), node("t.py::t", "Test", True)]
    sites = [
        ("a.py::main", "many", 1, None, 0), ("a.py::main", "many", 1, None, 1), ("a.py::main", "many", 2, "Kind", 2), ("a.py::main", "many", 2, None, 3), ("a.py::main", "many", 3, None, 4), ("a.py::main", "many", 3, "Kind", 5),
        ("a.py::main", "twice", 4, None, 6), ("a.py::twice", "twice", 4, None, 0), ("a.py::main", "main", 5, None, 7), ("a.py::main", "many", 6, "Kind", 8), ("a.py::main", "many", 6, "Other", 9), ("a.py::main", "many", 6, None, 10),
        ("t.py::t", "main", 1, None, 0), ("t.py::t", "many", 2, None, 1), ("t.py::t", "many", 2, "Kind", 2), ("f1.py::many", "gone", 1, None, 0), ("f1.py::many", "many", 1, None, 1),
    ]
    calls = spark.createDataFrame([(c.split("::")[0], c, name, line, q, o) for c, name, line, q, o in sites], RAW_CALLS)
    return resolve.parts(spark.createDataFrame(nodes, NODES), calls, spark.createDataFrame([], IMPORTS))


def test_one_edge_for_each_key_that_of_the_first_site(parts):
    got = [tuple(r) for r in parts.edges().select("source", "target", "kind", "line", "tier").collect()]
    assert len(got) == len({x[:4] for x in got})
    many = Counter((s, line, tier) for s, t, kind, line, tier in got if kind == "CALLS" and t.endswith("many"))
    main, test = "a.py::main", "t.py::t"
    assert many == {(main, 1, "AMBIGUOUS"): 30, (main, 2, "EXTRACTED"): 1, (main, 2, "AMBIGUOUS"): 29, (main, 3, "AMBIGUOUS"): 30, (main, 6, "EXTRACTED"): 2, (main, 6, "AMBIGUOUS"): 28, (test, 2, "AMBIGUOUS"): 30, ("f1.py::many", 1, "EXTRACTED"): 1}
    assert {(s, t) for s, t, kind, *_ in got if kind == "TESTED_BY"} == {("a.py::main", test), ("f3.py::many", test)}


def test_counts_from_parts_are_those_of_the_rows(parts):
    edges = parts.edges()
    rows = lambda df: {tuple(r) for r in df.collect()}
    assert rows(risk.touched(parts.ambiguous_ends(), parts.asserted).select("node", "ambiguous", "total")) == rows(risk.ambiguous_touch(edges).select("node", "ambiguous", "total"))
    assert rows(resolve.shares(parts.tiers())) == rows(resolve.tier_distribution(edges))


def test_ends_are_counted_without_the_asserted_edges(spark, parts, monkeypatch, tmp_path):
    rows = lambda df: {tuple(r) for r in df.select("node", "ambiguous", "total").collect()}
    assert rows(parts.ends()) == rows(risk.ambiguous_touch(parts.edges()))
    for t in ("part", "lineitem", "orders"):
        shutil.copy(f"{DIR}/{t}.parquet", tmp_path)
    monkeypatch.setattr(resolve.Parts, "asserted", property(lambda self: pytest.fail("asserted")))
    assert Q.QUERIES["ambiguous_touch"](spark, str(tmp_path)).count() > 0


@pytest.mark.parametrize("name", ["callers", "dead_symbols", "ambiguous_touch", "risk_v2", "tier_distribution", "impact_multi_seed"])
def test_no_query_but_the_edge_tables_lists_ambiguous_edges(spark, monkeypatch, tmp_path, name):
    for t in ("part", "lineitem", "orders"):
        shutil.copy(f"{DIR}/{t}.parquet", tmp_path)
    monkeypatch.setattr(resolve.Parts, "ambiguous", lambda self: pytest.fail("listed"))
    assert Q.QUERIES[name](spark, str(tmp_path)).count() > 0


def test_symbols_need_no_calls(spark, monkeypatch, tmp_path):
    for t in ("part", "lineitem", "orders"):
        shutil.copy(f"{DIR}/{t}.parquet", tmp_path)
    monkeypatch.setattr(derived, "parts", lambda *a, **k: pytest.fail("resolved"))
    assert Q.QUERIES["counts"](spark, str(tmp_path)).head()["nodes"] > 0
    assert Q.QUERIES["short_labels"](spark, str(tmp_path)).count() > 0


def test_similar_ranks_as_vectors_do(spark):
    texts = ["verifyLogin auth", "login, verify", "", "Straße über 1", "verify verify a", "zz", None, "loginLogin verifyLoginX " * 30]
    docs = spark.createDataFrame([(f"d{i:02}", t) for i, t in enumerate(texts * 3)], "id string, text string")
    for query in ("verifyLogin", "straße 1", "none of qqq"):
        want = search.rank(search.vectors(docs), search.vector_of(spark, query), 12)
        assert [tuple(r) for r in search.similar(docs, query, 12).collect()] == [tuple(r) for r in want.collect()]
    assert "zip_with" not in search.similar(docs, "login", 3)._jdf.queryExecution().toString()
