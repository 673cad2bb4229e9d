"""Queries over literal sources and graphs. What must come out is written by hand as SQL values, so the operators themselves run against it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..frontends.registry import Registry
from ..operators import graph as G
from ..operators import parse, structure
from ..schema import EDGES

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {}

#: path, source.
SOURCES = (
    ("src/a.rs", "use crate::math::{add, sub};\nuse a::b::c;\n/// Runs\n#[inline]\npub fn run() { add(1); a::b::emit(2); x.go(); Self::me(); println!(\"{}\", no()); }\nstruct Foo;\nimpl Foo { fn new() {} }\n#[cfg(test)]\nmod tests { #[test] fn works() {} }\n"),
    ("a.py", "from lib import f, g as h\nfrom . import x\nimport os\nclass C:\n    \"Doc\"\n    def m(self):\n        \"\"\"does  it\"\"\"\n        f(); self.k(); a.b.c(); foo().bar()\ndef test_m(): C()\ndef m(): pass\ndef m(): pass\n"),
    ("s.go", "package s\n// Handles\nfunc Handle(w http.W) (interface{}, error) { store.Fetch(1); a.b.C() }\nfunc (s *S) M() int { return n() }\ntype S struct { f func() }\ntype R interface {\n  Read(p int) int\n}\n"),
    ("web/app.ts", "import { a, b as c } from './lib';\n/** Runs */\nexport async function run(x: number): Promise<void> { a(x); lib.go(1); this.z(); new Foo(2); if (x) { b() } }\nclass Foo { async m() { return helper<string>(`a${k(1)}`, p?.q(2)); } }\ninterface I { k(): void }\n"),
    ("web/a.test.ts", "test(\"adds\", () => { run(1); });\n"),
    ("s.css", ":root { --brand: red; }\n.card, .p > .q, #top { color: var(--brand); }\n"),
    ("i.html", "<body id=\"main\">\n<div class=\"card title\">x</div>\n</body>\n<p class=\"out\">"),
    ("p.astro", "---\nimport { load } from './lib';\nload();\n---\n<h1>no()</h1>\n<script>\ngo();\n</script>\n"),
)
NODES = (
    ("src/a.rs::run", "Function", 5, "rust", False, "pub fn run()", "Runs"), ("src/a.rs::new", "Function", 7, "rust", False, "fn new()", ""), ("src/a.rs::works", "Test", 9, "rust", True, "fn works()", ""),
    ("src/a.rs::Foo", "Type", 6, "rust", False, "struct Foo;", ""), ("src/a.rs::Foo#L7", "Type", 7, "rust", False, "impl Foo", ""),
    ("a.py::m", "Function", 6, "python", False, "def m(self):", "does it"), ("a.py::test_m", "Test", 9, "python", True, "def test_m(): C()", ""), ("a.py::m#L10", "Function", 10, "python", False, "def m(): pass", ""),
    ("a.py::m#L11", "Function", 11, "python", False, "def m(): pass", ""), ("a.py::C", "Type", 4, "python", False, "class C:", "Doc"),
    ("s.go::Handle", "Function", 3, "go", False, "func Handle(w http.W) (interface", "Handles"), ("s.go::M", "Function", 4, "go", False, "func (s *S) M() int", ""), ("s.go::S", "Type", 5, "go", False, "type S struct", ""), ("s.go::R", "Type", 6, "go", False, "type R interface", ""),
    ("web/app.ts::run", "Function", 3, "typescript", False, "async function run(x: number): Promise<void>", "Runs"), ("web/app.ts::m", "Function", 4, "typescript", False, "async m()", ""), ("web/app.ts::Foo", "Type", 4, "typescript", False, "class Foo", ""), ("web/app.ts::I", "Type", 5, "typescript", False, "interface I", ""),
    ("web/a.test.ts::adds", "Test", 1, "typescript", True, "test(\"adds\", () =>", ""),
    ("s.css::--brand", "Selector", 1, "css", False, "--brand: red;", ""), ("s.css::card", "Selector", 2, "css", False, ".card, .p > .q, #top", ""), ("s.css::p", "Selector", 2, "css", False, ".card, .p > .q, #top", ""),
    ("s.css::q", "Selector", 2, "css", False, ".card, .p > .q, #top", ""), ("s.css::top", "Selector", 2, "css", False, ".card, .p > .q, #top", ""),
    ("p.astro::<file>", "File", 1, "astro", False, "", ""), ("i.html::<file>", "File", 1, "html", False, "", ""), ("i.html::main", "Anchor", 1, "html", False, "<body id=\"main\">", ""),
)
CALLS = (
    ("src/a.rs::run", "add", None), ("src/a.rs::run", "emit", "b"), ("src/a.rs::run", "go", None), ("src/a.rs::run", "me", "Self"),
    ("a.py::m", "f", None), ("a.py::m", "k", "self"), ("a.py::m", "c", None), ("a.py::m", "foo", None), ("a.py::test_m", "C", None),
    ("s.go::Handle", "Fetch", "store"), ("s.go::Handle", "C", None), ("s.go::M", "n", None),
    ("web/app.ts::run", "a", None), ("web/app.ts::run", "go", "lib"), ("web/app.ts::run", "b", None), ("web/app.ts::m", "helper", None), ("web/app.ts::m", "k", None), ("web/app.ts::m", "q", "p"), ("web/a.test.ts::adds", "test", None), ("web/a.test.ts::adds", "run", None),
    ("s.css::card", "--brand", None), ("i.html::main", "card", None), ("i.html::main", "title", None), ("i.html::<file>", "out", None), ("p.astro::<file>", "load", None), ("p.astro::<file>", "go", None),
)
IMPORTS = (
    ("src/a.rs", "add", "crate::math"), ("src/a.rs", "sub", "crate::math"), ("src/a.rs", "c", "a::b"), ("a.py", "f", "lib"), ("a.py", "x", None), ("a.py", "os", None),
    ("web/app.ts", "a", "./lib"), ("web/app.ts", "b", "./lib"), ("p.astro", "load", "./lib"),
)
#: Two triangles and a pair.
CLUSTERS = tuple((f"x/m.rs::{a}", f"x/m.rs::{b}") for a, b in ("ab", "bc", "ca")) + tuple((f"y/n.rs::{a}", f"y/n.rs::{b}") for a, b in ("pq", "qr", "rp")) + (("z/u.rs::s", "z/u.rs::t"),)
CHAIN = tuple((f"f{i:02}", f"f{i + 1:02}") for i in range(19)) + (("f10", "f19"),)


def values(columns: str, rows: Sequence[tuple]) -> str:
    """Rows as SQL."""
    def one(x) -> str:
        return "NULL" if x is None else str(x).upper() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({columns})"


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f, sql
        return f

    return add


def parsed(spark: SparkSession) -> dict[str, DataFrame]:
    files = spark.createDataFrame([(p, p.rsplit(".", 1)[1], t) for p, t in SOURCES], "path string, extension string, text string")
    return parse.tables(parse.parse_files(files.select("path", "extension", F.sha2("text", 256).alias("hash"), F.encode("text", "utf-8").alias("content")), Registry()))


def calls(spark: SparkSession, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame([(a, b, "CALLS", i, 1.0, "EXTRACTED") for i, (a, b) in enumerate(pairs)], EDGES)


@query(values("qualified_name, kind, line_start, language, is_test, signature, doc", NODES))
def parsed_nodes(spark, sf_dir):
    return parsed(spark)["nodes"].select("qualified_name", "kind", "line_start", "language", "is_test", "signature", "doc")


@query(values("caller, callee, qualifier", CALLS))
def parsed_calls(spark, sf_dir):
    return parsed(spark)["raw_calls"].select("caller", "callee", "qualifier")


@query(values("file, name, module", IMPORTS))
def parsed_imports(spark, sf_dir):
    return parsed(spark)["imports"].select("file", "name", "module")


@query(values("id, size, label", ((0, 3, "x/m.rs"), (1, 3, "y/n.rs"), (2, 2, "z/u.rs"))))
def literal_communities(spark, sf_dir):
    return structure.communities(calls(spark, CLUSTERS))[0].select("id", "size", "label")


@query(values("node, community_id", [(f"{f}::{n}", k) for k, (f, ns) in enumerate((("x/m.rs", "abc"), ("y/n.rs", "pqr"), ("z/u.rs", "st"))) for n in ns]))
def literal_community_members(spark, sf_dir):
    return structure.communities(calls(spark, CLUSTERS))[1]


@query(values("place, node", list(enumerate([f"f{i:02}" for i in (7, 8, 9, 10, 19)]))))
def literal_shortest_path(spark, sf_dir):
    path = G.shortest_path(calls(spark, CHAIN), "f07", "f19")
    return spark.createDataFrame(list(enumerate(path)), "place int, node string")


@query(values("place, node", [(1, "b"), (2, "a"), (3, "c"), (4, "z")]))
def literal_hub_order(spark, sf_dir):
    members = spark.createDataFrame([(n, "m") for n in "abcz"], "node string, module string")
    return G.hub_order(calls(spark, [("a", "b"), ("c", "b")]), members).select("place", "node")
