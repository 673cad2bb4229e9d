"""From source trees to stored graphs and back: walks, builds, updates, reviews, exports, watching, serving, federation."""

import io
import json
import os
import subprocess

import pytest

from codelattice import build as B
from codelattice import cli, export, install, review, viz
from codelattice.frontends.registry import Registry
from codelattice.serve import Server
from codelattice.sources import ignore, repo
from codelattice.store import Store
from codelattice.streaming.watch import Root, Watcher

FILES = {
    "core.py": "def hot():\n    '''The hot one.'''\n    return 1\n\ndef cold():\n    return hot()\n\ndef login():\n    return cold() + hot()\n",
    "core_test.py": "from core import hot\n\ndef test_hot():\n    hot()\n",
    "web/styles.css": ":root { --brand: red; }\n.card { color: var(--brand); }\n.unused { margin: 0 }\n",
    "web/index.html": '<body id="page"><div class="card">x</div></body>\n',
}


def tree(folder, files):
    for name, text in files.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
    return str(folder)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tree(tmp_path_factory.mktemp("repo"), FILES)
    for args in (["init", "-q"], ["add", "-A"], ["-c", "user.name=t", "-c", "user.email=t@example.com", "commit", "-qm", "x"]):
        subprocess.run(["git", "-C", root, *args], check=True)
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    return store, root, B.build(store, root)


def test_ignore_rules(tmp_path):
    root = tree(tmp_path, {".gitignore": "*.log\n/out\n!keep.log\ngen/**/x.py\n", "sub/.gitignore": "!deep.log\n", "a.py": "", "x.log": "", "keep.log": "", "out/b.py": "", "sub/out/c.py": "", "sub/deep.log": "", "gen/p/q/x.py": "", "node_modules/m.js": "", "nested/.git": "", "nested/n.py": ""})
    assert {f.rel for f in repo.walk(root)} == {".gitignore", "a.py", "keep.log", "sub/.gitignore", "sub/out/c.py", "sub/deep.log"}
    assert ignore.rules("[\n\n# c\n") is not None


def test_build_resolves_across_languages(built):
    store, _, stats = built
    got = {(r["source"], r["target"], r["kind"], r["tier"]) for r in store.table("edges").collect()}
    assert ("core.py::cold", "core.py::hot", "CALLS", "EXTRACTED") in got and ("core.py::hot", "core_test.py::test_hot", "TESTED_BY", "INFERRED") in got
    assert ("web/index.html::page", "web/styles.css::card", "CALLS", "INFERRED") in got and ("web/styles.css::card", "web/styles.css::--brand", "CALLS", "EXTRACTED") in got
    assert (stats.files, stats.reparsed) == (4, 4) and store.meta()["last_build_type"] == "full" and store.meta()["built_at_commit"]
    r = review.Review(store)
    assert r.impact("web/styles.css::--brand") == ["web/index.html::page", "web/styles.css::card"] and "web/styles.css::unused" in r.dead()


def test_review_answers(built):
    r = review.Review(built[0])
    got = r.context("core.py::hot")
    assert (got["fan_in"], got["has_tests"], got["callers_total"], got["tests"]) == (3, True, 3, ["core_test.py::test_hot"])
    assert r.context("nope") == {"error": "no such symbol: nope"}
    assert review.symbols_named(r.nodes, "hot") == ["core.py::hot"] and review.symbols_named(r.nodes, "zzz") == []
    assert r.overview()["stats"]["files"] == 4 and r.neighbours("file_summary", "core.py")[0] == "core.py::hot"
    report = r.changes(["core.py"], limit=1)
    assert report["truncated"] and report["summary"]["symbols"] == 3 and "The 1 riskiest are listed." in review.changes_markdown(report)
    assert "knows no symbol" in review.changes_markdown(r.changes(["none.py"]))
    assert r.risk_v2("core.py::login")["security"] == 1.0 and r.risk_v2("nope") is None


def test_export_has_the_same_bytes_whatever_the_partitions(built, spark, tmp_path):
    store, root, _ = built
    one = "".join(export.export_json(store))
    other = Store(spark, str(tmp_path / "again"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        B.build(other, root)
        assert "".join(export.export_json(other)) == one and len(json.loads(one)["nodes"]) == store.table("nodes").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_update_parses_changes_only_and_evicts(spark, tmp_path):
    root, store = tree(tmp_path / "r", FILES), Store(spark, str(tmp_path / "s"))
    B.build(store, root)
    first = store.current()
    assert B.update(store, root).reparsed == 0 and store.current() == first
    tree(root, {"core.py": "def hot():\n    return 2\n"})
    os.remove(os.path.join(root, "web/index.html"))
    with open(os.path.join(root, "broken.py"), "wb") as f:
        f.write(b"\xff\xfe\xff")
    stats = B.update(store, root)
    assert (stats.reparsed, stats.evicted) == (1, 1) and store.current() != first and store.meta()["last_build_type"] == "incremental"
    assert [r["qualified_name"] for r in store.table("nodes").where("file = 'core.py'").collect()] == ["core.py::hot"]
    assert B.update(store, root).reparsed == 0  # what can't be parsed changes nothing
    assert store.prune(1) and store.current()


def test_old_snapshots_lack_columns(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    store.clear()
    spark.createDataFrame([("a.py", "f")], "file string, name string").write.mode("overwrite").parquet(f"{store.current()}/imports")
    assert store.table("imports").head().asDict() == {"file": "a.py", "name": "f", "module": None}


def test_watching_isolates_failures(spark, tmp_path):
    root, said = tree(tmp_path / "ok", {"a.py": "def f(): pass\n"}), []
    watcher = Watcher(spark, [Root(str(tmp_path / "gone"), str(tmp_path / "s1")), Root(root, str(tmp_path / "s2"))], said.append)
    got = watcher.tick()
    watcher.tick()
    assert isinstance(got[str(tmp_path / "gone")], Exception) and got[root].reparsed == 1
    assert len([s for s in said if s.startswith("warn")]) == 1 and len(said) == 2
    tree(tmp_path / "gone", {"b.py": "def g(): pass\n"})
    watcher.tick()
    assert any("recovered" in s for s in said)


def test_streaming_trigger_runs_ticks(spark, tmp_path):
    ticks = []
    watcher = Watcher(spark, [Root("r", "s")], lambda _: None, lambda store, root: ticks.append(root) or B.Stats(0, 0, 0, 0, 0))
    query = watcher.start(str(tmp_path / "cp"), 200)
    try:
        for _ in range(60):
            query.processAllAvailable()
            if len(ticks) > 1:
                break
        assert ticks
    finally:
        query.stop()


def test_server(built):
    store, root, _ = built
    server = Server(store, root)
    ask = lambda method, **params: server.handle({"id": 1, "method": method, "params": params})
    call = lambda name, **args: json.loads(ask("tools/call", name=name, arguments=args)["result"]["content"][0]["text"])
    assert len(ask("tools/list")["result"]["tools"]) == 7 and server.handle({"method": "x"}) is None
    assert ask("nope")["error"]["code"] == -32601 and ask("initialize")["result"]["serverInfo"]["name"] == "codelattice"
    assert call("search", query="hot one")["symbols"] == ["core.py::hot"]
    assert call("query_graph", pattern="callers_of", symbol="core.py::hot")["callers"] == ["core.py::cold", "core.py::login", "core_test.py::test_hot"]
    assert "error" in call("query_graph", pattern="bad", symbol="x") and call("impact", symbol="core.py::login", direction="forward")["nodes"] == ["core.py::cold", "core.py::hot"]
    assert call("get_minimal_context")["_meta"]["token_estimate"] > 0 and call("detect_changes", base="HEAD")["changed_files"] == []
    assert Server(store, root, ["impact"]).handle({"id": 1, "method": "tools/call", "params": {"name": "search"}})["error"]
    out = io.StringIO()
    server.run(io.StringIO('\n{bad\n{"id": 2, "method": "ping"}\n'), out)
    assert [json.loads(x).get("error", {}).get("code") for x in out.getvalue().splitlines()] == [-32700, None]


def test_page(built):
    one, two = "".join(viz.page(built[0])), "".join(viz.page(built[0]))
    assert one == two and "http" not in one.split("<script>")[1][:200] and "core.py::hot" in one
    assert '"truncated":true' in "".join(viz.page(built[0], max_nodes=2))


def test_federation_needs_import_evidence(spark, tmp_path):
    lib = tree(tmp_path / "lib", {"core.py": "def fetch():\n    pass\n\ndef info():\n    pass\n"})
    svc = tree(tmp_path / "svc", {"api.py": "from core import fetch\n\ndef handle():\n    fetch()\n    info()\n"})
    members = []
    for path in (lib, svc):
        B.build(Store(spark, os.path.join(path, ".codelattice", "graph")), path)
        members.append(B.Member.of(path))
    out = Store(spark, str(tmp_path / "both"))
    assert B.federate(spark, members, out)["cross_edges"] == 1
    assert review.Review(out).impact("lib/core.py::fetch") == ["svc/api.py::handle"]
    with pytest.raises(ValueError):
        B.federate(spark, members[:1], out)
    assert B.Member.of("x=/a/b") == B.Member("x", "/a/b")


GOLD = {
    "py/lib.py": "def compute():\n    return 1\n", "py/app.py": "from lib import compute\n\ndef run():\n    return compute()\n", "py/a/util.py": "def helper():\n    pass\n", "py/b/util2.py": "def helper():\n    pass\n",
    "py/use.py": "import util2\n\ndef go():\n    util2.helper()\n", "rs/math.rs": "pub fn add() {}\n", "rs/other.rs": "pub fn add() {}\npub fn lone() {}\n", "rs/main.rs": "use crate::math::add;\nfn main() { add(); lone(); }\n",
    "go/store/fetch.go": "package store\nfunc Load() {}\n", "go/cache/load.go": "package cache\nfunc Load() {}\n", "go/main.go": "package main\nfunc Serve() { store.Load() }\n",
}
TRUTH = {("py/app.py::run", "py/lib.py::compute"), ("py/use.py::go", "py/b/util2.py::helper"), ("rs/main.rs::main", "rs/math.rs::add"), ("rs/main.rs::main", "rs/other.rs::lone"), ("go/main.go::Serve", "go/store/fetch.go::Load")}


def test_gold_edges(spark, tmp_path):
    root = tree(tmp_path / "gold", GOLD)
    found = {}
    for deep in (False, True):
        store = Store(spark, str(tmp_path / f"s{deep}"))
        B.build(store, root, deep=deep)
        found[deep] = {(r["source"], r["target"]) for r in store.table("edges").where("kind = 'CALLS' AND tier <> 'AMBIGUOUS'").collect()}
        assert len(found[deep] & TRUTH) / len(found[deep]) >= 0.85
    assert found[True] == TRUTH and len(found[False]) == 2


def test_command_line(built, spark, capsys, tmp_path):
    store, root, _ = built
    run = lambda *a: (cli.main(["--root", root, "--store", store.root, *a], spark), capsys.readouterr().out)
    assert run("impact", "hot", "--depth", "1")[1].split() == ["core.py::cold", "core.py::login", "core_test.py::test_hot"]
    assert json.loads(run("review", "hot")[1])["fan_in"] == 3 and run("detect-changes", "--gate")[0] == 0
    assert run("communities")[1] and run("flows")[1] and "page" in run("search", "page")[1]
    assert run("export", "--out", str(tmp_path / "g.json"))[0] == 0 and (tmp_path / "g.json").stat().st_size
    with pytest.raises(SystemExit):
        run("impact", "nothing")
    assert "tokens" in run("estimate", os.path.join(root, "core.py"), "missing")[1]


def test_installer_keeps_what_is_there(tmp_path, capsys):
    (tmp_path / ".codex").mkdir()
    (tmp_path / ".codex/config.toml").write_text('model = "x"\n')
    (tmp_path / ".claude.json").write_text('{"a": 1}')
    assert install.run("codex", str(tmp_path)) == 0 and install.run("claude", str(tmp_path)) == 0
    once = (tmp_path / ".codex/config.toml").read_text()
    assert once.startswith('model = "x"') and json.loads((tmp_path / ".claude.json").read_text())["a"] == 1
    install.run("all", str(tmp_path))
    assert (tmp_path / ".codex/config.toml").read_text() == once
    (tmp_path / ".claude.json").write_text("[1]")
    assert install.run("claude", str(tmp_path)) == 1 and (tmp_path / ".claude.json").read_text() == "[1]"


def test_registry_families():
    assert Registry().families()["html"] == ("css", "html") and Registry().of("tsx").name == "typescript" and Registry().of("zig") is None
