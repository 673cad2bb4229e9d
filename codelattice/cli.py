"""The command line: a thin layer over the library, on a local session unless one is configured."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import build as B
from . import export, install, review, serve, viz
from .operators import graph, risk, search
from .sources import git
from .store import Store
from .streaming.watch import INTERVAL_MS, Root, Watcher

DEFAULT_STORE = os.path.join(".codelattice", "graph")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="codelattice", description="questions about a code graph")
    top.add_argument("--root", default=".")
    top.add_argument("--store", help=f"folder of the graph; by default {DEFAULT_STORE} under the root")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, **options):
        p = commands.add_parser(name)
        for x in positional:
            p.add_argument(x)
        for x, default in options.items():
            flag = "--" + x.replace("_", "-")
            if isinstance(default, bool):
                p.add_argument(flag, action="store_true")
            else:
                p.add_argument(flag, default=default, type=type(default) if default is not None else str)
        return p

    command("build", deep=False)
    command("update", deep=False)
    command("impact", "symbol", depth=review.DEPTH, forward=False)
    command("query", "pattern", "symbol")
    command("search", "text", limit=serve.SEARCH_LIMIT, hybrid=False)
    command("path", "start", "end")
    command("find", "part", limit=serve.SEARCH_LIMIT)
    command("export", out="")
    command("risk", "symbol", v2=False)
    command("communities")
    command("community", "symbol")
    command("architecture")
    command("flows")
    command("flow", "id")
    command("review", "symbol", detail="minimal")
    command("detect-changes", base="HEAD", limit=review.CHANGE_LIMIT, markdown=False, gate=False)
    command("serve", tools="", hybrid=False)
    command("watch", interval=INTERVAL_MS, once=False)
    command("daemon", interval=INTERVAL_MS, once=False).add_argument("roots", nargs="+")
    command("install", "platform", dry_run=False, home="")
    command("visualize", out="graph.html", max_nodes=viz.MAX_NODES, mode="community")
    command("federate", out="").add_argument("members", nargs="+")
    command("estimate").add_argument("files", nargs="+")
    return top


def session() -> SparkSession:
    return SparkSession.builder.appName("codelattice").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def one_symbol(r: review.Review, given: str) -> str:
    """The only symbol that a name means; otherwise the command ends with what it could mean."""
    found = review.symbols_named(r.nodes, given)
    if len(found) == 1:
        return found[0]
    raise SystemExit(f"no such symbol: {given}" if not found else f"{given} is ambiguous:\n" + "\n".join(f"  {x}" for x in found))


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    if a.command == "install":
        return install.run(a.platform, a.home or os.path.expanduser("~"), a.dry_run)
    if a.command == "estimate":
        total = 0
        for path in a.files:
            try:
                with open(path, "rb") as f:
                    total += len(f.read()) // 4
            except OSError:
                continue  # a file that can't be read counts nothing
        print(f"{total} tokens (estimate)")
        return 0
    spark = spark or session()
    store = Store(spark, a.store or os.path.join(os.path.abspath(a.root), DEFAULT_STORE))
    if a.command in ("build", "update"):
        s = (B.build if a.command == "build" else B.update)(store, a.root, deep=a.deep)
        print(f"{s.files} files, {s.nodes} nodes, {s.edges} edges; {s.reparsed} parsed, {s.evicted} evicted")
        return 0
    if a.command == "federate":
        print(json.dumps(B.federate(spark, [B.Member.of(m) for m in a.members], Store(spark, a.out or store.root))))
        return 0
    if a.command in ("watch", "daemon"):
        roots = [Root(x, os.path.join(os.path.abspath(x), DEFAULT_STORE)) for x in (a.roots if a.command == "daemon" else [a.root])]
        watcher = Watcher(spark, roots)
        if a.once:
            return int(any(isinstance(x, Exception) for x in watcher.tick().values()))
        watcher.start(f"{store.root}-watch", a.interval).awaitTermination()
        return 0
    if store.current() is None:
        raise SystemExit(f"no graph in {store.root}; run build first")
    r = review.Review(store)
    show = lambda x: print(json.dumps(x, indent=2, ensure_ascii=False))
    if a.command == "impact":
        print("\n".join(r.impact(one_symbol(r, a.symbol), a.depth, a.forward)))
    elif a.command == "query":
        print("\n".join(r.neighbours(a.pattern, a.symbol if a.pattern == "file_summary" else one_symbol(r, a.symbol))))
    elif a.command == "search":
        found = search.hybrid_search(r.nodes, r.edges, a.text, a.limit) if a.hybrid else search.text_search(r.nodes, a.text, a.limit)
        print("\n".join(x["id"] for x in found.collect()))
    elif a.command == "path":
        print("\n".join(graph.shortest_path(r.edges, one_symbol(r, a.start), one_symbol(r, a.end))))
    elif a.command == "find":
        for x in search.find_name(r.nodes, a.part, risk.fan_in(r.edges).withColumnRenamed("fan_in", "size"), a.limit).collect():
            print(f"{x['size']}\t{x['qualified_name']}")
    elif a.command == "export":
        out = open(a.out, "w", encoding="utf-8", newline="\n") if a.out else sys.stdout
        out.writelines(export.export_json(store))
        if a.out:
            out.close()
    elif a.command == "risk":
        symbol = one_symbol(r, a.symbol)
        row = r.risk_v2(symbol) if a.v2 else risk.scored(r.nodes.where(F.col("qualified_name") == symbol), r.edges).select("score", "fan_in", "has_tests", "ambiguous_density").head().asDict()
        show(row)
    elif a.command == "communities":
        for x in store.table("communities").orderBy(F.desc("size"), "id").collect():
            print(f"{x['id']}\t{x['size']}\t{x['label']}")
    elif a.command == "community":
        print("\n".join(r.neighbours("community_of", one_symbol(r, a.symbol))))
    elif a.command == "architecture":
        show(r.architecture())
    elif a.command == "flows":
        for x in r.flows():
            print(f"{x['id']}\t{x['criticality']:.2f}\t{x['size']}\t{x['entry']}")
    elif a.command == "flow":
        print("\n".join(r.flow(int(a.id))))
    elif a.command == "review":
        show(r.context(one_symbol(r, a.symbol), a.detail))
    elif a.command == "detect-changes":
        report = r.changes(git.changed_files(a.root, a.base), a.base, a.limit)
        print(review.changes_markdown(report)) if a.markdown else show(report)
        return int(a.gate and report["summary"]["high_risk"] > 0)
    elif a.command == "serve":
        serve.Server(store, a.root, [t for t in a.tools.split(",") if t] or None, a.hybrid).run(sys.stdin, sys.stdout)
    elif a.command == "visualize":
        with open(a.out, "w", encoding="utf-8") as f:
            f.writelines(viz.page(store, a.max_nodes, a.mode))
        print(a.out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
