"""From a source tree to a stored graph: collect, parse what changed, resolve, and describe the structure."""

from __future__ import annotations

import os
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .frontends.registry import TOML, Registry, load_toml
from .lineage import cut
from .operators import parse as P
from .operators import structure
from .operators.resolve import federated, resolve
from .schema import CALLS, INFERRED, conform
from .schema import COMMUNITIES, EDGES, FLOW_MEMBERS, FLOWS, MEMBERS
from .sources import git, repo
from .store import Store, delta, unique_nodes


@dataclass(frozen=True)
class Stats:
    files: int
    nodes: int
    edges: int
    reparsed: int
    evicted: int


def registry_of(root: str, allow_foreign: bool = False) -> Registry:
    """Built-in languages and those of the tree's own file."""
    path = os.path.join(root, TOML)
    if not os.path.isfile(path):
        return Registry()
    with open(path, encoding="utf-8", errors="replace") as f:
        custom, warned = load_toml(f.read(), allow_foreign)
    for w in warned:
        warnings.warn(f"{TOML}: {w}", stacklevel=2)
    return Registry(tuple(custom))


def derived(store: Store, tables: dict[str, DataFrame], edges: DataFrame) -> dict[str, DataFrame]:
    """Communities and flows of edges; a stage that fails warns and leaves its tables empty."""
    out = {}
    for names, stage in ((("communities", "community_members"), structure.communities), (("flows", "flow_memberships"), structure.flows)):
        try:
            out |= dict(zip(names, map(cut, stage(edges))))
        except Exception as e:  # the graph itself is complete without them
            warnings.warn(f"{stage.__name__}: {e}", stacklevel=2)
    empty = {"communities": COMMUNITIES, "community_members": MEMBERS, "flows": FLOWS, "flow_memberships": FLOW_MEMBERS}
    return {n: out.get(n, store.spark.createDataFrame([], s)) for n, s in empty.items()}


def sync(store: Store, root: str, full: bool, deep: bool = False, allow_foreign: bool = False) -> Stats:
    """The store brought up to the tree: only files whose hash is new are parsed, and nothing is written if nothing changed."""
    spark, root = store.spark, os.path.abspath(root)
    if not os.path.isdir(root):
        raise NotADirectoryError(f"root {root} is not a directory")
    registry = registry_of(root, allow_foreign)
    listed = repo.collect(root, [e for x in registry.all() for e in x.extensions])
    now = repo.read_files(spark, root, listed)
    before = store.table("files")
    if full:
        before = before.limit(0)
    hashes = cut(now.select("path", "hash"))
    moved = cut(delta(hashes, before.select("path", "hash")))
    fresh = P.tables(P.parse_files(now.join(moved.where("state <> 'removed'").select("path"), "path", "left_semi"), registry))
    fresh["nodes"] = unique_nodes(fresh["nodes"])
    for w in fresh["files"].where("warning is not null").orderBy("path").collect():
        warnings.warn(f"{w['path']}: {w['warning']}", stacklevel=2)
    # a file that can't be parsed any more loses its old rows; one that never could changes nothing
    gone = cut(before.select("path").join(moved.select("path"), "path", "left_semi"))
    reparsed, evicted = fresh["files"].count(), gone.join(fresh["files"].select("path"), "path", "left_anti").count()
    if not full and not reparsed and not evicted and store.current() is not None:
        return Stats(**_sizes(store), reparsed=0, evicted=0)
    tables = fresh if full else store.replaced(fresh, gone)
    tables = {k: cut(v) for k, v in tables.items()}
    edges = cut(resolve(tables["nodes"], tables["raw_calls"], tables["imports"], deep, registry.families()))
    meta = {"last_build_type": "full" if full else "incremental"}
    commit = git.head(root)
    store.write(tables | {"edges": edges} | derived(store, tables, edges), meta | ({"built_at_commit": commit} if commit else {}))
    return Stats(**_sizes(store), reparsed=reparsed, evicted=evicted)


def _sizes(store: Store) -> dict[str, int]:
    return store.counts()


def build(store: Store, root: str, **options) -> Stats:
    return sync(store, root, full=True, **options)


def update(store: Store, root: str, **options) -> Stats:
    return sync(store, root, full=False, **options)


@dataclass(frozen=True)
class Member:
    """A repository of a federation: its label and its store's folder."""

    label: str
    store: str

    @classmethod
    def of(cls, spec: str) -> "Member":
        """From label=path, or a path whose last part is the label; a source tree stands for the store in it."""
        label, given, path = spec.partition("=")
        if not given:
            path = spec
            label = os.path.basename(os.path.abspath(spec))
            if label == "graph" and os.path.basename(os.path.dirname(os.path.abspath(spec))) == ".codelattice":
                label = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(spec))))
        if not label or not path:
            raise ValueError(f"bad repository `{spec}`; use label=path or path")
        inner = os.path.join(path, ".codelattice", "graph")
        return cls(label, inner if os.path.isdir(inner) else path)


def federate(spark: SparkSession, members: list[Member], out: Store) -> dict[str, int]:
    """One graph of several: names get their repository's label, and calls that a file imports across are joined."""
    if len(members) < 2:
        raise ValueError("a federation needs at least two repositories")
    if len({m.label for m in members}) < len(members):
        raise ValueError("repository labels must differ")
    columns = {"nodes": ("qualified_name", "file"), "edges": ("source", "target"), "raw_calls": ("file", "caller"), "imports": ("file",), "files": ("path",)}
    parts: dict[str, DataFrame] = {}
    for m in members:
        store = Store(spark, m.store)
        for t, named in columns.items():
            one = store.table(t).withColumns({c: F.concat_ws("/", F.lit(m.label), F.col(c)) for c in named}).withColumn("repo", F.lit(m.label))
            parts[t] = parts[t].unionByName(one) if t in parts else one
    nodes = cut(parts["nodes"])
    cross = cut(federated(nodes, parts["raw_calls"], parts["imports"]))
    across = cross.select("source", "target", F.lit(CALLS).alias("kind"), "line", F.lit(0.5).alias("confidence"), F.lit(INFERRED).alias("tier"))
    edges = cut(conform(parts["edges"].drop("repo"), EDGES).unionByName(conform(across, EDGES)).dropDuplicates(["source", "target", "kind", "line"]))
    tables = {t: df.drop("repo") for t, df in parts.items()} | {"nodes": nodes.drop("repo"), "edges": edges}
    out.write(tables | derived(out, tables, edges), {"last_build_type": "federated", "federated_repos": ",".join(sorted(m.label for m in members))})
    return {"repos": len(members), "nodes": nodes.count(), "edges": edges.count(), "cross_edges": cross.count()}
