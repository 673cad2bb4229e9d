"""The graph as JSON, the same bytes for the same graph."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import functions as F

from .review import round_half_up
from .schema import VERSION
from .store import Store


def _rows(df) -> Iterator[dict]:
    for r in df.toLocalIterator():
        yield r.asDict()


def export_json(store: Store) -> Iterator[str]:
    """Pieces of the document: nodes by name, edges by source, target, kind and line; keys in a fixed order, nothing held but a partition."""
    members = store.table("community_members").select(F.col("node").alias("qualified_name"), "community_id")
    nodes = store.table("nodes").join(members, "qualified_name", "left").orderBy("qualified_name")
    edges = store.table("edges").orderBy("source", "target", "kind", "line")
    yield f'{{\n  "directed": true,\n  "schema_version": {VERSION},\n  "built_at_commit": {json.dumps(store.meta().get("built_at_commit") or None)},\n  "nodes": ['
    for k, n in enumerate(_rows(nodes)):
        row = {"id": n["qualified_name"], "kind": n["kind"], "language": n["language"], "file": n["file"], "line": n["line_start"], "signature": n["signature"], "is_test": n["is_test"], "community": n["community_id"]}
        yield ("," if k else "") + "\n    " + json.dumps(row, ensure_ascii=False)
    yield '\n  ],\n  "edges": ['
    for k, e in enumerate(_rows(edges)):
        row = {"source": e["source"], "target": e["target"], "kind": e["kind"], "line": e["line"], "confidence": round_half_up(e["confidence"]), "tier": e["tier"]}
        yield ("," if k else "") + "\n    " + json.dumps(row, ensure_ascii=False)
    yield "\n  ]\n}\n"
