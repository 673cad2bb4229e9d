"""Answers over standard input and output: one JSON-RPC message a line, the tools of a code-review assistant."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from typing import IO

from . import __version__
from .operators import search
from .review import CHANGE_LIMIT, DEPTH, Review
from .sources import git
from .store import Store

# The protocol's version and error codes, and the limit of a search.
PROTOCOL, PARSE_ERROR, NO_METHOD, SEARCH_LIMIT = "2024-11-05", -32700, -32601, 20
TEXT, SYMBOL = {"type": "string"}, {"symbol": {"type": "string", "description": "qualified name, file::Symbol"}}
PATTERNS = ["callers_of", "callees_of", "tests_for", "impact_of", "community_of", "file_summary"]


def tool(description: str, properties: dict | None = None, required: Iterable[str] = ()) -> dict:
    schema: dict = {"type": "object", "properties": properties or {}}
    if required:
        schema["required"] = list(required)
    return {"description": description, "inputSchema": schema}


TOOLS = {
    "get_minimal_context": tool("Size of the graph, its five riskiest symbols, and which tools go on from there."),
    "get_review_context": tool("A symbol's head, risk, and the first of those around it.", SYMBOL | {"detail_level": {"type": "string", "enum": ["minimal", "standard"]}}, ["symbol"]),
    "detect_changes": tool("The riskiest symbols in files that differ from a commit.", {"base": TEXT, "limit": {"type": "integer"}}, ["base"]),
    "impact": tool("All that depends on a symbol (reverse) or that it depends on (forward), so many steps away.", SYMBOL | {"depth": {"type": "integer"}, "direction": {"type": "string", "enum": ["reverse", "forward"]}}, ["symbol"]),
    "search": tool("Full names of symbols that hold all the words.", {"query": TEXT, "limit": {"type": "integer"}}, ["query"]),
    "query_graph": tool("The neighbours of a symbol of one kind.", SYMBOL | {"pattern": {"type": "string", "enum": PATTERNS}}, ["pattern", "symbol"]),
    "architecture": tool("Groups of symbols that call each other, with their most called members."),
}


def token_estimate(text: str) -> int:
    return len(text.encode()) // 4


class Server:
    """Tools over one store; with an allowlist only those in it exist."""

    def __init__(self, store: Store, root: str, allow: Iterable[str] | None = None, hybrid: bool = False):
        self.store, self.root, self.hybrid = store, root, hybrid
        self.tools = {n: t for n, t in TOOLS.items() if allow is None or n in set(allow)}

    def handle(self, request: dict) -> dict | None:
        """The reply to a message; none to a notification."""
        if request.get("id") is None:
            return None
        method = request.get("method", "")
        answers: dict[str, Callable[[], dict]] = {
            "initialize": lambda: {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "codelattice", "version": __version__}},
            "ping": dict,
            "tools/list": lambda: {"tools": [{"name": n} | t for n, t in self.tools.items()]},
        }
        reply: dict = {"jsonrpc": "2.0", "id": request["id"]}
        if method in answers:
            return reply | {"result": answers[method]()}
        params = request.get("params") or {}
        if method == "tools/call" and params.get("name") in self.tools:
            return reply | {"result": self._call(params["name"], params.get("arguments") or {})}
        why = f"no such tool: {params.get('name')}" if method == "tools/call" else f"method not found: {method}"
        return reply | {"error": {"code": NO_METHOD, "message": why}}

    def _call(self, name: str, args: dict) -> dict:
        """The answer of a tool as text, or why there is none; either is a result of the call."""
        try:
            payload, failed = self.answer(name, args), False
        except Exception as e:
            payload, failed = {"error": str(e)}, True
        payload["_meta"] = {"token_estimate": token_estimate(json.dumps(payload, indent=2, ensure_ascii=False)), "tokenizer": "bytes / 4 (estimate)"}
        return {"content": [{"type": "text", "text": json.dumps(payload, indent=2, ensure_ascii=False)}], "isError": failed}

    def answer(self, name: str, args: dict) -> dict:
        review, symbol = Review(self.store), str(args.get("symbol", ""))
        if name == "get_minimal_context":
            return review.overview()
        if name == "get_review_context":
            return review.context(symbol, args.get("detail_level", "minimal"))
        if name == "detect_changes":
            base = args.get("base", "HEAD")
            return review.changes(git.changed_files(self.root, base), base, int(args.get("limit", CHANGE_LIMIT)))
        if name == "impact":
            depth, forward = int(args.get("depth", DEPTH)), args.get("direction") == "forward"
            return {"symbol": symbol, "direction": "forward" if forward else "reverse", "depth": depth, "nodes": review.impact(symbol, depth, forward)}
        if name == "search":
            query, limit = str(args.get("query", "")), int(args.get("limit", SEARCH_LIMIT))
            hits = search.hybrid_search(review.nodes, review.edges, query, limit) if self.hybrid else search.text_search(review.nodes, query, limit)
            found = [r["id"] for r in hits.collect()]
            return {"query": query, "mode": "hybrid" if self.hybrid else "fts", "count": len(found), "symbols": found}
        if name == "architecture":
            return review.architecture()
        pattern = str(args.get("pattern", ""))
        key = {"callers_of": "callers", "callees_of": "callees", "tests_for": "tests", "impact_of": "impact", "community_of": "community_members", "file_summary": "symbols"}
        return {"symbol": symbol, key.get(pattern, "nodes"): review.neighbours(pattern, symbol)}

    def run(self, source: IO[str], sink: IO[str]) -> None:
        """Until the input ends; blank lines are skipped."""
        for line in source:
            if not line.strip():
                continue
            try:
                reply = self.handle(json.loads(line))
            except json.JSONDecodeError as e:
                reply = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE_ERROR, "message": str(e)}}
            if reply is not None:
                sink.write(json.dumps(reply, ensure_ascii=False) + "\n")
                sink.flush()
