"""Adds the server to assistants' configuration files; what else they hold stays."""

from __future__ import annotations

import json
import os
import re
import sys
import tomllib

NAME = "codelattice"
# Each assistant's file under the home folder, its format and the key of its servers.
PLATFORMS = {
    "claude": (".claude.json", "json", "mcpServers"), "cursor": (".cursor/mcp.json", "json", "mcpServers"), "windsurf": (".codeium/windsurf/mcp_config.json", "json", "mcpServers"),
    "vscode": (".vscode/mcp.json", "json", "servers"), "gemini": (".gemini/settings.json", "json", "mcpServers"), "zed": (".config/zed/settings.json", "json", "context_servers"), "codex": (".codex/config.toml", "toml", "mcp_servers"),
}


def entry() -> dict:
    return {"command": sys.executable, "args": ["-m", "codelattice.cli", "serve"]}


def merged_json(text: str, key: str) -> str:
    """The file with our entry under the key; text that isn't a JSON object is refused."""
    data = json.loads(text) if text.strip() else {}
    if not isinstance(data, dict) or not isinstance(data.get(key, {}), dict):
        raise ValueError("the file holds no JSON object to add to")
    data[key] = data.get(key, {}) | {NAME: entry()}
    return json.dumps(data, indent=2, ensure_ascii=False) + "\n"


def merged_toml(text: str, key: str) -> str:
    """The file with our table, in the place of an older one."""
    tomllib.loads(text)
    head = f"[{key}.{NAME}]"
    rest = re.sub(rf"(?ms)^{re.escape(head)}\n.*?(?=^\[|\Z)", "", text).rstrip()
    table = [head, *(f"{k} = {json.dumps(v)}" for k, v in entry().items())]
    return (rest + "\n\n" if rest else "") + "\n".join(table) + "\n"


def run(platform: str, home: str, dry_run: bool = False) -> int:
    """Writes one platform's file, or those of all that have a folder here. 1 if a file couldn't be read."""
    if platform not in (*PLATFORMS, "all"):
        raise SystemExit(f"unknown platform {platform}; use all or one of {', '.join(PLATFORMS)}")
    failed = 0
    for name, (rel, kind, key) in PLATFORMS.items():
        path = os.path.join(home, rel)
        here = os.path.exists(path) or os.path.isdir(os.path.dirname(path)) and os.path.dirname(path) != home
        if platform not in (name, "all") or platform == "all" and not here:
            continue
        try:
            with open(path, encoding="utf-8") as f:
                old = f.read()
        except FileNotFoundError:
            old = ""
        try:
            new = (merged_json if kind == "json" else merged_toml)(old, key)
        except ValueError as e:
            print(f"{name}: left alone, {path}: {e}", file=sys.stderr)
            failed = 1
            continue
        if new == old:
            print(f"{name}: unchanged {path}")
            continue
        print(f"{name}: {'would write' if dry_run else 'wrote'} {path}")
        if not dry_run:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            with open(path, "w", encoding="utf-8") as f:
                f.write(new)
    return failed
