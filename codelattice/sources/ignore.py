"""Ignore rules of source trees: patterns with anchors, globs and negation, the last match in the nearest file winning."""

from __future__ import annotations

import re
from dataclasses import dataclass

# Directories that hold no source of the repository, and the names of rule files.
SKIP_DIRS = ("target", ".git", ".codelattice", "node_modules", ".venv", "venv", "__pycache__", "dist", "build", ".mypy_cache", ".pytest_cache")
RULE_FILES = (".gitignore", ".codelatticeignore")


def glob_regex(glob: str) -> str:
    """A glob of path segments as a regular expression: * and ? stay within a segment, ** spans segments."""
    out, i = [], 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out.append("(?:[^/]+/)*")
            i += 3
        elif glob.startswith("/**", i) and i + 3 == len(glob):
            out.append("/.+")
            i += 3
        elif glob[i] == "*":
            while i < len(glob) and glob[i] == "*":
                i += 1
            out.append("[^/]*")
        elif glob[i] == "?":
            out.append("[^/]")
            i += 1
        elif glob[i] == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inside = glob[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inside[1:] if inside[0] in "!^" else inside) + "]")
            i = end + 1
        else:
            if glob[i] == "\\" and i + 1 < len(glob):
                i += 1
            out.append(re.escape(glob[i]))
            i += 1
    return "".join(out)


@dataclass(frozen=True)
class Rule:
    pattern: re.Pattern
    keep: bool
    dirs_only: bool


def rules(text: str) -> list[Rule]:
    """The rules of one file, in order; blank lines and comments aren't rules, nor are patterns that can't be read."""
    out = []
    for line in text.splitlines():
        line = line.removesuffix("\r")
        if not line.endswith("\\ "):
            line = line.rstrip(" ")
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        glob = line[1:] if keep else line
        dirs_only, glob = glob.endswith("/"), glob.rstrip("/")
        anchored = "/" in glob
        glob = glob.lstrip("/")
        if not glob:
            continue
        try:
            out.append(Rule(re.compile(("" if anchored else "(?:.*/)?") + glob_regex(glob)), keep, dirs_only))
        except re.error:
            continue
    return out


def ignored(path: str, is_dir: bool, levels: list[tuple[str, list[Rule]]]) -> bool:
    """Whether rules leave out a path, relative to the root. levels: (directory, rules) from the root inward."""
    for folder, found in reversed(levels):
        inner = path[len(folder) + 1 :] if folder else path
        for rule in reversed(found):
            if (is_dir or not rule.dirs_only) and rule.pattern.fullmatch(inner):
                return not rule.keep
    return False
