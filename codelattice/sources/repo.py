"""Source trees as tables: what to read is decided by a walk, the reading is Spark's."""

from __future__ import annotations

import os
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ignore


@dataclass(frozen=True)
class SourceFile:
    path: str
    rel: str
    extension: str


def _rules_at(folder: str, rel: str) -> list[tuple[str, list[ignore.Rule]]]:
    names = [*((os.path.join(".git", "info", "exclude"),) if not rel else ()), *ignore.RULE_FILES]
    out = []
    for name in names:
        try:
            with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                out.append((rel, ignore.rules(f.read())))
        except OSError:
            continue
    return out


def walk(root: str) -> Iterator[SourceFile]:
    """Files under root that belong to its repository, by directory; links aren't followed, unreadable folders warn."""

    def visit(folder: str, rel: str, levels: list) -> Iterator[SourceFile]:
        levels = levels + _rules_at(folder, rel)
        try:
            entries = sorted(os.scandir(folder), key=lambda e: e.name)
        except OSError as e:
            warnings.warn(f"walk: {e}", stacklevel=2)
            return
        for e in entries:
            inner = f"{rel}/{e.name}" if rel else e.name
            if e.is_symlink():
                continue
            if e.is_dir():
                own = e.name in ignore.SKIP_DIRS or os.path.exists(os.path.join(e.path, ".git"))  # a nested repository is another's
                if not own and not ignore.ignored(inner, True, levels):
                    yield from visit(e.path, inner, levels)
            elif e.is_file() and not ignore.ignored(inner, False, levels):
                yield SourceFile(e.path, inner, os.path.splitext(e.name)[1][1:].lower())

    yield from visit(root, "", [])


def collect(root: str, extensions: Sequence[str]) -> list[SourceFile]:
    """Files of known extensions, sorted by path from the root."""
    wanted = set(extensions)
    return sorted((f for f in walk(root) if f.extension in wanted), key=lambda f: f.rel)


def _plain(path: str) -> str:
    """A path in which no character is a glob's."""
    return "file://" + "".join("\\" + c if c in "\\{}[]*?" else c for c in path)


def read_files(spark: SparkSession, root: str, files: Sequence[SourceFile]) -> DataFrame:
    """path (from the root), extension, hash, content of listed files; each task reads a share of them."""
    root = os.path.abspath(root)
    if not files:
        warnings.warn(f"no source files under {root}", stacklevel=2)
        return spark.createDataFrame([], "path string, extension string, hash string, content binary")
    listed = spark.createDataFrame([(f.rel, f.extension) for f in files], "path string, extension string")
    read = spark.read.format("binaryFile").load([_plain(os.path.join(root, f.rel)) for f in files])
    local = F.regexp_replace("path", "^file:/*", "/")
    found = read.select(F.substring(local, len(root) + 2, 1 << 30).alias("path"), "content")
    return found.join(listed, "path").select("path", "extension", F.sha2("content", 256).alias("hash"), "content")
