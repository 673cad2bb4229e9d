"""Files to rows: each is parsed once, where it was read, and gives its nodes, call sites and imports."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..frontends.base import parse
from ..frontends.registry import Registry
from ..lineage import cut

PARSED = f"path string, hash string, language string, warning string, nodes array<struct<{schema.NODES.replace(' string', ':string').replace(' int', ':int').replace(' boolean', ':boolean')}>>, raw_calls array<struct<file:string,caller:string,callee:string,line:int,qualifier:string,ord:long>>, imports array<struct<file:string,name:string,module:string>>"


def parse_files(files: DataFrame, registry: Registry) -> DataFrame:
    """One row for each (path, extension, hash, content); files that aren't text or can't be parsed have a warning and no language."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, extension, digest, content in zip(frame["path"], frame["extension"], frame["hash"], frame["content"]):
                row = {"path": path, "hash": digest, "language": None, "warning": None, "nodes": [], "raw_calls": [], "imports": []}
                language = registry.of(extension)
                try:
                    if language is not None:
                        row |= parse(language, path, bytes(content).decode("utf-8")) | {"language": language.name}
                except Exception as e:  # one bad file must not end a build
                    row["warning"] = f"not parsed: {e}"
                out.append(row)
            yield pd.DataFrame(out, columns=["path", "hash", "language", "warning", "nodes", "raw_calls", "imports"])

    return files.mapInPandas(run, PARSED)


def tables(parsed: DataFrame) -> dict[str, DataFrame]:
    """files, nodes, raw_calls and imports of parsed files that have a language."""
    kept = cut(parsed.where("language is not null"))
    out = {"files": kept.select("path", "hash", "language", "warning")}
    for name in ("nodes", "raw_calls", "imports"):
        out[name] = kept.select(F.explode(name).alias("r")).select("r.*")
    return out
