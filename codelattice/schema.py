"""Tables of a code graph, and the values that its columns take."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VERSION = 5

# Kinds of nodes and edges, and the tiers of evidence.
FUNCTION, TEST, TYPE, FILE, SELECTOR, ANCHOR = "Function", "Test", "Type", "File", "Selector", "Anchor"
CALLS, TESTED_BY = "CALLS", "TESTED_BY"
EXTRACTED, INFERRED, AMBIGUOUS = "EXTRACTED", "INFERRED", "AMBIGUOUS"
#: Tiers that drive analysis; ambiguous edges are stored and counted, never followed.
ASSERTED = (EXTRACTED, INFERRED)

FILES = "path string, hash string, language string, warning string"
NODES = "qualified_name string, kind string, name string, file string, line_start int, line_end int, language string, signature string, doc string, is_test boolean"
IMPORTS = "file string, name string, module string"
RAW_CALLS = "file string, caller string, callee string, line int, qualifier string, ord long"
EDGES = "source string, target string, kind string, line int, confidence double, tier string"
COMMUNITIES = "id long, size long, label string"
MEMBERS = "node string, community_id long"
FLOWS = "id long, entry string, size long, criticality double"
FLOW_MEMBERS = "flow_id long, node string"

TABLES = {"files": FILES, "nodes": NODES, "imports": IMPORTS, "raw_calls": RAW_CALLS, "edges": EDGES, "communities": COMMUNITIES, "community_members": MEMBERS, "flows": FLOWS, "flow_memberships": FLOW_MEMBERS}


def conform(df: DataFrame, schema: str) -> DataFrame:
    """df with the columns of a table in their order and types; a column that an older version lacks is null."""
    wanted = T.StructType.fromDDL(schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted])


def asserted(edges: DataFrame, kind: str | None = None) -> DataFrame:
    """Edges with enough evidence to be followed, of one kind if it is given."""
    out = edges.where(F.col("tier").isin(*ASSERTED))
    return out.where(F.col("kind") == kind) if kind else out
