"""The data model: two core tables (nodes, edges) and the tables derived from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 9
NODE_KINDS = ("File", "Class", "Function", "Type", "Test")
EDGE_KINDS = ("CALLS", "IMPORTS_FROM", "INHERITS", "IMPLEMENTS", "CONTAINS", "TESTED_BY", "DEPENDS_ON", "REFERENCES")
#: Declared weights of edge kinds, for weighted variants.
EDGE_WEIGHTS = {"CALLS": 1.0, "IMPORTS_FROM": 0.5, "INHERITS": 0.8, "IMPLEMENTS": 0.7, "CONTAINS": 0.3, "TESTED_BY": 0.4, "DEPENDS_ON": 0.6}

_S, _L, _D, _B = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()


def _struct(*fields):
    return T.StructType([T.StructField(n, t, null) for n, t, null in fields])


NODES = _struct(
    ("id", _L, True), ("kind", _S, False), ("name", _S, False), ("qualified_name", _S, False), ("file_path", _S, False),
    ("line_start", _L, True), ("line_end", _L, True), ("language", _S, True), ("parent_name", _S, True), ("params", _S, True),
    ("return_type", _S, True), ("modifiers", _S, True), ("is_test", _B, True), ("file_hash", _S, True), ("extra", _S, True),
    ("updated_at", _D, True), ("signature", _S, True), ("community_id", _L, True),
)
EDGES = _struct(
    ("id", _L, True), ("kind", _S, False), ("source_qualified", _S, False), ("target_qualified", _S, False), ("file_path", _S, False),
    ("line", _L, True), ("extra", _S, True), ("confidence", _D, True), ("confidence_tier", _S, True), ("updated_at", _D, True),
)
METADATA = _struct(("key", _S, False), ("value", _S, True))
FLOWS = _struct(
    ("id", _L, False), ("name", _S, False), ("entry_point_id", _L, False), ("depth", _L, False), ("node_count", _L, False),
    ("file_count", _L, False), ("criticality", _D, False), ("path", T.ArrayType(_S), True), ("created_at", T.TimestampType(), True), ("updated_at", T.TimestampType(), True),
)
FLOW_MEMBERSHIPS = _struct(("flow_id", _L, False), ("node_id", _L, False), ("position", _L, False))
COMMUNITIES = _struct(
    ("id", _L, False), ("name", _S, False), ("level", _L, True), ("parent_id", _L, True), ("cohesion", _D, True),
    ("size", _L, True), ("dominant_language", _S, True), ("description", _S, True), ("created_at", T.TimestampType(), True),
)
COMMUNITY_SUMMARIES = _struct(("community_id", _L, False), ("name", _S, True), ("purpose", _S, True), ("key_symbols", T.ArrayType(_S), True), ("risk", _S, True), ("size", _L, True), ("dominant_language", _S, True))
FLOW_SNAPSHOTS = _struct(("flow_id", _L, False), ("name", _S, True), ("entry_point", _S, True), ("critical_path", _S, True), ("criticality", _D, True), ("node_count", _L, True), ("file_count", _L, True))
RISK_INDEX = _struct(("node_id", _L, False), ("qualified_name", _S, True), ("risk_score", _D, True), ("caller_count", _L, True), ("test_coverage", _S, True), ("security_relevant", _B, True), ("last_computed", _S, True))
EMBEDDINGS = _struct(("qualified_name", _S, False), ("vector", T.ArrayType(T.FloatType()), False), ("text_hash", _S, False), ("provider", _S, False))
TABLES = {
    "nodes": NODES, "edges": EDGES, "metadata": METADATA, "flows": FLOWS, "flow_memberships": FLOW_MEMBERSHIPS, "communities": COMMUNITIES,
    "community_summaries": COMMUNITY_SUMMARIES, "flow_snapshots": FLOW_SNAPSHOTS, "risk_index": RISK_INDEX, "embeddings": EMBEDDINGS,
}
DEFAULTS = {"line_start": 0, "line_end": 0, "language": "", "is_test": False, "extra": "{}", "line": 0, "confidence": 1.0, "confidence_tier": "EXTRACTED", "file_hash": "", "updated_at": 0.0}


def ensure_columns(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Bring an older snapshot to ``schema``: missing columns appear with their default, types are cast; idempotent."""
    have = set(df.columns)
    cols = []
    for f in schema.fields:
        default = F.lit(DEFAULTS.get(f.name)).cast(f.dataType)
        value = F.col(f"`{f.name}`").cast(f.dataType) if f.name in have else default
        cols.append((F.coalesce(value, default) if f.name in DEFAULTS else value).alias(f.name))
    return df.select(*cols)


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns
