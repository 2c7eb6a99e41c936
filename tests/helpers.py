"""Small graphs for unit tests."""

from graphloom.schema import EDGES, NODES


def nodes(spark, rows):
    """rows: dicts; what is left out gets a default."""
    out = []
    for i, r in enumerate(rows):
        kind, path, name = r.get("kind", "Function"), r.get("file_path", "src/f.py"), r["name"]
        d = {"id": i + 1, "kind": kind, "name": name, "qualified_name": path if kind == "File" else f"{path}::{name}", "file_path": path, "line_start": 1, "line_end": 10, "language": "python", "is_test": False, "extra": "{}"} | r
        out.append(tuple(d.get(f) for f in NODES.fieldNames()))
    return spark.createDataFrame(out, NODES)


def edges(spark, rows):
    """rows: (kind, source, target) or longer dicts."""
    out = []
    for i, r in enumerate(rows):
        d = r if isinstance(r, dict) else dict(zip(("kind", "source_qualified", "target_qualified"), r, strict=True))
        d = {"id": i + 1, "file_path": "src/f.py", "line": 5, "extra": "{}", "confidence": 1.0, "confidence_tier": "EXTRACTED"} | d
        out.append(tuple(d.get(f) for f in EDGES.fieldNames()))
    return spark.createDataFrame(out, EDGES)


def q(name, path="src/f.py"):
    return f"{path}::{name}"
