"""Graph traversal: level-synchronous breadth-first searches from many starts at once."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

IMPACT_KINDS = ("CALLS", "IMPORTS_FROM", "DEPENDS_ON")


def shared_dir(spark) -> str:
    """The folder that driver and executors share, or a local one where the session names none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        import tempfile

        path = "file://" + tempfile.mkdtemp(prefix="graphloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write a loop's state to the shared folder and read it back, so plans stay short and lost executors don't matter."""
    path = f"{shared_dir(df.sparkSession)}/graphloom/level-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def breadth_first(starts: DataFrame, links: DataFrame, max_depth: int, max_nodes: int, known: DataFrame | None = None) -> DataFrame:
    """(entry, node, depth, pos) of all nodes reached from each entry, in the order of a queue.

    starts: (entry). links: (from, to, ord), ord being the order in which a node's links are followed. known: nodes to
    which the search is confined. The first place in the queue wins, at most ``max_nodes`` are kept for each entry, and
    nodes at ``max_depth`` are not left again. Each level is a join, an anti-join and a rank within its entry.
    """
    level = starts.select("entry", F.col("entry").alias("node"), F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("pos"))
    if known is not None:
        links = links.join(known.select(F.col("qualified_name").alias("to")), "to", "left_semi").select("from", "to", "ord")
    links = links.groupBy("from", "to").agg(F.min("ord").alias("ord"))
    seen = level = cut(level)
    for depth in range(1, max_depth + 1):
        reached = level.join(links, level["node"] == links["from"]).groupBy("entry", F.col("to").alias("node")).agg(F.min(F.struct("pos", "ord")).alias("by"))
        fresh = reached.join(seen.select("entry", "node"), ["entry", "node"], "left_anti")
        had = seen.groupBy("entry").agg(F.count(F.lit(1)).alias("had"))
        place = F.row_number().over(Window.partitionBy("entry").orderBy("by", "node"))
        level = fresh.withColumn("r", place).join(had, "entry").select("entry", "node", F.lit(depth).cast("long").alias("depth"), (F.col("had") + F.col("r") - 1).cast("long").alias("pos")).filter(F.col("pos") < max_nodes)
        level = cut(level)
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen


def impact_radius(edges: DataFrame, qualified_name: str, max_depth: int = 5, max_nodes: int = 100) -> DataFrame:
    """Names that depend on a name over calls, imports and dependencies, nearest first; the start is left out."""
    spark = edges.sparkSession
    links = edges.filter(F.col("kind").isin(*IMPACT_KINDS)).select(F.col("target_qualified").alias("from"), F.col("source_qualified").alias("to"), F.col("id").alias("ord"))
    starts = spark.createDataFrame([(qualified_name,)], "entry string")
    found = breadth_first(starts, links, max_depth, max_nodes + 1)
    return found.filter("depth > 0").select(F.col("node").alias("qualified_name"), "depth", F.col("pos").alias("position"))


def transitive_tests(edges: DataFrame, qualified_name: str) -> DataFrame:
    """Sources of test links to a name, then callers whose name holds "test" or "spec" and that are not among them."""
    direct = edges.filter((F.col("kind") == "TESTED_BY") & (F.col("target_qualified") == qualified_name)).select(F.col("source_qualified").alias("qualified_name"), F.lit("direct").alias("via"))
    lower = F.lower("source_qualified")
    callers = edges.filter((F.col("kind") == "CALLS") & (F.col("target_qualified") == qualified_name) & (lower.contains("test") | lower.contains("spec"))).select(F.col("source_qualified").alias("qualified_name")).distinct()
    return direct.unionByName(callers.join(direct, "qualified_name", "left_anti").withColumn("via", F.lit("caller")))


def query_graph(edges: DataFrame, pattern: str, qualified_name: str) -> DataFrame:
    """(qualified_name, kind) by pattern: callers_of, dependents_of, callees_of, imports_of or tests_for."""
    if pattern in ("callers_of", "dependents_of"):
        return edges.filter(F.col("target_qualified") == qualified_name).select(F.col("source_qualified").alias("qualified_name"), "kind")
    if pattern in ("callees_of", "imports_of"):
        return edges.filter(F.col("source_qualified") == qualified_name).select(F.col("target_qualified").alias("qualified_name"), "kind")
    if pattern == "tests_for":
        return transitive_tests(edges, qualified_name).select("qualified_name", F.lit("TESTED_BY").alias("kind"))
    raise ValueError(f"unknown pattern: {pattern}")


def subgraph(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Edges whose two ends are among ``names`` (qualified_name)."""
    n = names.select("qualified_name").distinct()
    return edges.join(n.toDF("source_qualified"), "source_qualified", "left_semi").join(n.toDF("target_qualified"), "target_qualified", "left_semi")


def unresolved_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls whose target is no node."""
    return edges.filter("kind = 'CALLS'").join(nodes.select(F.col("qualified_name").alias("target_qualified")), "target_qualified", "left_anti")


def resolve_calls(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """All edges, with bare call targets replaced where exactly one function, method, class or test has the name."""
    unique = nodes.filter("kind IN ('Function', 'Method', 'Class', 'Test')").groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("qualified_name").alias("resolved")).filter("n = 1").select("name", "resolved")
    have = nodes.select(F.col("qualified_name").alias("have")).distinct()
    e = edges.join(have, edges["target_qualified"] == have["have"], "left").join(unique, edges["target_qualified"] == unique["name"], "left")
    target = F.when((F.col("kind") == "CALLS") & F.col("have").isNull(), F.coalesce("resolved", "target_qualified")).otherwise(F.col("target_qualified"))
    return e.select(*(target.alias(c) if c == "target_qualified" else edges[c] for c in edges.columns))
