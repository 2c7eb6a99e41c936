"""Execution flows: entry points, forward searches from them, criticality, and what changes touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import has_framework_decorator, is_security_relevant, is_test_file, matches_entry_name, round4
from .traverse import breadth_first

MAX_DEPTH, MAX_NODES = 10, 500


def entry_points(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions that nothing calls or that a framework calls, tests left out."""
    called = edges.filter("kind = 'CALLS'").select(F.col("target_qualified").alias("called")).distinct()
    own = nodes.filter("kind IN ('Function', 'Test') AND NOT is_test").filter(~is_test_file())
    decorated = has_framework_decorator() if "extra" in nodes.columns else F.lit(False)
    return own.join(called, own["qualified_name"] == called["called"], "left").filter(F.col("called").isNull() | decorated | matches_entry_name()).drop("called")


def call_links(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'CALLS'").select(F.col("source_qualified").alias("from"), F.col("target_qualified").alias("to"), F.col("id").alias("ord"))


def bfs_flow(nodes: DataFrame, edges: DataFrame, entries: DataFrame, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> DataFrame:
    """(entry, node, depth, pos): existing nodes reached from each entry over calls."""
    return breadth_first(entries.select(F.col("qualified_name").alias("entry")), call_links(edges), max_depth, max_nodes, nodes)


def flow_criticality(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(entry, node_count, file_count, criticality); members: (entry, name, qualified_name, file_path) of each flow."""
    tested = edges.filter("kind = 'TESTED_BY'").select(F.col("target_qualified").alias("qualified_name"), F.lit(True).alias("tested")).distinct()
    marked = members.join(tested, "qualified_name", "left").withColumn("secure", is_security_relevant("name", "qualified_name"))
    out = marked.groupBy("entry").agg(F.count(F.lit(1)).alias("node_count"), F.count_distinct("file_path").alias("file_count"), F.max(F.when(F.col("secure"), 1).otherwise(0)).alias("s"), F.max(F.when(F.col("tested"), 1).otherwise(0)).alias("t"))
    score = F.least(F.col("node_count") / 100, F.lit(0.3)) + F.least(F.col("file_count") / 10, F.lit(0.3)) + F.col("s") * 0.3 + F.col("t") * 0.1
    return out.select("entry", "node_count", "file_count", round4(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).alias("criticality"))


def detect_flows(nodes: DataFrame, edges: DataFrame, max_depth: int = MAX_DEPTH, max_nodes: int = MAX_NODES) -> tuple[DataFrame, DataFrame]:
    """(flows, memberships). Flows of one node are dropped; depth is the number of nodes less one; a flow has the id of
    its entry point; memberships are made anew, so none is stale."""
    reached = bfs_flow(nodes, edges, entry_points(nodes, edges), max_depth, max_nodes)
    info = nodes.select(F.col("qualified_name").alias("node"), F.col("id").alias("node_id"), "name", "file_path")
    full = reached.join(info, "node")
    scored = flow_criticality(full.withColumn("qualified_name", F.col("node")), edges).filter("node_count >= 2")
    paths = full.groupBy("entry").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node"))), lambda x: x["node"]).alias("path"))
    entry = nodes.select(F.col("qualified_name").alias("entry"), F.col("id").alias("entry_point_id"), "name")
    flows = scored.join(entry, "entry").join(paths, "entry").select(F.col("entry_point_id").alias("id"), "name", "entry_point_id", (F.col("node_count") - 1).alias("depth"), "node_count", "file_count", "criticality", "path")
    memberships = full.join(scored.select("entry"), "entry", "left_semi").join(entry.select("entry", F.col("entry_point_id").alias("flow_id")), "entry").select("flow_id", "node_id", F.col("pos").alias("position"))
    return flows, memberships


def flow_criticalities_for_node(flows: DataFrame, memberships: DataFrame, node_id: int) -> DataFrame:
    return memberships.filter(F.col("node_id") == node_id).join(flows, memberships["flow_id"] == flows["id"]).select("flow_id", "criticality")


def flow_qualified_names(nodes: DataFrame, memberships: DataFrame, flow_id: int) -> DataFrame:
    return memberships.filter(F.col("flow_id") == flow_id).join(nodes, memberships["node_id"] == nodes["id"]).select("position", "qualified_name")


def count_flow_memberships(memberships: DataFrame) -> DataFrame:
    return memberships.groupBy("node_id").agg(F.count(F.lit(1)).alias("flow_count"))


def affected_flows(nodes: DataFrame, flows: DataFrame, memberships: DataFrame, files: list[str]) -> DataFrame:
    """Flows with a node in one of the files, most critical first."""
    ids = nodes.filter(F.col("file_path").isin(files)).select(F.col("id").alias("node_id"))
    hit = memberships.join(ids, "node_id", "left_semi").select(F.col("flow_id").alias("id")).distinct()
    return flows.join(hit, "id", "left_semi").orderBy(F.desc("criticality"), "id")


def flows_through(flows: DataFrame, names: list[str]) -> DataFrame:
    """Flows whose path holds one of the names."""
    return flows.filter(F.arrays_overlap("path", F.array(*(F.lit(n) for n in names)))).orderBy(F.desc("criticality"), "id")
