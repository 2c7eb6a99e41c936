"""Aggregates over the graph: statistics, hubs, bridges, coupling, gaps and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import TEST_COMMUNITY, round4
from .lookup import get_all_call_targets

COUPLING_KINDS = ("CALLS", "IMPORTS_FROM", "DEPENDS_ON")


def get_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, item, n): totals, nodes and edges by kind, files and the distinct non-empty languages."""
    rows = lambda df, metric, item: df.groupBy(item.alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(metric).alias("metric"), "item", "n")
    total = lambda df, metric: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(metric).alias("metric"), F.lit("").alias("item"), "n")
    out = total(nodes, "total_nodes").unionByName(total(edges, "total_edges"))
    out = out.unionByName(rows(nodes, "nodes_by_kind", F.col("kind"))).unionByName(rows(edges, "edges_by_kind", F.col("kind")))
    out = out.unionByName(total(nodes.filter("kind = 'File'"), "files_count"))
    return out.unionByName(nodes.filter("language != ''").groupBy(F.col("language").alias("item")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("languages").alias("metric"), "item", F.lit(1).cast("long").alias("n")))


def incoming_calls(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'CALLS'").groupBy(F.col("target_qualified").alias("qualified_name")).agg(F.count(F.lit(1)).alias("call_count"))


def hub_nodes(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """Most-called names. The limit comes before the node lookup, so names without a node take places."""
    top = incoming_calls(edges).orderBy(F.desc("call_count"), "qualified_name").limit(limit)
    return F.broadcast(top).join(nodes.select("qualified_name", "name", "kind", "file_path"), "qualified_name").select("qualified_name", "name", "kind", "file_path", "call_count").orderBy(F.desc("call_count"), "qualified_name")


def bridge_nodes(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """Nodes whose call and import neighbours, with multiplicity, lie in other communities."""
    e = edges.filter(F.col("kind").isin("CALLS", "IMPORTS_FROM")).select("source_qualified", "target_qualified")
    both = e.toDF("me", "other").unionByName(e.select(F.col("target_qualified").alias("me"), F.col("source_qualified").alias("other")))
    mine = nodes.filter("kind != 'File' AND community_id IS NOT NULL").select(F.col("qualified_name").alias("me"), F.col("community_id").alias("c"))
    theirs = nodes.filter("community_id IS NOT NULL").select(F.col("qualified_name").alias("other"), F.col("community_id").alias("oc"))
    counted = both.join(mine, "me").join(theirs, "other", "left").groupBy("me").agg(F.count(F.lit(1)).alias("total_neighbors"), F.sum(F.when(F.col("oc") != F.col("c"), 1).otherwise(0)).alias("cross_community_edges")).filter("cross_community_edges > 0")
    scored = counted.withColumn("bridge_score", F.col("cross_community_edges") / F.col("total_neighbors"))
    top = scored.orderBy(F.desc("bridge_score"), F.desc("cross_community_edges"), "me").limit(limit)
    return top.join(nodes.select("qualified_name", "name", "kind", "file_path", "community_id"), top["me"] == nodes["qualified_name"]).select("qualified_name", "name", "kind", "file_path", "community_id", "bridge_score", "cross_community_edges", "total_neighbors").orderBy(F.desc("bridge_score"), F.desc("cross_community_edges"), "qualified_name")


def with_communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with the communities of both ends (null where an end has none); the lookup is a hash join on the name."""
    c = nodes.select("qualified_name", "community_id")
    src = c.toDF("source_qualified", "source_community")
    dst = c.toDF("target_qualified", "target_community")
    return edges.join(src, "source_qualified", "left").join(dst, "target_qualified", "left")


def community_cohesion(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Internal share of the edges that touch each community; a crossing edge counts for either side."""
    e = with_communities(nodes, edges).select("source_community", "target_community")
    sides = e.select(F.explode(F.when(F.col("source_community") == F.col("target_community"), F.array("source_community")).otherwise(F.array("source_community", "target_community"))).alias("community_id"), (F.col("source_community").eqNullSafe(F.col("target_community"))).alias("inside")).filter("community_id IS NOT NULL")
    counts = sides.groupBy("community_id").agg(F.sum(F.when(F.col("inside"), 1).otherwise(0)).alias("internal_edges"), F.sum(F.when(F.col("inside"), 0).otherwise(1)).alias("external_edges"))
    every = nodes.filter("community_id IS NOT NULL").select("community_id").distinct()
    out = every.join(counts, "community_id", "left").fillna(0, ["internal_edges", "external_edges"])
    touched = F.col("internal_edges") + F.col("external_edges")
    return out.withColumn("cohesion", F.when(touched == 0, 0.0).otherwise(round4(F.col("internal_edges") / touched)))


def cross_community_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges between each unordered pair of communities, test links left out."""
    e = with_communities(nodes, edges.filter("kind != 'TESTED_BY'")).filter("source_community != target_community")
    return e.groupBy(F.least("source_community", "target_community").alias("c1"), F.greatest("source_community", "target_community").alias("c2")).agg(F.count(F.lit(1)).alias("edge_count"))


def coupling_warnings(nodes: DataFrame, edges: DataFrame, communities: DataFrame, above: int = 10) -> DataFrame:
    """A message for each pair of communities with over ``above`` edges, unless a name says it holds tests."""
    name = communities.select(F.col("id").alias("cid"), "name")
    pairs = cross_community_counts(nodes, edges).filter(F.col("edge_count") > above)
    pairs = pairs.join(name.toDF("c1", "name1"), "c1", "left").join(name.toDF("c2", "name2"), "c2", "left").fillna("", ["name1", "name2"])
    pairs = pairs.filter(~F.col("name1").rlike(TEST_COMMUNITY) & ~F.col("name2").rlike(TEST_COMMUNITY))
    return pairs.select("c1", "c2", "edge_count", F.format_string("High coupling (%d edges) between '%s' and '%s'", "edge_count", "name1", "name2").alias("warning")).orderBy(F.desc("edge_count"), "c1", "c2")


def architecture_overview(nodes: DataFrame, edges: DataFrame, communities: DataFrame) -> DataFrame:
    """(section, position, text, value): communities by size, then warnings by count."""
    c = communities.withColumn("position", F.row_number().over(Window.orderBy(F.desc("size"), "id"))).select(F.lit("community").alias("section"), F.col("position").cast("long"), F.col("name").alias("text"), F.col("size").cast("double").alias("value"))
    w = coupling_warnings(nodes, edges, communities)
    w = w.withColumn("position", F.row_number().over(Window.orderBy(F.desc("edge_count"), "c1", "c2"))).select(F.lit("warning").alias("section"), F.col("position").cast("long"), F.col("warning").alias("text"), F.col("edge_count").cast("double").alias("value"))
    return c.unionByName(w)


def high_coupling(edges: DataFrame, above: int = 10, limit: int = 10) -> DataFrame:
    return incoming_calls(edges).filter(F.col("call_count") > above).orderBy(F.desc("call_count"), "qualified_name").limit(limit)


def knowledge_gaps(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """Functions, then tests, that no test link points to; in id order within a kind."""
    tested = edges.filter("kind = 'TESTED_BY'").select(F.col("target_qualified").alias("qualified_name"))
    todo = nodes.filter("kind IN ('Function', 'Test') AND NOT is_test").join(tested, "qualified_name", "left_anti")
    return todo.orderBy(F.when(F.col("kind") == "Function", 0).otherwise(1), "id").limit(limit).select("qualified_name", "name", "kind", "file_path", "line_start")


def surprising_connections(nodes: DataFrame, edges: DataFrame, communities: DataFrame | None = None, limit: int = 20) -> DataFrame:
    """Calls between different communities that are not parent and child, in edge order."""
    e = with_communities(nodes, edges.filter("kind = 'CALLS'")).filter("source_community != target_community")
    if communities is not None:
        related = communities.filter("parent_id IS NOT NULL").select("id", "parent_id")
        both = related.toDF("source_community", "target_community").unionByName(related.select(F.col("parent_id").alias("source_community"), F.col("id").alias("target_community")))
        e = e.join(both, ["source_community", "target_community"], "left_anti")
    return e.orderBy("id").limit(limit).select("id", "source_qualified", "target_qualified", "source_community", "target_community", "file_path", "line")


def external_deps(nodes: DataFrame, edges: DataFrame, limit: int = 10) -> DataFrame:
    """For each community the names outside it that its members call, import or depend on, with how often."""
    e = with_communities(nodes, edges.filter(F.col("kind").isin(*COUPLING_KINDS))).filter("source_community IS NOT NULL AND NOT (source_community <=> target_community)")
    counted = e.groupBy(F.col("source_community").alias("community_id"), F.col("target_qualified").alias("dependency")).agg(F.count(F.lit(1)).alias("ref_count"))
    w = Window.partitionBy("community_id").orderBy(F.desc("ref_count"), "dependency")
    return counted.withColumn("position", F.row_number().over(w).cast("long")).filter(F.col("position") <= limit)


def dominant_language(nodes: DataFrame) -> DataFrame:
    """The most frequent non-empty language of each community; ties go to the first by name."""
    counted = nodes.filter("community_id IS NOT NULL AND language != ''").groupBy("community_id", "language").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("community_id").agg(F.min_by("language", F.struct(-F.col("n"), F.col("language"))).alias("dominant_language"))


def dead_code_candidates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    called = get_all_call_targets(edges).select(F.col("target_qualified").alias("qualified_name"))
    return nodes.join(called, "qualified_name", "left_anti")
