"""Refactoring: dead code, large functions, suggestions, questions and renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_live_name, make_qualified
from .aggregate import bridge_nodes, dead_code_candidates, high_coupling, hub_nodes, knowledge_gaps


def dead_code(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """Functions, then classes, that nothing calls; the limit comes before the sort by name."""
    own = dead_code_candidates(nodes.filter("kind IN ('Function', 'Class') AND NOT is_test"), edges).filter(~is_live_name())
    first = own.orderBy(F.when(F.col("kind") == "Function", 0).otherwise(1), "id").limit(limit)
    return first.select("qualified_name", "name", "kind", "file_path", "line_start").orderBy("name", "qualified_name")


def large_functions(nodes: DataFrame, min_lines: int = 50, limit: int = 50) -> DataFrame:
    sized = nodes.filter("kind IN ('Function', 'Test')").withColumn("size", F.col("line_end") - F.col("line_start")).filter(F.col("size") >= min_lines)
    return sized.orderBy(F.desc("size"), "qualified_name").limit(limit).select("qualified_name", "name", "file_path", "line_start", "line_end", "size")


def refactoring_suggestions(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, position, type, qualified_name, reason, priority): dead code, large functions, high coupling."""

    def ranked(df, order):
        return df.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))

    dead = ranked(dead_code(nodes, edges, 20), ["name", "qualified_name"]).select(F.lit(1).alias("section"), "position", F.lit("dead_code").alias("type"), "qualified_name", F.lit("Never called; consider removing or marking with a TODO.").alias("reason"), F.lit("high").alias("priority"))
    large = ranked(large_functions(nodes, 50, 20), [F.desc("size"), "qualified_name"]).select(F.lit(2).alias("section"), "position", F.lit("large_function").alias("type"), "qualified_name", F.format_string("Function is %d lines; consider splitting.", "size").alias("reason"), F.when(F.col("size") > 150, "high").otherwise("medium").alias("priority"))
    coupled = ranked(high_coupling(edges), [F.desc("call_count"), "qualified_name"]).select(F.lit(3).alias("section"), "position", F.lit("high_coupling").alias("type"), "qualified_name", F.format_string("Called by %d callers; changes here are high-risk.", "call_count").alias("reason"), F.lit("medium").alias("priority"))
    return dead.unionByName(large).unionByName(coupled)


def suggested_questions(nodes: DataFrame, edges: DataFrame, communities: DataFrame, context: str | None = None) -> DataFrame:
    """(position, question) from three gaps, three hubs, three bridges and an optional name; two generic ones otherwise."""
    spark = nodes.sparkSession
    kind_order = F.when(F.col("kind") == "Function", 0).otherwise(1)
    gaps = knowledge_gaps(nodes, edges, 3).withColumn("p", F.row_number().over(Window.orderBy(kind_order, "line_start", "qualified_name")))
    gaps = gaps.select((F.col("p") + 0).alias("position"), F.format_string("Which functions in `%s` lack test coverage?", "file_path").alias("question"))
    hubs = hub_nodes(nodes, edges, 3).withColumn("p", F.row_number().over(Window.orderBy(F.desc("call_count"), "qualified_name")))
    hubs = hubs.select((F.col("p") + 10).alias("position"), F.format_string("What calls `%s` and could affect system stability if it changes?", "name").alias("question"))
    b = bridge_nodes(nodes, edges, 3).join(communities.select(F.col("id").alias("community_id"), F.col("name").alias("c_name")), "community_id", "left")
    b = b.withColumn("p", F.row_number().over(Window.orderBy(F.desc("bridge_score"), F.desc("cross_community_edges"), "qualified_name")))
    where = F.coalesce("c_name", F.concat(F.lit("community "), F.col("community_id").cast("string")))
    b = b.select((F.col("p") + 20).alias("position"), F.format_string("How does `%s` bridge `%s` to other parts of the codebase (%d cross-community connections)?", F.col("name"), where, F.col("cross_community_edges")).alias("question"))
    out = gaps.unionByName(hubs).unionByName(b)
    if context is not None:
        named = nodes.filter(F.col("qualified_name") == context).select(F.lit(31).alias("position"), F.format_string("What is the impact radius of changes to `%s`?", "name").alias("question"))
        out = out.unionByName(named)
    generic = spark.createDataFrame([(41, "Which functions are most heavily called and pose the highest risk?"), (42, "Are there any isolated components with no dependencies?")], "position int, question string")
    n = out.agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(generic.crossJoin(n).filter("n = 0").drop("n")).withColumn("position", F.col("position").cast("long"))


def rename_preview(nodes: DataFrame, edges: DataFrame, qualified_name: str, new_name: str) -> DataFrame:
    """One row: old and new name, edges that touch the node (a self-loop twice) and the files to update."""
    node = nodes.filter(F.col("qualified_name") == qualified_name)
    touching = edges.filter((F.col("source_qualified") == qualified_name) | (F.col("target_qualified") == qualified_name))
    counts = touching.agg(F.coalesce(F.sum((F.col("source_qualified") == qualified_name).cast("long") + (F.col("target_qualified") == qualified_name).cast("long")), F.lit(0)).alias("affected_edges_count"))
    files = touching.select("file_path").unionByName(node.select("file_path")).agg(F.sort_array(F.collect_set("file_path")).alias("files"))
    return node.select(F.col("name").alias("old_name"), F.lit(new_name).alias("new_name")).crossJoin(counts).crossJoin(files).select("old_name", "new_name", "affected_edges_count", F.array_join("files", ",").alias("files_to_update"))


class UnknownNode(ValueError):
    """A name that no node has."""


def apply_rename(nodes: DataFrame, edges: DataFrame, qualified_name: str, new_name: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(nodes, edges, counts) after a rename. A missing node or a name that is taken is an error and changes nothing."""
    node = nodes.filter(F.col("qualified_name") == qualified_name)
    target = node.select(make_qualified(kind=F.lit("Function"), parent="parent_name", name=F.lit(new_name)).alias("q")).first()
    if target is None:
        raise UnknownNode(f"node not found: {qualified_name}")
    if target.q != qualified_name and not nodes.filter(F.col("qualified_name") == target.q).isEmpty():
        raise ValueError(f"name is taken: {target.q}")
    is_it = F.col("qualified_name") == qualified_name
    out = nodes.withColumns({"name": F.when(is_it, F.lit(new_name)).otherwise(F.col("name")), "qualified_name": F.when(is_it, F.lit(target.q)).otherwise(F.col("qualified_name"))})
    moved = lambda c: F.when(F.col(c) == qualified_name, F.lit(target.q)).otherwise(F.col(c))
    counts = edges.agg(F.coalesce(F.sum((F.col("source_qualified") == qualified_name).cast("long") + (F.col("target_qualified") == qualified_name).cast("long")), F.lit(0)).alias("n")).first().n
    return out, edges.withColumns({"source_qualified": moved("source_qualified"), "target_qualified": moved("target_qualified")}), {"nodes": node.count(), "edges": counts}
