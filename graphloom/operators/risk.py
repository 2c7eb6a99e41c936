"""Change analysis: from changed line ranges to nodes, their risk, the flows they touch and what to review first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_security_relevant, like_pattern, round4
from .flows import affected_flows

SCORED_KINDS = ("Function", "Test", "Class")
MAX_CHANGED = 500


def parse_unified_diff(diffs: DataFrame, key: str = "diff_id", text: str = "diff") -> DataFrame:
    """(key, file_path, start, end) of every hunk of unified diffs, one diff a row.

    ``+++ b/<path>`` names the file; ``@@ ... +start[,count] @@`` gives the range; a count of 0 is the start line alone.
    """
    lines = diffs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    named = F.regexp_extract("line", r"^\+\+\+ b/(.*)$", 1)
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("file_path", F.last(F.when(named != "", named), ignorenulls=True).over(w))
    hunk = r"^@@ [^@]*\+(\d+)(?:,(\d+))?[^@]*@@"
    hunks = lines.filter(F.col("line").rlike(hunk) & F.col("file_path").isNotNull())
    start = F.regexp_extract("line", hunk, 1).cast("long")
    count = F.coalesce(F.expr("try_cast(nullif(regexp_extract(line, '^@@ [^@]*\\\\+(\\\\d+)(?:,(\\\\d+))?[^@]*@@', 2), '') as bigint)"), F.lit(1))
    return hunks.select(key, "file_path", start.alias("start"), F.when(count == 0, start).otherwise(start + count - 1).alias("end"), "pos").orderBy(key, "pos").drop("pos")


def change_overlap(nodes: DataFrame, ranges: DataFrame) -> DataFrame:
    """Nodes whose lines meet a changed range (file_path, start, end), each once.

    The file is an equi-key of the range join. A file without an exact match is looked up by its end instead.
    """
    r = ranges.select(F.col("file_path").alias("r_file"), "start", "end")
    meets = (F.col("line_start") <= F.col("end")) & (F.col("line_end") >= F.col("start"))
    have = nodes.select(F.col("file_path").alias("r_file")).distinct()
    exact = nodes.join(r, nodes["file_path"] == F.col("r_file")).filter(meets).select(*nodes.columns)
    loose = r.join(have, "r_file", "left_anti")
    # only files differ in spelling, so the pairs are made among distinct paths, not among nodes; the last path segment
    # is the equi-key, as a path that ends like another ends with the same segment
    last = lambda c: F.lower(F.element_at(F.split(F.replace(c, F.lit("\\"), F.lit("/")), "/"), -1))
    files = have.toDF("n_file").withColumn("seg", last(F.col("n_file")))
    paired = loose.withColumn("seg", last(F.col("r_file"))).join(files, "seg").filter(F.lower("n_file").endswith(F.lower("r_file")))
    by_end = nodes.join(paired.select("n_file", "start", "end"), nodes["file_path"] == F.col("n_file")).filter(meets).select(*nodes.columns)
    return exact.unionByName(by_end).dropDuplicates(["qualified_name"])


def risk_score(nodes: DataFrame, edges: DataFrame, flows: DataFrame, memberships: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(qualified_name, risk_score) of ``targets`` (default: all nodes): flows, foreign callers, tests, security words
    and callers, each one aggregate joined back by name."""
    t = (targets if targets is not None else nodes).select("id", "name", "qualified_name", "community_id")
    # flows: the sum of criticalities, at most 0.25; memberships without a flow row count 0.05 each
    per_node = memberships.join(flows.select(F.col("id").alias("flow_id"), "criticality"), "flow_id", "left").groupBy(F.col("node_id").alias("id")).agg(F.sum("criticality").alias("crit"), F.count(F.lit(1)).alias("n_flows"), F.count("criticality").alias("n_rows"))
    flow = F.when(F.col("n_rows") > 0, F.least(F.col("crit"), F.lit(0.25))).otherwise(F.least(F.coalesce("n_flows", F.lit(0)) * 0.05, F.lit(0.25)))
    calls = edges.filter("kind = 'CALLS'").select("source_qualified", F.col("target_qualified").alias("qualified_name"))
    who = nodes.select(F.col("qualified_name").alias("source_qualified"), F.col("community_id").alias("caller_community"))
    callers = calls.join(who, "source_qualified", "left").join(t.select("qualified_name", "community_id"), "qualified_name")
    counted = callers.groupBy("qualified_name").agg(F.count(F.lit(1)).alias("n_calls"), F.count_distinct(F.when(F.col("caller_community") != F.col("community_id"), F.col("source_qualified"))).alias("n_foreign"))
    tests = edges.filter("kind = 'TESTED_BY'").groupBy(F.col("target_qualified").alias("qualified_name")).agg(F.count(F.lit(1)).alias("n_direct"))
    lower = F.lower("source_qualified")
    direct = edges.filter("kind = 'TESTED_BY'").select("source_qualified", F.col("target_qualified").alias("qualified_name")).distinct()
    more = calls.filter(lower.contains("test") | lower.contains("spec")).distinct().join(direct, ["source_qualified", "qualified_name"], "left_anti").groupBy("qualified_name").agg(F.count(F.lit(1)).alias("n_callers_tests"))
    out = t.join(per_node, "id", "left").join(counted, "qualified_name", "left").join(tests, "qualified_name", "left").join(more, "qualified_name", "left")
    n_tests = F.coalesce("n_direct", F.lit(0)) + F.coalesce("n_callers_tests", F.lit(0))
    score = (
        F.coalesce(flow, F.lit(0.0))
        + F.when(F.col("community_id").isNotNull(), F.least(F.coalesce("n_foreign", F.lit(0)) * 0.05, F.lit(0.15))).otherwise(0.0)
        + (F.lit(0.30) - F.least(n_tests / 5.0, F.lit(1.0)) * 0.25)
        + F.when(is_security_relevant("name", "qualified_name"), 0.20).otherwise(0.0)
        + F.least(F.coalesce("n_calls", F.lit(0)) / 20.0, F.lit(0.10))
    )
    return out.select("qualified_name", round4(F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))).alias("risk_score"))


def test_gaps(changed: DataFrame, edges: DataFrame) -> DataFrame:
    tested = edges.filter("kind = 'TESTED_BY'").select(F.col("target_qualified").alias("qualified_name"))
    return changed.filter("NOT is_test").join(tested, "qualified_name", "left_anti")


def analyze_changes(nodes: DataFrame, edges: DataFrame, flows: DataFrame, memberships: DataFrame, files: list[str], ranges: DataFrame | None = None, max_changed: int = MAX_CHANGED) -> dict[str, DataFrame]:
    """changed_functions, affected_flows, test_gaps, review_priorities (top 10) and a one-row summary.

    ``max_changed`` bounds what is listed and summed up; priorities are chosen among all that changed.
    """
    touched = change_overlap(nodes, ranges) if ranges is not None else nodes.filter(F.col("file_path").isin(files))
    scored_kinds = touched.filter(F.col("kind").isin(*SCORED_KINDS))
    changed = scored_kinds.orderBy("id").limit(max_changed)
    scored = lambda t: t.join(risk_score(nodes, edges, flows, memberships, t), "qualified_name").select("name", "qualified_name", "kind", F.col("file_path").alias("file"), "line_start", "line_end", "risk_score")
    risks = scored(changed)
    hit = affected_flows(nodes, flows, memberships, files)
    gaps = test_gaps(changed, edges).select("name", "qualified_name", F.col("file_path").alias("file"), "line_start", "line_end", "id")
    names = gaps.groupBy("name").agg(F.min("id").alias("first")).orderBy("first").limit(5).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]), ", ").alias("untested"))
    numbers = changed.agg(F.count(F.lit(1)).alias("n_changed")).crossJoin(hit.agg(F.count(F.lit(1)).alias("n_flows"))).crossJoin(gaps.agg(F.count(F.lit(1)).alias("n_gaps"))).crossJoin(risks.agg(F.coalesce(F.max("risk_score"), F.lit(0.0)).alias("risk_score"))).crossJoin(names).crossJoin(scored_kinds.agg((F.count(F.lit(1)) > max_changed).alias("functions_truncated")))
    lines: list[Column] = [
        F.format_string("Analyzed %d changed file(s):", F.lit(len(files))),
        F.format_string("  - %d changed function(s)/class(es)", "n_changed"),
        F.format_string("  - %d affected flow(s)", "n_flows"),
        F.format_string("  - %d test gap(s)", "n_gaps"),
        F.format_string("  - Overall risk score: %.2f", "risk_score"),
        F.when(F.col("n_gaps") > 0, F.concat(F.lit("  - Untested: "), "untested")),
        F.when(F.col("functions_truncated"), F.lit(f"  - Warning: analysis capped at {max_changed} functions (raise max_changed to adjust)")),
    ]
    summary = numbers.withColumn("summary", F.concat_ws("\n", *lines))
    return {"changed_functions": risks, "affected_flows": hit, "test_gaps": gaps.drop("id"), "review_priorities": scored(scored_kinds).orderBy(F.desc("risk_score"), "qualified_name").limit(10), "summary": summary}


def suffix_files(nodes: DataFrame, path: str) -> DataFrame:
    return nodes.filter(F.col("file_path").ilike("%" + like_pattern(path)))
