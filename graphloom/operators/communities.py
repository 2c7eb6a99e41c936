"""Communities: by modularity, by label propagation, by directory; their names, cohesion and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import COMMON_WORDS, split_name, to_slug
from .aggregate import community_cohesion, dominant_language
from .traverse import cut

NAMED_KINDS = ("Function", "Class", "Test", "Type")
MIN_SIZE, ENOUGH_GROUPS = 2, 10


def _segments(path="file_path"):
    return F.split(F.replace(F.col(path), F.lit("\\"), F.lit("/")), "/")


def _stem(path="file_path"):
    last = F.element_at(_segments(path), -1)
    parts = F.split(last, r"\.")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise(last)


def directory_groups(nodes: DataFrame, min_size: int = MIN_SIZE) -> DataFrame:
    """(qualified_name, depth, group_key) for every depth below the longest common directory prefix.

    The prefix is found position by position with distinct counts, not by bringing paths to the driver.
    """
    files = nodes.filter("kind != 'File'").select("qualified_name", F.filter(F.slice(_segments(), 1, F.greatest(F.size(_segments()) - 1, F.lit(0))), lambda s: s != "").alias("dirs"), _stem().alias("stem"))
    at = files.select("qualified_name", F.size("dirs").alias("n"), F.posexplode_outer("dirs").alias("pos", "seg"))
    shortest = files.agg(F.min(F.size("dirs")).alias("shortest"))
    same = at.filter("pos IS NOT NULL").groupBy("pos").agg(F.count_distinct("seg").alias("d"))
    first_change = same.filter("d > 1").agg(F.min("pos").alias("p"))
    prefix = shortest.crossJoin(first_change).select(F.least("shortest", F.coalesce("p", "shortest")).alias("prefix"))  # one row each
    rest = files.crossJoin(F.broadcast(prefix)).select("qualified_name", "stem", F.slice("dirs", F.col("prefix") + 1, F.greatest(F.size("dirs") - F.col("prefix"), F.lit(0))).alias("rest"))
    deepest = F.broadcast(rest.agg(F.greatest(F.max(F.size("rest")), F.lit(1)).alias("deepest")))
    every = rest.crossJoin(deepest).withColumn("depth", F.explode(F.sequence(F.lit(1), F.col("deepest"))))
    key = F.when(F.size("rest") > 0, F.array_join(F.slice("rest", F.lit(1), F.least("depth", F.size("rest"))), "/")).otherwise(F.col("stem"))
    return every.select("qualified_name", "depth", key.alias("group_key"))


def file_communities(nodes: DataFrame, min_size: int = MIN_SIZE, enough: int = ENOUGH_GROUPS) -> DataFrame:
    """(qualified_name, group_key): the shallowest depth with ``enough`` groups of ``min_size``, else the deepest."""
    grouped = directory_groups(nodes, min_size)
    sizes = grouped.groupBy("depth", "group_key").agg(F.count(F.lit(1)).alias("n"))
    per_depth = sizes.groupBy("depth").agg(F.sum(F.when(F.col("n") >= min_size, 1).otherwise(0)).alias("groups"))
    chosen = per_depth.agg(F.coalesce(F.min(F.when(F.col("groups") >= enough, F.col("depth"))), F.max("depth")).alias("depth"))
    kept = sizes.filter(F.col("n") >= min_size).select("depth", "group_key")
    return grouped.join(F.broadcast(chosen), "depth").join(kept, ["depth", "group_key"], "left_semi").select("qualified_name", "group_key")


def keyword_counts(members: DataFrame, limit: int = 5) -> DataFrame:
    """(community_id, word, n, position): the commonest words of member names that say something."""
    words = members.filter(F.col("kind").isin(*NAMED_KINDS)).select("community_id", F.explode(split_name("name")).alias("w")).select("community_id", F.lower("w").alias("word"))
    words = words.filter(~F.col("word").isin(*COMMON_WORDS) & (F.octet_length("word") > 1))
    counted = words.groupBy("community_id", "word").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("community_id").orderBy(F.desc("n"), "word")
    return counted.withColumn("position", F.row_number().over(w).cast("long")).filter(F.col("position") <= limit)


def file_prefix_mode(members: DataFrame) -> DataFrame:
    """(community_id, prefix): slug of the commonest parent directory (or file stem); ties go to the first by name."""
    seg = _segments()
    part = F.when(F.size(seg) >= 2, F.element_at(seg, -2)).otherwise(_stem())
    counted = members.select("community_id", part.alias("part")).groupBy("community_id", "part").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy("community_id").agg(to_slug(F.min_by("part", F.struct(-F.col("n"), F.col("part")))).alias("prefix"))


def community_name(members: DataFrame) -> DataFrame:
    """(community_id, name): the file prefix with a dominant class (over 40 % of members) or the top keyword."""
    size = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"))
    classes = members.filter("kind = 'Class'").groupBy("community_id", "name").agg(F.count(F.lit(1)).alias("n"))
    top = classes.groupBy("community_id").agg(F.min_by("name", F.struct(-F.col("n"), F.col("name"))).alias("top_class"), F.max("n").alias("class_count"))
    word = keyword_counts(members, 1).select("community_id", "word")
    out = size.join(top, "community_id", "left").join(file_prefix_mode(members), "community_id", "left").join(word, "community_id", "left")
    tail = F.when(F.col("class_count") > F.col("size") * 0.4, to_slug("top_class")).otherwise(F.col("word"))
    parts = F.array_join(F.filter(F.array("prefix", tail), lambda x: x.isNotNull() & (x != "")), "-")
    return out.select("community_id", F.when(parts == "", "cluster").otherwise(parts).alias("name"))


def communities_table(nodes: DataFrame, edges: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(communities, assignments) from (qualified_name, group_key): ids by the order of keys, named, measured."""
    keys = membership.select("group_key").distinct()
    ids = keys.withColumn("community_id", F.row_number().over(Window.orderBy("group_key")).cast("long"))  # one row a community
    assigned = membership.join(ids, "group_key").select("qualified_name", "group_key", "community_id")
    members = nodes.drop("community_id").join(assigned.select("qualified_name", "community_id"), "qualified_name")
    size = members.groupBy("community_id").agg(F.count(F.lit(1)).alias("size"))
    out = ids.join(size, "community_id").join(community_name(members), "community_id").join(community_cohesion(members, edges).select("community_id", "cohesion"), "community_id", "left").join(dominant_language(members), "community_id", "left")
    described = out.select(F.col("community_id").alias("id"), "name", F.lit(0).cast("long").alias("level"), F.lit(None).cast("long").alias("parent_id"), F.coalesce("cohesion", F.lit(0.0)).alias("cohesion"), "size", F.coalesce("dominant_language", F.lit("")).alias("dominant_language"), F.concat(F.lit("Directory-based community: "), "group_key").alias("description"))
    return described, assigned


def _call_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(a, b): calls between known nodes, each in both directions, as often as there are edges."""
    known = nodes.select("qualified_name")
    e = edges.filter("kind = 'CALLS' AND source_qualified != target_qualified").select(F.col("source_qualified").alias("a"), F.col("target_qualified").alias("b"))
    e = e.join(known.toDF("a"), "a", "left_semi").join(known.toDF("b"), "b", "left_semi")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))


def label_propagation(nodes: DataFrame, edges: DataFrame, rounds: int = 10) -> DataFrame:
    """(qualified_name, group_key): groups of the undirected call graph by synchronous label propagation.

    Cheaper than modularity and coarser: the commonest label among the neighbours (and the node itself, as one vote) wins
    and ties go to the smallest, so runs agree.
    """
    links = cut(_call_links(nodes, edges))
    labels = cut(links.select("a").distinct().withColumn("label", F.col("a")))
    for _ in range(rounds):
        votes = links.join(labels.toDF("b", "label"), "b").select("a", "label").unionByName(labels).groupBy("a", "label").agg(F.count(F.lit(1)).alias("n"))
        fresh = cut(votes.groupBy("a").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")))
        moved = not fresh.join(labels.toDF("a", "old"), "a").filter("label != old").isEmpty()
        labels = fresh
        if not moved:
            break
    return labels.select(F.col("a").alias("qualified_name"), F.col("label").alias("group_key"))


def modularity(links: DataFrame, labels: DataFrame, resolution: float = 1.0) -> float:
    """Modularity of labels (a, label) over links (a, b, w) that stand in both directions."""
    ends = links.join(labels, "a").join(labels.toDF("b", "other"), "b")
    per = ends.groupBy("label").agg(F.sum("w").alias("vol"), F.sum(F.when(F.col("label") == F.col("other"), F.col("w")).otherwise(0.0)).alias("inner"))
    total, inner, squares = per.agg(F.sum("vol"), F.sum("inner"), F.sum(F.col("vol") * F.col("vol"))).first()
    return inner / total - resolution * squares / (total * total) if total else 0.0


def _move(links: DataFrame, labels: DataFrame, degrees: DataFrame, total: float, resolution: float) -> DataFrame:
    """(a, label, best): the neighbouring community that raises modularity most, or the node's own."""
    volumes = labels.join(degrees, "a").groupBy("label").agg(F.sum("k").alias("vol"))
    near = links.filter("a != b").join(labels.toDF("b", "label"), "b").groupBy("a", "label").agg(F.sum("w").alias("w"))
    own = labels.withColumn("w", F.lit(0.0))  # a node may stay where it has no links
    options = near.unionByName(own.select("a", "label", "w")).groupBy("a", "label").agg(F.sum("w").alias("w"))
    options = options.join(labels.toDF("a", "own"), "a").join(degrees, "a").join(volumes, "label")
    others = F.col("vol") - F.when(F.col("label") == F.col("own"), F.col("k")).otherwise(0.0)
    gain = F.round(F.col("w") - F.lit(resolution) * F.col("k") * others / F.lit(total), 9)
    order = F.struct(-gain, F.col("label") != F.col("own"), F.col("label"))
    return options.groupBy("a").agg(F.first("own").alias("label"), F.min_by("label", order).alias("best"))


def modularity_communities(nodes: DataFrame, edges: DataFrame, resolution: float = 1.0, rounds: int = 10, levels: int = 5) -> DataFrame:
    """(qualified_name, group_key): communities of the undirected call graph by modularity.

    At each level nodes move to the neighbouring community of the highest gain, then communities become the next level's
    nodes. A move is an aggregate over links and volumes. Half of the nodes, chosen by hash, may move in a round, so that
    neighbours don't swap forever; the labels of the highest modularity seen are kept, so more rounds never do harm.
    Ties go to the own, then to the smallest label: runs agree. Nodes without calls are left out.
    """
    links = cut(_call_links(nodes, edges).groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w")))
    total = links.agg(F.sum("w")).first()[0]
    found = links.select("a").distinct().select(F.col("a").alias("qualified_name"), F.col("a").alias("group_key"))
    if not total:
        return found
    reached = modularity(links, links.select("a").distinct().withColumn("label", F.col("a")), resolution)
    for level in range(levels):
        degrees = cut(links.groupBy("a").agg(F.sum("w").alias("k")))
        labels = degrees.select("a", F.col("a").alias("label"))
        best, top = None, reached
        for r in range(rounds):
            wish = cut(_move(links, labels, degrees, total, resolution))
            if wish.filter("best != label").isEmpty():
                break
            turn = F.pmod(F.xxhash64("a", F.lit(level * rounds + r)), F.lit(2)) == 0
            labels = wish.select("a", F.when(turn, F.col("best")).otherwise(F.col("label")).alias("label"))
            now = modularity(links, labels, resolution)
            if now > top + 1e-9:
                best, top = labels, now
        if best is None:
            break
        reached = top
        found = cut(found.join(best.toDF("group_key", "label"), "group_key").select("qualified_name", F.col("label").alias("group_key")))
        ends = links.join(best, "a").join(best.toDF("b", "other"), "b")
        links = cut(ends.groupBy(F.col("label").alias("a"), F.col("other").alias("b")).agg(F.sum("w").alias("w")))
    return found


def detect_communities(nodes: DataFrame, edges: DataFrame, min_size: int = MIN_SIZE, by_calls: bool = True) -> DataFrame:
    """Groups by modularity over calls; by directory where there are no calls (or on demand)."""
    if not by_calls or edges.filter("kind = 'CALLS'").isEmpty():
        return file_communities(nodes, min_size)
    groups = modularity_communities(nodes, edges)
    big = groups.groupBy("group_key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_size).select("group_key")
    return groups.join(big, "group_key", "left_semi").select("qualified_name", "group_key")


def store_communities(nodes: DataFrame, communities: DataFrame, assigned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes with their community ids, summaries); what was there before is replaced as a whole, summaries too."""
    out = nodes.drop("community_id").join(assigned.select("qualified_name", "community_id"), "qualified_name", "left").select(*nodes.columns)
    first = Window.partitionBy("community_id").orderBy("qualified_name")
    keys = assigned.withColumn("r", F.row_number().over(first)).filter("r <= 5").groupBy("community_id").agg(F.sort_array(F.collect_list("qualified_name")).alias("key_symbols"))
    return out, communities.join(keys, communities["id"] == keys["community_id"]).select("community_id", "name", F.col("description").alias("purpose"), "key_symbols", F.lit("unknown").alias("risk"), "size", "dominant_language")


def clear_communities(nodes: DataFrame, communities: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    return nodes.withColumn("community_id", F.lit(None).cast("long")), communities.limit(0), summaries.limit(0)


def community_summary(nodes: DataFrame, communities: DataFrame, community_id: int, limit: int = 20) -> DataFrame:
    members = nodes.filter(F.col("community_id") == community_id).select("qualified_name", F.col("community_id").alias("id")).orderBy("qualified_name").limit(limit)
    return communities.filter(F.col("id") == community_id).join(members, "id").select("id", "name", "size", "cohesion", "dominant_language", "qualified_name")
