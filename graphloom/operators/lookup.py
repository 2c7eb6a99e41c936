"""Point, filter and projection scans over nodes, edges and derived tables.

Each is a declarative filter: predicates and columns reach the scan. Limits stand behind a total order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import like_pattern

FILE_LIMIT = 100
EDGE_LIMIT = 1000


def get_node(nodes: DataFrame, qualified_name: str) -> DataFrame:
    return nodes.filter(F.col("qualified_name") == qualified_name)


def get_node_by_id(nodes: DataFrame, node_id: int) -> DataFrame:
    return nodes.filter(F.col("id") == node_id)


def get_node_kind_by_id(nodes: DataFrame, node_id: int) -> DataFrame:
    return get_node_by_id(nodes, node_id).select("kind")


def get_node_community_id(nodes: DataFrame, node_id: int) -> DataFrame:
    return get_node_by_id(nodes, node_id).select("community_id")


def get_nodes_by_file(nodes: DataFrame, file_path: str) -> DataFrame:
    return nodes.filter(F.col("file_path") == file_path)


def get_all_nodes(nodes: DataFrame, exclude_files: bool = False) -> DataFrame:
    return nodes.filter("kind != 'File'") if exclude_files else nodes


def get_nodes_by_kind(nodes: DataFrame, kind: str) -> DataFrame:
    """Stored kinds are capitalised and compared as they are."""
    return nodes.filter(F.col("kind") == kind)


def get_nodes_by_ids(nodes: DataFrame, ids) -> DataFrame:
    """ids: a list, or a one-column DataFrame of ids for lists that outgrow a plan."""
    if isinstance(ids, DataFrame):
        return nodes.join(ids.toDF("id"), "id", "left_semi")
    return nodes.filter(F.col("id").isin(list(ids)))


def get_edges_by_source(edges: DataFrame, qualified_name: str) -> DataFrame:
    return edges.filter(F.col("source_qualified") == qualified_name)


def get_edges_by_target(edges: DataFrame, qualified_name: str) -> DataFrame:
    return edges.filter(F.col("target_qualified") == qualified_name)


def get_all_edges(edges: DataFrame) -> DataFrame:
    return edges


def get_outgoing_targets(edges: DataFrame, qualified_name: str) -> DataFrame:
    return get_edges_by_source(edges, qualified_name).select(F.col("target_qualified").alias("qualified_name"), "kind")


def get_incoming_sources(edges: DataFrame, qualified_name: str) -> DataFrame:
    return get_edges_by_target(edges, qualified_name).select(F.col("source_qualified").alias("qualified_name"), "kind")


def get_all_call_targets(edges: DataFrame) -> DataFrame:
    return edges.filter("kind = 'CALLS'").select("target_qualified").distinct()


def get_all_file_paths(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'File'").select("file_path").distinct()


get_all_files = get_all_file_paths


def get_all_file_hashes(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind = 'File' AND file_hash IS NOT NULL AND file_hash != ''").select("file_path", "file_hash")


def get_files_matching(nodes: DataFrame, suffix: str, limit: int = FILE_LIMIT) -> DataFrame:
    """Paths that end in ``suffix`` without regard to case; % and _ are wildcards."""
    return nodes.filter(F.col("file_path").ilike("%" + like_pattern(suffix))).select("file_path").distinct().orderBy("file_path").limit(limit)


def search_edges_by_target_name(edges: DataFrame, kind: str, name: str, limit: int = EDGE_LIMIT) -> DataFrame:
    return edges.filter((F.col("kind") == kind) & F.col("target_qualified").ilike("%" + like_pattern(name))).orderBy("id").limit(limit)


def get_all_community_ids(nodes: DataFrame) -> DataFrame:
    return nodes.select("qualified_name", "community_id")


def get_community_ids_by_qualified_names(nodes: DataFrame, names) -> DataFrame:
    out = get_all_community_ids(nodes)
    return out.join(names.toDF("qualified_name"), "qualified_name", "left_semi") if isinstance(names, DataFrame) else out.filter(F.col("qualified_name").isin(list(names)))


def get_community_member_qns(nodes: DataFrame, community_id: int) -> DataFrame:
    return nodes.filter(F.col("community_id") == community_id).select("qualified_name")


def get_nodes_by_community_id(nodes: DataFrame, community_id: int) -> DataFrame:
    return nodes.filter(F.col("community_id") == community_id)


def get_communities_list(communities: DataFrame) -> DataFrame:
    return communities.orderBy(F.desc("size"), "id")


def get_flows_list(flows: DataFrame) -> DataFrame:
    return flows.drop("path").orderBy(F.desc("criticality"), "id")


def get_flow_by_id(flows: DataFrame, flow_id: int) -> DataFrame:
    return flows.filter(F.col("id") == flow_id)


def get_node_ids_by_files(nodes: DataFrame, files: list[str]) -> DataFrame:
    return nodes.filter(F.col("file_path").isin(files)).groupBy("file_path").agg(F.sort_array(F.collect_list("id")).alias("node_ids"))


def get_flow_ids_by_node_ids(memberships: DataFrame, ids) -> DataFrame:
    part = memberships.join(ids.toDF("node_id"), "node_id", "left_semi") if isinstance(ids, DataFrame) else memberships.filter(F.col("node_id").isin(list(ids)))
    return part.groupBy("node_id").agg(F.sort_array(F.collect_list("flow_id")).alias("flow_ids"))


def get_nodes_without_signature(nodes: DataFrame) -> DataFrame:
    return nodes.filter("kind IN ('Function', 'Test') AND (signature IS NULL OR signature = '')")


def review_context(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Nodes of a list of names in the order of the list; unknown names are left out."""
    wanted = nodes.sparkSession.createDataFrame([(i, n) for i, n in enumerate(names)], "pos long, qualified_name string")
    return nodes.join(wanted, "qualified_name").orderBy("pos")
