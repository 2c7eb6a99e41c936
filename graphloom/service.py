"""One method for each tool of the interactive surface, over a stored or given graph, and static prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .functions.scalars import sanitize_name
from .operators import aggregate, communities, flows, lookup, refactor, risk, search, traverse
from .operators.store import Snapshots

PROMPTS = {
    "review_changes": "List the changed files, call detect_changes on them and look at the review priorities first.",
    "architecture_map": "Call get_architecture_overview, then describe the communities and how strongly they are coupled.",
    "debug_issue": "Find the symbol with semantic_search_nodes, then follow callers_of and callees_of with query_graph.",
    "onboard_developer": "Start from get_stats and list_communities, then read the most called symbols.",
    "pre_merge_check": "Call detect_changes, check the test gaps and the affected flows before merging.",
}


class GraphService:
    """Answers as DataFrames. Made from a snapshot store, or from tables that are given."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, flow_table: DataFrame | None = None, memberships: DataFrame | None = None, community_table: DataFrame | None = None):
        self.nodes, self.edges, self.flows, self.memberships, self.communities = nodes, edges, flow_table, memberships, community_table

    @classmethod
    def open(cls, store: Snapshots) -> GraphService:
        return cls(*(store.read(t) for t in ("nodes", "edges", "flows", "flow_memberships", "communities")))

    def get_stats(self):
        return aggregate.get_stats(self.nodes, self.edges)

    def get_node(self, qualified_name: str):
        return lookup.get_node(self.nodes, qualified_name)

    def get_node_by_id(self, node_id: int):
        return lookup.get_node_by_id(self.nodes, node_id)

    def get_nodes_by_file(self, file_path: str):
        return lookup.get_nodes_by_file(self.nodes, file_path)

    def get_all_nodes(self, exclude_files: bool = False):
        return lookup.get_all_nodes(self.nodes, exclude_files)

    def get_nodes_by_kind(self, kind: str):
        return lookup.get_nodes_by_kind(self.nodes, kind)

    def get_edges_by_source(self, qualified_name: str):
        return lookup.get_edges_by_source(self.edges, qualified_name)

    def get_edges_by_target(self, qualified_name: str):
        return lookup.get_edges_by_target(self.edges, qualified_name)

    def list_all_edges(self):
        return lookup.get_all_edges(self.edges)

    def get_outgoing_targets(self, qualified_name: str):
        return lookup.get_outgoing_targets(self.edges, qualified_name)

    def get_incoming_sources(self, qualified_name: str):
        return lookup.get_incoming_sources(self.edges, qualified_name)

    def get_all_file_paths(self):
        return lookup.get_all_file_paths(self.nodes)

    list_files = get_all_file_paths

    def get_all_file_hashes(self):
        return lookup.get_all_file_hashes(self.nodes)

    def get_files_matching(self, suffix: str):
        return lookup.get_files_matching(self.nodes, suffix)

    def semantic_search_nodes(self, query: str, limit: int = 20):
        """Phrase matches in the order of their rank."""
        hits = search.fts_search(self.nodes, query, limit)
        return hits.join(self.nodes, "id").orderBy(hits["score"].desc(), "id")

    def get_minimal_context(self, query: str, limit: int = 20):
        return search.minimal_context(self.nodes, query, limit)

    def keyword_search(self, query: str, limit: int = 20):
        return search.keyword_search(self.nodes, query, limit)

    def hybrid_search(self, query: str, kind: str | None = None, limit: int = 20, context_files: list[str] | None = None):
        return search.hybrid_search(self.nodes, query, kind, limit, context_files)

    def get_impact_radius(self, qualified_name: str, max_depth: int = 5, max_nodes: int = 100):
        return traverse.impact_radius(self.edges, qualified_name, max_depth, max_nodes)

    def get_subgraph(self, names: list[str]):
        wanted = self.nodes.sparkSession.createDataFrame([(n,) for n in names], "qualified_name string")
        return self.nodes.join(wanted, "qualified_name", "left_semi"), traverse.subgraph(self.edges, wanted)

    def query_graph(self, pattern: str, qualified_name: str):
        return traverse.query_graph(self.edges, pattern, qualified_name)

    def get_transitive_tests(self, qualified_name: str):
        return traverse.transitive_tests(self.edges, qualified_name)

    def list_flows(self):
        return lookup.get_flows_list(self.flows)

    def get_flow_by_id(self, flow_id: int):
        return lookup.get_flow_by_id(self.flows, flow_id)

    def get_affected_flows(self, names: list[str]):
        return flows.flows_through(self.flows, names)

    def list_communities(self):
        return lookup.get_communities_list(self.communities)

    def get_community_members(self, community_id: int):
        return lookup.get_community_member_qns(self.nodes, community_id)

    def get_nodes_by_community(self, community_id: int):
        return lookup.get_nodes_by_community_id(self.nodes, community_id)

    def get_architecture_overview(self):
        return aggregate.architecture_overview(self.nodes, self.edges, self.communities)

    def get_community_summary(self, community_id: int):
        return communities.community_summary(self.nodes, self.communities, community_id)

    def get_review_context(self, names: list[str]):
        return lookup.review_context(self.nodes, names)

    def detect_changes(self, files: list[str], ranges: DataFrame | None = None):
        return risk.analyze_changes(self.nodes, self.edges, self.flows, self.memberships, files, ranges)

    def refactor_tool(self, mode: str, qualified_name: str | None = None, new_name: str | None = None):
        if mode == "rename":
            return refactor.rename_preview(self.nodes, self.edges, qualified_name, new_name)
        if mode == "dead_code":
            return refactor.dead_code(self.nodes, self.edges)
        return refactor.refactoring_suggestions(self.nodes, self.edges)

    def suggested_questions(self, context: str | None = None):
        return refactor.suggested_questions(self.nodes, self.edges, self.communities, context)

    @staticmethod
    def prompt(name: str) -> str:
        return PROMPTS[name]

    @staticmethod
    def clean(column):
        return sanitize_name(column)
