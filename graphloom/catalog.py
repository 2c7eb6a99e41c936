"""Queries of the graph operators over the driver's tables, each beside the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import aggregate as A
from .operators import communities as C
from .operators import flows as FL
from .operators import lookup as L
from .operators import refactor as R
from .operators import render as V
from .operators import risk as K
from .operators import search as T
from .operators import store as ST
from .operators import traverse as B
from .plans.projection import oracle_prefix, project
from .sources import files as SF
from .streaming.incremental import latest_state

FN = "src/r0/n10.py::Customer_000000003"
FN2 = "src/r4/n19.py::Customer_000000001"
BARE = "Supplier_000000001"
FILE = "src/r1/n16.py"
FILES = ["src/r1/n16.py", "src/r4/n19.py", "src/r0/n0.py"]

_flow_tables: dict = {}


class Context:
    """What a query works on: the projected graph and, on demand, what is derived from it."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        g = project(spark, sf_dir)
        self.nodes, self.edges = g.nodes, g.edges

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def communities(self) -> DataFrame:
        size = self.nodes.groupBy(F.col("community_id").alias("id")).agg(F.count(F.lit(1)).alias("size"))
        r = self.table("region").select(F.col("r_regionkey").cast("long").alias("id"), F.lower("r_name").alias("name"))
        return r.join(size, "id").select("id", "name", F.lit(0).cast("long").alias("level"), F.lit(None).cast("long").alias("parent_id"), "size", F.lit("python").alias("dominant_language"), F.concat(F.lit("Region "), "name").alias("description"), F.lit(0.0).alias("cohesion"))

    @property
    def flows(self) -> tuple[DataFrame, DataFrame]:
        key = (self.spark.sparkContext.applicationId, id(self.spark), self.dir)
        if key not in _flow_tables:
            flows, memberships = FL.detect_flows(self.nodes, self.edges)
            _flow_tables[key] = (flows.cache(), memberships.cache())
        return _flow_tables[key]

    def names(self, *names: str) -> DataFrame:
        return self.spark.createDataFrame([(n,) for n in names], "qualified_name string")


_COMMUNITIES = "communities AS (SELECT CAST(r_regionkey AS BIGINT) AS id, lower(r_name) AS name, n.size AS size, 'python' AS dominant_language, 'Region ' || lower(r_name) AS description FROM region JOIN (SELECT community_id, count(*) AS size FROM nodes GROUP BY 1) n ON n.community_id = r_regionkey)"
_SEC = "regexp_matches(lower({0}), '" + "|".join(S.SECURITY_KEYWORDS) + "')"
_ENTRY = "regexp_matches(name, '" + "|".join(f"(?:{p})" for p in S.ENTRY_NAMES) + "')"
_TESTFILE = "regexp_matches(file_path, '([\\\\/]__tests__[\\\\/]|\\.spec\\.[jt]sx?$|\\.test\\.[jt]sx?$|[\\\\/]test_[^/\\\\]*\\.py$)')"
_LIVE = "(lower(name) IN (" + ",".join(f"'{x}'" for x in S.LIVE_NAMES) + ") OR lower(name) LIKE 'test%')"
_FLOWS = f"""
entries AS (SELECT * FROM nodes WHERE kind IN ('Function','Test') AND NOT is_test AND NOT {_TESTFILE} AND (qualified_name NOT IN (SELECT target_qualified FROM edges WHERE kind='CALLS') OR {_ENTRY})),
links AS (SELECT DISTINCT source_qualified AS a, target_qualified AS b FROM edges WHERE kind='CALLS' AND target_qualified IN (SELECT qualified_name FROM nodes)),
walk AS (SELECT qualified_name AS entry, qualified_name AS node, 0 AS depth FROM entries UNION SELECT entry, b, depth+1 FROM walk JOIN links ON node = a WHERE depth < 10),
member AS (SELECT entry, node, min(depth) AS depth FROM walk GROUP BY 1,2),
tested AS (SELECT DISTINCT target_qualified AS q FROM edges WHERE kind='TESTED_BY'),
scored AS (SELECT entry, count(*) AS node_count, count(DISTINCT n.file_path) AS file_count,
  round(least(1.0, greatest(0.0, least(count(*)/100.0, 0.3) + least(count(DISTINCT n.file_path)/10.0, 0.3) + max(CASE WHEN {_SEC.format('n.name')} OR {_SEC.format('n.qualified_name')} THEN 1 ELSE 0 END)*0.3 + max(CASE WHEN t.q IS NOT NULL THEN 1 ELSE 0 END)*0.1))*10000)/10000 AS criticality
  FROM member m JOIN nodes n ON n.qualified_name = m.node LEFT JOIN tested t ON t.q = m.node GROUP BY 1 HAVING count(*) >= 2),
flows AS (SELECT n.id AS id, n.name AS name, n.id AS entry_point_id, s.node_count-1 AS depth, s.node_count, s.file_count, s.criticality, s.entry FROM scored s JOIN nodes n ON n.qualified_name = s.entry),
fm AS (SELECT f.id AS flow_id, n.id AS node_id FROM member m JOIN flows f ON f.entry = m.entry JOIN nodes n ON n.qualified_name = m.node)"""
_RISK = f"""
crit AS (SELECT node_id, sum(criticality) AS crit FROM fm JOIN flows ON flows.id = fm.flow_id GROUP BY 1),
calls AS (SELECT source_qualified AS s, target_qualified AS t FROM edges WHERE kind='CALLS'),
cnt AS (SELECT t, count(*) AS n_calls FROM calls GROUP BY 1),
foreign_ AS (SELECT c.t, count(DISTINCT c.s) AS n FROM calls c JOIN nodes a ON a.qualified_name=c.s JOIN nodes b ON b.qualified_name=c.t WHERE a.community_id <> b.community_id GROUP BY 1),
direct AS (SELECT source_qualified AS s, target_qualified AS t FROM edges WHERE kind='TESTED_BY'),
dcount AS (SELECT t, count(*) AS n FROM direct GROUP BY 1),
via AS (SELECT t, count(*) AS n FROM (SELECT DISTINCT s, t FROM calls WHERE (lower(s) LIKE '%test%' OR lower(s) LIKE '%spec%') AND NOT EXISTS (SELECT 1 FROM direct d WHERE d.s=calls.s AND d.t=calls.t)) GROUP BY 1),
risk AS (SELECT n.qualified_name, round(least(1.0, greatest(0.0, least(coalesce(crit.crit, 0.0), 0.25) + CASE WHEN n.community_id IS NOT NULL THEN least(coalesce(f.n,0)*0.05, 0.15) ELSE 0.0 END + (0.30 - least((coalesce(d.n,0)+coalesce(v.n,0))/5.0, 1.0)*0.25) + CASE WHEN {_SEC.format('n.name')} OR {_SEC.format('n.qualified_name')} THEN 0.20 ELSE 0.0 END + least(coalesce(c.n_calls,0)/20.0, 0.10)))*10000)/10000 AS risk_score
 FROM nodes n LEFT JOIN crit ON crit.node_id=n.id LEFT JOIN cnt c ON c.t=n.qualified_name LEFT JOIN foreign_ f ON f.t=n.qualified_name LEFT JOIN dcount d ON d.t=n.qualified_name LEFT JOIN via v ON v.t=n.qualified_name)"""
_CROSS = "cross_ AS (SELECT least(a.community_id,b.community_id) AS c1, greatest(a.community_id,b.community_id) AS c2, count(*) AS edge_count FROM edges e JOIN nodes a ON a.qualified_name=e.source_qualified JOIN nodes b ON b.qualified_name=e.target_qualified WHERE e.kind<>'TESTED_BY' AND a.community_id<>b.community_id GROUP BY 1,2)"
_BRIDGE = "both_ AS (SELECT source_qualified AS me, target_qualified AS other FROM edges WHERE kind IN ('CALLS','IMPORTS_FROM') UNION ALL SELECT target_qualified, source_qualified FROM edges WHERE kind IN ('CALLS','IMPORTS_FROM')), bridge AS (SELECT n.qualified_name, n.name, n.kind, n.file_path, n.community_id, sum(CASE WHEN o.community_id<>n.community_id THEN 1 ELSE 0 END)/count(*) AS bridge_score, CAST(sum(CASE WHEN o.community_id<>n.community_id THEN 1 ELSE 0 END) AS BIGINT) AS cross_community_edges, count(*) AS total_neighbors FROM both_ JOIN nodes n ON n.qualified_name=me LEFT JOIN nodes o ON o.qualified_name=other WHERE n.kind<>'File' AND n.community_id IS NOT NULL GROUP BY 1,2,3,4,5)"
_NODE = "id, kind, name, qualified_name, file_path, line_start, line_end, language, is_test, community_id"
_NODE_COLS = _NODE.split(", ")
_EDGE = "id, kind, source_qualified, target_qualified, file_path, line"
_WORDS = "list_filter(regexp_split_to_array(regexp_replace(name, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[_\\-.\\s]+'), lambda w: w <> '')"
_DOCTOK = "tok AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS term, generate_subscripts(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''), 1) AS pos FROM documents)"

_queries: dict[str, Callable[[Context], DataFrame]] = {}
_sql: dict[str, str] = {}


def _add(name: str, query: Callable[[Context], DataFrame], sql: str | None = None, graph: bool = True) -> None:
    """sql: what follows the projection's CTEs (``, more AS (...) SELECT`` or ``SELECT``), or whole SQL if not graph."""
    _queries[name] = query
    if sql is not None:
        _sql[name] = (oracle_prefix() + (sql if sql.lstrip().startswith(",") else " " + sql)) if graph else sql


def _nodes(df: DataFrame) -> DataFrame:
    return df.select(*_NODE_COLS)


def _edges(df: DataFrame) -> DataFrame:
    return df.select(*_EDGE.split(", "))


# the projection and lookups
_add("projection_nodes", lambda c: _nodes(c.nodes), f"SELECT {_NODE} FROM nodes")
_add("projection_edges", lambda c: _edges(c.edges), f"SELECT {_EDGE} FROM edges")
_add("get_node", lambda c: _nodes(L.get_node(c.nodes, FN)), f"SELECT {_NODE} FROM nodes WHERE qualified_name='{FN}'")
_add("get_node_by_id", lambda c: _nodes(L.get_node_by_id(c.nodes, 1000003)), f"SELECT {_NODE} FROM nodes WHERE id=1000003")
_add("get_node_kind_by_id", lambda c: L.get_node_kind_by_id(c.nodes, 1000003), "SELECT kind FROM nodes WHERE id=1000003")
_add("get_node_community_id", lambda c: L.get_node_community_id(c.nodes, 1000003), "SELECT community_id FROM nodes WHERE id=1000003")
_add("get_nodes_by_file", lambda c: _nodes(L.get_nodes_by_file(c.nodes, FILE)), f"SELECT {_NODE} FROM nodes WHERE file_path='{FILE}'")
_add("get_all_nodes", lambda c: _nodes(L.get_all_nodes(c.nodes, True)), f"SELECT {_NODE} FROM nodes WHERE kind<>'File'")
_add("get_nodes_by_kind", lambda c: _nodes(L.get_nodes_by_kind(c.nodes, "Class")), f"SELECT {_NODE} FROM nodes WHERE kind='Class'")
_add("get_nodes_by_ids", lambda c: _nodes(L.get_nodes_by_ids(c.nodes, [1, 2, 1001, 1000003, 999])), f"SELECT {_NODE} FROM nodes WHERE id IN (1,2,1001,1000003,999)")
_add("get_edges_by_source", lambda c: _edges(L.get_edges_by_source(c.edges, FN)), f"SELECT {_EDGE} FROM edges WHERE source_qualified='{FN}'")
_add("get_edges_by_target", lambda c: _edges(L.get_edges_by_target(c.edges, BARE)), f"SELECT {_EDGE} FROM edges WHERE target_qualified='{BARE}'")
_add("get_all_edges", lambda c: _edges(L.get_all_edges(c.edges)), f"SELECT {_EDGE} FROM edges")
_add("get_outgoing_targets", lambda c: L.get_outgoing_targets(c.edges, FN), f"SELECT target_qualified AS qualified_name, kind FROM edges WHERE source_qualified='{FN}'")
_add("get_incoming_sources", lambda c: L.get_incoming_sources(c.edges, FN), f"SELECT source_qualified AS qualified_name, kind FROM edges WHERE target_qualified='{FN}'")
_add("get_all_call_targets", lambda c: L.get_all_call_targets(c.edges), "SELECT DISTINCT target_qualified FROM edges WHERE kind='CALLS'")
_add("get_all_file_paths", lambda c: L.get_all_file_paths(c.nodes), "SELECT DISTINCT file_path FROM nodes WHERE kind='File'")
_add("get_all_file_hashes", lambda c: L.get_all_file_hashes(c.nodes.withColumn("file_hash", F.when(F.col("id") % 2 == 0, F.sha2("file_path", 256)).otherwise(""))), "SELECT file_path, sha256(file_path) AS file_hash FROM nodes WHERE kind='File' AND id%2=0")
_add("get_files_matching", lambda c: L.get_files_matching(c.nodes, "N1_.PY"), "SELECT DISTINCT file_path FROM nodes WHERE file_path ILIKE '%N1_.PY' ORDER BY 1 LIMIT 100")
_add("search_edges_by_target_name", lambda c: _edges(L.search_edges_by_target_name(c.edges, "CALLS", "supplier_000000003")), f"SELECT {_EDGE} FROM edges WHERE kind='CALLS' AND target_qualified ILIKE '%supplier_000000003' ORDER BY id LIMIT 1000")
_add("get_all_community_ids", lambda c: L.get_all_community_ids(c.nodes), "SELECT qualified_name, community_id FROM nodes")
_add("get_community_ids_by_qualified_names", lambda c: L.get_community_ids_by_qualified_names(c.nodes, c.names(FN, FN2, "none")), f"SELECT qualified_name, community_id FROM nodes WHERE qualified_name IN ('{FN}','{FN2}')")
_add("get_community_member_qns", lambda c: L.get_community_member_qns(c.nodes, 2), "SELECT qualified_name FROM nodes WHERE community_id=2")
_add("get_nodes_by_community_id", lambda c: _nodes(L.get_nodes_by_community_id(c.nodes, 2)), f"SELECT {_NODE} FROM nodes WHERE community_id=2")
_add("get_communities_list", lambda c: L.get_communities_list(c.communities).select("id", "name", "size", "dominant_language", "description"), f", {_COMMUNITIES} SELECT id, name, size, dominant_language, description FROM communities")
_add("get_nodes_without_signature", lambda c: L.get_nodes_without_signature(c.nodes.withColumn("signature", F.when(F.col("id") % 3 == 0, "def f()").otherwise(""))).select("id"), "SELECT id FROM nodes WHERE kind IN ('Function','Test') AND id%3<>0")
_add("get_node_ids_by_files", lambda c: L.get_node_ids_by_files(c.nodes, FILES).select("file_path", F.explode("node_ids").alias("node_id")), "SELECT file_path, id AS node_id FROM nodes WHERE file_path IN (" + ",".join(f"'{x}'" for x in FILES) + ")")
_add("review_context", lambda c: L.review_context(c.nodes, [FN2, "none", FN]).select("pos", "qualified_name", "kind", "file_path"), f"SELECT CAST(CASE qualified_name WHEN '{FN2}' THEN 0 ELSE 2 END AS BIGINT) AS pos, qualified_name, kind, file_path FROM nodes WHERE qualified_name IN ('{FN}','{FN2}')")

# joins and call resolution
_add("resolve_calls", lambda c: _edges(B.resolve_calls(c.nodes, c.edges)), ", u1 AS (SELECT name, min(qualified_name) AS q FROM nodes WHERE kind IN ('Function','Method','Class','Test') GROUP BY 1 HAVING count(*)=1) SELECT e.id, e.kind, e.source_qualified, CASE WHEN e.kind='CALLS' AND n.qualified_name IS NULL THEN coalesce(u1.q, e.target_qualified) ELSE e.target_qualified END AS target_qualified, e.file_path, e.line FROM edges e LEFT JOIN nodes n ON n.qualified_name=e.target_qualified LEFT JOIN u1 ON u1.name=e.target_qualified")
_add("unresolved_calls", lambda c: _edges(B.unresolved_calls(c.nodes, c.edges)), f"SELECT {_EDGE} FROM edges WHERE kind='CALLS' AND target_qualified NOT IN (SELECT qualified_name FROM nodes)")
_add("subgraph", lambda c: _edges(B.subgraph(c.edges, c.nodes.filter("community_id <= 1"))), ", s AS (SELECT qualified_name AS q FROM nodes WHERE community_id<=1) SELECT e.id, e.kind, e.source_qualified, e.target_qualified, e.file_path, e.line FROM edges e WHERE e.source_qualified IN (SELECT q FROM s) AND e.target_qualified IN (SELECT q FROM s)")
_add("community_lookup_join", lambda c: A.with_communities(c.nodes, c.edges).select("id", "source_community", "target_community"), "SELECT e.id, a.community_id AS source_community, b.community_id AS target_community FROM edges e LEFT JOIN nodes a ON a.qualified_name=e.source_qualified LEFT JOIN nodes b ON b.qualified_name=e.target_qualified")
_add("change_overlap", lambda c: _nodes(K.change_overlap(c.nodes, c.spark.createDataFrame([("src/r1/n16.py", 100, 300), ("N19.py", 10, 60), ("n0.py", 500, 520), ("src/r1/n16.py", 290, 310)], "file_path string, start long, end long"))), ", r(fp,s,e) AS (VALUES ('src/r1/n16.py',100,300),('N19.py',10,60),('n0.py',500,520),('src/r1/n16.py',290,310)), hit AS (SELECT n.* FROM nodes n JOIN r ON n.file_path=r.fp AND n.line_start<=r.e AND n.line_end>=r.s UNION SELECT n.* FROM nodes n JOIN r ON n.file_path ILIKE '%/'||r.fp AND n.line_start<=r.e AND n.line_end>=r.s WHERE r.fp NOT IN (SELECT file_path FROM nodes)) " + f"SELECT DISTINCT {_NODE} FROM hit")
_add("query_graph", lambda c: B.query_graph(c.edges, "callers_of", BARE), f"SELECT source_qualified AS qualified_name, kind FROM edges WHERE target_qualified='{BARE}'")
_add("query_graph_callees", lambda c: B.query_graph(c.edges, "callees_of", FN), f"SELECT target_qualified AS qualified_name, kind FROM edges WHERE source_qualified='{FN}'")
_T0 = "src/r0/n20.py::Customer_000000091"
_add("transitive_tests", lambda c: B.transitive_tests(c.edges, _T0), f", d AS (SELECT source_qualified AS q FROM edges WHERE kind='TESTED_BY' AND target_qualified='{_T0}') SELECT q AS qualified_name, 'direct' AS via FROM d UNION ALL SELECT DISTINCT source_qualified, 'caller' FROM edges WHERE kind='CALLS' AND target_qualified='{_T0}' AND (lower(source_qualified) LIKE '%test%' OR lower(source_qualified) LIKE '%spec%') AND source_qualified NOT IN (SELECT q FROM d)")

# aggregates and rankings
_add("get_stats", lambda c: A.get_stats(c.nodes, c.edges), "SELECT 'total_nodes' AS metric, '' AS item, count(*) AS n FROM nodes UNION ALL SELECT 'total_edges','',count(*) FROM edges UNION ALL SELECT 'nodes_by_kind',kind,count(*) FROM nodes GROUP BY kind UNION ALL SELECT 'edges_by_kind',kind,count(*) FROM edges GROUP BY kind UNION ALL SELECT 'files_count','',count(*) FROM nodes WHERE kind='File' UNION ALL SELECT DISTINCT 'languages',language,CAST(1 AS BIGINT) FROM nodes WHERE language<>''")
_add("hub_nodes", lambda c: A.hub_nodes(c.nodes, B.resolve_calls(c.nodes, c.edges), 20), ", u1 AS (SELECT name, min(qualified_name) AS q FROM nodes WHERE kind IN ('Function','Method','Class','Test') GROUP BY 1 HAVING count(*)=1), r AS (SELECT CASE WHEN n.qualified_name IS NULL THEN coalesce(u1.q, e.target_qualified) ELSE e.target_qualified END AS t FROM edges e LEFT JOIN nodes n ON n.qualified_name=e.target_qualified LEFT JOIN u1 ON u1.name=e.target_qualified WHERE e.kind='CALLS'), top AS (SELECT t, count(*) AS call_count FROM r GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) SELECT qualified_name, name, kind, file_path, call_count FROM top JOIN nodes ON t=qualified_name")
_add("bridge_nodes", lambda c: A.bridge_nodes(c.nodes, c.edges, 20).withColumn("bridge_score", F.round(F.col("bridge_score") * 1000000) / 1000000), f", {_BRIDGE} SELECT qualified_name, name, kind, file_path, community_id, round(bridge_score*1000000)/1000000 AS bridge_score, cross_community_edges, total_neighbors FROM bridge WHERE cross_community_edges>0 ORDER BY bridge.bridge_score DESC, cross_community_edges DESC, qualified_name LIMIT 20")
_add("community_cohesion", lambda c: A.community_cohesion(c.nodes, c.edges).select("community_id", F.col("internal_edges").cast("long"), F.col("external_edges").cast("long"), "cohesion"), ", e2 AS (SELECT a.community_id AS s, b.community_id AS t FROM edges e LEFT JOIN nodes a ON a.qualified_name=e.source_qualified LEFT JOIN nodes b ON b.qualified_name=e.target_qualified), sides AS (SELECT s AS c, 1 AS i, 0 AS x FROM e2 WHERE s=t UNION ALL SELECT s,0,1 FROM e2 WHERE s IS DISTINCT FROM t AND s IS NOT NULL UNION ALL SELECT t,0,1 FROM e2 WHERE s IS DISTINCT FROM t AND t IS NOT NULL) SELECT c AS community_id, CAST(sum(i) AS BIGINT) AS internal_edges, CAST(sum(x) AS BIGINT) AS external_edges, round(sum(i)/(sum(i)+sum(x))*10000)/10000 AS cohesion FROM sides GROUP BY 1")
_add("cross_community_counts", lambda c: A.cross_community_counts(c.nodes, c.edges), f", {_CROSS} SELECT c1, c2, edge_count FROM cross_")
_add("coupling_warnings", lambda c: A.coupling_warnings(c.nodes, c.edges, c.communities), f", {_COMMUNITIES}, {_CROSS} SELECT c1, c2, edge_count, 'High coupling (' || edge_count || ' edges) between ''' || a.name || ''' and ''' || b.name || '''' AS warning FROM cross_ JOIN communities a ON a.id=c1 JOIN communities b ON b.id=c2 WHERE edge_count>10")
_add("architecture_overview", lambda c: A.architecture_overview(c.nodes, c.edges, c.communities), f", {_COMMUNITIES}, {_CROSS} SELECT 'community' AS section, row_number() OVER (ORDER BY size DESC, id) AS position, name AS text, CAST(size AS DOUBLE) AS value FROM communities UNION ALL SELECT 'warning', row_number() OVER (ORDER BY edge_count DESC, c1, c2), 'High coupling (' || edge_count || ' edges) between ''' || a.name || ''' and ''' || b.name || '''', CAST(edge_count AS DOUBLE) FROM cross_ JOIN communities a ON a.id=c1 JOIN communities b ON b.id=c2 WHERE edge_count>10")
_add("high_coupling", lambda c: A.high_coupling(c.edges), "SELECT target_qualified AS qualified_name, count(*) AS call_count FROM edges WHERE kind='CALLS' GROUP BY 1 HAVING count(*)>10 ORDER BY 2 DESC, 1 LIMIT 10")
_add("knowledge_gaps", lambda c: A.knowledge_gaps(c.nodes, c.edges, 50), "SELECT qualified_name, name, kind, file_path, line_start FROM nodes WHERE kind IN ('Function','Test') AND NOT is_test AND qualified_name NOT IN (SELECT target_qualified FROM edges WHERE kind='TESTED_BY') ORDER BY CASE WHEN kind='Function' THEN 0 ELSE 1 END, id LIMIT 50")
_add("surprising_connections", lambda c: A.surprising_connections(c.nodes, c.edges, c.communities, 50), "SELECT e.id, e.source_qualified, e.target_qualified, a.community_id AS source_community, b.community_id AS target_community, e.file_path, e.line FROM edges e JOIN nodes a ON a.qualified_name=e.source_qualified JOIN nodes b ON b.qualified_name=e.target_qualified WHERE e.kind='CALLS' AND a.community_id<>b.community_id ORDER BY e.id LIMIT 50")
_add("related_pairs", lambda c: A.surprising_connections(c.nodes, c.edges, c.communities.withColumn("parent_id", F.when(F.col("id") == 1, F.lit(0).cast("long"))), 50).select("id"), "SELECT e.id FROM edges e JOIN nodes a ON a.qualified_name=e.source_qualified JOIN nodes b ON b.qualified_name=e.target_qualified WHERE e.kind='CALLS' AND a.community_id<>b.community_id AND NOT (a.community_id IN (0,1) AND b.community_id IN (0,1)) ORDER BY e.id LIMIT 50")
_add("external_deps", lambda c: A.external_deps(c.nodes, c.edges), "SELECT * FROM (SELECT a.community_id, e.target_qualified AS dependency, count(*) AS ref_count, row_number() OVER (PARTITION BY a.community_id ORDER BY count(*) DESC, e.target_qualified) AS position FROM edges e JOIN nodes a ON a.qualified_name=e.source_qualified LEFT JOIN nodes b ON b.qualified_name=e.target_qualified WHERE e.kind IN ('CALLS','IMPORTS_FROM','DEPENDS_ON') AND a.community_id IS DISTINCT FROM b.community_id GROUP BY 1,2) WHERE position<=10")
_add("dominant_language", lambda c: A.dominant_language(c.nodes), "SELECT community_id, mode(language) AS dominant_language FROM nodes WHERE community_id IS NOT NULL GROUP BY 1")
_add("file_count_distinct", lambda c: c.nodes.groupBy("community_id").agg(F.count_distinct("file_path").alias("file_count")), "SELECT community_id, count(DISTINCT file_path) AS file_count FROM nodes GROUP BY 1")

# traversal and flows
_add("impact_radius", lambda c: B.impact_radius(c.edges, BARE, 5, 100000).select("qualified_name", "depth"), f", w AS (SELECT '{BARE}' AS n, 0 AS d UNION SELECT source_qualified, d+1 FROM w JOIN edges ON target_qualified=n WHERE kind IN ('CALLS','IMPORTS_FROM','DEPENDS_ON') AND d<5) SELECT n AS qualified_name, CAST(min(d) AS BIGINT) AS depth FROM w WHERE n<>'{BARE}' GROUP BY 1")
_add("entry_points", lambda c: FL.entry_points(c.nodes, c.edges).select("qualified_name"), f", {_FLOWS.split('links AS')[0].strip().rstrip(',')} SELECT qualified_name FROM entries")
_add("bfs_flow", lambda c: FL.bfs_flow(c.nodes, c.edges, FL.entry_points(c.nodes, c.edges)).select("entry", "node", "depth"), f", {_FLOWS} SELECT entry, node, CAST(depth AS BIGINT) AS depth FROM member")
_add("flow_criticality", lambda c: c.flows[0].select("id", "node_count", "file_count", "criticality"), f", {_FLOWS} SELECT id, node_count, file_count, criticality FROM flows")
_add("detect_flows", lambda c: c.flows[0].select("id", "name", "entry_point_id", "depth", "node_count", "file_count", "criticality"), f", {_FLOWS} SELECT id, name, entry_point_id, depth, node_count, file_count, criticality FROM flows")
_add("flow_memberships", lambda c: c.flows[1].select("flow_id", "node_id"), f", {_FLOWS} SELECT flow_id, node_id FROM fm")
_add("count_flow_memberships", lambda c: FL.count_flow_memberships(c.flows[1]), f", {_FLOWS} SELECT node_id, count(*) AS flow_count FROM fm GROUP BY 1")
_add("get_flows_list", lambda c: L.get_flows_list(c.flows[0]).select("id", "name", "criticality"), f", {_FLOWS} SELECT id, name, criticality FROM flows")
_add("get_flow_by_id", lambda c: L.get_flow_by_id(c.flows[0], 1000003).select("id", "name", "node_count"), f", {_FLOWS} SELECT id, name, node_count FROM flows WHERE id=1000003")
_add("get_flow_ids_by_node_ids", lambda c: L.get_flow_ids_by_node_ids(c.flows[1], c.nodes.filter("id % 7 = 0").select("id")).select("node_id", F.explode("flow_ids").alias("flow_id")), f", {_FLOWS} SELECT node_id, flow_id FROM fm WHERE node_id%7=0")
_add("flow_criticalities_for_node", lambda c: FL.flow_criticalities_for_node(*c.flows, 1000003), f", {_FLOWS} SELECT flow_id, criticality FROM fm JOIN flows ON id=flow_id WHERE node_id=1000003")
_add("flow_qualified_names", lambda c: FL.flow_qualified_names(c.nodes, c.flows[1], 1000003).select("qualified_name"), f", {_FLOWS} SELECT qualified_name FROM fm JOIN nodes ON id=node_id WHERE flow_id=1000003")
_add("affected_flows", lambda c: FL.affected_flows(c.nodes, *c.flows, FILES).select("id", "name", "criticality"), f", {_FLOWS} SELECT DISTINCT flows.id, flows.name, criticality FROM flows JOIN fm ON flow_id=flows.id JOIN nodes n ON n.id=node_id WHERE n.file_path IN (" + ",".join(f"'{x}'" for x in FILES) + ")")
_add("affected_flows_mcp", lambda c: FL.flows_through(c.flows[0], [FN, _T0]).select("id", "name"), f", {_FLOWS} SELECT DISTINCT flows.id, flows.name FROM flows JOIN member m ON m.entry=flows.entry WHERE m.node IN ('{FN}','{_T0}')")

# risk and quality
_add("risk_score", lambda c: K.risk_score(c.nodes, c.edges, *c.flows), f", {_FLOWS}, {_RISK} SELECT qualified_name, risk_score FROM risk")
_IN_FILES = "(" + ",".join(f"'{x}'" for x in FILES) + ")"
_add("analyze_changes", lambda c: K.analyze_changes(c.nodes, c.edges, *c.flows, FILES)["changed_functions"], f", {_FLOWS}, {_RISK} SELECT n.name, n.qualified_name, n.kind, n.file_path AS file, n.line_start, n.line_end, r.risk_score FROM (SELECT * FROM nodes WHERE file_path IN {_IN_FILES} AND kind IN ('Function','Test','Class') ORDER BY id LIMIT 500) n JOIN risk r USING (qualified_name)")
_add("review_priorities", lambda c: K.analyze_changes(c.nodes, c.edges, *c.flows, FILES)["review_priorities"].select("qualified_name", "risk_score"), f", {_FLOWS}, {_RISK} SELECT qualified_name, risk_score FROM risk JOIN nodes n USING (qualified_name) WHERE n.file_path IN {_IN_FILES} AND kind IN ('Function','Test','Class') ORDER BY 2 DESC, 1 LIMIT 10")
_add("test_gaps", lambda c: K.analyze_changes(c.nodes, c.edges, *c.flows, FILES)["test_gaps"], f"SELECT name, qualified_name, file_path AS file, line_start, line_end FROM nodes WHERE file_path IN {_IN_FILES} AND kind IN ('Function','Test','Class') AND NOT is_test AND qualified_name NOT IN (SELECT target_qualified FROM edges WHERE kind='TESTED_BY') ORDER BY id LIMIT 500")
_add("change_summary", lambda c: K.analyze_changes(c.nodes, c.edges, *c.flows, FILES)["summary"].select("summary", "risk_score"))
_add("dead_code", lambda c: R.dead_code(c.nodes, c.edges, 100), f"SELECT qualified_name, name, kind, file_path, line_start FROM nodes WHERE kind IN ('Function','Class') AND NOT is_test AND NOT {_LIVE} AND qualified_name NOT IN (SELECT target_qualified FROM edges WHERE kind='CALLS') ORDER BY CASE kind WHEN 'Function' THEN 0 ELSE 1 END, id LIMIT 100")
_add("large_functions", lambda c: R.large_functions(c.nodes, 100, 50), "SELECT qualified_name, name, file_path, line_start, line_end, line_end-line_start AS size FROM nodes WHERE kind IN ('Function','Test') AND line_end-line_start>=100 ORDER BY 6 DESC, 1 LIMIT 50")
_add("is_entry_point", lambda c: c.nodes.filter(S.is_live_name()).select("qualified_name"), f"SELECT qualified_name FROM nodes WHERE {_LIVE}")
_SUGGEST = f", dead AS (SELECT qualified_name, name FROM nodes WHERE kind IN ('Function','Class') AND NOT is_test AND NOT {_LIVE} AND qualified_name NOT IN (SELECT target_qualified FROM edges WHERE kind='CALLS') ORDER BY CASE kind WHEN 'Function' THEN 0 ELSE 1 END, id LIMIT 20), large AS (SELECT qualified_name, line_end-line_start AS size FROM nodes WHERE kind IN ('Function','Test') AND line_end-line_start>=50 ORDER BY 2 DESC, 1 LIMIT 20), hot AS (SELECT target_qualified AS q, count(*) AS n FROM edges WHERE kind='CALLS' GROUP BY 1 HAVING count(*)>10 ORDER BY 2 DESC, 1 LIMIT 10) SELECT 1 AS section, row_number() OVER (ORDER BY name, qualified_name) AS position, 'dead_code' AS type, qualified_name, 'Never called; consider removing or marking with a TODO.' AS reason, 'high' AS priority FROM dead UNION ALL SELECT 2, row_number() OVER (ORDER BY size DESC, qualified_name), 'large_function', qualified_name, 'Function is ' || size || ' lines; consider splitting.', CASE WHEN size>150 THEN 'high' ELSE 'medium' END FROM large UNION ALL SELECT 3, row_number() OVER (ORDER BY n DESC, q), 'high_coupling', q, 'Called by ' || n || ' callers; changes here are high-risk.', 'medium' FROM hot"
_add("refactoring_suggestions", lambda c: R.refactoring_suggestions(c.nodes, c.edges), _SUGGEST)
_add("suggested_questions", lambda c: R.suggested_questions(c.nodes, c.edges, c.communities, FN).select("question"), f", {_COMMUNITIES}, {_BRIDGE}, gaps AS (SELECT file_path FROM nodes WHERE kind IN ('Function','Test') AND NOT is_test AND qualified_name NOT IN (SELECT target_qualified FROM edges WHERE kind='TESTED_BY') ORDER BY CASE WHEN kind='Function' THEN 0 ELSE 1 END, id LIMIT 3), top AS (SELECT target_qualified AS t, count(*) AS n FROM edges WHERE kind='CALLS' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3), b3 AS (SELECT * FROM bridge WHERE cross_community_edges>0 ORDER BY bridge_score DESC, cross_community_edges DESC, qualified_name LIMIT 3) SELECT 'Which functions in `' || file_path || '` lack test coverage?' AS question FROM gaps UNION ALL SELECT 'What calls `' || nodes.name || '` and could affect system stability if it changes?' FROM top JOIN nodes ON qualified_name=t UNION ALL SELECT 'How does `' || b3.name || '` bridge `' || communities.name || '` to other parts of the codebase (' || cross_community_edges || ' cross-community connections)?' FROM b3 JOIN communities ON communities.id=community_id UNION ALL SELECT 'What is the impact radius of changes to `' || name || '`?' FROM nodes WHERE qualified_name='{FN}'")
_add("rename_preview", lambda c: R.rename_preview(c.nodes, c.edges, FN, "renamed"), f", t AS (SELECT * FROM edges WHERE source_qualified='{FN}' OR target_qualified='{FN}') SELECT n.name AS old_name, 'renamed' AS new_name, (SELECT CAST(coalesce(sum((source_qualified='{FN}')::INT + (target_qualified='{FN}')::INT),0) AS BIGINT) FROM t) AS affected_edges_count, (SELECT string_agg(f, ',' ORDER BY f) FROM (SELECT DISTINCT file_path AS f FROM t UNION SELECT file_path FROM nodes WHERE qualified_name='{FN}')) AS files_to_update FROM nodes n WHERE n.qualified_name='{FN}'")
_RENAMED = "src/r0/n10.py::renamed"


def _rename(c: Context) -> DataFrame:
    """Edges that a rename touched; a name that no node has is refused and touches none."""
    try:
        edges = R.apply_rename(c.nodes, c.edges, FN, "renamed")[1]
    except R.UnknownNode:
        return _edges(c.edges.limit(0))
    return _edges(edges.filter(F.col("source_qualified").endswith("::renamed") | F.col("target_qualified").endswith("::renamed")))


_add("apply_rename", _rename, f"SELECT id, kind, CASE WHEN source_qualified='{FN}' THEN '{_RENAMED}' ELSE source_qualified END AS source_qualified, CASE WHEN target_qualified='{FN}' THEN '{_RENAMED}' ELSE target_qualified END AS target_qualified, file_path, line FROM edges WHERE source_qualified='{FN}' OR target_qualified='{FN}'")

# communities
_add("file_communities", lambda c: C.file_communities(c.nodes), "SELECT qualified_name, split_part(file_path,'/',2) AS group_key FROM nodes WHERE kind<>'File'")
_add("keyword_counts", lambda c: C.keyword_counts(c.nodes.filter("kind != 'File'")), f", w AS (SELECT community_id, lower(unnest({_WORDS})) AS word FROM nodes WHERE kind IN ('Function','Class','Test','Type')), k AS (SELECT community_id, word, count(*) AS n, row_number() OVER (PARTITION BY community_id ORDER BY count(*) DESC, word) AS position FROM w WHERE length(word)>1 AND word NOT IN (" + ",".join(f"'{x}'" for x in S.COMMON_WORDS) + ") GROUP BY 1,2) SELECT community_id, word, n, position FROM k WHERE position<=5")
_add("file_prefix_mode", lambda c: C.file_prefix_mode(c.nodes.filter("kind != 'File'")), "SELECT community_id, min(split_part(file_path,'/',2)) AS prefix FROM nodes WHERE kind<>'File' GROUP BY 1")
_add("community_name", lambda c: C.community_name(c.nodes.filter("kind != 'File'")), "SELECT community_id, min(split_part(file_path,'/',2)) || '-customer' AS name FROM nodes WHERE kind<>'File' GROUP BY 1")
_add("detect_communities", lambda c: C.communities_table(c.nodes.filter("kind != 'File'"), c.edges, C.file_communities(c.nodes))[0].select("id", "name", "size", "dominant_language", "description"), "SELECT community_id+1 AS id, 'r' || community_id || '-customer' AS name, count(*) AS size, 'python' AS dominant_language, 'Directory-based community: r' || community_id AS description FROM nodes WHERE kind<>'File' GROUP BY community_id")
_add("community_summary", lambda c: C.community_summary(c.nodes, c.communities, 2).select("id", "name", "size", "qualified_name"), f", {_COMMUNITIES} SELECT communities.id, communities.name, size, m.qualified_name FROM communities, (SELECT qualified_name FROM nodes WHERE community_id=2 ORDER BY 1 LIMIT 20) m WHERE communities.id=2")
_add("store_communities", lambda c: C.store_communities(c.nodes, c.communities, c.nodes.filter("kind != 'File'").select("qualified_name", "community_id"))[1].select("community_id", F.array_join("key_symbols", ",").alias("key_symbols"), "risk"), "SELECT community_id, string_agg(qualified_name, ',' ORDER BY qualified_name) AS key_symbols, 'unknown' AS risk FROM (SELECT community_id, qualified_name, row_number() OVER (PARTITION BY community_id ORDER BY qualified_name) AS r FROM nodes WHERE kind<>'File') WHERE r<=5 GROUP BY 1")
_add("leiden_modularity", lambda c: C.modularity_communities(c.nodes, c.edges, rounds=6, levels=2))
_add("leiden_label_propagation", lambda c: C.label_propagation(c.nodes, c.edges, 5))

# writes
_add("upsert_nodes", lambda c: ST.upsert_nodes(c.nodes.filter("id % 2 = 0"), c.nodes.withColumn("seq", F.col("id")).unionByName(c.nodes.withColumns({"seq": F.col("id") + 1, "line_end": F.lit(7).cast("long")}))).select("qualified_name", "kind", "line_end"), "SELECT qualified_name, kind, CAST(7 AS BIGINT) AS line_end FROM nodes")
_add("upsert_edges", lambda c: ST.upsert_edges(c.edges.filter("id % 2 = 0"), c.edges.withColumns({"seq": F.col("id"), "extra": F.lit('{"confidence": 0.5, "confidence_tier": "INFERRED"}')}).unionByName(c.edges.withColumns({"seq": F.col("id"), "extra": F.lit('{"confidence": 0.5, "confidence_tier": "INFERRED"}')}))).select(*ST.EDGE_KEY, "confidence", "confidence_tier"), "SELECT kind, source_qualified, target_qualified, file_path, line, CAST(0.5 AS DOUBLE) AS confidence, 'INFERRED' AS confidence_tier FROM edges")
_add("remove_file_data", lambda c: _nodes(ST.remove_file_data(c.nodes, c.edges, c.spark.createDataFrame([(f,) for f in FILES], "file_path string"))[0]), f"SELECT {_NODE} FROM nodes WHERE file_path NOT IN {_IN_FILES}")
_add("delete_nodes_for_file", lambda c: _nodes(ST.delete_nodes_for_file(c.nodes, FILE)), f"SELECT {_NODE} FROM nodes WHERE file_path<>'{FILE}'")
_add("replace_file_batch", lambda c: ST.replace_file_batch(c.nodes, c.edges, c.spark.createDataFrame([(FILE,)], "file_path string"), c.nodes.filter(f"file_path = '{FILE}' AND kind != 'Class'").withColumn("seq", F.col("id")), c.edges.filter("id < 0").withColumn("seq", F.col("id")))[0].select("qualified_name", "kind"), f"SELECT qualified_name, kind FROM nodes WHERE NOT (file_path='{FILE}' AND kind='Class')")

# text and vectors
_add("keyword_search", lambda c: T.keyword_search(c.nodes, "auth Customer", 30), "SELECT id, CAST(CASE WHEN lower(name)='auth customer' THEN 3 WHEN lower(name) LIKE 'auth customer%' THEN 2 ELSE 1 END AS DOUBLE) AS score FROM nodes WHERE (lower(name) LIKE '%auth%' OR lower(qualified_name) LIKE '%auth%') AND (lower(name) LIKE '%customer%' OR lower(qualified_name) LIKE '%customer%') ORDER BY id LIMIT 30")
_PHRASE = "of the"
_BM = f"WITH {_DOCTOK}, len AS (SELECT doc_id, count(*) AS len FROM tok GROUP BY 1), hit AS (SELECT a.doc_id, count(*) AS tf FROM tok a JOIN tok b ON a.doc_id=b.doc_id AND b.pos=a.pos+1 WHERE a.term='of' AND b.term='the' GROUP BY 1), k AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM hit) AS df, (SELECT avg(len) FROM len) AS al) SELECT doc_id, round(ln(1+(n-df+0.5)/(df+0.5))*tf*2.2/(tf+1.2*(0.25+0.75*len/al))*1000000)/1000000 AS score FROM hit JOIN len USING (doc_id), k"
_add("fts_search", lambda c: T.fts_search(c.table("documents"), _PHRASE, 1 << 30, "doc_id", ("text",), stem=False).withColumn("score", F.round(F.col("score") * 1000000) / 1000000), _BM, graph=False)
_add("fts_search_stemmed", lambda c: T.fts_search(c.nodes, "auth customer", 20))
_add("inverted_index", lambda c: T.build_index(c.table("benchmark"), "item_id", ("text",)).groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("item_id").alias("df")), "SELECT term, count(*) AS n, count(DISTINCT item_id) AS df FROM (SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS term FROM benchmark) GROUP BY 1", graph=False)
_add("rrf_merge", lambda c: T.rrf_merge(c.nodes.filter("kind = 'Class'").select("id", F.col("line_start").cast("double").alias("score")), c.nodes.filter("kind = 'Class'").select("id", F.col("line_end").cast("double").alias("score")), c.nodes.filter("kind = 'Class' AND id % 2 = 0").select("id", F.col("id").cast("double").alias("score"))).withColumn("score", F.round(F.col("score") * 1e9) / 1e9), "SELECT id, round(sum(1.0/(60+r))*1e9)/1e9 AS score FROM (SELECT id, row_number() OVER (ORDER BY line_start DESC, id) AS r FROM nodes WHERE kind='Class' UNION ALL SELECT id, row_number() OVER (ORDER BY line_end DESC, id) FROM nodes WHERE kind='Class' UNION ALL SELECT id, row_number() OVER (ORDER BY id DESC, id) FROM nodes WHERE kind='Class' AND id%2=0) GROUP BY 1")
_add("query_identifiers", lambda c: c.nodes.filter("kind != 'File'").select("id", F.explode(T.query_identifiers(F.concat(F.lit("who calls "), F.regexp_replace("name", "_", "."), F.lit(" or get_item in APIRoute"), F.lit(" now")))).alias("ident")), "SELECT id, unnest(list_distinct(list_transform(list_concat(regexp_extract_all(q, '\\b[A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)+\\b'), list_concat(regexp_extract_all(q, '\\b[a-z][a-z0-9]*(?:_[a-z0-9]+)+\\b'), regexp_extract_all(q, '\\b[A-Z][a-z0-9]+(?:[A-Z][a-z0-9]+)+\\b'))), lambda x: lower(x)))) AS ident FROM (SELECT id, 'who calls ' || replace(name,'_','.') || ' or get_item in APIRoute now' AS q FROM nodes WHERE kind<>'File')")
_add("hybrid_search", lambda c: T.hybrid_search(c.nodes, "auth_Customer", None, 20, [FILE]).drop("signature", "params", "return_type"))
_add("cosine_similarity", lambda c: _cosine(c), "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id=0))*1000000)/1000000 AS similarity FROM embeddings", graph=False)
_add("vector_search", lambda c: _nearest(c), "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id=0))*1000000)/1000000 AS similarity FROM embeddings ORDER BY 2 DESC, 1 LIMIT 20", graph=False)
_add("node_to_text", lambda c: _text_nodes(c).select("id", T.node_to_text().alias("text")), "SELECT id, concat_ws(' ', name, CASE WHEN trim(regexp_replace(name, '[_./\\-\\s]+', ' ', 'g'))<>name THEN trim(regexp_replace(name, '[_./\\-\\s]+', ' ', 'g')) END, CASE WHEN kind<>'File' THEN lower(kind) END, split_part(file_path,'/',2), language) AS text FROM nodes")
_add("text_hash", lambda c: c.table("documents").select("doc_id", S.text_hash("text").alias("text_hash")), "SELECT doc_id, substr(sha256(text),1,16) AS text_hash FROM documents", graph=False)
_add("vector_count", lambda c: T.vector_count(T.embed_nodes(c.nodes)), "SELECT count(*) AS n FROM nodes WHERE kind<>'File'")
_add("embed_nodes", lambda c: T.embed_nodes(c.nodes).select("qualified_name", "text_hash", "provider", F.size("vector").alias("n")))

# scalars
_add("make_qualified", lambda c: c.nodes.select("id", S.make_qualified().alias("q"), S.make_qualified(parent=F.lit("Outer")).alias("in_parent")), "SELECT id, CASE WHEN kind='File' THEN file_path ELSE file_path || '::' || name END AS q, CASE WHEN kind='File' THEN file_path ELSE file_path || '::Outer.' || name END AS in_parent FROM nodes")
_add("sanitize_name", lambda c: c.table("pages").select("page_id", S.sanitize_name("html").alias("clean")), "SELECT page_id, substr(regexp_replace(html, '[\\x00-\\x08\\x0B-\\x1F]', '', 'g'),1,256) AS clean FROM pages", graph=False)
_add("esc_html", lambda c: c.table("pages").select("page_id", F.sha2(S.escape_html("html"), 256).alias("escaped")), "SELECT page_id, sha256(replace(replace(replace(replace(replace(replace(html,'&','&amp;'),'<','&lt;'),'>','&gt;'),'\"','&quot;'),'''','&#39;'),'`','&#96;')) AS escaped FROM pages", graph=False)
_add("to_slug", lambda c: c.table("part").select("p_partkey", S.to_slug("p_name").alias("slug")), "SELECT p_partkey, substr(regexp_replace(regexp_replace(lower(p_name),'[^a-z0-9]+','-','g'),'^-+|-+$','','g'),1,30) AS slug FROM part", graph=False)
_add("split_name", lambda c: c.table("part").select("p_partkey", F.array_join(S.split_name(F.initcap("p_name")), "|").alias("words")), "SELECT p_partkey, array_to_string(list_filter(regexp_split_to_array(regexp_replace(n, '([a-z])([A-Z])', '\\1_\\2', 'g'), '[_\\-.\\s]+'), lambda w: w <> ''), '|') AS words FROM (SELECT p_partkey, array_to_string(list_transform(string_split(lower(p_name),' '), lambda x: upper(x[1]) || x[2:]),' ') AS n FROM part)", graph=False)
_add("split_identifier", lambda c: c.table("customer").select("c_custkey", S.split_identifier(F.concat(F.lit("getItem_"), "c_name")).alias("words")), "SELECT c_custkey, 'get Item ' || replace(c_name,'_',' ') AS words FROM (SELECT c_custkey, regexp_replace(c_name,'[_./\\-\\s]+',' ','g') AS c_name FROM customer)", graph=False)
_add("community_slug", lambda c: c.table("region").select(S.community_slug("r_name", "r_regionkey").alias("slug")), "SELECT 'community_' || r_regionkey || '_' || lower(regexp_replace(r_name,'[^\\p{L}\\p{N}-]','_','g')) AS slug FROM region", graph=False)
_add("node_color", lambda c: c.nodes.select("id", S.node_color("kind").alias("color")), "SELECT id, CASE kind WHEN 'File' THEN '#6366f1' WHEN 'Class' THEN '#10b981' WHEN 'Function' THEN '#f59e0b' WHEN 'Test' THEN '#3b82f6' ELSE '#6b7280' END AS color FROM nodes")
_add("fmt_count", lambda c: c.table("orders").select("o_orderkey", S.fmt_count("o_orderkey").alias("shown")), "SELECT o_orderkey, format('{:,}', o_orderkey) AS shown FROM orders", graph=False)
_add("security_keywords", lambda c: c.nodes.filter(S.is_security_relevant("name", "qualified_name")).select("id"), f"SELECT id FROM nodes WHERE {_SEC.format('name')} OR {_SEC.format('qualified_name')}")
_add("is_test_name", lambda c: c.nodes.select("id", S.is_test_name("name", "function").alias("f"), S.is_test_name("name", "class").alias("k")), "SELECT id, name LIKE 'test\\_%' ESCAPE '\\' OR name LIKE 'Test%' OR name LIKE '%\\_test' ESCAPE '\\' OR name LIKE '%\\_spec' ESCAPE '\\' AS f, name LIKE 'Test%' OR name LIKE '%Test' OR name LIKE '%Tests' OR name LIKE '%TestCase' OR name LIKE '%Spec' AS k FROM nodes")
_add("is_test_file", lambda c: c.nodes.filter(S.is_test_file(F.concat(F.lit("a/test_"), F.element_at(F.split("file_path", "/"), -1)))).select("id"), "SELECT id FROM nodes")
_add("matches_entry_name", lambda c: c.nodes.filter(S.matches_entry_name()).select("id"), f"SELECT id FROM nodes WHERE {_ENTRY}")
_add("has_framework_decorator", lambda c: c.nodes.withColumn("extra", F.when(F.col("id") % 3 == 0, '{"decorators": ["app.get(1)", "x"]}').when(F.col("id") % 3 == 1, '{"decorators": "pytest.fixture"}').otherwise('{"decorators": "plain"}')).filter(S.has_framework_decorator()).select("id"), "SELECT id FROM nodes WHERE id%3<>2")
_add("json_extra", lambda c: c.table("events").select("event_id", F.get_json_object(S.json_or_empty("props"), "$.k").cast("long").alias("k")), "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", graph=False)
_add("validate_git_ref", lambda c: c.table("orders").select("o_orderkey", S.is_valid_git_ref(F.concat(F.lit("v"), F.col("o_orderkey").cast("string"), F.when(F.col("o_orderkey") % 2 == 0, ";rm").otherwise("~1"))).alias("ok"), S.is_valid_svn_revision(F.concat(F.lit("r"), F.col("o_orderkey").cast("string"), F.lit(":HEAD"))).alias("svn")), "SELECT o_orderkey, o_orderkey%2<>0 AS ok, true AS svn FROM orders", graph=False)
_LANGUAGES = ", ".join([f"('dir/file.{x}', '{lang}')" for x, lang in sorted(SF.LANGUAGE_OF.items())] + ["('dir/README', NULL)", "('x.unknown', NULL)"])
_add("detect_language", lambda c: c.spark.createDataFrame([(f"dir/file.{x}",) for x in sorted(SF.LANGUAGE_OF)] + [("dir/README",), ("x.unknown",)], "path string").select("path", SF.detect_language(F.col("path")).alias("language")), f"SELECT * FROM (VALUES {_LANGUAGES}) t(path, language)", graph=False)
_add("file_hash", lambda c: c.table("pages").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("file_hash")), "SELECT page_id, sha256(html) AS file_hash FROM pages", graph=False)
_add("contains_edges", lambda c: c.nodes.filter("kind != 'File' AND parent_name IS NULL").select(F.lit("CONTAINS").alias("kind"), F.col("file_path").alias("source_qualified"), F.col("qualified_name").alias("target_qualified")), "SELECT kind, source_qualified, target_qualified FROM edges WHERE kind='CONTAINS'")
_add("parse_unified_diff", lambda c: K.parse_unified_diff(_diffs(c)), "SELECT n_nationkey AS diff_id, 'src/n' || n_nationkey || '.py' AS file_path, CAST(n_nationkey+1 AS BIGINT) AS start, CAST(n_nationkey+4 AS BIGINT) AS end FROM nation UNION ALL SELECT n_nationkey, 'lib/b.py', CAST(7 AS BIGINT), CAST(7 AS BIGINT) FROM nation UNION ALL SELECT n_nationkey, 'lib/b.py', CAST(20 AS BIGINT), CAST(20 AS BIGINT) FROM nation", graph=False)

# presentation and streaming
_add("viz_nodes", lambda c: V.viz_nodes(c.nodes, 300).select("id", "label", "kind", "file", "color", "community"), "SELECT id, name AS label, kind, file_path AS file, CASE kind WHEN 'File' THEN '#6366f1' WHEN 'Class' THEN '#10b981' WHEN 'Function' THEN '#f59e0b' WHEN 'Test' THEN '#3b82f6' ELSE '#6b7280' END AS color, community_id AS community FROM nodes ORDER BY CASE WHEN kind='File' THEN 1 ELSE 0 END, id LIMIT 300")
_add("viz_links", lambda c: V.viz_links(c.nodes, c.edges, 300), ", v AS (SELECT * FROM nodes ORDER BY CASE WHEN kind='File' THEN 1 ELSE 0 END, id LIMIT 300) SELECT a.id AS source, b.id AS target, e.kind, e.id AS edge_id FROM edges e JOIN v a ON a.qualified_name=e.source_qualified JOIN v b ON b.qualified_name=e.target_qualified")
_add("wiki_index", lambda c: V.wiki_index(c.communities), f", {_COMMUNITIES} SELECT row_number() OVER (ORDER BY size DESC, id) AS position, '| [' || name || '](community_' || id || '_' || regexp_replace(name,'[^\\p{{L}}\\p{{N}}-]','_','g') || '.md) | ' || size || ' | python | ' || description || ' |' AS line FROM communities")
_add("wiki_page", lambda c: V.wiki_page(c.nodes, c.edges, c.communities, 2).filter("section = 'symbols'"), "SELECT 'symbols' AS section, row_number() OVER (ORDER BY name, qualified_name)-1 AS position, '- `' || name || '` (' || kind || ') in `' || file_path || '`' AS line FROM (SELECT * FROM nodes WHERE community_id=2 AND kind IN ('Function','Class') ORDER BY name, qualified_name LIMIT 20)")
_add("incremental_latest_state", lambda c: latest_state(c.spark, c.table("events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id"), "SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1", graph=False)
_add("changed_files", lambda c: SF.changed_files(c.nodes.filter("kind = 'File' AND id % 5 != 0").select(F.col("file_path").alias("path"), F.when(F.col("id") % 5 == 1, "new").otherwise("same").alias("file_hash")), c.nodes.filter("id % 5 != 2").withColumn("file_hash", F.lit("same"))), "SELECT file_path AS path, CASE id%5 WHEN 0 THEN 'deleted' WHEN 1 THEN 'changed' ELSE 'added' END AS change FROM nodes WHERE kind='File' AND id%5 IN (0,1,2)")


def _query_vector(c: Context) -> list[float]:
    return list(c.table("embeddings").filter("vec_id = 0").first()["embedding"])


def _cosine(c: Context) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in _query_vector(c)))
    return c.table("embeddings").select("vec_id", (F.round(S.cosine("embedding", q) * 1000000) / 1000000).alias("similarity"))


def _nearest(c: Context) -> DataFrame:
    out = T.vector_search(c.table("embeddings"), _query_vector(c), 20, "vec_id", "embedding")
    return out.withColumn("similarity", F.round(F.col("similarity") * 1000000) / 1000000)


def _text_nodes(c: Context) -> DataFrame:
    return c.nodes.withColumns({"params": F.lit(""), "return_type": F.lit(None).cast("string")})


def _diffs(c: Context) -> DataFrame:
    n = F.col("n_nationkey").cast("string")
    text = F.concat(F.lit("diff --git a/x b/x\n--- a/x\n+++ b/src/n"), n, F.lit(".py\n@@ -1,2 +"), (F.col("n_nationkey") + 1).cast("string"), F.lit(",4 @@ def f():\n+x\n+++ b/lib/b.py\n@@ -3 +7,0 @@\n@@ -9,3 +20 @@\n-y\n"))
    return c.table("nation").select(F.col("n_nationkey").alias("diff_id"), text.alias("diff"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, d, q=q: q(Context(spark, d))) for name, q in _queries.items()}


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
