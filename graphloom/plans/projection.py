"""The driver's tables seen as a property graph, and the same projection as SQL for oracles.

Nations are files, suppliers classes, customers functions and tests; orders make calls, bare-name calls and test links.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_NODES = """
WITH nat AS (SELECT n_nationkey, n_regionkey, concat('src/r', n_regionkey, '/n', n_nationkey, '.py') AS fp FROM {nation})
SELECT CAST(1+n_nationkey AS BIGINT) AS id,'File' AS kind,concat('n',n_nationkey,'.py') AS name,fp AS qualified_name,fp AS file_path,CAST(1 AS BIGINT) AS line_start,CAST(1000 AS BIGINT) AS line_end,'python' AS language,CAST(NULL AS STRING) AS parent_name,false AS is_test,CAST(n_regionkey AS BIGINT) AS community_id FROM nat
UNION ALL
SELECT 1000+s_suppkey,'Class',replace(s_name,'#','_'),concat(fp,'::',replace(s_name,'#','_')),fp,(s_suppkey*7)%900,(s_suppkey*7)%900+30,'python',CAST(NULL AS STRING),false,CAST(n_regionkey AS BIGINT) FROM {supplier} JOIN nat ON s_nationkey=n_nationkey
UNION ALL
SELECT 1000000+c_custkey,CASE WHEN c_custkey%10=0 THEN 'Test' ELSE 'Function' END,nm,concat(fp,'::',nm),fp,(c_custkey*13)%900,(c_custkey*13)%900+c_custkey%120,'python',CAST(NULL AS STRING),c_custkey%10=0,CAST(n_regionkey AS BIGINT)
FROM (SELECT c_custkey,c_nationkey,concat(CASE WHEN c_custkey%10=0 THEN 'test_' WHEN c_custkey%37=0 THEN 'auth_' ELSE '' END,replace(c_name,'#','_')) AS nm FROM {customer}) c JOIN nat ON c_nationkey=n_nationkey
"""

_NEXT = "o AS (SELECT o_orderkey,o_custkey,lead(o_custkey) OVER (ORDER BY o_orderkey) AS nxt FROM {orders} WHERE o_orderkey%5=0 AND o_orderstatus<>'P')"
#: The same without one window over all rows: order keys in stretches of 4096, the last of each looks up the next stretch's first.
_NEXT_DEALT = """
picked AS (SELECT o_orderkey,o_custkey,o_orderkey DIV 4096 AS stretch FROM {orders} WHERE o_orderkey%5=0 AND o_orderstatus<>'P'),
firsts AS (SELECT stretch, lead(first_cust) OVER (ORDER BY stretch) AS after FROM (SELECT stretch, min_by(o_custkey, o_orderkey) AS first_cust FROM picked GROUP BY stretch)),
o AS (SELECT o_orderkey,o_custkey,coalesce(lead(o_custkey) OVER (PARTITION BY picked.stretch ORDER BY o_orderkey), CASE WHEN row_number() OVER (PARTITION BY picked.stretch ORDER BY o_orderkey DESC) = 1 THEN after END) AS nxt FROM picked JOIN firsts ON picked.stretch = firsts.stretch)
"""

_EDGES = """
WITH {next},
calls AS (SELECT 'CALLS' AS kind,a.qualified_name AS source_qualified,b.qualified_name AS target_qualified,a.file_path,o.o_orderkey AS line FROM o JOIN {nodes} a ON a.id=1000000+o.o_custkey JOIN {nodes} b ON b.id=1000000+o.nxt WHERE o.o_custkey<o.nxt),
bare AS (SELECT 'CALLS' AS kind,a.qualified_name,CASE WHEN o_orderkey%2=0 THEN 'print' ELSE replace(s_name,'#','_') END,a.file_path,o_orderkey FROM {orders} JOIN {nodes} a ON a.id=1000000+o_custkey JOIN {supplier} ON s_suppkey=o_orderkey%10 WHERE o_orderkey%11=0),
tested AS (SELECT DISTINCT 'TESTED_BY' AS kind,a.qualified_name,b.qualified_name,a.file_path,CAST(1 AS BIGINT) FROM {orders} JOIN (SELECT count(*) AS n_cust FROM {customer}) cc ON true JOIN {nodes} a ON a.id=1000000+o_custkey JOIN {nodes} b ON b.id=1000000+(o_custkey*7+1)%n_cust WHERE a.is_test AND NOT b.is_test),
imports AS (SELECT DISTINCT 'IMPORTS_FROM' AS kind,f.qualified_name,g.qualified_name,f.file_path,CAST(1 AS BIGINT) FROM {nodes} f JOIN {nodes} g ON g.id=(f.id*3)%25+1 WHERE f.kind='File' AND f.id<>g.id),
contains AS (SELECT 'CONTAINS' AS kind,n.file_path,n.qualified_name,n.file_path AS fp2,CAST(1 AS BIGINT) FROM {nodes} n WHERE n.kind<>'File' AND n.parent_name IS NULL),
u AS (SELECT * FROM calls UNION ALL SELECT * FROM bare UNION ALL SELECT * FROM tested UNION ALL SELECT * FROM imports UNION ALL SELECT * FROM contains)
"""
_IDS = "SELECT CAST(row_number() OVER (ORDER BY kind,source_qualified,target_qualified,line) AS BIGINT) AS id,u.* FROM u"
#: The same numbers without one window over all rows: numbers within (kind, first nine characters of the source) plus what comes before.
_IDS_DEALT = """,
g AS (SELECT kind AS gk, left(source_qualified,9) AS gs, coalesce(sum(count(*)) OVER (ORDER BY kind, left(source_qualified,9) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS before FROM u GROUP BY kind, left(source_qualified,9))
SELECT CAST(before + row_number() OVER (PARTITION BY kind, left(source_qualified,9) ORDER BY source_qualified,target_qualified,line) AS BIGINT) AS id,u.* FROM u JOIN g ON kind = gk AND left(source_qualified,9) = gs
"""


@dataclass(frozen=True)
class Graph:
    """Nodes and edges; every operator takes these two tables or one of them."""

    nodes: DataFrame
    edges: DataFrame


_kept: dict = {}


def project(spark: SparkSession, sf_dir: str) -> Graph:
    """Project the tables of ``sf_dir``; the graph is cached in the session, as many operators read it several times."""
    key = (spark.sparkContext.applicationId, id(spark), sf_dir)
    if key not in _kept:
        read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "supplier", "customer", "orders")}
        nodes = spark.sql(_NODES, **{t: read[t] for t in ("nation", "supplier", "customer")}).cache()
        text = _EDGES.replace("{next}", _NEXT_DEALT) + _IDS_DEALT
        edges = spark.sql(text, nodes=nodes, **{t: read[t] for t in ("supplier", "customer", "orders")}).cache()
        _kept[key] = Graph(nodes, edges)
    return _kept[key]


def oracle_prefix() -> str:
    """``WITH RECURSIVE nodes AS ..., edges AS ...`` for DuckDB; a query's own CTEs or SELECT follow."""
    plain = {t: t for t in ("nation", "supplier", "customer", "orders", "nodes")}
    edges = (_EDGES + _IDS).replace("{next}", _NEXT)
    for k, v in plain.items():
        edges = edges.replace("{" + k + "}", v)
    nodes = _NODES
    for k, v in plain.items():
        nodes = nodes.replace("{" + k + "}", v)
    return f"WITH RECURSIVE nodes AS ({nodes}), edges AS ({edges})"
