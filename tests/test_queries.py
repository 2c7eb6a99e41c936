"""Every query that has SQL is held against DuckDB at the smallest scale."""

import math
import os

import duckdb
import pytest

from graphloom import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables")
SAMPLE = [
    "projection_nodes", "projection_edges", "resolve_calls", "hub_nodes", "bridge_nodes", "community_cohesion", "architecture_overview", "external_deps", "impact_radius", "detect_flows",
    "risk_score", "change_overlap", "suggested_questions", "refactoring_suggestions", "file_communities", "keyword_counts", "upsert_edges", "fts_search", "rrf_merge", "query_identifiers",
    "cosine_similarity", "node_to_text", "esc_html", "parse_unified_diff", "viz_links", "wiki_index",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def plain(v):
    return repr(round(v, 9)) if isinstance(v, float) and not math.isnan(v) else repr(v)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    cur = duck.execute(catalog.oracle_sql()[name])
    have = [d[0] for d in cur.description]
    assert sorted(have) == cols
    at = [have.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


def test_embed_nodes_embeds_every_node(spark):
    every = catalog.queries()["projection_nodes"](spark, DIR).filter("kind != 'File'").select("qualified_name").distinct()
    got = catalog.queries()["embed_nodes"](spark, DIR)
    assert got.select("qualified_name").exceptAll(every).isEmpty() and every.exceptAll(got.select("qualified_name")).isEmpty()


def test_rename_of_a_name_that_no_node_has_equals_sql(spark, tmp_path):
    con = duckdb.connect()
    for t in TABLES:
        keep = "WHERE c_custkey <> 3" if t == "customer" else ""
        con.execute(f"copy (select * from '{DIR}/{t}.parquet' {keep}) to '{tmp_path}/{t}.parquet'")
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    assert con.execute(catalog.oracle_sql()["apply_rename"]).fetchall() == []
    assert catalog.queries()["apply_rename"](spark, str(tmp_path)).collect() == []
