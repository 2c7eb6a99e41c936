import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphloom.functions import scalars as S
from graphloom.functions.porter import stem
from graphloom.operators import aggregate as A
from graphloom.operators import communities as C
from graphloom.operators import flows as FL
from graphloom.operators import lookup as L
from graphloom.operators import refactor as R
from graphloom.operators import render as V
from graphloom.operators import risk as K
from graphloom.operators import search as T
from graphloom.operators import store as ST
from graphloom.operators import traverse as B

from .helpers import edges, nodes, q


def names(df, col="qualified_name"):
    return [r[col] for r in df.collect()]


def test_hub_counts_and_dangling_targets_take_places(spark):
    n = nodes(spark, [{"name": x} for x in "abc"])
    e = edges(spark, [("CALLS", q("a"), q("c")), ("CALLS", q("b"), q("c"))])
    top = A.hub_nodes(n, e, 5).first()
    assert (top.name, top.call_count) == ("c", 2)
    e2 = e.unionByName(edges(spark, [("CALLS", q("a"), "print")] * 3))
    assert A.hub_nodes(n, e2, 1).count() == 0


def test_gaps_and_dead_code(spark):
    n = nodes(spark, [{"name": "fn_tested"}, {"name": "fn_untested"}, {"name": "test_it", "kind": "Test", "is_test": True}])
    assert names(A.knowledge_gaps(n, edges(spark, [("TESTED_BY", q("test_it"), q("fn_tested"))]))) == [q("fn_untested")]
    n = nodes(spark, [{"name": "called_fn"}, {"name": "orphan_fn"}, {"name": "main"}, {"name": "testimony"}])
    assert names(R.dead_code(n, edges(spark, [("CALLS", "caller", q("called_fn"))]))) == [q("orphan_fn")]


def test_chain_and_cycle(spark):
    n = nodes(spark, [{"name": x} for x in ("main", "foo", "bar")])
    e = edges(spark, [("CALLS", q("main"), q("foo")), ("CALLS", q("foo"), q("bar")), ("CALLS", q("bar"), "nowhere")])
    got = FL.bfs_flow(n, e, n.filter("name = 'main'")).orderBy("pos").collect()
    assert [(r.node, r.depth) for r in got] == [(q("main"), 0), (q("foo"), 1), (q("bar"), 2)]
    e = edges(spark, [("CALLS", q("main"), q("foo")), ("CALLS", q("foo"), q("main"))])
    assert FL.bfs_flow(n, e, n.filter("name = 'main'")).count() == 2


def queue(links, start, max_depth, max_nodes):
    seen, out, todo = {start}, [start], [(start, 0)]
    while todo and len(out) < max_nodes:
        x, d = todo.pop(0)
        if d >= max_depth:
            break
        for y in links.get(x, []):
            if y not in seen:
                if len(out) >= max_nodes:
                    break
                seen.add(y)
                out.append(y)
                todo.append((y, d + 1))
    return out


def test_bfs_equals_a_queue(spark):
    rng = random.Random(3)
    for caps in ((10, 500), (3, 5)):
        pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(30)]
        n = nodes(spark, [{"name": f"n{i}"} for i in range(12)])
        e = edges(spark, [("CALLS", q(f"n{a}"), q(f"n{b}")) for a, b in pairs])
        links = {}
        for a, b in pairs:
            links.setdefault(q(f"n{a}"), []).append(q(f"n{b}"))
        got = {}
        for r in FL.bfs_flow(n, e, n, *caps).orderBy("entry", "pos").collect():
            got.setdefault(r.entry, []).append(r.node)
        assert got == {q(f"n{i}"): queue(links, q(f"n{i}"), *caps) for i in range(12)}


def test_impact_radius_takes_dangling_names(spark):
    e = edges(spark, [("CALLS", "b", "a"), ("IMPORTS_FROM", "c", "b"), ("CONTAINS", "d", "a")])
    assert {(r.qualified_name, r.depth) for r in B.impact_radius(e, "a").collect()} == {("b", 1), ("c", 2)}
    assert B.impact_radius(e, "a", 1).count() == 1 and B.impact_radius(e, "a", 5, 1).count() == 1


def test_resolution_needs_one_owner(spark):
    n = nodes(spark, [{"name": "one"}, {"name": "two"}, {"name": "two", "file_path": "src/g.py"}])
    got = {r.line: r.target_qualified for r in B.resolve_calls(n, edges(spark, [{"kind": "CALLS", "source_qualified": "x", "target_qualified": t, "line": i} for i, t in enumerate(("one", "two", "print", q("one")))])).collect()}
    assert got == {0: q("one"), 1: "two", 2: "print", 3: q("one")}


def test_cohesion(spark):
    n = nodes(spark, [{"name": "a", "community_id": 1}, {"name": "b", "community_id": 1}, {"name": "c"}])
    one = A.community_cohesion(n, edges(spark, [("CALLS", q("a"), q("b"))])).first()
    none = A.community_cohesion(n, edges(spark, [("CALLS", q("a"), q("c"))])).first()
    assert (one.cohesion, none.cohesion) == (1.0, 0.0)


def test_rename(spark):
    n = nodes(spark, [{"name": "orig_fn"}, {"name": "taken"}])
    e = edges(spark, [("CALLS", "caller", q("orig_fn"))])
    n2, e2, counts = R.apply_rename(n, e, q("orig_fn"), "new_fn")
    assert counts == {"nodes": 1, "edges": 1} and e2.first().target_qualified == q("new_fn") and q("new_fn") in names(n2)
    with pytest.raises(ValueError):
        R.apply_rename(n, e, q("orig_fn"), "taken")
    with pytest.raises(ValueError):
        R.apply_rename(n, e, "missing", "x")


def test_upserts_keep_ids_and_last_wins(spark):
    old = nodes(spark, [{"name": "a", "community_id": 7, "signature": "s"}, {"name": "b"}])
    new = nodes(spark, [{"name": "a", "line_end": 3}, {"name": "a", "line_end": 4}, {"name": "c"}, {"name": "d"}]).withColumn("seq", F.monotonically_increasing_id())
    got = {r.name: r for r in ST.upsert_nodes(old, new).collect()}
    assert (got["a"].id, got["a"].community_id, got["a"].signature, got["a"].line_end) == (1, 7, "s", 4)
    assert sorted(r.id for r in got.values()) == [1, 2, 3, 4]
    again = {r.name: r.id for r in ST.upsert_nodes(ST.upsert_nodes(old, new), new).collect()}
    assert again == {k: v.id for k, v in got.items()}
    e = edges(spark, [{"kind": "CALLS", "source_qualified": "a", "target_qualified": "b", "extra": '{"confidence": 0.25}'}] * 2).withColumn("seq", F.lit(1))
    row = ST.upsert_edges(edges(spark, []), e).collect()
    assert len(row) == 1 and row[0].confidence == 0.25 and row[0].confidence_tier == "EXTRACTED"


def test_snapshots_change_as_a_whole(spark, tmp_path):
    s = ST.Snapshots(spark, f"file://{tmp_path}/store")
    assert s.read("nodes").count() == 0
    s.write({"nodes": nodes(spark, [{"name": "a"}])})
    s.set_metadata("last_updated", "now")
    assert s.get_metadata("last_updated") == "now" and s.read("nodes").count() == 1


def test_diff_and_overlap(spark):
    text = "diff --git a/x b/x\n--- a/x\n+++ b/src/f.py\n@@ -1,2 +10,4 @@ def f\n+x\n@@ -9 +30,0 @@\n+++ b/g.py\n@@ -1 +5 @@\n"
    r = K.parse_unified_diff(spark.createDataFrame([(1, text)], "diff_id int, diff string"))
    assert [(x.file_path, x.start, x.end) for x in r.collect()] == [("src/f.py", 10, 13), ("src/f.py", 30, 30), ("g.py", 5, 5)]
    n = nodes(spark, [{"name": "a", "line_start": 1, "line_end": 9}, {"name": "b", "line_start": 13, "line_end": 20}, {"name": "c", "file_path": "src/g.py"}])
    assert set(names(K.change_overlap(n, r))) == {q("b"), q("c", "src/g.py")}


def test_risk_and_change_report(spark):
    n = nodes(spark, [{"name": "auth_a", "community_id": 1}, {"name": "b", "community_id": 2}, {"name": "test_a", "kind": "Test", "is_test": True, "community_id": 1}])
    e = edges(spark, [("CALLS", q("b"), q("auth_a")), ("TESTED_BY", q("test_a"), q("auth_a"))])
    f, m = FL.detect_flows(n, e)
    risk = {r.qualified_name: r.risk_score for r in K.risk_score(n, e, f, m).collect()}
    flow = f.first().criticality
    assert risk[q("auth_a")] == pytest.approx(round(min(flow, 0.25) + 0.05 + 0.25 + 0.2 + 0.05, 4))
    report = K.analyze_changes(n, e, f, m, ["src/f.py"])
    assert report["review_priorities"].first().qualified_name == q("auth_a")
    assert report["summary"].first().summary.startswith("Analyzed 1 changed file(s):\n  - 3 changed")
    assert names(report["test_gaps"]) == [q("b")]
    assert K.analyze_changes(n, e, f, m, ["none"])["summary"].first().summary.endswith("0.00")


def test_review_priorities_are_chosen_among_all_changes(spark):
    n = nodes(spark, [{"name": "plain"}, {"name": "other"}, {"name": "auth_late"}])
    e = edges(spark, [("CALLS", q("plain"), q("auth_late"))])
    report = K.analyze_changes(n, e, *FL.detect_flows(n, e), ["src/f.py"], max_changed=1)
    assert names(report["review_priorities"])[0] == q("auth_late") and report["review_priorities"].count() == 3
    assert names(report["changed_functions"]) == [q("plain")]


def test_flow_rules(spark):
    n = nodes(spark, [{"name": "main"}, {"name": "helper"}, {"name": "view", "extra": '{"decorators": ["app.get(\\"/\\")"]}'}])
    e = edges(spark, [("CALLS", q("main"), q("helper")), ("CALLS", q("helper"), q("view"))])
    assert set(names(FL.entry_points(n, e))) == {q("main"), q("view")}
    f, m = FL.detect_flows(n, e)
    row = f.collect()
    assert [(r.name, r.node_count, r.depth) for r in row] == [("main", 3, 2)] and m.filter("position = 0").first().node_id == 1
    assert FL.flows_through(f, [q("view")]).count() == 1 and FL.affected_flows(n, f, m, ["src/f.py"]).count() == 1


def test_communities(spark):
    n = nodes(spark, [{"name": f"getUser{i}", "file_path": f"src/{'auth' if i < 3 else 'db'}/m{i}.py"} for i in range(6)] + [{"name": "x", "kind": "File", "file_path": "src/auth/m0.py"}])
    got = {r.qualified_name: r.group_key for r in C.file_communities(n).collect()}
    assert set(got.values()) == {"auth", "db"} and len(got) == 6
    table, _ = C.communities_table(n, edges(spark, []), C.file_communities(n))
    assert [r.name for r in table.orderBy("id").collect()] == ["auth-user0", "db-user3"]
    e = edges(spark, [("CALLS", q("a"), q("b")), ("CALLS", q("b"), q("c")), ("CALLS", q("c"), q("a")), ("CALLS", q("x"), q("y"))])
    n = nodes(spark, [{"name": x} for x in "abcxy"])
    labels = {r.qualified_name: r.group_key for r in C.label_propagation(n, e).collect()}
    assert labels[q("a")] == labels[q("b")] == labels[q("c")] != labels[q("x")]


def test_search(spark):
    n = nodes(spark, [{"name": "helper", "file_path": "hot.py"}, {"name": "helper", "file_path": "cold.py"}, {"name": "other"}])
    got = T.hybrid_search(n, "helper", context_files=["cold.py"]).collect()
    assert [r.file_path for r in got] == ["cold.py", "hot.py"]
    assert T.hybrid_search(n, "  ").count() == 0 and T.hybrid_search(n, "helpe").count() == 2  # no phrase: keywords
    a = spark.createDataFrame([(1, 10.0), (2, 5.0)], "id long, score double")
    b = spark.createDataFrame([(3, 8.0), (1, 4.0)], "id long, score double")
    assert T.rrf_merge(a, b).first().score == pytest.approx(1 / 61 + 1 / 62)
    assert T.query_kind_boost("Who calls Context.Next in gin")["_qualified_identifiers"] == ["context.next"]
    v = spark.createDataFrame([("a", [1.0, 0.0], "p"), ("b", [0.0, 1.0], "p"), ("c", [0.0, 0.0], "p"), ("d", [1.0], "p")], "qualified_name string, vector array<float>, provider string")
    assert [(r.qualified_name, r.similarity) for r in T.vector_search(v, [1.0, 0.0]).collect()] == [("a", 1.0), ("b", 0.0), ("c", 0.0), ("d", 0.0)]


def test_minimal_context_and_vector_count(spark):
    n = nodes(spark, [{"name": "login"}, {"name": "logout"}])
    got = T.minimal_context(n, "login")
    assert got.columns == ["name", "qualified_name", "kind", "file_path", "line_start"] and [r.name for r in got.collect()] == ["login"]
    v = spark.createDataFrame([("a", "p"), ("b", "q")], "qualified_name string, provider string")
    assert T.vector_count(v).first().n == 2 and T.vector_count(v, "p").first().n == 1


def _modularity(pairs, label):
    """Of an undirected graph, by its definition."""
    m, inner, degree = len(pairs), 0, {}
    for a, b in pairs:
        inner += label[a] == label[b]
        degree[label[a]] = degree.get(label[a], 0) + 1
        degree[label[b]] = degree.get(label[b], 0) + 1
    return inner / m - sum((d / (2 * m)) ** 2 for d in degree.values())


def test_modularity_finds_cliques(spark):
    names = [f"{c}{i}" for c in "abcd" for i in range(5)]
    pairs = [(q(x), q(y)) for x in names for y in names if x < y and x[0] == y[0]]
    pairs += [(q("a0"), q("b0")), (q("b1"), q("c0")), (q("c1"), q("d0")), (q("d1"), q("a1"))]
    n, e = nodes(spark, [{"name": x} for x in [*names, "alone"]]), edges(spark, [("CALLS", a, b) for a, b in pairs])
    got = {r.qualified_name: r.group_key for r in C.modularity_communities(n, e).collect()}
    assert set(got) == {q(x) for x in names}
    groups = {}
    for x, g in got.items():
        groups.setdefault(g, set()).add(x)
    assert sorted(map(sorted, groups.values())) == [[q(f"{c}{i}") for i in range(5)] for c in "abcd"]
    links = spark.createDataFrame([(a, b, 1.0) for x, y in pairs for a, b in ((x, y), (y, x))], "a string, b string, w double")
    labels = spark.createDataFrame(list(got.items()), "a string, label string")
    assert C.modularity(links, labels) == pytest.approx(_modularity(pairs, got))
    assert C.modularity_communities(n, e.limit(0)).count() == 0


def test_embedding_is_incremental(spark):
    n = nodes(spark, [{"name": "getUser", "parent_name": "Repo", "params": "(x)", "return_type": "int", "file_path": "src/db/a.py"}])
    assert n.select(T.node_to_text().alias("t")).first().t == "Repo.getUser getUser get User function in Repo (x) returns int db python"
    first = T.embed_nodes(n)
    stored = spark.createDataFrame(first.collect(), first.schema)
    assert stored.count() == 1 and T.embed_nodes(n, stored).count() == 0 and len(stored.first().vector) == 64


def test_stems():
    pairs = {"caresses": "caress", "ponies": "poni", "hopping": "hop", "relational": "relat", "conditional": "condit", "happy": "happi", "controlling": "control", "generalization": "gener", "sky": "sky", "adjustment": "adjust", "rate": "rate", "cease": "ceas"}
    assert {w: stem(w) for w in pairs} == pairs


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(S.escape_html(F.lit("<a href='x'>\"&`")).alias("e"), S.to_slug(F.lit("My Cool__Name!")).alias("s"), F.array_join(S.split_name(F.lit("getUser_by-id")), "|").alias("w"), S.sanitize_name(F.lit("a\x01b\tc" + "x" * 300)).alias("n")).first()
    assert got.e == "&lt;a href=&#39;x&#39;&gt;&quot;&amp;&#96;" and got.s == "my-cool-name" and got.w == "get|User|by|id" and len(got.n) == 256 and got.n.startswith("ab\tc")


@settings(max_examples=15, deadline=None)
@given(st.lists(st.sampled_from(["main", "feature/x~1", "a;b", "HEAD@{1}", "a b", "--x"]), min_size=1, max_size=4))
def test_git_refs(refs):
    from graphloom.sources.vcs import validate_git_ref

    assert [validate_git_ref(r) for r in refs] == [not set(r) & set("; ") for r in refs]


def test_html_and_wiki(spark):
    n = nodes(spark, [{"name": "<script>alert(1)</script>", "community_id": 1}, {"name": "parse_file", "community_id": 1}])
    e = edges(spark, [("CALLS", q("parse_file"), "outside")])
    page = V.export_html(n, e)
    assert "<script>alert(1)" not in page and "&lt;script&gt;" in page
    c = spark.createDataFrame([(1, "parser", 2, 0.5, "python", "parses")], "id long, name string, size long, cohesion double, dominant_language string, description string")
    wiki = V.export_wiki(n, e, c)
    text = wiki["community_1_parser.md"]
    assert text.startswith("# parser\n") and "**Size**: 2" in text and "`outside` (referenced 1 time(s))" in text and "parser" in wiki["index.md"]


def test_lookups(spark):
    n = nodes(spark, [{"name": "a"}, {"name": "f.py", "kind": "File"}])
    assert names(L.review_context(n, ["zz", q("a")])) == [q("a")]
    assert L.get_files_matching(n, "F.PY").count() == 1


def test_encoder_works_each_word_out_once(spark):
    df = spark.createDataFrame([("one two two",), ("",), ("one",)], "t string").select(T.hashing_encoder(F.col("t")).alias("v"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 2
    two, none, one = (r.v for r in df.collect())
    assert set(none) == {0.0} and sorted(map(abs, one))[-2:] == [0.0, 1.0] and sum(x * x for x in two) == pytest.approx(1.0)
