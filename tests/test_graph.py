"""Operators over small hand-made graphs."""

import pytest
from pyspark.sql import functions as F

from lodestone.functions import evaluation, text
from lodestone.operators import iterative, relational, sets
from lodestone.plans import context, engine, router
from lodestone.sources import formats
from lodestone.sources.tables import Graph

NODE = "id string, label string, kind string, path string, parent string, active boolean, ord long"
EDGE = "source string, target string, type string, weight double, confidence double, provenance string, ord long"


def make(spark, nodes, edges):
    n = [(i, i.title(), "function", f"src/{i}.py", "", active, o) for o, (i, active) in enumerate(nodes)]
    e = [(s, t, k, 1.0, c, "tree_sitter", o) for o, (s, t, k, c) in enumerate(edges)]
    return Graph(spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE))


@pytest.fixture(scope="module")
def g(spark):
    nodes = [("a", True), ("b", True), ("c", True), ("d", True), ("gone", False), ("lone", True)]
    edges = [("a", "b", "calls", 0.9), ("a", "b", "calls", 0.95), ("b", "c", "calls", 0.8), ("c", "d", "reads", 0.9), ("a", "gone", "calls", 0.9), ("d", "d", "calls", 1.0)]
    return make(spark, nodes, edges)


def test_relations_take_the_best_edge(g):
    rows = relational.relations(g, "b", "in").collect()
    assert [(r["id"], r["confidence"], r["total"], r["omitted"]) for r in rows] == [("a", 0.95, 1, 0)]


def test_resolution(g, spark):
    got = {r["handle"]: r["status"] for r in relational.resolve(g, spark.createDataFrame([("a",), ("B",), ("zzz",)], "handle string")).collect()}
    assert got == {"a": "ok", "B": "ok", "zzz": "not_found"}


def test_degree_counts_a_self_loop_twice(g):
    assert {r["id"]: r["degree"] for r in relational.degree(g).collect()}["d"] == 3


def test_pagerank_sums_to_one(g):
    total, n = iterative.pagerank(g, 5).agg(F.sum("score"), F.count("*")).first()
    assert total == pytest.approx(1.0) and n == 5


def test_components(g):
    got = {r["id"]: r["component"] for r in iterative.components(g).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "a", "gone": "a", "lone": "lone"}


def test_reach_and_paths(g):
    assert {r["id"]: r["hop"] for r in iterative.reach(g.live.edges, ["a"], 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r["id"]: r["value"] for r in iterative.best_paths(g, "a", 3, widest=True).collect()}["d"] == 0.8


def test_replay_diff_and_merge(g, spark):
    base = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int")
    log = spark.createDataFrame([("x", 5, 1, "upsert"), ("y", 0, 2, "delete"), ("z", 7, 3, "upsert")], "k string, v int, seq long, op string")
    after = sets.replay(base, log, "k")
    assert {(r["k"], r["v"]) for r in after.collect()} == {("x", 5), ("z", 7)}
    assert {(r["k"], r["change"]) for r in sets.diff(base, after, ["k"], ["v"]).collect()} == {("x", "changed"), ("y", "removed"), ("z", "added")}
    assert sets.merge_node(g, "b", "a").filter("source = target").isEmpty()


def test_as_of_refuses_unbounded_elements(spark):
    df = spark.createDataFrame([("x", None), ("y", "2020-01-01")], "id string, f string").select("id", F.col("f").cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    assert sets.as_of(df, "2021-01-01").isEmpty()
    assert sets.as_of(df.filter("valid_from IS NOT NULL"), "2021-01-01").count() == 1


def test_murphy_identity(spark):
    pairs = spark.createDataFrame([(0.1, 0), (0.4, 1), (0.8, 0), (0.9, 1)], "confidence double, outcome int")
    r = evaluation.calibration(pairs, 2).first()
    assert (r["brier"], r["ece"], r["mce"]) == (0.255, 0.3, 0.35)


def test_isotonic_pools_violators(spark):
    pairs = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.9, 1)], "confidence double, outcome int")
    assert [(r["upper"], r["value"]) for r in evaluation.isotonic(pairs).orderBy("upper").collect()] == [(0.1, 0.0), (0.3, 0.5), (0.9, 1.0)]


def test_text(spark):
    row = spark.createDataFrame([("parse_httpUrl",)], "s string").select(text.identifier_quality(F.col("s")).alias("q"), text.tokens(F.col("s")).alias("t")).first()
    assert row["q"] == 1.0 and row["t"] == ["parse", "httpurl"]


def test_router_and_engine(g, spark):
    assert router.compile_query("who calls `b`?").operator == "relations"
    assert [r["id"] for r in engine.query(g, "who calls `b`?").collect()] == ["a"]
    df = router.bulk(spark.createDataFrame([("what is the impact",), (None,)], "t string"), "t")
    assert [r["route"] for r in df.collect()] == ["blast_radius", "unknown"]


def test_words_of_a_route_end_at_letters_beyond_ascii(spark):
    asked = ["der testö enung", "éimpact", "İmpact", "attests", "ein_test", "pathé between"]
    want = ["affected_tests", "blast_radius", "blast_radius", "unknown", "unknown", "multi_hop_path"]
    assert [r["route"] for r in router.bulk(spark.createDataFrame([(a,) for a in asked], "t string"), "t").collect()] == want
    assert [router.compile_query(a).query_class for a in asked] == want


def test_edge_list_and_guard(spark, tmp_path):
    (tmp_path / "e.csv").write_text("source,target,type,weight\na,b,calls,2\na,b,calls,3\nb,c,,x\n")
    got = formats.edge_list(spark, str(tmp_path / "e.csv"))
    assert {(r["source"], r["target"], r["type"], r["weight"]) for r in got.edges.collect()} == {("a", "b", "calls", 2.0), ("b", "c", "relates", 1.0)}
    formats.safe_overwrite(spark.range(100), str(tmp_path / "t"))
    with pytest.raises(ValueError):
        formats.safe_overwrite(spark.range(10), str(tmp_path / "t"))


def test_empty_graph(spark):
    g = Graph(spark.createDataFrame([], NODE), spark.createDataFrame([], EDGE))
    assert relational.validate(g).filter("n > 0").isEmpty() and iterative.components(g).isEmpty()


def test_context(g, spark):
    ids, edges = context.expand(g, ["a"], 3, 3)
    assert ids == ["a", "b", "c"] and edges.count() == 2
    assert context.expand(g, ["a"], 1, 10, direction="in")[0] == ["a"]
    assert [r["id"] for r in context.search(g, ["b"], 5).collect()] == ["b"]
    text = context.packet(g, ["a"], 3, 10, 1000)
    assert "1 -calls> 2" in text and "gone" not in text.lower()
    assert context.select(["a"], {"b": 1.0, "c": 5.0}, [("a", "b"), ("a", "c")], dict.fromkeys("abc", "x"), 40) == ["a", "c"]


def test_label_propagation(spark):
    g = make(spark, [(x, True) for x in "abcd"], [("a", "b", "calls", 0.9), ("c", "d", "calls", 0.9)])
    assert len({r["label"] for r in iterative.label_propagation(g, 2).collect()}) == 4 or iterative.label_propagation(g, 2).count() == 4
