"""What queries of the graph read, shuffle and hold as tables grow; results on odd graphs against brute force."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from lodestone.operators import iterative, mutations, relational, sets
from lodestone.sources import scratch, tables
from lodestone.sources.tables import Graph

SF = "/root/testdata/sf0.001"
NODE = "id string, label string, kind string, path string, parent string, active boolean, ord long"
EDGE = "source string, target string, type string, weight double, confidence double, provenance string, ord long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def graph(spark, nodes, edges):
    """nodes: (id, active); edges: (source, target, type, weight, confidence)."""
    return Graph(spark.createDataFrame([(i, i, "function", "p", "", a, k) for k, (i, a) in enumerate(nodes)], NODE), spark.createDataFrame([(s, t, y, w, c, "human", k) for k, (s, t, y, w, c) in enumerate(edges)], EDGE))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_a_query_reads_the_tables_it_needs_and_no_store(spark):
    g = tables.graph(spark, SF)
    assert {os.path.dirname(f).removeprefix("file://") for f in g.edges.inputFiles() + g.nodes.inputFiles()} == {SF}
    few = plan(g.nodes.filter("kind IN ('package', 'module')").select("id", "label"))
    assert "orders.parquet" not in few and "part.parquet" not in few and "Exchange hashpartitioning" not in few


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_partitions_follow_the_size_of_the_files(spark, monkeypatch):
    edges = tables.graph(spark, SF).edges
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scratch.parts(edges) == most
    monkeypatch.setattr(scratch, "PART_BYTES", 10_000)
    n = scratch.parts(edges)
    assert n > 2 * os.path.getsize(f"{SF}/lineitem.parquet") // 10_000 > most
    whole = tables.graph(spark, SF)
    for df in (relational.dedupe(edges), sets.symmetric(edges), sets.merge_node(whole, "supplier:2", "supplier:1"), relational.best_per_pair(edges), mutations.union(whole, whole).edges):
        widths = {int(w) for w in re.findall(r"hashpartitioning\(source#\d+, target#\d+[^()]*?, (\d+)\)", plan(df))}
        assert widths and min(widths) >= n


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_edges_are_not_sorted_before_a_shuffle_or_for_a_join_to_nodes(spark):
    g = tables.graph(spark, SF)
    for df in (relational.dedupe(g.edges), relational.coupling(g), relational.caller_counts(g)):
        below = plan(df)[plan(df).rindex("Exchange hashpartitioning"):]
        assert "Sort " not in below and "SortMergeJoin" not in plan(df)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_a_join_to_nodes_shuffles_edges_once(spark, monkeypatch):
    monkeypatch.setattr(scratch, "PART_BYTES", 10_000)
    g = tables.graph(spark, SF)
    for df, most in ((relational.caller_counts(g), 3), (g.live_edges(), 4)):  # edges, nodes and counts; edges and nodes for either end
        assert plan(df).count("Exchange hashpartitioning") <= most and "LeftSemi" not in plan(df)


def odd(spark, seed, n=60, m=150):
    r = random.Random(seed)
    names = [f"n{i}" for i in range(n)]
    ends = [*names, "nobody"]
    edges = [(r.choice(ends), r.choice(ends), r.choice(["calls", "uses", "imports", "contains"]), r.choice([0.0, 0.5, 1.0]), r.choice([0.1, 0.5, 0.9])) for _ in range(m)]
    return names, edges, graph(spark, [(x, i % 7 != 3) for i, x in enumerate(names)], edges)


def find(names, edges):
    label = {x: x for x in names}
    while True:
        near = dict(label)
        for s, t, *_ in edges:
            if s in label and t in label:
                near[s], near[t] = min(near[s], label[t]), min(near[t], label[s])
        if near == label:
            return label
        label = near


@pytest.mark.parametrize("rows", [0, 100_000])
def test_components_by_contraction_and_on_the_driver(spark, monkeypatch, rows):
    monkeypatch.setattr(iterative, "BROADCAST_ROWS", rows)
    names, edges, g = odd(spark, 1, m=45)
    chain = [(f"n{i}", f"n{i + 1}", "calls", 1.0, 1.0) for i in range(9)]
    for own in (edges, chain, [(s, "z", *e) for s, _, *e in chain], []):
        got = iterative.components(graph(spark, [(x, True) for x in [*names, "z"]], own))
        assert {r["id"]: r["component"] for r in got.collect()} == find([*names, "z"], own)


@pytest.mark.parametrize("rows", [0, 100_000])
@pytest.mark.parametrize("widest", [False, True])
def test_best_paths_read_on_from_bettered_nodes(spark, monkeypatch, rows, widest):
    monkeypatch.setattr(iterative, "BROADCAST_ROWS", rows)
    _, edges, g = odd(spark, 2)
    pairs = {}
    for s, t, _, _, c in edges:
        pairs[s, t] = max(c, pairs.get((s, t), 0))
    best = {"n0": 1.0 if widest else 0.0}
    for _ in range(4):
        step = dict(best)
        for (s, t), c in pairs.items():
            if s in best:
                new = min(best[s], c) if widest else best[s] + 1 / max(c, 0.05)
                step[t] = new if t not in step else (max if widest else min)(new, step[t])
        best = step
    assert {r["id"]: r["value"] for r in iterative.best_paths(g, "n0", 4, widest).collect()} == pytest.approx(best)


@pytest.mark.parametrize("repeat", [False, True])
def test_label_propagation_against_a_plain_loop(spark, repeat):
    names, edges, g = odd(spark, 3)
    if repeat:  # a node that is listed twice votes twice
        g = Graph(g.nodes.unionByName(g.nodes.filter("id IN ('n1', 'n10')")), g.edges)
    live = [r["id"] for r in g.nodes.filter("active").collect()]
    strength = {"calls": 1.0, "uses": 0.8, "imports": 0.95, "contains": 0.7}
    around = {}
    for s, t, kind, w, c in edges:
        v = round(w * c * strength[kind] * 10**6)
        if s in live and t in live and v > 0:
            for a, b in ((s, t), (t, s)):
                around.setdefault(a, []).append((b, v))
    label = {x: x for x in live}
    for _ in range(3):
        nxt = {}
        for x in label:
            votes = {}
            for y, v in around.get(x, []):
                votes[label[y]] = votes.get(label[y], 0) + v * live.count(y)
            nxt[x] = min(votes, key=lambda k: (-votes[k], k)) if votes else label[x]
        label = nxt
    got = sorted((r["id"], r["label"]) for r in iterative.label_propagation(g, 3).collect())
    assert got == sorted((x, label[x]) for x in live)


def test_pagerank_stops_when_the_flow_ran_dry(spark, monkeypatch):
    written = []
    table = scratch.table
    monkeypatch.setattr(scratch, "table", lambda df, name: written.append(name) or table(df, name))
    g = graph(spark, [(x, True) for x in "abcd"], [("a", "b", "calls", 1.0, 1.0), ("b", "c", "uses", 1.0, 1.0)])
    got = {r["id"]: r["score"] for r in iterative.pagerank(g, 10, seeds=["a"]).collect()}
    score = {"a": 1.0, "b": 0.0, "c": 0.0, "d": 0.0}
    for _ in range(10):
        score = {"a": 0.15 + 0.85 * (score["c"] + score["d"]), "b": 0.85 * score["a"], "c": 0.85 * score["b"], "d": 0.0}
    assert written.count("flow") == 3 and got == pytest.approx(score)


def test_first_edges_without_a_sort_of_all(spark, monkeypatch):
    _, edges, g = odd(spark, 4)
    want = {}
    for k, (s, t, kind, *_) in enumerate(edges):
        want.setdefault(kind, []).append((s, t, kind, k))
    capped = {k: v[: 5 if k == "uses" else 3] for k, v in want.items()}
    for few in (32, 1):
        monkeypatch.setattr(relational, "FEW_TYPES", few)
        got = relational.cap_per_relation(g.edges, {"uses": 5}, 3).select("source", "target", "type", "ord")
        assert sorted(map(tuple, got.collect())) == sorted(r for v in capped.values() for r in v)
        assert ("Window" in plan(got)) == (few == 1)
    rows = relational.reserve_per_family(g.edges, 4).select("source", "target", "type", "ord").collect()
    assert list(map(tuple, rows)) == [want[k][0] for k in ("calls", "imports", "contains")]
    kept = g.edges.filter("type = 'none'")
    assert relational.reserve_per_family(kept, 4).isEmpty() and relational.cap_per_relation(kept, {}, 3).isEmpty()
