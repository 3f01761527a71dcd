"""Changes of a graph and the log of operations that records them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.relational import dedupe, first_per
from lodestone.sources.scratch import spread
from lodestone.sources.tables import EDGE, Graph

OPERATIONS = "seq long, op string, subject string, detail string"


def add_nodes(g: Graph, nodes: DataFrame) -> Graph:
    """Upsert by id: a node that is there is replaced."""
    kept = g.nodes.join(nodes.select("id"), "id", "left_anti")
    return Graph(kept.select(g.nodes.columns).unionByName(nodes.select(g.nodes.columns)), g.edges)


def add_edges(g: Graph, edges: DataFrame) -> Graph:
    """Inserts edges whose source, target and type are not there; the first of several wins."""
    key = ["source", "target", "type"]
    fresh = dedupe(edges).join(spread(g.edges.select(*key), *key), key, "left_anti")
    return Graph(g.nodes, g.edges.select(*EDGE).unionByName(fresh.select(*EDGE)))


def deactivate(g: Graph, ids: DataFrame) -> Graph:
    """Soft delete: the nodes (column id) stay, inactive; their edges are hidden by Graph.live."""
    gone = ids.select("id").distinct().withColumn("_gone", F.lit(True))
    return Graph(g.nodes.join(gone, "id", "left").withColumn("active", F.col("active") & F.col("_gone").isNull()).drop("_gone").select(g.nodes.columns), g.edges)


def union(a: Graph, b: Graph) -> Graph:
    """Both graphs: of a node in both the first wins, edges are deduplicated by source, target and type."""
    tag = lambda df, i: df.withColumn("_side", F.lit(i))
    nodes = first_per(tag(a.nodes, 0).unionByName(tag(b.nodes, 1)), ["id"], "_side", "ord").drop("_side")
    key = ["source", "target", "type"]
    edges = first_per(spread(tag(a.edges.select(*EDGE), 0).unionByName(tag(b.edges.select(*EDGE), 1)), *key), key, "_side", "ord").drop("_side")
    return Graph(nodes, edges)


def overlay(base: Graph, extra: Graph) -> Graph:
    """base enriched by a foreign graph: nodes of an equal, non-empty path are one, active only if both are; others are appended.

    The foreign edges follow to the nodes they now belong to; base's edges win over equal ones.
    """
    clean = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"^\./|\\", "")
    own = first_per(base.nodes.select("id", clean("path").alias("_p"), "ord").filter("_p <> ''"), ["_p"], "ord").select(F.col("id").alias("_to"), "_p")
    other = extra.nodes.withColumn("_p", clean("path")).join(own, "_p", "left")
    matched = other.filter("_to IS NOT NULL").groupBy(F.col("_to").alias("id")).agg(F.bool_and("active").alias("_active"))
    nodes = base.nodes.join(matched, "id", "left").withColumn("active", F.col("active") & F.coalesce("_active", F.lit(True))).select(base.nodes.columns)
    fresh = other.filter("_to IS NULL").join(base.nodes.select("id"), "id", "left_anti").select(base.nodes.columns)
    moved = other.filter("_to IS NOT NULL").select(F.col("id").alias("_from"), "_to")
    edges = extra.edges.select(*EDGE)
    for end in ("source", "target"):
        to = moved.select(F.col("_from").alias(end), F.col("_to").alias("_new"))
        edges = edges.join(to, end, "left").withColumn(end, F.coalesce("_new", end)).drop("_new")
    return union(Graph(nodes, base.edges), Graph(fresh, edges.filter("source <> target").select(*EDGE)))


def decision_trace(trace: str, inputs: Iterable[str], policies: Iterable[str], g: Graph) -> tuple[DataFrame, DataFrame]:
    """(node, edges) of a decision: used_input to each input node and applied_policy to each policy node that is there."""
    spark = g.nodes.sparkSession
    node = spark.createDataFrame([(trace, trace, "decision_trace", "", "", True, 0)], "id string, label string, kind string, path string, parent string, active boolean, ord long").select(g.nodes.columns)
    asked = spark.createDataFrame([(i, "used_input") for i in inputs] + [(p, "applied_policy") for p in policies], "target string, type string")
    there = asked.join(g.nodes.select(F.col("id").alias("target")), "target", "left_semi")
    edges = there.select(F.lit(trace).alias("source"), "target", "type", F.lit(1.0).alias("weight"), F.lit(1.0).alias("confidence"), F.lit("human").alias("provenance"), F.lit(0).cast("long").alias("ord"))
    return node, edges


def policy_nodes(policies: DataFrame, columns: list[str]) -> DataFrame:
    """Policies (name, text) as nodes."""
    given = {"id": F.concat(F.lit("policy:"), "name"), "label": F.col("name"), "kind": F.lit("policy"), "path": F.lit(""), "parent": F.lit(""), "active": F.lit(True), "ord": F.lit(0).cast("long")}
    return policies.select(*(given[c].alias(c) for c in columns))


def operations(log: DataFrame) -> DataFrame:
    """The operations (OPERATIONS) of a log of JSON lines (value); a torn or foreign line is left out."""
    parsed = log.select(F.from_json("value", OPERATIONS).alias("o")).select("o.*")
    return parsed.filter("seq IS NOT NULL AND op IS NOT NULL")


def final_state(ops: DataFrame) -> DataFrame:
    """(subject, op, seq): the last operation of each subject."""
    return ops.groupBy("subject").agg(F.max_by("op", "seq").alias("op"), F.max("seq").alias("seq"))


def hierarchy(g: Graph, communities: DataFrame) -> Graph:
    """g with a node per community (id, label) and contains edges to its members; its label: the six commonest words of theirs."""
    name = F.concat(F.lit("community:"), F.col("label")).alias("community")
    member = communities.select(F.col("id"), name).join(g.nodes.select("id", F.col("label").alias("text")), "id")
    words = member.select("community", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{3,}"), F.lit(0))).alias("w")).groupBy("community", "w").count()
    top = words.groupBy("community").agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("n"), "w"))), 1, 6), lambda x: x["w"]), " ").alias("words"))
    group = member.select("community").distinct().join(top, "community", "left")
    given = {"id": F.col("community"), "label": F.coalesce("words", "community"), "kind": F.lit("community"), "path": F.lit(""), "parent": F.lit(""), "active": F.lit(True), "ord": F.lit(0).cast("long")}
    edges = member.select(F.col("community").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("type"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("confidence"), F.lit("inferred").alias("provenance"), F.lit(0).cast("long").alias("ord"))
    return Graph(g.nodes.unionByName(group.select(*(given[c].alias(c) for c in g.nodes.columns))), g.edges.select(*EDGE).unionByName(edges))
