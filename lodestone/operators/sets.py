"""Set, temporal and change operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.relational import dedupe, first_per
from lodestone.sources.tables import Graph


def merge_node(g: Graph, source: str, target: str) -> DataFrame:
    """Edges after node source is merged into target: redirected, without self loops, first wins."""
    to = lambda c: F.when(F.col(c) == source, target).otherwise(F.col(c)).alias(c)
    moved = g.edges.select(to("source"), to("target"), "type", "weight", "confidence", "provenance", "ord")
    return dedupe(moved.filter("source <> target"))


def diff(before: DataFrame, after: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keyed difference: added, removed or changed."""
    a = before.select(*key, F.struct(*values).alias("_a"))
    b = after.select(*key, F.struct(*values).alias("_b"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "changed")
    return both.select(*key, change.alias("change")).filter("change IS NOT NULL")


def replay(base: DataFrame, log: DataFrame, key: str) -> DataFrame:
    """Last writer wins over base and a log (same columns, seq, op upsert or delete); base has seq -1."""
    rows = base.withColumns({"seq": F.lit(-1).cast("long"), "op": F.lit("upsert")}).unionByName(log)
    return first_per(rows, [key], F.desc("seq")).filter("op = 'upsert'").drop("seq", "op")


def as_of(elements: DataFrame, at: str) -> DataFrame:
    """Elements valid at a time; nothing if any element has no start, since the answer would be a guess."""
    t = F.lit(at).cast("timestamp")
    unbounded = elements.agg(F.count_if(F.col("valid_from").isNull()).alias("_u"))
    valid = elements.filter((F.col("valid_from") <= t) & (F.col("valid_to").isNull() | (F.col("valid_to") >= t)))
    return valid.crossJoin(F.broadcast(unbounded)).filter("_u = 0").drop("_u")


def symmetric(edges: DataFrame) -> DataFrame:
    """Both orientations of each edge; flipped edges keep the six core columns."""
    core = ["source", "target", "type", "weight", "confidence", "ord"]
    flipped = edges.select(F.col("target").alias("source"), F.col("source").alias("target"), *core[2:])
    return dedupe(edges.select(core).unionByName(flipped))


def federate(nodes: DataFrame, project: str, most: int = 8) -> DataFrame:
    """Links consecutive ids that share a label (case aside) across two or more projects and at most `most` ids."""
    named = nodes.select(F.concat_ws("::", project, "id").alias("gid"), F.lower("label").alias("key"), F.col(project).alias("p"))
    # labels are counted first, so that a common one is never gathered
    few = named.groupBy("key").agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high")).filter(f"n <= {most} AND low <> high")
    linked = named.join(few.select("key"), "key", "left_semi").withColumn("target", F.lead("gid").over(Window.partitionBy("key").orderBy("gid"))).filter("target IS NOT NULL")
    return linked.select(F.col("gid").alias("source"), "target", F.lit("cross_repo").alias("type"))


def superseded(episodes: DataFrame) -> DataFrame:
    """Episodes (id, supersedes) with whether a later one replaces them."""
    gone = episodes.filter("supersedes IS NOT NULL").select(F.col("supersedes").alias("id")).distinct().withColumn("gone", F.lit(True))
    return episodes.join(gone, "id", "left").withColumn("active", F.col("gone").isNull()).drop("gone")


def observed_calls(events: DataFrame) -> DataFrame:
    """Transitions of each user's events in time as caller, callee and count."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = events.select(F.lag("event_type").over(order).alias("caller"), F.col("event_type").alias("callee"))
    return steps.filter("caller IS NOT NULL").groupBy("caller", "callee").agg(F.count("*").alias("weight"))
