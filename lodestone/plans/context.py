"""Context assembly: ranked search, budgeted expansion, greedy selection and rendering.

Search and expansion run over the whole graph in the cluster.  What is selected is bounded by the node
budget, so selection and rendering work on the driver with at most that many rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import identifier_quality
from lodestone.operators.iterative import checkpoint
from lodestone.operators.relational import dedupe, degree, traversal_value
from lodestone.sources.tables import Graph

ENERGY, HUB_COST = 100.0, 25.0
#: Tokens that a packet spends per node and per edge.
NODE_COST, EDGE_COST = 12.0, 5.2


def lexical_score(terms: list[str]) -> Column:
    """Additive score of a node row for query terms, times the share of terms that matched, plus the label's quality."""
    label = F.split(F.lower("label"), "[^a-z0-9]+")
    path = F.split(F.lower("path"), "[^a-z0-9]+")
    total, matched = F.lit(0.0), F.lit(0)
    for term in terms:
        q = F.lit(term.lower())
        own = (
            F.when(F.lower("id") == q, 8.0).otherwise(0.0) + F.when(F.lower("label") == q, 12.0).when(F.array_contains(label, q), 4.0).otherwise(0.0)
            + F.when(F.lower("path") == q, 8.0).when(F.array_contains(path, q), 3.0).otherwise(0.0) + F.when(F.lower("kind") == q, 2.0).otherwise(0.0)
        )
        total, matched = total + own, matched + F.when(own > 0, 1).otherwise(0)
    return F.when(total > 0, total * (0.5 + matched / len(terms)) + identifier_quality(F.col("label"))).otherwise(0.0)


def search(g: Graph, terms: list[str], limit: int) -> DataFrame:
    """The best active nodes for the terms: by score, path, label and id."""
    scored = g.nodes.filter("active").withColumn("score", F.bround(lexical_score(terms), 4)).filter("score > 0")
    return scored.orderBy(F.desc("score"), "path", "label", "id").limit(limit)


def expand(g: Graph, starts: list[str], hops: int, budget: int, direction: str = "both", allowed: tuple[str, ...] | None = None, decay_hubs: bool = False) -> tuple[list[str], DataFrame]:
    """Budgeted breadth-first expansion: (ids in the order they were taken, edges among them).

    Each round scores neighbours by the summed traversal value over the root of the frontier node's
    degree and takes the best that the budget allows.  A relation of strength zero is never crossed.
    Where none of a frontier node's edges is in `allowed`, all of them count.  With decay_hubs a
    route loses energy by weak edges and by high degrees, and ends when it has none.
    """
    live = g.live
    spark = live.nodes.sparkSession
    edges = checkpoint(live.edges.withColumn("tv", traversal_value()).filter("tv > 0"))
    degrees = degree(live)
    taken = {r["id"]: ENERGY for r in live.nodes.filter(F.col("id").isin(starts)).select("id").collect()}
    frontier = dict(taken)
    for _ in range(hops):
        room = budget - len(taken)
        if not frontier or room <= 0:
            break
        front = F.broadcast(spark.createDataFrame(list(frontier.items()), "at string, energy double"))
        out = edges.join(front, edges["source"] == front["at"]).withColumn("id", F.col("target"))
        back = edges.join(front, edges["target"] == front["at"]).withColumn("id", F.col("source"))
        crossed = {"out": out, "in": back}.get(direction) or out.unionByName(back)
        if allowed is not None:
            preferred = F.col("type").isin(*allowed)
            gate = crossed.groupBy("at").agg(F.max(preferred).alias("gated"))
            crossed = crossed.join(gate, "at").filter(preferred | ~F.col("gated"))
        scored = crossed.join(degrees.withColumnRenamed("id", "at"), "at")
        if decay_hubs:
            scored = scored.withColumn("left", F.col("energy") - HUB_COST * (1 + F.log10("degree")) / F.col("tv")).filter("left > 0")
        else:
            scored = scored.withColumn("left", F.lit(ENERGY))
        seen = F.broadcast(spark.createDataFrame([(i,) for i in taken], "id string"))
        ranked = scored.join(seen, "id", "left_anti").groupBy("id").agg(F.sum(F.col("tv") / F.sqrt("degree") * F.col("left") / ENERGY).alias("score"), F.max("left").alias("left"))
        best = ranked.join(live.nodes.select("id", "ord"), "id").orderBy(F.desc(F.bround("score", 9)), "ord", "id").limit(room).collect()
        frontier = {r["id"]: r["left"] for r in best}
        taken |= frontier
    ids = spark.createDataFrame([(i,) for i in taken], "id string")
    both = edges.join(F.broadcast(ids.withColumnRenamed("id", "source")), "source", "left_semi").join(F.broadcast(ids.withColumnRenamed("id", "target")), "target", "left_semi")
    return list(taken), dedupe(both)


def select(starts: list[str], values: dict[str, float], edges: list[tuple[str, str]], labels: dict[str, str], budget: float) -> list[str]:
    """Greedy connected selection: from the starts outward, the best value per cost first; what doesn't fit is passed over."""
    around, touching = defaultdict(list), defaultdict(int)
    for a, b in edges:
        if a in labels and b in labels:
            around[a].append(b)
            around[b].append(a)
            touching[a] += 1
            touching[b] += 1
    cost = {i: max(1.0, NODE_COST, len(label) / 4) + touching[i] * EDGE_COST / 2 for i, label in labels.items()}
    chosen = [s for s in dict.fromkeys(starts) if s in labels]
    spent = sum(cost[i] for i in chosen)
    offered, heap = set(chosen), []

    def offer(node: str) -> None:
        for other in sorted(around[node]):
            if other not in offered:
                offered.add(other)
                heapq.heappush(heap, (-values.get(other, 0.0) / cost[other], other))

    for start in list(chosen):
        offer(start)
    while heap:
        _, node = heapq.heappop(heap)
        if spent + cost[node] <= budget:
            chosen.append(node)
            spent += cost[node]
            offer(node)
    return chosen


def render(nodes: list, edges: list) -> str:
    """A compact packet: numbered nodes, then edges by number and relation, in a stable order."""
    number = {r["id"]: i for i, r in enumerate(sorted(nodes, key=lambda r: r["id"]), 1)}
    lines = [f"{number[r['id']]} {r['label']} [{r['kind']}] {r['path']}".rstrip() for r in sorted(nodes, key=lambda r: r["id"])]
    links = sorted((number[r["source"]], r["type"], number[r["target"]]) for r in edges if r["source"] in number and r["target"] in number)
    return "\n".join([*lines, *(f"{a} -{kind}> {b}" for a, kind, b in links)])


def packet(g: Graph, starts: list[str], hops: int, nodes: int, tokens: float) -> str:
    """Expansion, selection and rendering in one."""
    ids, edges = expand(g, starts, hops, nodes)
    rows = {r["id"]: r for r in g.nodes.filter(F.col("id").isin(ids)).collect()}
    links = edges.collect()
    values = {i: 1.0 / (k + 1) for k, i in enumerate(ids)}
    kept = set(select(starts, values, [(r["source"], r["target"]) for r in links], {i: r["label"] for i, r in rows.items()}, tokens))
    return render([r for i, r in rows.items() if i in kept], links)
