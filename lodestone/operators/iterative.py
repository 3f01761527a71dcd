"""Iterative graph operators: a loop of joins whose lineage is cut by reliable checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.operators.relational import traversal_value
from lodestone.sources import scratch
from lodestone.sources.tables import Graph, within


def checkpoint(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that spark.checkpoint.dir names."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(scratch.folder(df.sparkSession))
    return df.checkpoint()


def pagerank(g: Graph, iterations: int = 10, damping: float = 0.85, seeds: list[str] | None = None) -> DataFrame:
    """(id, score) after fixed iterations; dangling mass and teleport go to the seeds, or to all nodes.

    With u(0) the teleport vector and u(k + 1) the flow of u(k), every iterate is a combination of the u, whose
    coefficients follow from their sums alone.  Edges are written in buckets by source once, so an iteration
    shuffles the flow and what it sends; a flow that ran dry ends the loop.  The combination is made at the end.
    """
    n = scratch.parts(g.edges)
    own = g.live_edges(traversal_value().alias("tv"), n=n).filter("tv > 0")
    valued = own.groupBy("source", "target").agg(F.sum("tv").alias("tv"))
    share = F.col("tv") / F.sum("tv").over(Window.partitionBy("source"))
    steps = scratch.bucketed(valued.select("source", "target", share.alias("share")), "source", n, "steps")
    at = F.col("id").isin(seeds) if seeds else F.lit(True)
    ids = g.nodes.filter("active").select("id")
    count = ids.filter(at).count()
    if not count:
        raise ValueError("no active seed")
    flows, sums = [ids.filter(at).select("id", F.lit(1.0 / count).alias("u"))], [1.0]
    while len(flows) <= iterations and sums[-1]:
        sent = steps.join(flows[-1].hint("shuffle_hash"), F.col("source") == F.col("id")).groupBy(F.col("target").alias("id")).agg(F.sum(F.col("u") * F.col("share")).alias("u"))
        flows.append(scratch.table(sent, "flow"))
        sums.append(flows[-1].agg(F.coalesce(F.sum("u"), F.lit(0.0))).first()[0])
    sums += [0.0] * (iterations + 1 - len(sums))
    held = [1.0] + [0.0] * iterations  # the coefficients of the iterate
    for _ in range(iterations):
        lost = sum(held) and sum(h * sums[k] for k, h in enumerate(held)) - sum(h * sums[k + 1] for k, h in enumerate(held[:-1]))
        held = [1 - damping + damping * lost] + [damping * h for h in held[:-1]]
    got = None
    for h, flow in zip(held[1:], flows[1:], strict=False):
        part = flow.select("id", (F.lit(h) * F.col("u")).alias("u"))
        got = part if got is None else got.unionByName(part)
    own = F.when(at, F.lit(held[0] / count)).otherwise(0.0)
    if got is None:
        return ids.select("id", own.alias("score"))
    return ids.join(got.groupBy("id").agg(F.sum("u").alias("u")), "id", "left").select("id", (own + F.coalesce("u", F.lit(0.0))).alias("score"))


#: Nodes of a frontier that are broadcast at most; a larger one is joined by a shuffle.
BROADCAST_ROWS = 100_000


def reach(edges: DataFrame, seeds: list[str], hops: int, incoming: DataFrame | None = None) -> DataFrame:
    """(id, hop) of the nodes within so many undirected hops of the seeds.

    Only edges at the frontier are read on; incoming: the same edges, laid out by target.  A frontier of checked
    size is broadcast, so that a hop shuffles the ids it finds and no edges.
    """
    spark = edges.sparkSession
    seen = spark.createDataFrame([(s, 0) for s in seeds], "id string, hop int")
    front, few = seen, True
    back = incoming if incoming is not None else edges
    for hop in range(1, hops + 1):
        at = F.broadcast(front.select("id")) if few else front.select("id")
        out = edges.select("source", "target").join(at, F.col("source") == F.col("id"), "left_semi").select(F.col("target").alias("id"))
        into = back.select("source", "target").join(at, F.col("target") == F.col("id"), "left_semi").select(F.col("source").alias("id"))
        front = scratch.table(out.unionByName(into).distinct().join(seen.select("id"), "id", "left_anti").withColumn("hop", F.lit(hop)), "front")
        few = hop < hops and front.count() <= BROADCAST_ROWS
        seen = seen.unionByName(front)
    return seen


def _joined(links: DataFrame) -> list[tuple[str, str]]:
    """(id, smallest id of its component) of the ids that aren't their own, for links that the driver holds."""
    up: dict[str, str] = {}

    def root(x: str) -> str:
        while x in up:
            if up[x] in up:
                up[x] = up[up[x]]
            x = up[x]
        return x

    for s, t in links.collect():
        a, b = sorted((root(s), root(t)), key=str.encode)
        if a != b:
            up[b] = a
    return [(x, root(x)) for x in up]


def _parents(links: DataFrame) -> DataFrame:
    """(id, parent): each id that has a smaller neighbour with the root of the tree that the smallest neighbours make."""
    both = links.unionByName(links.select(F.col("target").alias("source"), F.col("source").alias("target")))
    near = scratch.spread(both, "source").groupBy(F.col("source").alias("id")).agg(F.min("target").alias("parent"))
    hooks = scratch.table(near.filter("parent < id"), "hooks")
    while True:
        above = hooks.join(hooks.select(F.col("parent").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("parent"), F.col("parent").alias("above"))
        above = scratch.table(above, "above")
        if above.isEmpty():
            return hooks
        hooks = scratch.table(hooks.join(above, "parent", "left").select("id", F.coalesce("above", "parent").alias("parent")), "hooks")


def components(g: Graph) -> DataFrame:
    """(id, component): the smallest id that each node reaches, by contraction.

    A round hooks each id to its smallest neighbour, flattens the trees so made and keeps the links between their
    roots, so the tables of later rounds are smaller; the last BROADCAST_ROWS links are joined on the driver.
    """
    ids = g.nodes.select("id")
    links = scratch.table(within(g.edges.select("source", "target").filter("source <> target"), ids).distinct(), "links")
    rounds: list[DataFrame] = []
    while links.limit(BROADCAST_ROWS + 1).count() > BROADCAST_ROWS:
        hooks = _parents(links)
        rounds.append(hooks)
        for end in ("source", "target"):
            links = links.join(hooks.select(F.col("id").alias(end), "parent"), end, "left").withColumn(end, F.coalesce("parent", end)).drop("parent")
        links = scratch.table(links.filter("source <> target").select(F.least("source", "target").alias("source"), F.greatest("source", "target").alias("target")).distinct(), "links")
    roots = links.sparkSession.createDataFrame(_joined(links), "id string, parent string")
    few = True  # the driver's are broadcast; the later of two rounds is the smaller one
    for hooks in reversed(rounds):
        top = roots.select(F.col("id").alias("parent"), F.col("parent").alias("root"))
        roots = scratch.table(hooks.join(F.broadcast(top) if few else top, "parent", "left").select("id", F.coalesce("root", "parent").alias("parent")).unionByName(roots), "roots")
        few = False
    return ids.join(roots, "id", "left").select("id", F.coalesce("parent", "id").alias("component"))


def activation(g: Graph, starts: list[str], steps: int = 2, alpha: float = 0.6) -> DataFrame:
    """Spreading activation: each step sends alpha of a node's energy over its edges by strength x weight."""
    from lodestone import ontology

    w = g.live.edges.select("source", "target", (ontology.strength() * F.greatest("weight", F.lit(0.0))).alias("w")).filter("w > 0")
    both = w.unionByName(w.select(F.col("target").alias("source"), F.col("source").alias("target"), "w"))
    out = both.groupBy("source").agg(F.sum("w").alias("total"))
    share = checkpoint(both.join(out, "source").groupBy("source", "target").agg((F.sum("w") / F.first("total")).alias("share")))
    state = g.live.nodes.filter(F.col("id").isin(starts)).select("id", F.lit(1.0).alias("energy"))
    for _ in range(steps):
        sent = state.filter("energy > 0.01").join(share, F.col("id") == F.col("source")).groupBy(F.col("target").alias("id")).agg(F.sum(alpha * F.col("energy") * F.col("share")).alias("energy"))
        new, tokens = sent.join(state, "id", "left_anti").agg(F.coalesce(F.sum("energy"), F.lit(0.0)), F.count("*") * 8).first()
        if tokens and new / tokens < 0.005:
            break  # the step just computed is discarded
        state = checkpoint(state.unionByName(sent).groupBy("id").agg(F.sum("energy").alias("energy")))
    return state


def best_paths(g: Graph, root: str, hops: int, widest: bool = False) -> DataFrame:
    """(id, value) within so many hops of root: least summed cost 1 / max(.05, confidence), or the widest path's confidence.

    A hop reads on only from nodes whose value it bettered; a frontier of checked size is broadcast.
    """
    best, better = (F.max, "new > value") if widest else (F.min, "new < value")
    step = F.least("value", "c") if widest else F.col("value") + 1 / F.greatest(F.col("c"), F.lit(0.05))
    state = front = scratch.table(g.nodes.filter(F.col("id") == root).select("id", F.lit(1.0 if widest else 0.0).alias("value")), "front")
    edges = g.edges.select("source", "target", "confidence")
    for _ in range(hops):
        size = front.limit(BROADCAST_ROWS + 1).count()
        if not size:
            break
        at = front.select(F.col("id").alias("source"), "value")
        out = edges.join(F.broadcast(at), "source") if size <= BROADCAST_ROWS else scratch.spread(edges, "source").join(at.hint("shuffle_hash"), "source")
        pairs = out.groupBy("source", "target", "value").agg(F.max("confidence").alias("c"))
        moved = pairs.groupBy(F.col("target").alias("id")).agg(best(step).alias("new"))
        front = scratch.table(moved.join(state.groupBy("id").agg(best("value").alias("value")), "id", "left").filter(f"value IS NULL OR {better}").select("id", F.col("new").alias("value")), "front")
        state = state.unionByName(front)
    return state.groupBy("id").agg(best("value").alias("value"))


def label_propagation(g: Graph, rounds: int = 3) -> DataFrame:
    """(id, label) after synchronous rounds: the label with the most traversal value around a node, ties to the smaller.

    The synchronous variant of the sequential sweep: every node sees the labels of the round before, so
    its results differ from a sweep in id order where labels would travel within a round.  Rounds run on numbers
    of the ids in their order and on millionths of the value; the neighbours are written in buckets once, and since
    they are symmetric the first round needs no shuffle of them.
    """
    nodes = g.nodes.filter("active").select("id")
    if not rounds:
        return nodes.select("id", F.col("id").alias("label"))
    n = scratch.parts(g.edges)
    named = nodes.filter("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("times"))
    codes = scratch.table(named.repartitionByRange(n, "id").sortWithinPartitions("id").withColumn("code", F.monotonically_increasing_id()), "codes")
    value = (F.bround(traversal_value(), 6).cast("decimal(20,6)") * 1_000_000).cast("long")
    ends = g.edges.select("source", "target", value.alias("tv")).filter("tv > 0")
    for end in ("source", "target"):  # an end that isn't live has no number
        ends = scratch.spread(ends, end, n=n).join(codes.select(F.col("id").alias(end), F.col("code").alias(end[0])).hint("shuffle_hash"), end).drop(end)
    both = ends.select(F.inline(F.array(F.struct("s", "t"), F.struct(F.col("t").alias("s"), F.col("s").alias("t")))), "tv")
    around = scratch.bucketed(scratch.spread(both, "t", n=n).groupBy("t", "s").agg(F.sum("tv").alias("tv")), "t", n, "around")
    labels = codes.select("code", F.col("code").alias("label"), "times")
    repeated = not codes.filter("times > 1").isEmpty()
    for k in range(rounds):
        if k == 0 and not repeated:
            votes = around.select(F.col("t").alias("node"), F.col("s").alias("label"), "tv")
        else:
            given = around.join(labels.hint("shuffle_hash"), F.col("t") == F.col("code")).select(F.col("s").alias("node"), "label", (F.col("tv") * F.col("times")).alias("tv"))
            votes = scratch.spread(given, "node", n=n).groupBy("node", "label").agg(F.sum("tv").alias("tv"))
        won = votes.groupBy("node").agg(F.min(F.struct((-F.col("tv")).alias("k"), "label")).alias("w")).select(F.col("node").alias("code"), F.col("w.label").alias("next"))
        labels = scratch.bucketed(scratch.spread(labels, "code", n=n).join(won, "code", "left").select("code", F.coalesce("next", "label").alias("label"), "times"), "code", n, "labels")
    names = codes.select(F.col("code").alias("label"), F.col("id").alias("name"))
    got = codes.select("id", "code").join(labels.select("code", "label"), "code").join(names, "label").select("id", F.col("name").alias("label"))
    return nodes.join(got, "id", "left")
