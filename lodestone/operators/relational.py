"""Joins, filters, aggregates and windows over the property graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone import ontology
from lodestone.sources.scratch import spread
from lodestone.sources.tables import Graph, among


def traversal_value() -> Column:
    """weight x confidence x trust in the provenance x strength of the relation."""
    return F.col("weight") * F.col("confidence") * ontology.trust() * ontology.strength()


def relations(g: Graph, target: str, direction: str = "in", relation: str | None = None, limit: int = 50) -> DataFrame:
    """One-hop neighbours of a node: the best edge per neighbour (highest confidence, first wins), with totals."""
    near, far = ("target", "source") if direction == "in" else ("source", "target")
    own = (g.by_target if direction == "in" else g.edges).filter(F.col(near) == target)
    if relation:
        own = own.filter(F.col("type") == relation)
    best = Window.partitionBy(far).orderBy(F.desc("confidence"), "ord")
    hits = own.withColumn("_n", F.row_number().over(best)).filter("_n = 1").select(F.col(far).alias("id"), "type", "confidence")
    hits = hits.join(g.nodes.select("id", "label", "path"), "id")
    total = hits.agg(F.count("*").alias("total"))
    top = hits.orderBy("path", "label", "id").limit(limit)
    return top.crossJoin(F.broadcast(total)).select("id", "label", "path", "type", "confidence", "total", F.greatest(F.col("total") - limit, F.lit(0)).alias("omitted"))


def resolve(g: Graph, handles: DataFrame) -> DataFrame:
    """Cascading resolution of handles (column handle): id, then label, then path; status ok, ambiguous or not_found."""
    tagged = None
    for rank, column in enumerate(("id", "label", "path")):
        part = handles.join(g.nodes.select(F.col("id"), F.col(column).alias("handle") if column != "id" else F.col("id").alias("handle")), "handle").select("handle", "id", F.lit(rank).alias("rank"))
        tagged = part if tagged is None else tagged.unionByName(part)
    first = tagged.withColumn("best", F.min("rank").over(Window.partitionBy("handle"))).filter("rank = best")
    found = first.groupBy("handle").agg(F.count("*").alias("n"), F.min("rank").alias("rank"), F.min("id").alias("id"))
    return handles.join(found, "handle", "left").select(
        "handle", F.when(F.col("n").isNull(), "not_found").when(F.col("n") == 1, "ok").otherwise("ambiguous").alias("status"),
        F.coalesce("n", F.lit(0)).alias("matches"), F.when(F.col("n") == 1, F.col("id")).alias("resolved"),
    )


#: Relations by which a target is called.
CALLS = ("calls", "uses", "imports")


def caller_counts(g: Graph, is_test: Column | None = None, known: bool = True) -> DataFrame:
    """Distinct callers of each target of any call or dependency, self edges aside.

    Pairs are made distinct once and then counted twice, so that no row is expanded per count.  known: count only
    callers that are nodes.
    """
    test = is_test if is_test is not None else F.col("source").startswith("test")
    used = g.edges.filter((F.col("source") != F.col("target")) & F.col("type").isin(*CALLS))
    pairs = used.select("target", "source")
    pairs = (among(pairs, "source", g.nodes.select("id")) if known else spread(pairs, "source")).distinct()  # by source already: the edges are shuffled once
    return pairs.groupBy("target").agg(F.count("*").alias("callers"), F.count_if(~test).alias("production_callers"))


def select(g: Graph, predicate: Column, limit: int) -> DataFrame:
    """Set predicate selection: truncated in insertion order, then sorted by path and label."""
    return g.nodes.filter(predicate).orderBy("ord").limit(limit).orderBy("path", "label")


def degree(g: Graph) -> DataFrame:
    """In plus out edges; a self loop counts twice."""
    ends = g.edges.select(F.explode(F.array("source", "target")).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("degree"))


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("name")).agg(F.count("*").alias("n"))


def shape(g: Graph) -> DataFrame:
    """Density, weak-edge ratio and edges per kind of the whole graph, in one row."""
    n = g.nodes.agg(F.count("*").alias("nodes"), F.count_if(F.col("kind") == "function").alias("functions"))
    e = g.edges.agg(F.count("*").alias("edges"), F.count_if(F.col("type").isin(*ontology.WEAK)).alias("weak"), F.count_if(F.col("type") == "calls").alias("calls"))
    ratio = lambda a, b: F.bround(F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0)), 4)
    return n.crossJoin(e).select("nodes", "edges", ratio("edges", "nodes").alias("density"), ratio("weak", "edges").alias("weak_ratio"), ratio("calls", "functions").alias("calls_per_symbol"))


def relation_entropy(edges: DataFrame) -> DataFrame:
    """Entropy of the relation types, divided by that of a uniform distribution."""
    n = edges.groupBy("type").agg(F.count("*").alias("n"))
    p = n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return p.agg(F.count("*").alias("relations"), F.bround(F.coalesce(F.try_divide(-F.sum(F.col("p") * F.log("p")), F.log(F.count("*").cast("double"))), F.lit(0.0)), 6).alias("entropy"))


def first_per(df: DataFrame, keys: list[str], *order) -> DataFrame:
    """The first row per key in a stated order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def dedupe(edges: DataFrame) -> DataFrame:
    """The first edge of each source, target and type; spread first, since nearly all of them differ and a sort before the shuffle would drop few."""
    return first_per(spread(edges, "source", "target", "type"), ["source", "target", "type"], "ord")


def best_per_pair(edges: DataFrame) -> DataFrame:
    """The most confident edge of each pair, first wins, and the number of edges of the pair."""
    pair = Window.partitionBy("source", "target")
    ranked = spread(edges, "source", "target").withColumn("parallel", F.count("*").over(pair)).withColumn("_n", F.row_number().over(pair.orderBy(F.desc("confidence"), "ord")))
    return ranked.filter("_n = 1").drop("_n")


#: Relations that are capped one by one; more would read the edges too often.
FEW_TYPES = 32


def cap_per_relation(edges: DataFrame, caps: dict[str, int], default: int) -> DataFrame:
    """The first edges of each relation in arrival order: a task keeps only so many of a relation and sorts no edges, unless there are many relations."""
    types = [r[0] for r in edges.select("type").distinct().limit(FEW_TYPES + 1).collect()]
    if len(types) <= FEW_TYPES:
        out = edges.limit(0)
        for t in types:
            out = out.unionByName(edges.filter(F.col("type").eqNullSafe(F.lit(t))).orderBy("ord").limit(caps.get(t, default)))
        return out
    most = max([default, *caps.values()])
    cap = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for i in caps.items() for x in i]), F.col("type")), F.lit(default)) if caps else F.lit(default)
    return edges.withColumn("_n", F.row_number().over(Window.partitionBy("type").orderBy("ord"))).filter(F.col("_n") <= most).filter(F.col("_n") <= cap).drop("_n")


def reserve_per_family(edges: DataFrame, limit: int) -> DataFrame:
    """The first edge of each relation family, strongest relation first.

    Family and strength follow from the relation, so the first number of each relation decides; only the edges
    that bear a deciding number are ranked.
    """
    ranks = {"family": ontology.family(), "strength": ontology.strength()}
    first = first_per(edges.groupBy("type").agg(F.min("ord").alias("ord")).withColumns(ranks), ["family"], F.desc("strength"), "type", "ord")
    chosen = F.lit(False)
    for r in first.select("type", "ord").collect():
        chosen = chosen | (F.col("type").eqNullSafe(F.lit(r["type"])) & F.col("ord").eqNullSafe(F.lit(r["ord"])))
    return first_per(edges.filter(chosen).withColumns(ranks), ["family"], F.desc("strength"), "type", "ord").orderBy(F.desc("strength"), "family").limit(limit)


def dangling(g: Graph) -> DataFrame:
    """Endpoints of edges that are no node: the external references."""
    ends = g.edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    return ends.join(g.nodes, "id", "left_anti").select("id", F.lit("external").alias("kind"), F.lit(0.35).alias("confidence"))


def validate(g: Graph) -> DataFrame:
    """One row per integrity rule with the number of offenders."""
    rules = {
        "duplicate_id": g.nodes.groupBy("id").count().filter("count > 1"),
        "dangling": dangling(g),
        "missing_type": g.edges.filter("coalesce(type, '') = ''"),
        "bad_weight": g.edges.filter("weight IS NULL OR isnan(weight)"),
    }
    parts = [df.agg(F.lit(name).alias("rule"), F.count("*").alias("n")) for name, df in rules.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def infer(edges: DataFrame, rules: list[tuple[str, str, str, float]]) -> DataFrame:
    """One pass of two-hop rules (left, right, output, confidence): a -left-> b -right-> c gives a -output-> c.

    Pairs that exist already, self pairs and repeats (rule order, then first edges) are dropped.
    """
    parts = []
    for i, (left, right, output, confidence) in enumerate(rules):
        a = edges.filter(F.col("type") == left).select(F.col("source"), F.col("target").alias("mid"), F.col("confidence").alias("c1"), F.col("ord").alias("o1"))
        b = edges.filter(F.col("type") == right).select(F.col("source").alias("mid"), F.col("target"), F.col("confidence").alias("c2"), F.col("ord").alias("o2"))
        parts.append(a.join(b, "mid").filter("source <> target").select("source", "target", F.lit(output).alias("type"), F.least("c1", "c2", F.lit(confidence)).alias("confidence"), F.lit(i).alias("rule"), "o1", "o2"))
    all_rules = parts[0]
    for part in parts[1:]:
        all_rules = all_rules.unionByName(part)
    fresh = all_rules.join(edges.select("source", "target", "type"), ["source", "target", "type"], "left_anti")
    return first_per(fresh, ["source", "target", "type"], "rule", "o1", "o2").select("source", "target", "type", "confidence")


def subsystems(g: Graph, rank: DataFrame, per: int = 2) -> DataFrame:
    """Groups nodes by the first segment of their path: members, summed rank and the top labels."""
    placed = g.nodes.join(rank, "id").withColumn("subsystem", F.substring_index("path", "/", 1))
    top = Window.partitionBy("subsystem").orderBy(F.desc("score"), F.lower("label"), "id")
    # the bound on the rank keeps `per` rows a task and subsystem before the shuffle
    named = placed.select("subsystem", "score", "label", "id").withColumn("_n", F.row_number().over(top)).filter(F.col("_n") <= per)
    best = named.groupBy("subsystem").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_n", "label"))), lambda x: x["label"]), ",").alias("representatives"))
    totals = placed.groupBy("subsystem").agg(F.count("*").alias("members"), F.bround(F.sum("score"), 4).alias("rank_sum"))
    return totals.join(best, "subsystem").select("subsystem", "members", "rank_sum", "representatives")


def coupling(g: Graph) -> DataFrame:
    """Edges between different subsystems by pair and relation, with the smallest example."""
    place = g.nodes.select("id", F.substring_index("path", "/", 1).alias("s"))
    e = g.edges.select("source", "target", "type")
    for end, s in (("source", "from_s"), ("target", "to_s")):  # nodes are hashed by partition, so that no edge is sorted for a join
        e = spread(e, end).join(place.select(F.col("id").alias(end), F.col("s").alias(s)).hint("shuffle_hash"), end)
    return e.filter("from_s <> to_s").groupBy("from_s", "to_s", "type").agg(F.count("*").alias("n"), F.min(F.concat_ws("->", "source", "target")).alias("example"))


def trusted(edges: DataFrame, least: float) -> DataFrame:
    """Edges whose confidence times the trust in their provenance is at least so much."""
    return edges.filter(F.col("confidence") * ontology.trust() >= least)


def relation_ranks(edges: DataFrame, relations: list[str], families: list[str]) -> DataFrame:
    """(type, place): relations by their position in a policy's relations, then their family's, then by name; one row per relation."""
    position = lambda c, names: F.coalesce(F.nullif(F.array_position(F.lit(names), c), F.lit(0)), F.lit(999))
    kinds = edges.select("type").distinct()
    order = Window.orderBy(position(F.col("type"), relations), position(ontology.family(), families), "type")
    return kinds.select("type", F.row_number().over(order).alias("place"))


def root_folders(nodes: DataFrame, group: str, k: int) -> DataFrame:
    """The k commonest first segments of paths in each group, with their number and place."""
    roots = nodes.filter("path <> ''").groupBy(group, F.substring_index("path", "/", 1).alias("root")).agg(F.count("*").alias("n"))
    return roots.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), "root"))).filter(F.col("place") <= k)
