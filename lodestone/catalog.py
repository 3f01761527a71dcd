"""All queries of the library by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone import ontology
from lodestone.functions import evaluation, predicates, text
from lodestone.operators import evidence, iterative, relational, sets
from lodestone.plans import context, router
from lodestone.sources.tables import WITH, graph, table
from lodestone.streaming import events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def on_graph(name: str, sql: str | None, columns: list[str] | None = None):
    """Registers a function of a Graph; its SQL sees the CTEs nodes and edges."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(graph(spark, sf_dir))
        if sql:
            ORACLES[name] = f"WITH RECURSIVE {WITH}" + (", " if not sql.lstrip().upper().startswith("SELECT") else " ") + sql
        return fn

    return register


def on_tables(name: str, tables: str, sql: str | None):
    """Registers a function of the named tables."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(*(table(spark, sf_dir, t) for t in tables.split()))
        if sql:
            ORACLES[name] = sql
        return fn

    return register


STRENGTH = ontology.sql_case("type", {k: v for k, (_, v) in ontology.RELATIONS.items()}, repr(ontology.DEFAULT_STRENGTH))
TRUST = ontology.sql_case("provenance", ontology.PROVENANCE, repr(ontology.DEFAULT_PROVENANCE))
FAMILY = ontology.sql_case("type", {k: f for k, (f, _) in ontology.RELATIONS.items()}, "'generic'")
TV = f"(weight * confidence * {TRUST} * {STRENGTH})"
LIVE = "ln AS (SELECT * FROM nodes WHERE active), le AS (SELECT * FROM edges WHERE source IN (SELECT id FROM ln) AND target IN (SELECT id FROM ln))"
TOKENS = "regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]{2,}')"


def _relation_sql(near: str, far: str, target: str, relation: str) -> str:
    return f"""own AS (SELECT * FROM edges WHERE {near} = '{target}' AND type = '{relation}'),
best AS (SELECT * FROM (SELECT {far} AS id, type, confidence, row_number() OVER (PARTITION BY {far} ORDER BY confidence DESC, ord) AS n FROM own) WHERE n = 1),
hits AS (SELECT b.id, label, path, type, b.confidence FROM best b JOIN nodes USING (id))
SELECT *, (SELECT count(*) FROM hits) AS total, greatest((SELECT count(*) FROM hits) - 50, 0) AS omitted FROM hits ORDER BY path, label, id LIMIT 50"""


@on_graph("relations_callers", _relation_sql("target", "source", "supplier:1", "imports"))
def _callers(g):
    return relational.relations(g, "supplier:1", "in", "imports")


@on_graph("relations_callees", _relation_sql("source", "target", "customer:7", "calls"))
def _callees(g):
    return relational.relations(g, "customer:7", "out", "calls")


HANDLES = ["order:1", "FRANCE", "nowhere", "orders/1-URGENT", "EUROPE"]


@on_graph("resolve_target_status", f"""h AS (SELECT unnest({HANDLES}) AS handle),
m AS (SELECT handle, id, 0 AS rank FROM h JOIN nodes ON id = handle UNION ALL SELECT handle, id, 1 FROM h JOIN nodes ON label = handle UNION ALL SELECT handle, id, 2 FROM h JOIN nodes ON path = handle),
f AS (SELECT handle, count(*) AS n, min(id) AS id FROM m WHERE rank = (SELECT min(rank) FROM m x WHERE x.handle = m.handle) GROUP BY handle)
SELECT handle, CASE WHEN n IS NULL THEN 'not_found' WHEN n = 1 THEN 'ok' ELSE 'ambiguous' END AS status, coalesce(n, 0) AS matches, CASE WHEN n = 1 THEN id END AS resolved FROM h LEFT JOIN f USING (handle)""")
def _resolve(g):
    return relational.resolve(g, g.nodes.sparkSession.createDataFrame([(h,) for h in HANDLES], "handle string"))


@on_graph("select_filtered", "SELECT id, label, path FROM (SELECT * FROM nodes WHERE kind = 'class' AND path LIKE '%/BUILDING' ORDER BY ord LIMIT 100)")
def _select(g):
    return relational.select(g, (F.col("kind") == "class") & F.col("path").endswith("/BUILDING"), 100).select("id", "label", "path")


@on_graph("select_count", "SELECT count(*) AS n FROM nodes WHERE kind = 'class' AND path LIKE '%/BUILDING'")
def _count(g):
    return g.nodes.filter((F.col("kind") == "class") & F.col("path").endswith("/BUILDING")).agg(F.count("*").alias("n"))


@on_graph("degree", "SELECT id, count(*) AS degree FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id")
def _degree(g):
    return relational.degree(g)


@on_graph("caller_counts", "SELECT target, count(DISTINCT source) AS callers, count(DISTINCT source) FILTER (WHERE source NOT LIKE 'test%') AS production_callers FROM edges WHERE source <> target AND type IN ('calls', 'uses', 'imports') AND source IN (SELECT id FROM nodes) GROUP BY target")
def _caller_counts(g):
    return relational.caller_counts(g)


@on_graph("kind_histogram", "SELECT kind AS name, count(*) AS n FROM nodes GROUP BY kind")
def _kinds(g):
    return relational.histogram(g.nodes, "kind")


@on_graph("relation_histogram", "SELECT type AS name, count(*) AS n FROM edges GROUP BY type")
def _types(g):
    return relational.histogram(g.edges, "type")


@on_graph("shape_profile", """n AS (SELECT count(*) AS nodes, count(*) FILTER (WHERE kind = 'function') AS functions FROM nodes), e AS (SELECT count(*) AS edges, 0 AS weak, count(*) FILTER (WHERE type = 'calls') AS calls FROM edges)
SELECT nodes, edges, round_even(edges / nodes, 4) AS density, round_even(weak / edges, 4) AS weak_ratio, round_even(calls / functions, 4) AS calls_per_symbol FROM n, e""")
def _shape(g):
    return relational.shape(g)


@on_graph("subgraph_entropy", "p AS (SELECT count(*) / sum(count(*)) OVER () AS p FROM edges GROUP BY type) SELECT count(*) AS relations, round_even(-sum(p * ln(p)) / ln(count(*)), 6) AS entropy FROM p")
def _entropy(g):
    return relational.relation_entropy(g.edges)


@on_graph("edge_traversal_val", f"SELECT source, target, type, ord, round_even({TV}, 6) AS tv FROM edges WHERE {TV} > 0")
def _tv(g):
    return g.edges.select("source", "target", "type", "ord", F.bround(relational.traversal_value(), 6).alias("tv")).filter("tv > 0")


@on_graph("edge_dedupe_first", "SELECT source, target, type, ord FROM (SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY ord) AS n FROM edges) WHERE n = 1")
def _dedupe(g):
    return relational.dedupe(g.edges).select("source", "target", "type", "ord")


@on_graph("weak_edge_cap", "SELECT source, target, type, ord FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY ord) AS n FROM edges) WHERE n <= CASE type WHEN 'uses' THEN 16 ELSE 12 END")
def _cap(g):
    return relational.cap_per_relation(g.edges, {"uses": 16}, 12).select("source", "target", "type", "ord")


@on_graph("family_reservation", f"""r AS (SELECT source, target, type, ord, {FAMILY} AS family, {STRENGTH} AS strength FROM edges)
SELECT source, target, type, family FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY strength DESC, type, ord) AS n FROM r) WHERE n = 1 ORDER BY strength DESC, family LIMIT 4""")
def _families(g):
    return relational.reserve_per_family(g.edges, 4).select("source", "target", "type", "family")


@on_graph("best_edge_per_pair", "SELECT source, target, type, ord, parallel FROM (SELECT *, count(*) OVER (PARTITION BY source, target) AS parallel, row_number() OVER (PARTITION BY source, target ORDER BY confidence DESC, ord) AS n FROM edges) WHERE n = 1")
def _best(g):
    return relational.best_per_pair(g.edges).select("source", "target", "type", "ord", "parallel")


@on_graph("two_hop_inference", """j AS (SELECT a.source, b.target, 'uses' AS type, least(a.confidence, b.confidence, 0.7) AS confidence, a.ord AS o1, b.ord AS o2 FROM edges a JOIN edges b ON a.target = b.source WHERE a.type = 'calls' AND b.type = 'uses' AND a.source <> b.target)
SELECT source, target, type, confidence FROM (SELECT *, row_number() OVER (PARTITION BY source, target ORDER BY o1, o2) AS n FROM j WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.source = j.source AND e.target = j.target AND e.type = 'uses')) WHERE n = 1""")
def _infer(g):
    return relational.infer(g.edges, [("calls", "uses", "uses", 0.7)])


@on_graph("dangling_endpoints", "SELECT DISTINCT id, 'external' AS kind, 0.35::DOUBLE AS confidence FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) WHERE id NOT IN (SELECT id FROM nodes WHERE kind <> 'part' AND active)")
def _dangling(g):
    return relational.dangling(type(g)(g.nodes.filter("kind <> 'part' AND active"), g.edges))


@on_graph("graph_validate", """SELECT 'duplicate_id' AS rule, count(*) AS n FROM (SELECT id FROM nodes GROUP BY id HAVING count(*) > 1)
UNION ALL SELECT 'dangling', count(DISTINCT id) FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) WHERE id NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'missing_type', count(*) FROM edges WHERE coalesce(type, '') = '' UNION ALL SELECT 'bad_weight', count(*) FROM edges WHERE weight IS NULL OR isnan(weight)""")
def _validate(g):
    return relational.validate(g)


@on_graph("merge_node", """m AS (SELECT CASE WHEN source = 'supplier:2' THEN 'supplier:1' ELSE source END AS source, CASE WHEN target = 'supplier:2' THEN 'supplier:1' ELSE target END AS target, type, ord FROM edges)
SELECT source, target, type, ord FROM (SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY ord) AS n FROM m WHERE source <> target) WHERE n = 1""")
def _merge(g):
    return sets.merge_node(g, "supplier:2", "supplier:1").select("source", "target", "type", "ord")


@on_graph("symmetric_closure", """b AS (SELECT source, target, type, ord FROM edges UNION ALL SELECT target, source, type, ord FROM edges)
SELECT source, target, type, ord FROM (SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY ord) AS n FROM b) WHERE n = 1""")
def _symmetric(g):
    return sets.symmetric(g.edges).select("source", "target", "type", "ord")


@on_graph("subsystem_map", """p AS (SELECT id, label, split_part(path, '/', 1) AS subsystem, d.score FROM nodes JOIN (SELECT id, count(*) AS score FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id) d USING (id)),
r AS (SELECT *, row_number() OVER (PARTITION BY subsystem ORDER BY score DESC, lower(label), id) AS n FROM p)
SELECT subsystem, count(*) AS members, sum(score)::BIGINT AS rank_sum, string_agg(label, ',' ORDER BY n) FILTER (WHERE n <= 2) AS representatives FROM r GROUP BY subsystem""")
def _subsystems(g):
    return relational.subsystems(g, relational.degree(g).withColumnRenamed("degree", "score")).withColumn("rank_sum", F.col("rank_sum").cast("long"))


@on_graph("coupling_matrix", """s AS (SELECT id, split_part(path, '/', 1) AS s FROM nodes)
SELECT a.s AS from_s, b.s AS to_s, type, count(*) AS n, min(source || '->' || target) AS example FROM edges JOIN s a ON a.id = source JOIN s b ON b.id = target WHERE a.s <> b.s GROUP BY ALL""")
def _coupling(g):
    return relational.coupling(g)


@on_graph("inventory_by_kind", "SELECT kind, count(DISTINCT path) AS paths FROM nodes GROUP BY kind")
def _inventory(g):
    return g.nodes.groupBy("kind").agg(F.count_distinct("path").alias("paths"))


@on_graph("impact_set", """b AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges),
r0 AS (SELECT 'supplier:1' AS id, 0 AS hop), r1 AS (SELECT DISTINCT target AS id, 1 AS hop FROM b JOIN r0 ON source = id WHERE target NOT IN (SELECT id FROM r0)),
r2 AS (SELECT DISTINCT target AS id, 2 AS hop FROM b JOIN r1 ON source = id WHERE target NOT IN (SELECT id FROM r0 UNION SELECT id FROM r1))
SELECT * FROM r0 UNION ALL SELECT * FROM r1 UNION ALL SELECT * FROM r2""")
def _impact(g):
    return iterative.reach(g.edges, ["supplier:1"], 2, g.incoming)


@on_graph("components", None)
def _components(g):
    return iterative.components(type(g)(g.nodes, g.edges.filter("type IN ('calls', 'contains')")))


ORACLES["components"] = f"""WITH RECURSIVE {WITH}, e AS (SELECT source, target FROM edges WHERE type IN ('calls', 'contains') UNION SELECT target, source FROM edges WHERE type IN ('calls', 'contains')),
r(id, root) AS (SELECT id, id FROM nodes WHERE kind = 'module' UNION SELECT e.target, r.root FROM r JOIN e ON e.source = r.id)
SELECT n.id, coalesce(c.component, n.id) AS component FROM nodes n LEFT JOIN (SELECT r.id, min(m.id) AS component FROM r JOIN r m ON m.root = r.root GROUP BY r.id) c USING (id)"""


def _pagerank_sql(iterations: int, seed: str | None) -> str:
    jump = f"CASE WHEN id = '{seed}' THEN 1.0::DOUBLE ELSE 0 END" if seed else "1.0::DOUBLE / (SELECT count(*) FROM ln)"
    parts = [f"{LIVE}, v AS MATERIALIZED (SELECT source, target, sum({TV}) AS tv FROM le GROUP BY ALL HAVING sum({TV}) > 0), o AS (SELECT source, sum(tv) AS total FROM v GROUP BY source), t AS MATERIALIZED (SELECT source, target, tv / total AS share FROM v JOIN o USING (source)), s0 AS (SELECT id, {jump} AS jump, id NOT IN (SELECT source FROM t) AS dangling, {jump} AS score FROM ln)"]
    for i in range(iterations):
        parts.append(f"s{i + 1} AS MATERIALIZED (SELECT s.id, jump, dangling, jump * (0.15 + 0.85 * (SELECT coalesce(sum(score) FILTER (WHERE dangling), 0) FROM s{i})) + 0.85 * coalesce(f, 0) AS score FROM s{i} s LEFT JOIN (SELECT target AS id, sum(score * share) AS f FROM s{i} JOIN t ON id = source GROUP BY target) USING (id))")
    return ", ".join(parts) + f" SELECT id, round_even(score, 8) AS score FROM s{iterations}"


@on_graph("pagerank_10it", _pagerank_sql(10, None))
def _pagerank(g):
    return iterative.pagerank(g, 10).select("id", F.bround("score", 8).alias("score"))


@on_graph("ppr_10it", _pagerank_sql(10, "nation:3"))
def _ppr(g):
    return iterative.pagerank(g, 10, seeds=["nation:3"]).select("id", F.bround("score", 8).alias("score"))


@on_graph("spreading_activation_2", f"""{LIVE}, w AS (SELECT source, target, {STRENGTH} * greatest(weight, 0) AS w FROM le), b AS (SELECT * FROM w WHERE w > 0 UNION ALL SELECT target, source, w FROM w WHERE w > 0),
sh AS (SELECT source, target, sum(w) / any_value(total) AS share FROM b JOIN (SELECT source, sum(w) AS total FROM b GROUP BY source) USING (source) GROUP BY ALL),
a0 AS (SELECT id, 1.0::DOUBLE AS energy FROM ln WHERE id = 'nation:3'),
a1 AS (SELECT id, sum(energy) AS energy FROM (SELECT * FROM a0 UNION ALL SELECT target, 0.6 * energy * share FROM a0 JOIN sh ON source = id WHERE energy > 0.01) GROUP BY id),
a1k AS (SELECT * FROM a1 WHERE (SELECT coalesce(sum(energy) / (count(*) * 8), 1) FROM a1 WHERE id NOT IN (SELECT id FROM a0)) >= 0.005 UNION ALL SELECT * FROM a0 WHERE (SELECT coalesce(sum(energy) / (count(*) * 8), 1) FROM a1 WHERE id NOT IN (SELECT id FROM a0)) < 0.005),
a2 AS (SELECT id, sum(energy) AS energy FROM (SELECT * FROM a1k UNION ALL SELECT target, 0.6 * energy * share FROM a1k JOIN sh ON source = id WHERE energy > 0.01) GROUP BY id),
ok AS (SELECT (SELECT count(*) FROM a1k) = (SELECT count(*) FROM a1) AND (SELECT coalesce(sum(energy) / (count(*) * 8), 1) FROM a2 WHERE id NOT IN (SELECT id FROM a1k)) >= 0.005 AS go)
SELECT id, round_even(energy, 6) AS energy FROM a2 WHERE (SELECT go FROM ok) UNION ALL SELECT id, round_even(energy, 6) FROM a1k WHERE NOT (SELECT go FROM ok)""")
def _activation(g):
    return iterative.activation(g, ["nation:3"]).select("id", F.bround("energy", 6).alias("energy"))


def _path_sql(widest: bool) -> str:
    step = "least(value, c)" if widest else "value + 1 / greatest(c, 0.05)"
    best = "max" if widest else "min"
    first = "1.0" if widest else "0.0"
    parts = [f"e AS MATERIALIZED (SELECT source, target, max(confidence) AS c FROM edges GROUP BY ALL), p0 AS (SELECT 'region:1' AS id, {first}::DOUBLE AS value)"]
    for i in range(4):
        parts.append(f"p{i + 1} AS (SELECT id, {best}(value) AS value FROM (SELECT * FROM p{i} UNION ALL SELECT target, {step} FROM p{i} JOIN e ON id = source) GROUP BY id)")
    return ", ".join(parts) + " SELECT id, round_even(value, 6) AS value FROM p4"


@on_graph("shortest_path_cost", _path_sql(False))
def _shortest(g):
    return iterative.best_paths(g, "region:1", 4).select("id", F.bround("value", 6).alias("value"))


@on_graph("widest_path", _path_sql(True))
def _widest(g):
    return iterative.best_paths(g, "region:1", 4, widest=True).select("id", F.bround("value", 6).alias("value"))


@on_tables("snapshot_diff", "orders", """WITH a AS (SELECT * FROM orders WHERE o_orderstatus <> 'O'), b AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 5 <> 0)
SELECT coalesce(a.o_orderkey, b.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'added' WHEN b.o_orderkey IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM a FULL JOIN b ON a.o_orderkey = b.o_orderkey WHERE a.o_orderkey IS NULL OR b.o_orderkey IS NULL OR a.o_custkey IS DISTINCT FROM b.o_custkey OR a.o_orderstatus IS DISTINCT FROM b.o_orderstatus""")
def _diff(orders):
    after = orders.filter("o_orderkey % 5 <> 0").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "X").otherwise(F.col("o_orderstatus")))
    return sets.diff(orders.filter("o_orderstatus <> 'O'"), after, ["o_orderkey"], ["o_custkey", "o_orderstatus"])


@on_tables("delta_replay", "orders", """WITH l AS (SELECT o_orderkey, o_orderstatus, -1 AS seq, 'upsert' AS op FROM orders UNION ALL SELECT o_orderkey, 'Z', 1, 'upsert' FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT o_orderkey, o_orderstatus, 2, 'delete' FROM orders WHERE o_orderkey % 6 = 0)
SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY seq DESC) AS n FROM l) WHERE n = 1 AND op = 'upsert'""")
def _replay(orders):
    base = orders.select("o_orderkey", "o_orderstatus")
    one = base.filter("o_orderkey % 3 = 0").select("o_orderkey", F.lit("Z").alias("o_orderstatus"), F.lit(1).cast("long").alias("seq"), F.lit("upsert").alias("op"))
    two = base.filter("o_orderkey % 6 = 0").select("o_orderkey", "o_orderstatus", F.lit(2).cast("long").alias("seq"), F.lit("delete").alias("op"))
    return sets.replay(base, one.unionByName(two), "o_orderkey")


@on_tables("as_of_snapshot", "orders", "SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1996-06-01' AND (o_orderstatus <> 'F' OR o_orderdate + INTERVAL 90 DAY >= TIMESTAMP '1996-06-01') AND (SELECT count(*) FROM orders WHERE o_orderdate IS NULL) = 0")
def _as_of(orders):
    spans = orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("valid_from"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate").cast("timestamp") + F.expr("INTERVAL 90 DAYS")).alias("valid_to"))
    return sets.as_of(spans, "1996-06-01 00:00:00").select("o_orderkey")


@on_tables("federate_cross_links", "customer supplier", """WITH n AS (SELECT 'c' AS p, c_custkey AS k, c_nationkey * 100000 + c_custkey // 4 AS label FROM customer UNION ALL SELECT 's', s_suppkey, s_nationkey * 100000 + s_suppkey // 4 FROM supplier),
g AS (SELECT p || '::' || k AS gid, p, label, count(*) OVER (PARTITION BY label) AS c, min(p) OVER (PARTITION BY label) AS lo, max(p) OVER (PARTITION BY label) AS hi FROM n)
SELECT * FROM (SELECT gid AS source, lead(gid) OVER (PARTITION BY label ORDER BY gid) AS target, 'cross_repo' AS type FROM g WHERE c <= 8 AND lo <> hi) WHERE target IS NOT NULL""")
def _federate(customer, supplier):
    label = lambda n, k: F.expr(f"cast({n} * 100000 + {k} div 4 as string)").alias("label")
    c = customer.select(F.lit("c").alias("project"), F.col("c_custkey").cast("string").alias("id"), label("c_nationkey", "c_custkey"))
    s = supplier.select(F.lit("s").alias("project"), F.col("s_suppkey").cast("string").alias("id"), label("s_nationkey", "s_suppkey"))
    return sets.federate(c.unionByName(s), "project")


@on_tables("trace_observed_calls", "events", "SELECT caller, callee, count(*) AS weight FROM (SELECT lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS caller, event_type AS callee FROM events) WHERE caller IS NOT NULL GROUP BY ALL")
def _trace(ev):
    return sets.observed_calls(ev)


@on_tables("episode_supersession", "events", """WITH e AS (SELECT event_id AS id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS supersedes FROM events)
SELECT id, coalesce(supersedes, -1) AS supersedes, id NOT IN (SELECT supersedes FROM e WHERE supersedes IS NOT NULL) AS active FROM e""")
def _supersede(ev):
    by = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return sets.superseded(ev.select(F.col("event_id").alias("id"), F.lag("event_id").over(by).alias("supersedes"))).withColumn("supersedes", F.coalesce("supersedes", F.lit(-1).cast("long")))


@on_tables("event_tumbling", "events", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round_even(sum(value), 4) AS total FROM events GROUP BY ALL")
def _tumbling(ev):
    return events.tumbling(ev).withColumn("total", F.bround("total", 4))


@on_tables("event_session", "events", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def _session(ev):
    return events.sessions(ev)


@on_tables("tokenize_docs", "documents", f"SELECT doc_id, len({TOKENS})::BIGINT AS n, len(list_distinct({TOKENS}))::BIGINT AS kinds FROM documents")
def _tokenize(docs):
    t = text.tokens(F.col("text"))
    return docs.select("doc_id", F.size(t).cast("long").alias("n"), F.size(F.array_distinct(t)).cast("long").alias("kinds"))


@on_tables("term_df_idf", "documents", f"""WITH d AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({TOKENS})) AS term FROM documents) GROUP BY term)
SELECT term, df, round_even(ln((SELECT count(*) FROM documents) / (1 + df)) / ln((SELECT count(*) FROM documents) + 1), 6) AS idf FROM d""")
def _df(docs):
    n = docs.agg(F.count("*").cast("double").alias("total"))
    return text.document_frequency(docs).crossJoin(F.broadcast(n)).select("term", "df", F.bround(F.log(F.col("total") / (1 + F.col("df"))) / F.log(F.col("total") + 1), 6).alias("idf"))


TERMS = ["the", "tion", "queue", "der"]
_F = ", ".join(f"len(list_filter(t, lambda x: x = '{q}')) AS f{i}" for i, q in enumerate(TERMS))
_D = ", ".join(f"count(*) FILTER (WHERE f{i} > 0) AS d{i}" for i in range(len(TERMS)))
_S = " + ".join(f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.5 / (f{i} + 1.5 * (0.25 + 0.75 * len / avgdl))" for i in range(len(TERMS)))


@on_tables("bm25_topk", "documents", f"WITH t AS (SELECT doc_id, {TOKENS} AS t FROM documents), l AS (SELECT doc_id, len(t) AS len, {_F} FROM t), s AS (SELECT count(*) AS n, avg(len) AS avgdl, {_D} FROM l) SELECT doc_id, round_even({_S}, 6) AS score FROM l, s ORDER BY score DESC, doc_id LIMIT 50")
def _bm25(docs):
    return text.bm25(docs, TERMS, 50)


@on_tables("jaccard_memory_topk", "conversations", f"""WITH t AS (SELECT conv_id, turn, list_distinct({TOKENS}) AS t FROM conversations), j AS (SELECT conv_id, turn, len(list_intersect(t, {TERMS})) AS i, len(t) AS n FROM t)
SELECT conv_id, turn, round_even(i / (n + {len(TERMS)} - i), 6) AS score FROM j ORDER BY score DESC, conv_id, turn LIMIT 20""")
def _jaccard(conversations):
    score = F.bround(text.jaccard(text.tokens(F.col("text")), F.array(*map(F.lit, TERMS))), 6)
    return conversations.select("conv_id", "turn", score.alias("score")).orderBy(F.desc("score"), "conv_id", "turn").limit(20)


@on_tables("token_estimate", "pages", r"SELECT page_id, round_even(coalesce(list_sum(list_transform(regexp_extract_all(coalesce(html, ''), '[A-Za-z0-9]+'), lambda x: 1 + greatest(length(x) - 2, 0) // 6)), 0) * 1.2593::DOUBLE + length(regexp_replace(coalesce(html, ''), '[A-Za-z0-9\s]+', '', 'g')) * 0.1626::DOUBLE, 0)::BIGINT AS tokens FROM pages")
def _estimate(pages):
    return pages.select("page_id", text.token_estimate(F.col("html")).alias("tokens"))


@on_tables("identifier_quality", "part", r"SELECT p_partkey, least(3, 0.5 * greatest(len(list_filter(string_split(regexp_replace(regexp_replace(p_name, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_'), lambda x: x <> '')) - 1, 0))::DOUBLE AS quality FROM part")
def _quality(part):
    return part.select("p_partkey", text.identifier_quality(F.col("p_name")).alias("quality"))


_COS = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[]) * list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[]))"


@on_tables("cosine_topk", "embeddings", f"SELECT e.vec_id, e.label, round_even({_COS}, 6) AS similarity FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND round_even({_COS}, 6) >= 0.05 ORDER BY similarity DESC, vec_id LIMIT 20")
def _cosine(vectors):
    return text.cosine_top(vectors, vectors.filter("vec_id = 0").select(F.col("embedding").alias("q")), 20)


@on_tables("balanced_topk", "embeddings", f"""WITH s AS (SELECT e.vec_id, e.label, round_even({_COS}, 6) AS similarity, e.label < 5 AS code FROM embeddings e, embeddings q WHERE q.vec_id = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY similarity DESC, vec_id) AS n FROM s)
SELECT vec_id, similarity, code FROM r WHERE n <= 10""")
def _balanced(vectors):
    scored = text.cosine(vectors, vectors.filter("vec_id = 0").select(F.col("embedding").alias("q")))
    return text.balanced_top(scored, F.col("label") < 5, 20).select("vec_id", "similarity", "code")


@on_tables("href_links", "pages", """SELECT DISTINCT page_id, unnest(regexp_extract_all(coalesce(html, ''), 'href="([^"]*)"', 1)) AS href FROM pages""")
def _hrefs(pages):
    return text.hrefs(pages)


@on_tables("noisy_or_grounding", "lineitem", "SELECT l_orderkey, l_linenumber, round_even(1 - (1 - l_discount) * (1 - l_tax) * (1 - l_quantity / 100), 6) AS grounding FROM lineitem")
def _noisy(lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", F.bround(text.noisy_or(F.array("l_discount", "l_tax", F.col("l_quantity") / 100)), 6).alias("grounding"))


PAIRS = "p AS (SELECT least(1, n_chars / 5000)::DOUBLE AS confidence, quality AS outcome FROM labels JOIN documents USING (doc_id) WHERE n_chars IS NOT NULL AND quality IS NOT NULL)"
BINS = "b AS (SELECT least(9, floor(confidence * 10))::INT AS bin, count(*) AS n, avg(confidence) AS confidence, avg(outcome) AS accuracy FROM p GROUP BY 1)"


def _pairs(labels, docs):
    joined = labels.join(docs.select("doc_id", "n_chars"), "doc_id").filter("n_chars IS NOT NULL AND quality IS NOT NULL")
    return joined.select(F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("confidence"), F.col("quality").alias("outcome"))


@on_tables("reliability_table", "labels documents", f"WITH {PAIRS}, {BINS} SELECT bin, n, round_even(confidence, 6) AS confidence, round_even(accuracy, 6) AS accuracy FROM b")
def _reliability(labels, docs):
    return evaluation.reliability(_pairs(labels, docs)).select("bin", "n", F.bround("confidence", 6).alias("confidence"), F.bround("accuracy", 6).alias("accuracy"))


@on_tables("calibration_report", "labels documents", f"""WITH {PAIRS}, {BINS}, s AS (SELECT count(*) AS total, avg(outcome) AS base, avg((confidence - outcome) ** 2) AS brier FROM p)
SELECT total, round_even(any_value(brier), 6) AS brier, round_even(sum(n / total * (confidence - accuracy) ** 2), 6) AS reliability, round_even(sum(n / total * (accuracy - base) ** 2), 6) AS resolution,
round_even(any_value(base) * (1 - any_value(base)), 6) AS uncertainty, round_even(sum(n / total * abs(confidence - accuracy)), 6) AS ece, round_even(max(abs(confidence - accuracy)), 6) AS mce FROM b, s GROUP BY total""")
def _calibration(labels, docs):
    return evaluation.calibration(_pairs(labels, docs))


@on_tables("pav_step", "labels documents", None)
def _pav(labels, docs):
    return evaluation.isotonic(_pairs(labels, docs))


HITS = "h AS (SELECT l_orderkey AS query, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS rank, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS relevant FROM lineitem)"


@on_tables("ranking_metrics", "lineitem", f"""WITH {HITS}, a AS (SELECT query, min(rank) FILTER (WHERE relevant = 1) AS first, sum(CASE WHEN relevant = 1 AND rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg, sum(relevant)::INT AS expected FROM h GROUP BY query)
SELECT query, round_even(coalesce(1 / first, 0), 6) AS rr, round_even(CASE WHEN expected > 0 THEN dcg / list_sum(list_transform(range(1, least(expected, 10) + 1), lambda i: 1 / log2(i + 1))) ELSE 0 END, 6) AS ndcg FROM a""")
def _ranking(lineitem):
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber"))
    return evaluation.ranking(lineitem.select(F.col("l_orderkey").alias("query"), rank.alias("rank"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("relevant")))


@on_tables("coverage_auc", "lineitem", """WITH o AS (SELECT l_orderkey AS query, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS rank, l_quantity AS width, CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END AS covered FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N')),
c AS (SELECT *, sum(covered) OVER (PARTITION BY query ORDER BY rank ROWS UNBOUNDED PRECEDING) AS y, sum(width) OVER (PARTITION BY query ORDER BY rank ROWS UNBOUNDED PRECEDING) AS x FROM o)
SELECT query, round_even(sum(width * (2 * y - covered) / 2) / max(x * y), 6) AS auc FROM c GROUP BY query""")
def _auc(lineitem):
    some = lineitem.filter("l_returnflag = 'N'").select("l_orderkey").distinct()
    rows = lineitem.join(some, "l_orderkey", "left_semi")
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    return evaluation.coverage_auc(rows.select(F.col("l_orderkey").alias("query"), rank.alias("rank"), F.col("l_quantity").alias("width"), F.when(F.col("l_returnflag") == "N", F.col("l_quantity")).otherwise(0.0).alias("covered")))


@on_tables("stratified_grouping_sets", "orders", "SELECT coalesce(o_orderstatus, '*') AS a, coalesce(o_orderpriority, '*') AS b, count(*) AS n, round_even(avg(o_totalprice), 4) AS mean FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def _stratified(orders):
    return evaluation.stratified(orders, "o_orderstatus", "o_orderpriority", "o_totalprice")


@on_tables("latency_percentiles", "events", "SELECT event_type, round_even(quantile_cont(value, 0.5), 6) AS p50, round_even(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def _percentiles(ev):
    return ev.groupBy("event_type").agg(F.bround(F.percentile("value", 0.5), 6).alias("p50"), F.bround(F.percentile("value", 0.95), 6).alias("p95"))


_ROUTES = list(router.CLASSES.items())
_SIG = ", ".join(f"least(len(regexp_extract_all(lower(coalesce(text, '')), '{s}')), 3) AS s{i}" for i, (_, (s, *_)) in enumerate(_ROUTES))
_TOP = f"greatest({', '.join(f's{i}' for i in range(len(_ROUTES)))})"
_ARMS = " ".join(f"WHEN s{i} = {_TOP} THEN '{c}'" for i, (c, _) in enumerate(_ROUTES))


@on_tables("route_bulk", "conversations", f"SELECT conv_id, turn, CASE WHEN {_TOP} = 0 THEN 'unknown' {_ARMS} END AS route FROM (SELECT conv_id, turn, {_SIG} FROM conversations)")
def _route(conversations):
    return router.bulk(conversations, "text").select("conv_id", "turn", "route")


def _lpa_sql(rounds: int) -> str:
    parts = [f"{LIVE}, w AS (SELECT source, target, round_even({TV}, 6)::DECIMAL(20,6) AS tv FROM le), b AS MATERIALIZED (SELECT source, target, sum(tv) AS tv FROM (SELECT * FROM w UNION ALL SELECT target, source, tv FROM w) WHERE tv > 0 GROUP BY ALL), l0 AS (SELECT id, id AS label FROM ln)"]
    for i in range(rounds):
        parts.append(f"v{i} AS (SELECT source AS id, label, row_number() OVER (PARTITION BY source ORDER BY sum(tv) DESC, label) AS n FROM b JOIN l{i} ON id = target GROUP BY source, label), l{i + 1} AS MATERIALIZED (SELECT l.id, coalesce(v.label, l.label) AS label FROM l{i} l LEFT JOIN v{i} v ON v.id = l.id AND v.n = 1)")
    return ", ".join(parts) + f" SELECT * FROM l{rounds}"


@on_graph("label_propagation_sync", _lpa_sql(3))
def _lpa(g):
    return iterative.label_propagation(g, 3)


_LEX = ["urgent", "1", "building", "class"]
_LABEL = "string_split_regex(lower(label), '[^a-z0-9]+')"
_PATH = "string_split_regex(lower(path), '[^a-z0-9]+')"
_OWN = [f"(CASE WHEN lower(id) = '{q}' THEN 8 ELSE 0 END + CASE WHEN lower(label) = '{q}' THEN 12 WHEN list_contains({_LABEL}, '{q}') THEN 4 ELSE 0 END + CASE WHEN lower(path) = '{q}' THEN 8 WHEN list_contains({_PATH}, '{q}') THEN 3 ELSE 0 END + CASE WHEN lower(kind) = '{q}' THEN 2 ELSE 0 END)" for q in _LEX]
_SEGMENTS = r"least(3, 0.5 * greatest(len(list_filter(string_split(regexp_replace(regexp_replace(label, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '_'), lambda x: x <> '')) - 1, 0))"


@on_graph("lexical_score_topk", f"""s AS (SELECT id, path, label, round_even(({" + ".join(_OWN)})::DOUBLE * (0.5 + ({" + ".join(f"({o} > 0)::INT" for o in _OWN)}) / {len(_LEX)}) + {_SEGMENTS}, 4) AS score FROM nodes WHERE active AND ({" + ".join(_OWN)}) > 0)
SELECT id, score FROM s ORDER BY score DESC, path, label, id LIMIT 100""")
def _lexical(g):
    return context.search(g, _LEX, 100).select("id", "score")


@on_graph("khop_budgeted", None)
def _khop(g):
    ids, edges = context.expand(g, ["customer:1"], 2, 80)
    return edges.select("source", "target", "type")


@on_graph("topology_trust", """c AS (SELECT count(*) FILTER (WHERE confidence >= 0.9) AS trusted, count(*) FILTER (WHERE confidence < 0.9) AS ambiguous FROM edges WHERE type IN ('calls', 'calls_candidate', 'uses'))
SELECT trusted, ambiguous, CASE WHEN trusted / (trusted + ambiguous) >= 0.8 THEN 'high' WHEN trusted / (trusted + ambiguous) < 0.2 THEN 'low' ELSE 'mixed' END AS trust FROM c""")
def _trust(g):
    return evidence.topology_trust(g.edges)


_DEGREES = "d AS (SELECT id, count(*) AS score FROM (SELECT source AS id FROM edges UNION ALL SELECT target FROM edges) GROUP BY id)"


@on_graph("anchor_score_shape", f"""{_DEGREES}, t AS (SELECT score::DOUBLE AS score FROM d ORDER BY score DESC, id LIMIT 24), m AS (SELECT max(score) AS a, sum(score) AS total, (SELECT score FROM t ORDER BY score DESC LIMIT 1 OFFSET 1) AS b FROM t)
SELECT round_even(a / total, 6) AS top_mass, round_even((a - b) / a, 6) AS gap, (SELECT round_even(-sum(score / total * ln(score / total)), 6) FROM t) AS entropy, (SELECT round_even(sum(score) FILTER (WHERE score >= 0.75 * a) / total, 6) FROM t) AS plateau FROM m""")
def _score_shape(g):
    return evidence.score_shape(relational.degree(g).withColumnRenamed("degree", "score"), 24)


@on_graph("dominant_scope", f"""{_DEGREES}, s AS (SELECT kind AS scope, sum(score) AS mass FROM nodes JOIN d USING (id) GROUP BY kind), p AS (SELECT scope, round_even(mass / sum(mass) OVER (), 6) AS share FROM s)
SELECT scope, share FROM p WHERE share >= 0.3""")
def _dominant(g):
    scored = g.nodes.join(relational.degree(g).withColumnRenamed("degree", "score"), "id")
    return evidence.dominant_scope(scored, F.col("kind"), 0.3)


@on_graph("graph_comparison", "SELECT count(*) FILTER (WHERE active AND right_in) AS shared, count(*) FILTER (WHERE active AND NOT right_in) AS left_only, count(*) FILTER (WHERE NOT active AND right_in) AS right_only FROM (SELECT active, ord % 2 = 0 AS right_in FROM nodes)")
def _compare(g):
    return evidence.compare(g.nodes.filter("active"), g.nodes.filter("ord % 2 = 0"), "id")


@on_graph("structural_signature", None)
def _signature(g):
    return evidence.signature(g.live.edges)


@on_graph("scope_filter", "SELECT id, path FROM nodes WHERE path = 'FRANCE' OR starts_with(path, 'FRANCE/') OR path = 'EUROPE' OR starts_with(path, 'EUROPE/')")
def _scope(g):
    return g.nodes.filter(predicates.in_scope(F.col("path"), ["FRANCE", "EUROPE/"])).select("id", "path")


@on_graph("term_keys", r"SELECT id, trim(regexp_replace(lower(regexp_replace(label, '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9]+', ' ', 'g')) AS key FROM nodes")
def _keys(g):
    return g.nodes.select("id", predicates.term_key(F.col("label")).alias("key"))


@on_graph("test_material", r"SELECT id FROM nodes WHERE regexp_matches(lower(path), '(^|/)(tests?|specs?)(/|$)|(^|/)test_[^/]*$|_test\.[a-z]+$|(test|spec)s?\.(java|kt|ts|js)$')")
def _tests(g):
    return g.nodes.filter(predicates.is_test_path(F.col("path"))).select("id")


@on_tables("snippet_extents", "lineitem", "WITH l AS (SELECT DISTINCT l_orderkey AS path, l_linenumber AS line FROM lineitem) SELECT path, line, coalesce(lead(line) OVER (PARTITION BY path ORDER BY line) - 1, -1) AS end_line FROM l")
def _extents(lineitem):
    nodes = lineitem.select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line")).distinct()
    return evidence.extents(nodes).select("path", "line", F.coalesce("end_line", F.lit(-1)).alias("end_line"))


@on_tables("interval_containment", "orders", """WITH s AS (SELECT o_custkey AS file, o_orderkey AS id, (o_orderkey % 997) AS b, (o_orderkey % 997) + 1 + (o_orderkey % 13) * 40 AS e FROM orders)
SELECT c.file, c.id, arg_min(p.id, (p.e - p.b) * 10000000000 + p.id) AS parent FROM s c JOIN s p ON c.file = p.file AND p.b < c.b AND c.e <= p.e GROUP BY ALL""")
def _containment(orders):
    begin = F.col("o_orderkey") % 997
    return evidence.containment(orders.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("id"), begin.alias("begin"), (begin + 1 + F.col("o_orderkey") % 13 * 40).alias("end")), 100)


@on_tables("stem_join", "orders customer", "SELECT o_orderkey AS test, c_custkey AS source FROM orders JOIN customer ON o_custkey = c_custkey")
def _stems(orders, customer):
    return evidence.stem_pairs(orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("stem")), customer.select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("stem")))


@on_tables("doc_code_pairs", "part supplier", "WITH a AS (SELECT DISTINCT p_partkey % 40 AS key FROM part), b AS (SELECT DISTINCT s_suppkey * 7 AS key FROM supplier) SELECT CASE WHEN b.key IS NULL THEN 'doc_only' WHEN a.key IS NULL THEN 'code_only' ELSE 'paired' END AS status, count(*) AS n FROM a FULL JOIN b ON a.key = b.key GROUP BY 1")
def _coverage(part, supplier):
    return evidence.key_coverage(part.select((F.col("p_partkey") % 40).alias("key")), supplier.select((F.col("s_suppkey") * 7).alias("key")))


@on_tables("freshness", "pages", "SELECT page_id AS path, CASE WHEN page_id % 5 = 0 THEN 'new' WHEN page_id % 7 = 0 THEN 'deleted' WHEN page_id % 3 = 0 THEN 'stale' ELSE 'fresh' END AS state FROM pages")
def _freshness(pages):
    h = F.sha2(F.coalesce("html", F.lit("")), 256)
    known = pages.filter("page_id % 5 <> 0").select(F.col("page_id").alias("path"), F.when(F.col("page_id") % 3 == 0, "old").otherwise(h).alias("hash"))
    now = pages.filter("page_id % 7 <> 0 OR page_id % 5 = 0").select(F.col("page_id").alias("path"), h.alias("hash"))
    return evidence.freshness(now, known)


@on_tables("inflection_forms", "nation", "SELECT n_nationkey, lower(n_name) || 's' AS term, list_contains([lower(n_name), lower(n_name) || 's'], lower(n_name)) AS stemmed, round_even(tanh((length(n_name) - 4) / 3), 6) AS specificity FROM nation")
def _inflections(nation):
    term = F.concat(F.lower("n_name"), F.lit("s"))
    return nation.select("n_nationkey", term.alias("term"), F.array_contains(predicates.inflections(term), F.lower("n_name")).alias("stemmed"), F.bround(predicates.specificity(term), 6).alias("specificity"))
