"""More queries of the library: predicates, search, changes, evaluation, streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.catalog import FAMILY, STRENGTH, TRUST, on_graph, on_tables
from lodestone.functions import evaluation, search
from lodestone.operators import evidence, mutations, relational
from lodestone.plans import criteria, selection
from lodestone.sources import delta
from lodestone.sources.tables import Graph
from lodestone.streaming import events

CALLS = "cc AS (SELECT target, count(DISTINCT source) AS callers FROM edges WHERE source <> target AND type IN ('calls', 'uses', 'imports') AND source IN (SELECT id FROM nodes) GROUP BY target)"


def _rows(g, text, limit=200):
    return criteria.run(g, criteria.parse(text, limit), "select").select("id", "label", "path")


@on_graph("predicate_callers", f"{CALLS} SELECT id, label, path FROM (SELECT n.* FROM nodes n LEFT JOIN cc ON target = id WHERE kind IN ('data', 'service') AND coalesce(callers, 0) > 35 ORDER BY ord LIMIT 200)")
def _by_callers(g):
    return _rows(g, "where callers > 35 and kind in [data, service]")


@on_graph("predicate_no_callers", f"{CALLS} SELECT id, label, path FROM (SELECT n.* FROM nodes n LEFT JOIN cc ON target = id WHERE kind = 'class' AND coalesce(callers, 0) <= 0 AND contains(lower(path), 'building') ORDER BY ord LIMIT 50)")
def _by_none(g):
    return _rows(g, "production_callers <= 0 and kind = class and path contains BUILDING", 50)


@on_graph("predicate_excludes", "SELECT id, label, path FROM (SELECT * FROM nodes WHERE kind = 'function' AND NOT contains(lower(path), 'urgent') AND contains(lower(label), '_99') ORDER BY ord LIMIT 200)")
def _by_excludes(g):
    return _rows(g, "kind = function and path excludes URGENT and label contains _99")


@on_graph("predicate_label_in", "SELECT id, label, path FROM nodes WHERE lower(label) IN ('france', 'asia', 'nowhere') AND kind IN ('package', 'module')")
def _by_labels(g):
    return _rows(g, "label in [France, ASIA, nowhere] and kind in [package, module]")


@on_graph("predicate_count", "SELECT count(*) AS total FROM nodes WHERE kind = 'class' AND NOT contains(lower(path), 'machinery')")
def _counted(g):
    return criteria.run(g, criteria.parse("kind = class and crate != MACHINERY"), "count")


@on_graph("predicate_exists", "SELECT least(count(*), 1) AS total FROM nodes WHERE kind = 'service'")
def _exists(g):
    return criteria.run(g, criteria.parse("kind = service"), "exists")


@on_graph("trusted_edges", f"SELECT source, target, type, ord FROM edges WHERE confidence * {TRUST} >= 0.72")
def _trusted(g):
    return relational.trusted(g.edges, 0.72).select("source", "target", "type", "ord")


@on_graph("relation_utility", f"SELECT type, count(*) AS n, round_even(sum(confidence * {TRUST} * greatest(weight, 0.05)), 4) AS utility FROM edges GROUP BY type")
def _utility(g):
    return selection.type_stats(g.edges).withColumn("utility", F.bround("utility", 4))


@on_graph("relation_ranks", f"SELECT type, row_number() OVER (ORDER BY CASE type WHEN 'uses' THEN 0 WHEN 'calls' THEN 1 ELSE 999 END, CASE {FAMILY} WHEN 'dependency' THEN 0 WHEN 'hierarchy' THEN 1 ELSE 999 END, type)::INT AS place FROM (SELECT DISTINCT type FROM edges)")
def _ranks(g):
    return relational.relation_ranks(g.edges, ["uses", "calls"], ["dependency", "hierarchy"])


@on_graph("root_folders", """r AS (SELECT kind, split_part(path, '/', 1) AS root, count(*) AS n FROM nodes WHERE path <> '' GROUP BY ALL)
SELECT kind, root, n, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, root) AS place FROM r) WHERE place <= 3""")
def _roots(g):
    return relational.root_folders(g.nodes, "kind", 3)


CHANGED = "b AS (SELECT * REPLACE (CASE WHEN ord % 11 = 0 THEN label || '!' ELSE label END AS label) FROM nodes WHERE ord % 7 <> 0 UNION ALL SELECT 'new:' || id, label, kind, path, parent, active, ord FROM nodes WHERE kind = 'module')"


def _changed(g):
    kept = g.nodes.filter("ord % 7 <> 0").withColumn("label", F.expr("CASE WHEN ord % 11 = 0 THEN concat(label, '!') ELSE label END"))
    return Graph(kept.unionByName(g.nodes.filter("kind = 'module'").withColumn("id", F.concat(F.lit("new:"), "id"))), g.edges.filter("ord % 3 <> 0").withColumn("weight", F.expr("CASE WHEN ord % 5 = 0 THEN 0.5D ELSE weight END")))


@on_graph("delta_nodes", f"""{CHANGED} SELECT CASE WHEN b.id IS NULL THEN 'delete' ELSE 'upsert' END AS op, coalesce(a.id, b.id) AS id, b.label FROM nodes a FULL JOIN b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.label <> b.label""")
def _delta_nodes(g):
    return delta.between(g, _changed(g))[0].select("op", "id", "label")


@on_graph("delta_replay_graph", f"{CHANGED} SELECT id, label, kind FROM b")
def _delta_replay(g):
    log = delta.between(g, _changed(g))[0].withColumn("seq", F.lit(1))
    return delta.replayed(g.nodes, log, ["id"]).select("id", "label", "kind")


@on_graph("graph_union", """b AS (SELECT source, target, CASE WHEN ord % 2 = 0 THEN type ELSE 'links' END AS type, 9.0 AS weight, ord FROM edges), u AS (SELECT source, target, type, weight, ord, 0 AS side FROM edges UNION ALL SELECT source, target, type, weight, ord, 1 FROM b)
SELECT source, target, type, weight > 5 AS added FROM (SELECT *, row_number() OVER (PARTITION BY source, target, type ORDER BY side, ord) AS n FROM u) WHERE n = 1""")
def _union(g):
    other = g.edges.withColumns({"type": F.expr("CASE WHEN ord % 2 = 0 THEN type ELSE 'links' END"), "weight": F.lit(9.0)})
    return mutations.union(g, Graph(g.nodes, other)).edges.select("source", "target", "type", (F.col("weight") > 5).alias("added"))


@on_graph("graph_overlay", "SELECT CASE WHEN id LIKE 'region:%' THEN active AND id <> 'region:2' ELSE active END AS active, id FROM nodes UNION ALL SELECT true, 'x:0'")
def _overlay(g):
    foreign = g.nodes.filter("kind = 'module'").select(F.concat(F.lit("x:"), "id").alias("id"), "label", "kind", "path", "parent", F.expr("id <> 'region:2'").alias("active"), "ord")
    lone = foreign.limit(1).select(F.lit("x:0").alias("id"), "label", "kind", F.lit("no/where").alias("path"), "parent", F.lit(True).alias("active"), "ord")
    return mutations.overlay(g, Graph(foreign.unionByName(lone), g.edges.limit(0))).nodes.select("id", "active")


@on_graph("insert_edges", "SELECT source, target, type FROM edges UNION SELECT target, source, 'links' FROM edges WHERE type = 'contains' UNION SELECT source, target, type FROM edges WHERE type = 'contains'")
def _insert(g):
    own = g.edges.filter("type = 'contains'")
    flipped = own.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("links").alias("type"), "weight", "confidence", "provenance", "ord")
    deduped = Graph(g.nodes, relational.dedupe(g.edges))
    return mutations.add_edges(deduped, own.unionByName(flipped)).edges.select("source", "target", "type")


@on_graph("soft_delete", "SELECT count(*) AS n, count(*) FILTER (WHERE active AND id NOT IN (SELECT 'supplier:' || k FROM range(1, 30) t(k))) AS live FROM nodes")
def _soft(g):
    gone = g.nodes.sparkSession.range(1, 30).select(F.concat(F.lit("supplier:"), "id").alias("id"))
    return mutations.deactivate(g, gone).nodes.agg(F.count("*").alias("n"), F.count_if("active").alias("live"))


@on_graph("community_nodes", """m AS (SELECT id, 'community:' || kind AS community, label FROM nodes WHERE kind IN ('package', 'module')), w AS (SELECT community, w, count(*) AS n FROM (SELECT community, unnest(regexp_extract_all(lower(label), '[a-z]{3,}')) AS w FROM m) GROUP BY ALL),
t AS (SELECT community, string_agg(w, ' ' ORDER BY n DESC, w) AS label FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, w) AS k FROM w) WHERE k <= 6 GROUP BY community)
SELECT t.community AS id, t.label, count(*) AS members FROM t JOIN m USING (community) GROUP BY ALL""")
def _communities(g):
    few = g.nodes.filter("kind IN ('package', 'module')")
    built = mutations.hierarchy(Graph(few, g.edges.limit(0)), few.select("id", F.col("kind").alias("label")))
    return built.nodes.filter("kind = 'community'").join(built.edges.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("members")), "id").select("id", "label", "members")


@on_tables("operation_state", "events", "SELECT CAST(user_id AS VARCHAR) AS subject, arg_max(event_type, event_id) AS op, max(event_id) AS seq FROM events GROUP BY user_id")
def _operations(ev):
    lines = ev.select(F.to_json(F.struct(F.col("event_id").alias("seq"), F.col("event_type").alias("op"), F.col("user_id").cast("string").alias("subject"))).alias("value"))
    torn = lines.limit(3).select(F.substring("value", 1, 9).alias("value"))
    return mutations.final_state(mutations.operations(lines.unionByName(torn))).select("subject", "op", "seq")


@on_tables("abstention_utility", "labels documents", """WITH r AS (SELECT least(1, n_chars / 5000)::DOUBLE AS confidence, toxic = 0 AS answerable, quality::DOUBLE AS recall FROM labels JOIN documents USING (doc_id))
SELECT count(*) AS n, round_even(avg(CASE WHEN confidence IS NULL THEN NULL WHEN coalesce(answerable, true) AND confidence >= 0.4 AND coalesce(recall, 1) >= 1 OR NOT coalesce(answerable, true) AND NOT confidence >= 0.4 THEN 1.0 ELSE -1.0 END), 6) AS utility,
round_even(avg(CASE WHEN coalesce(answerable, true) THEN (coalesce(recall, 1) < 1)::INT ELSE coalesce(confidence >= 0.4, false)::INT END), 6) AS failure_rate FROM r""")
def _abstention(labels, docs):
    rows = labels.join(docs, "doc_id").select(F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("confidence"), (F.col("toxic") == 0).alias("answerable"), F.col("quality").cast("double").alias("node_recall"), F.lit(None).cast("double").alias("edge_recall"), F.lit(None).cast("double").alias("completeness"))
    return evaluation.abstention(rows, 0.4)


@on_tables("link_health", "documents labels", "WITH r AS (SELECT count(DISTINCT doc_id) AS eligible, count(DISTINCT doc_id) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS linked FROM documents) SELECT eligible, linked, round_even(linked / eligible, 6) AS ratio, CASE WHEN linked / eligible < 0.2 THEN 'sparse' WHEN linked / eligible < 0.8 THEN 'partial' ELSE 'healthy' END AS status FROM r")
def _health(docs, labels):
    return evaluation.link_health(docs.select(F.col("doc_id").alias("id")), labels.select(F.col("doc_id").alias("id")))


WORDS = "list_filter(regexp_split_to_array(lower(coalesce({}, '')), '[^a-z0-9]+'), lambda w: w <> '')"
_F = lambda t: f"3 * len(list_filter(h, lambda w: w = '{t}')) + len(list_filter(b, lambda w: w = '{t}'))"
_T = lambda i: f"ln(1 + (n - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.5 / (f{i} + 1.5 * (0.25 + 0.75 * len / mean))"
BM25F = f"""w AS (SELECT id, {WORDS.format('label')} AS h, {WORDS.format('path')} AS b FROM nodes), t AS (SELECT id, 3 * len(h) + len(b) AS len, {_F('asia')} AS f0, {_F('automobile')} AS f1 FROM w),
c AS (SELECT * FROM t WHERE greatest(f0, f1) > 0), s AS (SELECT count(*) AS n, avg(len) AS mean, count(*) FILTER (WHERE f0 > 0) AS d0, count(*) FILTER (WHERE f1 > 0) AS d1 FROM c), sc AS (SELECT id, {_T(0)} + {_T(1)} AS score FROM c, s)"""


@on_graph("bm25f", f"{BM25F} SELECT id, round_even(score, 6) AS score FROM sc")
def _bm25f(g):
    return search.bm25f(g, ["asia", "automobile"]).select("id", F.bround("score", 6).alias("score"))


@on_graph("bm25f_multipliers", f"{BM25F} SELECT id, round_even(1 + 1.5 * score / (SELECT max(score) FROM sc), 6) AS multiplier, round_even(3 * score / (SELECT max(score) FROM sc), 6) AS bias FROM sc")
def _multipliers(g):
    return search.multipliers(search.bm25f(g, ["asia", "automobile"])).select("id", F.bround("multiplier", 6).alias("multiplier"), F.bround("bias", 6).alias("bias"))


@on_graph("exact_hit", "SELECT id, 'path' AS how FROM nodes WHERE lower(path) = 'asia'")
def _exact(g):
    return search.exact(g, " Asia ")


@on_graph("haystack", "SELECT id, length(h) AS n, contains(h, 'nation_7 automobile') AS hit FROM (SELECT id, lower(id || ' ' || label || ' ' || kind || ' ' || path || ' ' || replace(path, '/', ' ')) AS h FROM nodes)")
def _haystack(g):
    h = search.haystack()
    return g.nodes.select("id", F.length(h).cast("long").alias("n"), h.contains("nation_7 automobile").alias("hit"))


@on_graph("node_digest", "SELECT id, sha256(label || chr(31) || kind || chr(31) || path) AS digest FROM nodes")
def _digest(g):
    return g.nodes.select("id", search.digest("label", "kind", "path").alias("digest"))


@on_tables("doc_intensity", "conversations", """WITH w AS (SELECT conv_id, turn, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM conversations)
SELECT conv_id, turn, CASE WHEN len(w) = 0 THEN 0 ELSE round_even(len(list_filter(w, lambda x: regexp_matches(x, 'doc|readme|guide|spec|design|plan|roadmap'))) / len(w), 6) END AS intensity FROM w""")
def _intensity(conversations):
    return conversations.select("conv_id", "turn", F.bround(search.doc_intensity(F.col("text")), 6).alias("intensity"))


@on_tables("saturating_boost", "lineitem", "SELECT l_orderkey, l_linenumber, round_even(12 * (exp(l_quantity / 6) - 1) / (exp(l_quantity / 6) + 1), 6) AS boost FROM lineitem")
def _boost(lineitem):
    return lineitem.select("l_orderkey", "l_linenumber", F.bround(search.saturating(F.col("l_quantity"), 12.0), 6).alias("boost"))


@on_tables("search_confidence", "lineitem", """WITH r AS (SELECT *, least(greatest(CASE WHEN l_linenumber = 1 THEN 0.95 ELSE 0.25 + 0.45 * l_discount * 10 END * (0.7 + 0.3 * l_tax * 10), 0), 1) AS c FROM lineitem)
SELECT l_orderkey, l_linenumber, round_even(CASE WHEN l_linenumber = 1 THEN c WHEN l_returnflag = 'R' THEN least(c, 0.5) WHEN l_returnflag = 'A' THEN least(c, 0.15) ELSE c END, 6) AS confidence FROM r""")
def _confidence(lineitem):
    status = F.when(F.col("l_returnflag") == "R", "partial").when(F.col("l_returnflag") == "A", "incomplete").otherwise("ok")
    got = search.confidence(F.col("l_linenumber") == 1, F.col("l_discount") * 10, F.col("l_tax") * 10, status)
    return lineitem.select("l_orderkey", "l_linenumber", F.bround(got, 6).alias("confidence"))


@on_tables("region_overlap", "lineitem", """WITH s AS (SELECT l_orderkey AS file, l_linenumber AS id, l_partkey % 90 AS lo, l_partkey % 90 + l_quantity::INT AS hi FROM lineitem)
SELECT a.file, a.id AS a, b.id AS b, least(a.hi, b.hi) - greatest(a.lo, b.lo) + 1 AS lines FROM s a JOIN s b ON a.file = b.file AND a.id < b.id AND a.lo <= b.hi AND b.lo <= a.hi""")
def _overlap(lineitem):
    regions = lineitem.select(F.col("l_orderkey").alias("file"), F.col("l_linenumber").alias("id"), F.expr("l_partkey % 90").alias("lo"), F.expr("l_partkey % 90 + cast(l_quantity as int)").alias("hi"))
    return evidence.overlaps(regions, regions).filter("a < b")


@on_tables("event_sliding", "events", """SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY ALL""")
def _sliding(ev):
    return events.sliding(ev)
