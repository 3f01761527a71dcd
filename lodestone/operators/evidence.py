"""Evidence over graphs: trust, coverage, comparison, intervals and freshness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def topology_trust(edges: DataFrame) -> DataFrame:
    """Trusted and ambiguous call edges with their verdict: high from .8, low under .2 of trusted, else mixed."""
    n = edges.filter(F.col("type").isin("calls", "calls_candidate", "uses")).agg(F.count_if(F.col("confidence") >= 0.9).alias("trusted"), F.count_if(F.col("confidence") < 0.9).alias("ambiguous"))
    share = F.coalesce(F.try_divide(F.col("trusted").cast("double"), F.col("trusted") + F.col("ambiguous")), F.lit(0.0))
    return n.withColumn("trust", F.when(share >= 0.8, "high").when(share < 0.2, "low").otherwise("mixed"))


def score_shape(scored: DataFrame, window: int) -> DataFrame:
    """Shape of the best scores: share of the top one, gap to the second, entropy and plateau (three quarters of the top)."""
    top = scored.orderBy(F.desc("score"), "id").limit(window)
    ranked = top.agg(F.reverse(F.sort_array(F.collect_list(F.col("score").cast("double")))).alias("s"))
    total = F.aggregate("s", F.lit(0.0), lambda a, x: a + x)
    first, second = F.get("s", F.lit(0)), F.coalesce(F.get("s", F.lit(1)), F.lit(0.0))
    entropy = F.aggregate("s", F.lit(0.0), lambda a, x: a - x / total * F.log(x / total))
    plateau = F.aggregate(F.filter("s", lambda x: x >= 0.75 * first), F.lit(0.0), lambda a, x: a + x) / total
    return ranked.filter("size(s) > 0").select(F.bround(first / total, 6).alias("top_mass"), F.bround((first - second) / first, 6).alias("gap"), F.bround(entropy, 6).alias("entropy"), F.bround(plateau, 6).alias("plateau"))


def dominant_scope(scored: DataFrame, scope: Column, least: float = 0.67) -> DataFrame:
    """The scope with at least that share of the score mass, if there is one."""
    by = scored.groupBy(scope.alias("scope")).agg(F.sum("score").alias("mass"))
    return by.withColumn("share", F.bround(F.col("mass") / F.sum("mass").over(Window.partitionBy()), 6)).filter(F.col("share") >= least).select("scope", "share")


def compare(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Counts of keys in both, only left and only right."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    return a.join(b, key, "full_outer").agg(F.count_if(F.col("l") & F.col("r")).alias("shared"), F.count_if(F.col("r").isNull()).alias("left_only"), F.count_if(F.col("l").isNull()).alias("right_only"))


def signature(edges: DataFrame, parts: int = 64) -> DataFrame:
    """A digest of the topology that no order of rows changes: hashes of edges are summed per part, then hashed in the order of parts.

    No list of all edges is made; each part is one decimal sum.
    """
    h = F.xxhash64("source", "target", "type")
    sums = edges.groupBy(F.pmod(h, F.lit(parts)).alias("part")).agg(F.sum(h.cast("decimal(38,0)")).alias("s"), F.count("*").alias("n"))
    return sums.agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "s", "n"))), lambda x: F.concat_ws(":", x["part"], x["s"], x["n"])), ","), 256).alias("signature"), F.sum("n").alias("edges"))


def extents(nodes: DataFrame) -> DataFrame:
    """Nodes (path, line) with the line before the next larger one of the same path."""
    lines = nodes.select("path", "line").distinct().withColumn("end_line", F.lead("line").over(Window.partitionBy("path").orderBy("line")) - 1)
    return nodes.join(lines, ["path", "line"], "left")


def containment(spans: DataFrame, width: int = 1000) -> DataFrame:
    """The smallest span of the same file around each span (file, id, begin, end); a range join by buckets of `width` lines.

    A parent is entered in each bucket that it touches and a child only in that of its beginning, so a hot
    file is spread over its buckets and each pair meets once.
    """
    parents = spans.select("file", F.col("id").alias("parent"), F.col("begin").alias("pb"), F.col("end").alias("pe"), F.explode(F.sequence(F.expr(f"begin div {width}"), F.expr(f"end div {width}"))).alias("bucket"))
    children = spans.withColumn("bucket", F.expr(f"begin div {width}"))
    inside = children.join(parents, ["file", "bucket"]).filter("pb < begin AND end <= pe")
    best = inside.groupBy("file", "id").agg(F.min(F.struct((F.col("pe") - F.col("pb")).alias("w"), "parent")).alias("m"))
    return best.select("file", "id", F.col("m.parent").alias("parent"))


def stem_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (id, stem) with (id, stem) whose stem is unique on the right."""
    unique = right.groupBy("stem").agg(F.count("*").alias("n"), F.min("id").alias("source")).filter("n = 1")
    return left.join(unique, "stem").select(F.col("id").alias("test"), "source")


def key_coverage(docs: DataFrame, code: DataFrame) -> DataFrame:
    """Keys that documents and code share, or that only one of them has."""
    a, b = docs.select("key").distinct().withColumn("d", F.lit(1)), code.select("key").distinct().withColumn("c", F.lit(1))
    kind = F.when(F.col("c").isNull(), "doc_only").when(F.col("d").isNull(), "code_only").otherwise("paired")
    return a.join(b, "key", "full_outer").groupBy(kind.alias("status")).agg(F.count("*").alias("n"))


def freshness(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files (path, hash) against a manifest (path, hash): fresh, stale, new or deleted."""
    m = manifest.select("path", F.col("hash").alias("known"))
    state = F.when(F.col("known").isNull(), "new").when(F.col("hash").isNull(), "deleted").when(F.col("hash") == F.col("known"), "fresh").otherwise("stale")
    return files.select("path", "hash").join(m, "path", "full_outer").select("path", state.alias("state"))


def overlaps(left: DataFrame, right: DataFrame, width: int = 64) -> DataFrame:
    """(file, a, b, lines) of regions (file, id, lo, hi) of one file that share lines, with how many.

    Regions meet in buckets of `width` lines, so a long file isn't one group; a pair counts in the first bucket they share.
    """
    side = lambda df, x: df.select("file", F.col("id").alias(x), F.col("lo").alias(f"lo_{x}"), F.col("hi").alias(f"hi_{x}"), F.explode(F.sequence(F.expr(f"cast(floor(lo / {width}) as long)"), F.expr(f"cast(floor(hi / {width}) as long)"))).alias("bucket"))
    met = side(left.filter("lo <= hi"), "a").join(side(right.filter("lo <= hi"), "b"), ["file", "bucket"]).filter("lo_a <= hi_b AND lo_b <= hi_a")
    first = met.filter(F.col("bucket") == F.floor(F.greatest("lo_a", "lo_b") / width))
    return first.select("file", "a", "b", (F.least("hi_a", "hi_b") - F.greatest("lo_a", "lo_b") + 1).alias("lines"))
