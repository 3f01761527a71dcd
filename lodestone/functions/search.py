"""Search over nodes: what is searched, scores by fields, multipliers, exact hits and confidence."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.sources.tables import Graph

K1, B, HEADING = 1.5, 0.75, 3
#: Words of a question that plan the answer and name nothing.
PLANNER = ("please", "show", "find", "explain", "list", "give", "tell", "me")
DOCUMENT_WORDS = ("doc", "readme", "guide", "spec", "design", "plan", "roadmap")
GENERATED = ("generated", "gen", "dist", "build", "vendor", "node_modules", "benchmark", "benchmarks", "bench")


def haystack() -> Column:
    """The text of a node that is searched: id, label, kind, path and the path's segments, in lower case."""
    some = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.lower(F.concat_ws(" ", some("id"), some("label"), some("kind"), some("path"), F.replace(some("path"), F.lit("/"), F.lit(" "))))


def sanitized(text: Column) -> Column:
    """A question without fenced code, planner words and runs of blanks."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)```.*?```", " ")
    bare = F.regexp_replace(bare, rf"(?i)\b({'|'.join(PLANNER)})\b", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def doc_intensity(text: Column) -> Column:
    """Share of a text's words that contain a word for documents; 0 without words."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")
    hits = F.filter(words, lambda w: reduce(lambda a, b: a | b, (w.contains(d) for d in DOCUMENT_WORDS)))
    return F.coalesce(F.try_divide(F.size(hits).cast("double"), F.size(words)), F.lit(0.0))


def saturating(value: Column, cap: float) -> Column:
    """A boost that grows as its value at first and never exceeds the cap."""
    return F.lit(cap) * F.tanh(value / F.lit(cap))


def is_generated(path: Column) -> Column:
    """Whether a folder of the path, or its file's name, marks generated or benchmark material."""
    parts = F.split(F.lower(F.coalesce(path, F.lit(""))), "[/\\\\]")
    return F.arrays_overlap(parts, F.lit(list(GENERATED))) | F.element_at(parts, -1).rlike(r"(\.|_)(generated|pb2|min|bench)\.[a-z]+$|^bench_")


def stem(path: Column) -> Column:
    """The name of a path's last segment without its suffix and without a mark of tests."""
    name = F.regexp_replace(F.element_at(F.split(F.lower(F.coalesce(path, F.lit(""))), "/"), -1), r"\.[^.]*$", "")
    return F.regexp_replace(name, r"^test_|(_test|_spec|\.test|\.spec)$", "")


def digest(*columns: str) -> Column:
    """A stable digest of columns: SHA-256 of their texts, joined by the unit separator; null differs from empty."""
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)


def bm25f(g: Graph, terms: list[str]) -> DataFrame:
    """(id, score) of the nodes that have a term in label or path; a word of the label counts HEADING times.

    The corpus is the candidates.  Two passes over them, no shuffle but one row of totals.
    """
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(F.col(c), F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    fields = g.nodes.select("id", words("label").alias("h"), words("path").alias("b"))
    count = lambda t: HEADING * F.size(F.filter("h", lambda w: w == t)) + F.size(F.filter("b", lambda w: w == t))
    tf = fields.select("id", (HEADING * F.size("h") + F.size("b")).alias("len"), *(count(t).alias(f"f{i}") for i, t in enumerate(terms)))
    some = tf.filter(F.greatest(*(F.col(f"f{i}") for i in range(len(terms))), F.lit(0)) > 0)
    stats = some.agg(F.count("*").alias("n"), F.avg("len").alias("mean"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))))
    norm = K1 * (1 - B + B * F.col("len") / F.col("mean"))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log1p((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + idf * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + norm)
    return some.crossJoin(F.broadcast(stats)).select("id", score.alias("score"))


def multipliers(scored: DataFrame, strength: float = 1.5) -> DataFrame:
    """(id, multiplier, bias): 1 + strength x score / best, and 3 x score / best."""
    best = scored.agg(F.max("score").alias("best"))
    share = F.coalesce(F.try_divide(F.col("score"), F.col("best")), F.lit(0.0))
    return scored.crossJoin(F.broadcast(best)).select("id", (1 + strength * share).alias("multiplier"), (3 * share).alias("bias"))


def exact(g: Graph, text: str) -> DataFrame:
    """(id, how) of the one node that a text names by id, else path, else label, else the path's last segment; none if the first that fits is ambiguous."""
    low = text.strip().lower()
    ways = {"id": F.col("id"), "path": F.col("path"), "label": F.col("label"), "basename": F.element_at(F.split("path", "/"), -1)}
    rank = F.coalesce(*(F.when(F.lower(F.coalesce(c, F.lit(""))) == low, i) for i, c in enumerate(ways.values())))
    hits = g.nodes.select("id", rank.alias("rank")).filter("rank IS NOT NULL")
    first = hits.groupBy("rank").agg(F.min("id").alias("id"), F.count("*").alias("n")).orderBy("rank").limit(1)
    return first.filter("n = 1").select("id", F.element_at(F.lit(list(ways)), F.col("rank") + 1).alias("how"))


def confidence(exact_hit: Column, mass: Column, gap: Column, status: Column) -> Column:
    """Confidence in a search: .95 for an exact hit, else by the share of the query matched, lowered for a small gap; capped by status unless exact."""
    backbone = F.when(exact_hit, 0.95).otherwise(0.25 + 0.45 * mass)
    got = F.least(F.greatest(backbone * (0.7 + 0.3 * gap), F.lit(0.0)), F.lit(1.0))
    cap = F.when(status == "partial", 0.5).when(status == "incomplete", 0.15).when(status == "unanswerable", 0.1).otherwise(1.0)
    return F.when(exact_hit, got).otherwise(F.least(got, cap))
