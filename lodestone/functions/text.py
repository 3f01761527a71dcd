"""Text scalars and ranking, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K1, B = 1.5, 0.75


def tokens(text: Column) -> Column:
    """Lower-case alphanumeric runs of two or more characters."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]{2,}"), F.lit(0))


def identifier_quality(label: Column) -> Column:
    """min(3, .5 x (segments - 1)) over snake and camel segments."""
    spaced = F.regexp_replace(F.regexp_replace(label, "([a-z0-9])([A-Z])", "$1_$2"), "[^A-Za-z0-9]+", "_")
    segments = F.size(F.filter(F.split(spaced, "_"), lambda x: x != ""))
    return F.least(F.lit(3.0), 0.5 * F.greatest(segments - 1, F.lit(0)))


def token_estimate(text: Column) -> Column:
    """Token proxy: 1 + max(0, n - 2) // 6 per alphanumeric run times 1.2593, plus .1626 per other mark."""
    text = F.coalesce(text, F.lit(""))
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0))
    units = F.aggregate(runs, F.lit(0).cast("long"), lambda s, x: s + 1 + F.floor(F.greatest(F.length(x) - 2, F.lit(0)) / 6))
    marks = F.length(F.regexp_replace(text, "[A-Za-z0-9\\s]+", ""))
    return F.bround(units * 1.2593 + marks * 0.1626, 0).cast("long")


def saturating(value: Column, cap: float) -> Column:
    return cap * F.tanh(value / cap)


def noisy_or(channels: Column) -> Column:
    return 1 - F.aggregate(channels, F.lit(1.0), lambda a, x: a * (1 - x))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def document_frequency(docs: DataFrame) -> DataFrame:
    """(term, df) over distinct terms of each document; distinct within a row, so no shuffle but the count's own."""
    return docs.select(F.explode(F.array_distinct(tokens(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def bm25(docs: DataFrame, terms: list[str], k: int) -> DataFrame:
    """The k best documents for the query terms. Term counts stay in the row; only totals cross a shuffle."""

    def frequency(term: str) -> Column:
        return F.size(F.filter("t", lambda x: x == F.lit(term)))

    low = docs.select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("len"), *(frequency(q).alias(f"f{i}") for i, q in enumerate(terms)))
    stats = low.agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"), *(F.count_if(F.col(f"f{i}") > 0).alias(f"d{i}") for i in range(len(terms))))
    norm = K1 * (1 - B + B * F.col("len") / F.greatest(F.col("avgdl"), F.lit(1e-9)))
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log1p((F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + idf * F.col(f"f{i}") * (K1 + 1) / (F.col(f"f{i}") + norm)
    return low.crossJoin(F.broadcast(stats)).select("doc_id", F.bround(score, 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def cosine(vectors: DataFrame, query: DataFrame) -> DataFrame:
    """(vec_id, label, similarity) of all vectors to one query vector (a one-row DataFrame with q), in no order."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    cos = dot("embedding", "q") / F.sqrt(dot("embedding", "embedding") * dot("q", "q"))
    return vectors.crossJoin(F.broadcast(query.limit(1))).select("vec_id", "label", F.bround(cos, 6).alias("similarity"))


def cosine_top(vectors: DataFrame, query: DataFrame, k: int, threshold: float = 0.05) -> DataFrame:
    """The k vectors most alike to one query vector."""
    return cosine(vectors, query).filter(F.col("similarity") >= threshold).orderBy(F.desc("similarity"), "vec_id").limit(k)


def balanced_top(scored: DataFrame, is_code: Column, k: int) -> DataFrame:
    """Half of the places for code, the rest for prose, what is left over for either."""
    half = k // 2
    ranked = scored.withColumn("code", is_code).withColumn("_n", F.row_number().over(Window.partitionBy("code").orderBy(F.desc("similarity"), "vec_id")))
    reserved = (F.col("code") & (F.col("_n") <= half)) | (~F.col("code") & (F.col("_n") <= k - half))
    return ranked.filter(F.col("_n") <= k).withColumn("_r", reserved).orderBy(F.desc("_r"), F.desc("similarity"), "vec_id").limit(k).drop("_n", "_r")


def hrefs(pages: DataFrame) -> DataFrame:
    """Distinct link targets of each page."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit('href="([^"]*)"'), F.lit(1))
    return pages.select("page_id", F.explode(F.array_distinct(found)).alias("href"))
