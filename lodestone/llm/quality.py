"""Quality rules with risk-controlled thresholds. DataFrame functions only.

Every rule rejects a document whose statistic exceeds a cutoff.  The cutoffs stand in one sequence fixed in
advance (STEPS), each of which tightens one rule, so what a step rejects with all steps before it only grows.
For a stratum (language) the distinct texts of labelled documents of good quality are a holdout: with k of n
of them rejected by step t or before, the step is certified if an exact binomial test rejects a false-rejection
rate of alpha or more of all rules together, P(Bin(n, alpha) <= k) <= level.  Steps are tested in order until
one fails, which needs no correction within a stratum; the level is delta divided by the number of strata
(Bonferroni).  So with probability 1 - delta no stratum loses alpha or more of its good documents to all its
rules together.  A stratum without a certified step has no rules.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import scratch
from lodestone.llm.text import SPACE_CHARS, let, words

#: Largest certified rate of good documents that all rules together reject in one stratum.
ALPHA = 0.03
#: Probability that any stratum breaks it.
DELTA = 0.05
#: By rule: numerator, denominator and cutoffs from lenient to strict; a document is rejected beyond, not at, a cutoff.
RULES = {
    "symbols": ("1000 * n_symbols", "word_chars", (400, 300, 200, 150, 100, 50)),
    "dup_lines": ("1000 * n_dup_lines", "n_lines", (700, 500, 400, 300, 200, 100)),
    "repeats": ("1000 * n_repeat_words", "n_words", (900, 700, 500, 400, 300, 200)),
    "long_words": ("1000 * word_chars", "n_words", (40_000, 24_000, 16_000, 12_000)),
    "few_words": ("1000000", "n_words", (200_000, 100_000, 50_000, 20_000)),  # under 5, 10, 20 and 50 words
}
#: The sequence of tests: all rules at their first cutoff, then all at their second, and so on.
STEPS = [(r, cuts[d]) for d in range(max(len(c) for *_, c in RULES.values())) for r, (_, _, cuts) in RULES.items() if d < len(cuts)]
#: Above this many strata their steps are joined by a shuffle, not broadcast.
BROADCAST_ROWS = 100_000
SYMBOLS = "#*$%&|<>"


def _repeat_words(array: Column) -> Column:
    """Words inside 3-word windows that occur twice or more; the windows are compared exactly.

    Only texts with a repeated window are sorted.  A window's key ends in its padded position, and a
    word holds no blank, so equal windows are neighbours in the sorted keys.
    """

    def covered(keys: Column) -> Column:
        def head(i: Column) -> Column:
            return F.get(keys, i).substr(F.lit(1), F.length(F.get(keys, i)) - 9)

        hits = F.filter(F.sequence(F.lit(0), F.size(keys) - 1), lambda i: head(i).eqNullSafe(head(i - 1)) | head(i).eqNullSafe(head(i + 1)))
        places = F.sort_array(F.transform(hits, lambda i: F.substring(F.get(keys, i), -8, 8).cast("int")))
        widths = let(places, lambda p: F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda total, x: total + x)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def counted(k: Column) -> Column:
        keyed = F.sort_array(F.transform(k, lambda x, i: F.concat(x, F.lit(" "), F.lpad(i.cast("string"), 8, "0"))))
        return F.when(F.size(F.array_distinct(k)) == F.size(k), F.lit(0).cast("long")).otherwise(let(keyed, covered))

    return F.when(F.size(array) < 4, F.lit(0).cast("long")).otherwise(let(windows(array), counted))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name


def _step() -> str:
    """SQL of the first step that rejects a document, len(STEPS) if none does."""
    cases = []
    for rule, (top, bottom, cuts) in RULES.items():
        cases.append("CASE " + " ".join(f"WHEN {top} > {c} * {bottom} THEN {STEPS.index((rule, c))}" for c in cuts) + f" ELSE {len(STEPS)} END")
    return f"least({', '.join(cases)})"


def statistics(docs: DataFrame, into: str) -> DataFrame:
    """docs with a struct column `into`: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed, step, print.

    step: the first of STEPS that rejects the document; print: a hash of the text.  Null texts count as
    empty.  Texts are read whole.  Columns of docs stay as they are.
    """
    raw, own = fresh(docs, "_raw"), fresh(docs, "_own")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACE_CHARS, "")) > 0)
    # arrays are bound inside one expression each: a column of them could be inlined into a lambda and split anew per element
    by_word = let(words(F.col("text")), lambda w: F.struct(F.size(w).cast("long").alias("n"), _repeat_words(w).alias("r")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))
    out = docs.withColumns({raw: by_word, own: by_line})
    parts = {
        "n_words": F.col(f"{raw}.n"), "word_chars": F.length(F.translate(text, SPACE_CHARS, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_lines": F.col(f"{own}.n"), "n_dup_lines": F.col(f"{own}.d"), "n_repeat_words": F.col(f"{raw}.r"),
    }
    names = "|".join(parts)
    of = lambda sql: re.sub(rf"\b({names})\b", rf"{into}.\1", sql)
    out = out.withColumn(into, F.struct(*(c.alias(n) for n, c in parts.items()), F.xxhash64("text").alias("print"))).drop(raw, own)
    failed = F.expr(of("n_words < 50 OR 100 * n_repeat_words > 50 * n_words"))
    return out.withColumn(into, F.col(into).withField("base_failed", failed).withField("step", F.expr(of(_step()))))


def _binomial_tail(k: Column, n: Column, p: float) -> Column:
    """P(Bin(n, p) <= k), summed exactly from below in logarithms, for k < n * p."""
    odds = F.lit(p / (1 - p))
    start = F.struct((n * F.log1p(F.lit(-p))).alias("term"), F.exp(n * F.log1p(F.lit(-p))).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        term = s["term"] + F.log((n - i + 1) / i * odds)
        return F.struct(term.alias("term"), (s["sum"] + F.exp(term)).alias("sum"))

    return F.when(k < 1, F.exp(n * F.log1p(F.lit(-p)))).otherwise(F.aggregate(F.sequence(F.lit(1).cast("long"), k), start, step, lambda s: s["sum"]))


def certified(stats: DataFrame, good: DataFrame, alpha: float, delta: float) -> DataFrame:
    """(stratum, last): the last certified step of each stratum that has one.

    stats: doc_id, stratum, print, step; good: distinct doc_ids.  A text that occurs more than once in a stratum
    counts once.  The counts cover all labelled documents and are at most len(STEPS) + 1 rows a stratum.
    """
    texts = stats.join(good, "doc_id", "left_semi").select("stratum", "print", "step").distinct()
    counted = texts.groupBy("stratum", "step").agg(F.count("*").alias("k"))
    own = Window.partitionBy("stratum")
    below = F.sum("k").over(own.orderBy("step").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    cells = counted.select("stratum", "step", below.alias("k"), F.sum("k").over(own).alias("n"), F.lead("step").over(own.orderBy("step")).alias("next"))
    # every step up to the next one that rejects more has the same k; k = 0 holds up to the first that rejects any
    first = cells.groupBy("stratum").agg(F.min("step").alias("next"), F.max("n").alias("n")).select("stratum", F.lit(-1).alias("step"), F.lit(0).cast("long").alias("k"), "n", "next")
    runs = cells.unionByName(first).filter(F.col("step") < len(STEPS))
    strata = counted.agg(F.count_distinct("stratum").alias("strata"))  # one row
    tested = runs.join(F.broadcast(strata)).filter((F.col("k") < F.col("n") * alpha) & (_binomial_tail(F.col("k"), F.col("n"), alpha) <= F.lit(delta) / F.col("strata")))
    last = F.coalesce(F.col("next"), F.lit(len(STEPS))) - 1
    return tested.groupBy("stratum").agg(F.max(last).cast("int").alias("last")).filter("last >= 0")


def judge(docs: DataFrame, labels: DataFrame, into: str, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA, base: bool = True, columns: list[str] | None = None) -> DataFrame:
    """docs, or its given columns, with the struct column `into` of statistics() and in it kept (never null).

    A document is kept unless it fails the base rules (if base) or a step that is certified in its stratum rejects
    it.  With base, documents that fail the base rules are no part of the holdout.  Documents in a stratum
    without a certified step, and those of null language where it has none, face the base rules alone.
    labels: doc_id, quality; a document is good if any of its labels is 1, null ids match nothing.  The statistics
    are written once and read for both the certificates and the verdict; up to BROADCAST_ROWS strata are broadcast,
    one row each.
    """
    names = list(columns or docs.columns)
    key, last = fresh(docs, "_stratum"), fresh(docs, "_last")
    named = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum in docs.columns else F.lit("")
    stats = scratch.table(statistics(docs, into).select(*names, into, named.alias(key)), "quality", compression="zstd")
    good = labels.filter("quality = 1 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    slim = stats.filter(~F.col(f"{into}.base_failed") if base else F.lit(True)).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("stratum"), f"{into}.print", f"{into}.step")
    chosen = scratch.table(certified(slim, good, alpha, delta).toDF(key, last), "quality-steps")
    if chosen.count() <= BROADCAST_ROWS:
        chosen = F.broadcast(chosen)
    over = F.coalesce(F.col(f"{into}.step") <= F.col(last), F.lit(False))
    joined = stats.join(chosen, key, "left")
    return joined.withColumn(into, F.col(into).withField("kept", ~over & ~F.col(f"{into}.base_failed") if base else ~over)).select(*names, into)


#: Rate of good documents that the pipeline stage may reject.
STAGE_ALPHA = 0.01


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that no certified step rejects, with the columns of documents.

    The base rules count only as far as steps of theirs are certified, so good documents stay.
    """
    into = fresh(docs, "_quality")
    got = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), into, alpha=STAGE_ALPHA, base=False)
    return got.filter(f"{into}.kept").select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    got = judge(docs, labels, "q", columns=["doc_id"])
    return got.select("doc_id", *(f"q.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))


def oracle_sql() -> str:
    """The query in DuckDB's SQL."""
    return rf"""
WITH w AS (
  SELECT doc_id, lang, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: length(translate(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) > 0) AS l
  FROM documents),
tri AS (SELECT row_number() OVER () AS rid, * FROM w),
g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM tri)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM g) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
s AS (
  SELECT doc_id, coalesce(lang, '') AS stratum, text, len(w)::BIGINT AS n_words,
         length(translate(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), ''))::BIGINT AS word_chars,
         (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM tri LEFT JOIN cov USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_step()} AS step FROM s),
holdout AS (SELECT DISTINCT stratum, text, step FROM b WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
cells AS (
  SELECT stratum, t, count(*) FILTER (WHERE step <= t) AS k, count(*) AS n FROM holdout, unnest(range({len(STEPS)})) AS u(t) GROUP BY stratum, t),
tail AS (
  SELECT *, (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({ALPHA}) + (n - i) * ln(1 - {ALPHA}))) FROM unnest(range(0, k + 1)) AS v(i)) AS tail
  FROM cells WHERE k < n * {ALPHA}),
cut AS (SELECT stratum, max(t) AS last FROM tail WHERE tail <= {DELTA} / (SELECT count(DISTINCT stratum) FROM holdout) GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(step <= last, false) AS kept
FROM b LEFT JOIN cut USING (stratum)"""
