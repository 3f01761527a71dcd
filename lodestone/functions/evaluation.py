"""Calibration and retrieval evaluation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def reliability(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Pairs (confidence, outcome 0/1) by bin: count, mean confidence, accuracy; empty bins are absent."""
    at = F.least(F.lit(bins - 1), F.floor(F.col("confidence") * bins)).cast("int")
    return pairs.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("outcome").cast("double")).alias("accuracy"))


def calibration(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """Brier score, reliability, resolution, uncertainty, expected and maximum calibration error."""
    base = pairs.agg(F.count("*").alias("total"), F.avg(F.col("outcome").cast("double")).alias("base"), F.avg((F.col("confidence") - F.col("outcome")) ** 2).alias("brier"))
    gap = F.abs(F.col("confidence") - F.col("accuracy"))
    joined = reliability(pairs, bins).crossJoin(F.broadcast(base))
    share = F.col("n") / F.col("total")
    return joined.groupBy("total", "base", "brier").agg(
        F.sum(share * gap * gap).alias("reliability"), F.sum(share * (F.col("accuracy") - F.col("base")) ** 2).alias("resolution"),
        F.sum(share * gap).alias("ece"), F.max(gap).alias("mce"),
    ).select("total", *(F.bround(c, 6).alias(c) for c in ("brier", "reliability", "resolution")), F.bround(F.col("base") * (1 - F.col("base")), 6).alias("uncertainty"), F.bround("ece", 6).alias("ece"), F.bround("mce", 6).alias("mce"))


def isotonic(pairs: DataFrame) -> DataFrame:
    """Pool-adjacent-violators: steps (upper, value). Ties are pooled in the cluster first; the pass over distinct confidences is sequential."""
    pooled = pairs.groupBy("confidence").agg(F.count("*").alias("n"), F.sum("outcome").alias("hits")).coalesce(1).sortWithinPartitions("confidence")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        steps: list[list[float]] = []
        for batch in batches:
            for c, n, hits in zip(batch["confidence"], batch["n"], batch["hits"]):
                steps.append([c, n, hits])
                while len(steps) > 1 and steps[-2][2] * steps[-1][1] >= steps[-1][2] * steps[-2][1]:
                    c, n, hits = steps.pop()
                    steps[-1] = [c, steps[-1][1] + n, steps[-1][2] + hits]
        yield pd.DataFrame([(c, h / n) for c, n, h in steps], columns=["upper", "value"])

    return pooled.mapInPandas(run, "upper double, value double")


def ranking(hits: DataFrame, k: int = 10) -> DataFrame:
    """Per query (query, rank, relevant 0/1): reciprocal rank and NDCG at k with binary gains."""
    gain = F.when((F.col("relevant") == 1) & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    first = F.min(F.when(F.col("relevant") == 1, F.col("rank")))
    out = hits.groupBy("query").agg(first.alias("first"), F.sum(gain).alias("dcg"), F.sum("relevant").cast("long").alias("expected"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.least(F.col("expected"), F.lit(k)), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return out.select("query", F.bround(F.coalesce(1 / F.col("first"), F.lit(0.0)), 6).alias("rr"), F.bround(F.when(F.col("expected") > 0, F.col("dcg") / ideal).otherwise(0.0), 6).alias("ndcg"))


def stratified(df: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Overall, by a, by b and by both, in one pass over grouping sets."""
    rolled = df.cube(a, b).agg(F.count("*").alias("n"), F.bround(F.avg(value), 4).alias("mean"), F.grouping(a).alias("all_a"), F.grouping(b).alias("all_b"))
    # a null stratum is '' and the total is '*'
    name = lambda c, every: F.when(F.col(every) == 1, "*").otherwise(F.coalesce(F.col(c).cast("string"), F.lit("")))
    return rolled.select(name(a, "all_a").alias("a"), name(b, "all_b").alias("b"), "n", "mean")


def coverage_auc(segments: DataFrame) -> DataFrame:
    """Per query (query, rank, width, covered): trapezoid area of coverage over the lines read."""
    order = Window.partitionBy("query").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    run = segments.withColumns({"y": F.sum("covered").over(order), "x": F.sum("width").over(order)})
    area = run.withColumn("a", F.col("width") * (F.col("y") + F.col("y") - F.col("covered")) / 2)
    return area.groupBy("query").agg(F.bround(F.sum("a") / F.max(F.col("x") * F.col("y")), 6).alias("auc"))


def abstention(results: DataFrame, threshold: float) -> DataFrame:
    """One row: mean utility (1 for a complete answer or a right abstention, else -1) and failure rate at a confidence threshold.

    results: confidence, answerable (null: yes), node_recall, edge_recall, completeness (null: not measured).
    Rows without a confidence have no utility; an answerable one fails if a measure is below 1, another if it was answered.
    """
    measures = [F.coalesce(F.col(c), F.lit(1.0)) for c in ("node_recall", "edge_recall", "completeness")]
    complete = F.least(*measures) >= 1.0
    answered = F.col("confidence") >= threshold
    answerable = F.coalesce("answerable", F.lit(True))
    right = F.when(answerable, answered & complete).otherwise(~answered)
    utility = F.when(F.col("confidence").isNotNull(), F.when(right, 1.0).otherwise(-1.0))
    failed = F.when(answerable, ~complete).otherwise(F.coalesce(answered, F.lit(False)))
    return results.agg(F.count("*").alias("n"), F.bround(F.avg(utility), 6).alias("utility"), F.bround(F.avg(failed.cast("double")), 6).alias("failure_rate"))


def paired_bootstrap(pairs: DataFrame, effect: float, samples: int = 10_000, seed: int = 1337, confidence: float = 0.95) -> dict[str, object]:
    """Percentile interval of the mean difference b - a of matched tasks (task, a, b), by seeded resampling, and a verdict.

    promote if the whole interval is at least `effect`, reject if it is at most -effect.  One task, one pair:
    a repeated task raises, as do no pairs.  An evaluation has as many pairs as tasks, which the driver holds.
    """
    rows = pairs.filter("a IS NOT NULL AND b IS NOT NULL").orderBy("task").collect()
    if len({r["task"] for r in rows}) < len(rows):
        raise ValueError("a task is paired twice")
    if not rows:
        raise ValueError("no pairs")
    d = np.array([r["b"] - r["a"] for r in rows], np.float64)
    random = np.random.default_rng(seed)
    means = np.array([d[random.integers(0, len(d), len(d))].mean() for _ in range(samples)])
    low, high = np.quantile(means, [(1 - confidence) / 2, (1 + confidence) / 2])
    verdict = "promote" if low >= effect else "reject" if high <= -effect else "inconclusive"
    return {"tasks": len(d), "mean": float(d.mean()), "low": float(low), "high": float(high), "improved": int((d > 0).sum()), "tied": int((d == 0).sum()), "regressed": int((d < 0).sum()), "verdict": verdict}


def link_health(eligible: DataFrame, linked: DataFrame) -> DataFrame:
    """One row: how many of the eligible ids are linked, the ratio, and sparse below .2, partial below .8, else healthy."""
    hit = eligible.select("id").distinct().join(linked.select("id").distinct().withColumn("l", F.lit(1)), "id", "left")
    ratio = F.coalesce(F.try_divide(F.col("linked").cast("double"), F.col("eligible")), F.lit(0.0))
    status = F.when(F.col("eligible") == 0, "empty").when(ratio < 0.2, "sparse").when(ratio < 0.8, "partial").otherwise("healthy")
    return hit.agg(F.count("*").alias("eligible"), F.count("l").alias("linked")).select("eligible", "linked", F.bround(ratio, 6).alias("ratio"), status.alias("status"))
