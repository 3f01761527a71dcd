"""Exact top-k by inner product with a KD-tree per shard.

Vectors are floor(SCALE * x) in every component.  A shard is one task's share of the candidates; its
KD-tree splits at the median of the widest dimension and each node holds the tight bounding box of
its vectors.  A box bounds the inner product with q by sum(max(q * low, q * high)).  Queries that lie close
together are traversed as a block: best-first, the node opens whose bound exceeds some query's kth score by
most; a leaf is scored by one matrix product for the queries whose kth score its bound reaches, and the
traversal ends when no bound reaches any.  Ties count, so that the smaller vec_id wins.  Products are taken in
32 bits where the vectors' lengths keep every partial sum an exact integer, else in 64.

The kth score is propagated from leaf to leaf and from shard to shard: a first shard of FIRST candidates gives
every query a kth score that it is known to reach.  Shards beyond SPREAD are searched in rounds, each SPREAD
times as large as all before, which start from the kth score of the rounds before; so few candidates more than
k a query and round reach the shuffle, however many shards there are.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import scratch

SCALE = 64
LEAF = 1024
#: Queries traversed together.
TEAM = 512
#: Candidates per shard and queries per block; both bound a task's memory.
SHARD = 50_000
BLOCK = 20_000
#: Candidates of the first shard.
FIRST = 2048
#: Shards of the first round, and growth of the rounds.
SPREAD = 16


class KDTree:
    """Over integer vectors (rows of float64), with tight boxes."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order = np.arange(len(ids))
        self.low, self.high, self.span, self.kids = [], [], [], []
        stack = [(0, len(ids), -1, 0)]
        while stack:
            begin, end, parent, side = stack.pop()
            own = vectors[order[begin:end]]
            low, high = own.min(axis=0), own.max(axis=0)
            node = len(self.span)
            self.low.append(low)
            self.high.append(high)
            self.span.append((begin, end))
            self.kids.append([-1, -1])
            if parent >= 0:
                self.kids[parent][side] = node
            widest = int((high - low).argmax())
            if end - begin > leaf and high[widest] > low[widest]:
                mid = (end - begin) // 2
                order[begin:end] = order[begin:end][np.argpartition(own[:, widest], mid)]
                stack += [(begin, begin + mid, node, 0), (begin + mid, end, node, 1)]
        self.low, self.high = np.array(self.low), np.array(self.high)
        self.vectors, self.ids = vectors[order], ids[order]
        self.length = float(np.sqrt((vectors**2).sum(axis=1).max(initial=0)))
        self.single = self.vectors.astype(np.float32) if self.length < 1 << 24 else None

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Upper bound of the inner product with each node's box, by node and query."""
        return self.high @ np.maximum(queries, 0).T + self.low @ np.minimum(queries, 0).T

    def top(self, queries: np.ndarray, own: np.ndarray, k: int, kth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, id, score) of each query's k best, best first, rows of its own id aside.

        kth: a score that each query is known to reach k times, or -inf; only candidates that reach it are found.
        """
        # every partial sum is at most the product of the lengths, so below 2 ** 24 it is exact in 32 bits
        exact = self.single is not None and self.length * float(np.sqrt((queries**2).sum(axis=1).max())) < 1 << 24
        vectors, turned = (self.single, queries.T.astype(np.float32)) if exact else (self.vectors, queries.T)
        turned, kth, bound = np.ascontiguousarray(turned), kth.astype(np.float64), self.bounds(queries)
        found, held = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0

        def best() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            which, ids, scores = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((ids, -scores, which))
            which = which[order]
            rank = np.arange(len(which)) - np.searchsorted(which, which)
            last = rank == k - 1
            kth[which[last]] = np.maximum(kth[which[last]], scores[order[last]])
            order, which = order[rank < k], which[rank < k]
            return which, ids[order], scores[order]

        heap = [(-np.inf, 0)]
        while heap:
            node = heapq.heappop(heap)[1]
            need = np.flatnonzero(bound[node] >= kth)
            if not len(need):
                continue
            if self.kids[node][0] >= 0:
                for child in self.kids[node]:
                    ahead = float((bound[child] - kth).max())
                    if ahead >= 0:
                        heapq.heappush(heap, (-ahead, child))
                continue
            begin, end = self.span[node]
            dots = vectors[begin:end] @ (turned if len(need) == len(own) else turned[:, need])
            if end - begin > k and np.isneginf(kth[need]).any():
                at, col = np.nonzero(self.ids[begin:end, None] == own[need])
                dots[at, col] = -np.inf
                kth[need] = np.maximum(kth[need], np.partition(dots, end - begin - k, axis=0)[end - begin - k])
            hit = np.flatnonzero(dots >= kth[need].astype(dots.dtype))
            at, col = np.divmod(hit, len(need))
            which, ids = need[col], self.ids[begin:end][at]
            other = ids != own[which]
            found.append((which[other], ids[other], dots.ravel()[hit[other]].astype(np.float64)))
            held += len(hit)
            if held > 2 * k * len(own):
                found, held = [best()], 0
        return best()


def _search(tree: KDTree, names: np.ndarray, queries: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """tree.top for teams of queries that lie close together; the first array numbers the queries."""
    near = KDTree(queries, np.arange(len(names)), TEAM).ids
    for at in range(0, len(near), TEAM):
        team = near[at : at + TEAM]
        which, ids, scores = tree.top(queries[team], names[team], k, kth[team])
        yield team[which], ids, scores


def usable(vectors: DataFrame, dimension: int | None = None) -> DataFrame:
    """(vec_id, v): vectors without null or non-finite components, as floor(SCALE * x)."""
    x = F.col("embedding")
    bad = F.exists(x, lambda e: e.isNull() | F.isnan(e.cast("double")) | (F.abs(e.cast("double")) == float("inf")))
    rows = vectors.filter(x.isNotNull() & F.col("vec_id").isNotNull() & ~F.coalesce(bad, F.lit(True)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("double")).alias("v"))


def top_k(vectors: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best candidates, ties to smaller ids.

    vectors: vec_id, embedding; extra columns are ignored.  Queries: ids divisible by `every`; candidates:
    every row but the query's own id.  Vectors null or with null or non-finite components, and null ids,
    take no part.  Repeated rows are candidates each; a repeated query id gives one result, of its
    smallest vector.  All vectors must have one length (else an error); an empty table gives no rows.
    """
    spark = vectors.sparkSession
    rows = scratch.table(usable(vectors), "topk")
    n = rows.count()
    asked = rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    blocks = max(1, -(-n // every // BLOCK) + (n > 0))
    first = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIRST).collect()
    shared = spark.sparkContext.broadcast(([r["vec_id"] for r in first], [r["v"] for r in first]))

    def start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, vs = shared.value
        tree = KDTree(np.array(vs, np.float64).reshape(len(ids), -1), np.array(ids, np.int64)) if ids else None
        for batch in batches:
            if not len(batch):
                continue
            names, kth = batch["vec_id"].to_numpy(np.int64), np.full(len(batch), -np.inf)
            for which, _, scores in _search(tree, names, np.stack(batch["v"]), kth.copy(), k):
                # best first, so a query's kth score is its last, if it has k
                full = np.flatnonzero(np.bincount(which, minlength=len(kth))[which] == k)
                kth[which[full[k - 1 :: k]]] = scores[full[k - 1 :: k]]
            yield batch.assign(kth=kth)

    known = asked.mapInPandas(start, "vec_id long, v array<double>, kth double")

    def searched(part: DataFrame, tasks: int, asked_at: str) -> DataFrame:
        """What the shards of part find for the queries written in asked_at."""

        # each task holds one shard's tree; query blocks are read one after the other from the shared folder
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            import pyarrow.dataset as ds
            from pyarrow import fs

            system, root = fs.FileSystem.from_uri(asked_at)

            def search(ids: list, vs: list) -> Iterator[pd.DataFrame]:
                tree = KDTree(np.stack(vs), np.array(ids, np.int64))
                found = ds.dataset(root, filesystem=system, format="parquet", exclude_invalid_files=False)
                for batch in found.to_batches(columns=["vec_id", "v", "kth"], batch_size=16 * TEAM):
                    names = batch.column("vec_id").to_numpy()
                    if not len(names):
                        continue
                    queries = batch.column("v").flatten().to_numpy().reshape(len(names), -1)
                    for which, got, scores in _search(tree, names, queries, batch.column("kth").to_numpy(), k):
                        yield pd.DataFrame({"query_id": names[which], "vec_id": got, "score": scores.astype(np.int64)})

            ids, vs = [], []
            for batch in batches:
                ids += batch["vec_id"].tolist()
                vs += [np.asarray(v, np.float64) for v in batch["v"]]
                if len(ids) >= SHARD:
                    yield from search(ids, vs)
                    ids, vs = [], []
            if ids:
                yield from search(ids, vs)

        return part.repartition(tasks).mapInPandas(run, "query_id long, vec_id long, score long")

    def written(known: DataFrame) -> str:
        where = scratch.path(spark, "topk-queries")
        known.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))).write.partitionBy("block").parquet(where)
        return where

    shards = -(-n // SHARD)
    cuts = [0]
    while cuts[-1] < shards:
        cuts.append(min(shards, max(1, SPREAD * cuts[-1]) if shards > SPREAD else shards))
    bucket, best = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(max(1, shards))), Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = lambda found: found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    result = None
    for low, high in zip(cuts, cuts[1:] or [0]):
        asked_at = written(known)
        part = rows if high - low == shards else rows.filter((bucket >= low) & (bucket < high))
        tasks = max(1, high - low, min(-(-n * (high - low) // max(1, shards) // 4096), spark.sparkContext.defaultParallelism))
        found = searched(part, tasks, asked_at)
        result = ranked(found if result is None else result.drop("rank").unionByName(found))
        if high < shards:
            result = scratch.table(result, "topk-round")
            reached = result.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").cast("double").alias("reached"))
            before = spark.read.schema("vec_id long, v array<double>, kth double").parquet(asked_at)
            known = before.join(reached, "vec_id", "left").select("vec_id", "v", F.greatest("kth", "reached").alias("kth"))
    return result.select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = f"""
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM (SELECT * FROM e WHERE vec_id % 20 = 0) q JOIN e c ON c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
