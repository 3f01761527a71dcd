"""Reproducible shuffle and sharding by a Feistel permutation with cycle walking. DataFrame functions only.

Rows get global numbers 0..n-1 in the order of (doc_id, text checksum, size).  A permutation of
0..n-1, a Feistel network over Z_a x Z_b with a * b >= n that walks on while it lands at n or
beyond, gives each row its place; place % shards is the shard and place // shards the slot.  Both
follow from (row number, n, seed) alone, so any worker can compute them for any row.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import scratch

ROUNDS = 6
#: Applications of the permutation per pass. The grid exceeds n by less than its side a, so a
#: pass leaves a row unfinished with a probability of about n ** (-WALK / 2); such rows walk on.
WALK = 3
BROADCAST_ROWS = 100_000


def grid(n: int) -> tuple[int, int]:
    """The sides a, b of the smallest near-square grid with a * b >= n."""
    a = math.isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def permute(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """One application of the Feistel network to a column of numbers below a * b."""
    a, b = grid(n)
    df = df.withColumns({"_l": F.expr(f"{column} % {a}L"), "_r": F.expr(f"{column} div {a}L")})
    for turn in range(ROUNDS):
        if turn % 2 == 0:
            df = df.withColumn("_l", F.expr(f"(_l + pmod(xxhash64(_r, {seed}L, {turn}), {a}L)) % {a}L"))
        else:
            df = df.withColumn("_r", F.expr(f"(_r + pmod(xxhash64(_l, {seed}L, {turn}), {b}L)) % {b}L"))
    return df.withColumn(column, F.expr(f"_r * {a}L + _l")).drop("_l", "_r")


def walk(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """Cycle walking: WALK applications, the later ones only to numbers at n or beyond."""
    df = permute(df, column, n, seed)
    for _ in range(WALK - 1):
        again = permute(df.withColumn("_at", F.col(column)), "_at", n, seed)
        df = again.withColumn(column, F.when(F.col(column) < n, F.col(column)).otherwise(F.col("_at"))).drop("_at")
    return df


def numbered(df: DataFrame, order: list[str], name: str) -> tuple[DataFrame, int]:
    """df, written in the given order, with a gapless `row_number` from 0, and the number of rows.

    A range partitioning by all order columns splits any hot value of the first; only rows equal in
    all of them share a partition.  Offsets of partitions are a running sum of one row per partition.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    table = scratch.table(ranged.withColumn("_id", F.monotonically_increasing_id()), name)
    table = table.withColumns({"_part": F.shiftright("_id", 33), "_at": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = scratch.table(table.groupBy("_part").agg(F.count("*").alias("_n")), name + "-counts")
    rows, parts = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.count("*")).first()
    bases = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_base"))
    bases = F.broadcast(bases) if parts <= BROADCAST_ROWS else bases
    return table.join(bases, "_part").withColumn("row_number", F.col("_base") + F.col("_at")).drop("_id", "_part", "_at", "_base"), rows


def shard(docs: DataFrame, shards: int = 8, seed: int = 20_240_601) -> DataFrame:
    """Places all documents in shards under the law `rows`: counts differ by one at most.

    docs: doc_id and text; extra columns are ignored.  A null text has no bytes (size 1, checksum 0);
    null doc_ids come first in the numbering.  Rows equal in id and text are interchangeable and each
    get a place of their own.  An empty table gives no rows.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows, n = numbered(slim, ["doc_id", "text_crc32", "size"], "sharding")
    placed = walk(rows.withColumn("place", F.col("row_number").cast("long")), "place", n, seed)
    placed = scratch.table(placed, "sharding-placed")
    late = placed.filter(F.col("place") >= n)
    finished = placed.filter(F.col("place") < n)
    while not late.isEmpty():
        late = scratch.table(walk(late, "place", n, seed), "sharding-late")
        finished = finished.unionByName(late.filter(F.col("place") < n))
        late = late.filter(F.col("place") >= n)
    return finished.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.expr(f"cast(place % {shards} as int)").alias("shard"),
        F.expr(f"place div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number", "place",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
