"""Mixture-controlled packing.

Every source is a queue of tokens.  Windows of a fixed length take tokens from all queues
in proportion to target weights; what a queue is owed beyond whole tokens (its deficit) is
carried to the next window.  The deficit round-robin is evaluated in closed form: of x tokens placed
so far, each half of a balanced binary tree over the queues receives its weight's part, the left half
rounded down and the right half the rest.  A part of the weight grows by 0 or 1 with each token, so
no queue's count ever falls; its deficit stays below the depth of the tree.  Any worker can therefore
compute the window of any token from its position in its own queue, so deficits are carried across
windows and across partitions without a sequential pass.
A queue that runs dry ends a phase; the others go on with their weights renormalised.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import scratch
from lodestone.llm.byte_bpe import ByteBPE

#: Above this many rows the table of partition offsets is joined by a shuffle, not broadcast.
BROADCAST_ROWS = 100_000
TOKENIZED = "doc_id long, queue string, tokens binary, n long, part int, pre long"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, queue string"


@dataclass(frozen=True)
class Phase:
    """A run of tokens in which the same queues take part with fixed integer weights."""

    placed: int  # tokens placed before the phase
    length: int  # tokens placed in it
    queues: tuple[str, ...]
    taken: tuple[int, ...]  # of each queue, before the phase
    cum: tuple[int, ...]  # cumulated weights, 0 first

    def share(self, k: int, x: int) -> tuple[int, int]:
        """(tokens that the first k queues, and that queue k have received) after x tokens of the phase."""
        low, high, before, cum = 0, len(self.queues), 0, self.cum
        while high - low > 1:
            mid = (low + high) // 2
            left = x * (cum[mid] - cum[low]) // (cum[high] - cum[low])
            if k < mid:
                high, x = mid, left
            else:
                low, before, x = mid, before + left, x - left
        return before, x

    def of(self, k: int, x: int) -> int:
        return self.share(k, x)[1]


class Plan:
    """Where token g of queue q goes: (global position of the window, offset in the window)."""

    def __init__(self, totals: dict[str, int], window: int, targets: dict[str, int] | None = None):
        self.window, self.phases = window, []
        left = {q: n for q, n in sorted(totals.items()) if n > 0}
        self.total = sum(left.values())
        weights = {q: max(1, int((targets or {}).get(q, 0))) if targets else n for q, n in left.items()}
        taken, placed = dict.fromkeys(left, 0), 0
        while left:
            queues = tuple(left)
            cum = [0]
            for q in queues:
                cum.append(cum[-1] + weights[q])
            whole = Phase(placed, sum(left.values()), queues, tuple(taken[q] for q in queues), tuple(cum))
            low, high = 0, whole.length  # the longest prefix that no queue falls short of
            while low < high:
                mid = (low + high + 1) // 2
                if all(whole.of(k, mid) <= left[q] for k, q in enumerate(queues)):
                    low = mid
                else:
                    high = mid - 1
            if low == 0:  # a remainder smaller than the rounding: one queue at a time
                q = min(queues, key=lambda x: (left[x], x))
                whole, low = Phase(placed, left[q], (q,), (taken[q],), (0, 1)), left[q]
            self.phases.append(Phase(whole.placed, low, whole.queues, whole.taken, whole.cum))
            for k, q in enumerate(whole.queues):
                got = whole.of(k, low)
                taken[q] += got
                left[q] -= got
                if not left[q]:
                    del left[q]
            placed += low
        self.by_queue: dict[str, list[tuple[int, int, int]]] = {}  # taken before, phase, index in it
        for i, p in enumerate(self.phases):
            for k, q in enumerate(p.queues):
                self.by_queue.setdefault(q, []).append((p.taken[k], i, k))

    def pieces(self, queue: str, begin: int, count: int) -> Iterator[tuple[int, int, int]]:
        """(length, sequence, offset) of the runs that tokens begin .. begin+count-1 of a queue make."""
        runs = self.by_queue[queue]
        at = bisect_right(runs, (begin, len(self.phases), 0)) - 1
        w = self.window
        while count:
            taken, i, k = runs[at]
            p = self.phases[i]
            here = begin - taken
            total = p.of(k, p.length)
            if here >= total:
                at += 1
                continue
            # the window (cut by the phase) that holds the queue's token number `here`: the last that begins
            # with at most so many, searched in steps that double from where the weight puts it
            first, last = p.placed // w, (p.placed + p.length - 1) // w
            begins = lambda s: p.of(k, max(0, s * w - p.placed)) <= here  # noqa: B023, E731
            low = high = min(last, max(first, (p.placed + here * p.cum[-1] // (p.cum[k + 1] - p.cum[k])) // w))
            step = 1
            while low > first and not begins(low):
                low, high, step = max(first, low - step), low, 2 * step
            if high == low:
                high = low + 1
                while high <= last and begins(high):
                    low, high, step = high, min(last + 1, high + step), 2 * step
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if begins(mid) else (low, mid)
            seq, x0 = low, max(0, low * w - p.placed)
            before, got = p.share(k, x0)
            while count and here < total:
                x1 = min(p.length, (seq + 1) * w - p.placed)
                before1, got1 = p.share(k, x1)
                run = min(count, got1 - here)
                if run:
                    yield run, seq, p.placed + x0 - seq * w + before1 - before + here - got
                    begin, here, count = begin + run, here + run, count - run
                seq, x0, before, got = seq + 1, x1, before1, got1


def tokenize(docs: DataFrame, tokenizer_path: str, end_id: int = 0, queue: str = "source") -> DataFrame:
    """Written table of each document's ids, with its place in its partition's queues."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        bpe, part, seen = ByteBPE(tokenizer_path), TaskContext.get().partitionId(), {}
        end = np.array([end_id], "<u2").tobytes()
        for batch in batches:
            ids = [bpe.encode_bytes(t if isinstance(t, str) else "") + end for t in batch["text"]]
            n = np.fromiter((len(x) // 2 for x in ids), np.int64, len(ids))
            queues = [q if isinstance(q, str) else "" for q in batch["queue"]]
            pre = np.empty(len(ids), np.int64)
            for i, (q, m) in enumerate(zip(queues, n.tolist())):
                pre[i] = seen.get(q, 0)
                seen[q] = pre[i] + m
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "queue": queues, "tokens": ids, "n": n, "part": part, "pre": pre})

    source = F.col(queue).cast("string") if queue in docs.columns else F.lit("")
    return scratch.table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", source.alias("queue")).mapInPandas(encode, TOKENIZED), "packing")


def tempered(totals: dict[str, int]) -> dict[str, int]:
    """Target weights by the square root of the queues' sizes, so that small sources come up more often than their share."""
    return {q: isqrt(n) for q, n in totals.items()}


def pack(
    docs: DataFrame, tokenizer_path: str, window: int = 1024, targets: dict[str, int] | Callable[[dict[str, int]], dict[str, int]] | None = None, end_id: int = 0, queue: str = "source"
) -> DataFrame:
    """Packs all documents into windows of `window` tokens; one row per piece (PIECES).

    docs: doc_id, text and the queue column (absent: one queue).  Extra columns are ignored.
    Null texts are empty and give the end id alone; null queues are the queue ''.  Repeated
    rows are packed once each.  targets: integer weights by queue or a function that gives them for the
    queues' sizes, default the sizes themselves; a queue that is not in it weighs 1.  All windows but the last are full; an empty table gives
    no rows.  The number of queues is assumed to fit the driver (one total each); partition
    offsets are broadcast up to BROADCAST_ROWS and joined by a shuffle beyond.
    """
    spark = docs.sparkSession
    tokens = tokenize(docs, tokenizer_path, end_id, queue)
    sizes = scratch.table(tokens.groupBy("queue", "part").agg(F.sum("n").alias("size")), "packing-sizes")
    totals = {r["queue"]: r["total"] for r in sizes.groupBy("queue").agg(F.sum("size").alias("total")).collect()}
    plan = Plan(totals, window, targets(totals) if callable(targets) else targets)
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("queue", "part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    if sizes.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    shared = spark.sparkContext.broadcast(plan)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        plan = shared.value
        for batch in batches:
            rows: list[tuple] = []
            for doc, q, raw, n, begin in zip(batch["doc_id"], batch["queue"], batch["tokens"], batch["n"], batch["begin"]):
                wide = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
                start = 0
                for length, seq, offset in plan.pieces(q, int(begin), int(n)):
                    rows.append((doc, start, length, zlib.crc32(wide[4 * start : 4 * (start + length)]), n, seq, offset, q))
                    start += length
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "queue"])
            yield out.assign(doc_id=out["doc_id"].astype("Int64"))

    placed = tokens.join(bases, ["queue", "part"]).select("doc_id", "queue", "tokens", "n", (F.col("base") + F.col("pre")).alias("begin"))
    return placed.mapInPandas(cut, PIECES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), targets=tempered)
