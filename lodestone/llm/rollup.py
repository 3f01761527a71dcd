"""Delta-maintained token counts.

A rollup keeps additive totals (documents, tokens, characters) by source, language and tokenizer
version.  A batch of changes carries signed rows: an insert adds a document's counts, a delete takes
them away, a revision does both.  A batch is committed as one folder under the store, written
first and then named by its batch id, so that a batch that is committed again, or whose job is run
again after a failure, changes nothing.  Totals are the sum over committed batches, partially
aggregated before the shuffle; compaction folds committed batches into a base.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import scratch

KEYS = ["source", "lang", "tokenizer"]
MEASURES = ["docs", "tokens", "chars"]
SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long, chars long"


def counted(docs: DataFrame, tokenizers: dict[str, str]) -> DataFrame:
    """Per document and tokenizer version its counts: docs 1, tokens (byte-level BPE ids), chars.

    docs: source, lang, text; null source or lang is '', null text has no tokens.  tokenizers: version to
    file.  Repeated rows count each.  Extra columns are dropped.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from lodestone.llm.byte_bpe import ByteBPE

        encoders = {v: ByteBPE(p) for v, p in tokenizers.items()}
        for batch in batches:
            chars = batch["text"].str.len().astype(np.int64)
            for version, encoder in encoders.items():
                tokens = [len(encoder.ids(t)) for t in batch["text"]]
                # totals of the batch, not rows: the partial aggregation happens here
                part = batch[["source", "lang"]].assign(tokenizer=version, docs=1, tokens=tokens, chars=chars)
                yield part.groupby(KEYS, as_index=False)[MEASURES].sum()

    return docs.select(text("source"), text("lang"), text("text")).mapInPandas(run, SCHEMA)


def signed(before: DataFrame | None, after: DataFrame | None) -> DataFrame:
    """The delta of a change: counts after with sign +, counts before with sign -; either may be None."""
    if before is None and after is None:
        raise ValueError("a change needs rows before or after it")
    parts = [p for p in (after, before.select(*KEYS, *((-F.col(m)).alias(m) for m in MEASURES)) if before is not None else None) if p is not None]
    return parts[0] if len(parts) == 1 else parts[0].select(*KEYS, *MEASURES).unionByName(parts[1])


def _sum(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).agg(*(F.sum(m).cast("long").alias(m) for m in MEASURES))


class Rollup:
    """A store of committed batches in a folder that the whole cluster sees."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.folder))

    def batches(self) -> list[str]:
        """Names of committed batches and bases."""
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder)) if s.getPath().getName()[:1] not in "_.")

    def _bases(self) -> list[str]:
        return [b for b in self.batches() if b.startswith("base=")]

    def _merged(self, names: list[str]) -> set[str]:
        """Which of some batches are in the newest base; the names of others never leave the store."""
        bases = self._bases()
        if not bases or not names:
            return set()
        merged = self.spark.read.schema("name string").parquet(f"{self.folder}/{bases[-1]}/merged")
        return {r["name"] for r in merged.filter(F.col("name").isin(names)).collect()}

    def commit(self, batch_id: str, delta: DataFrame) -> bool:
        """Commits a delta once; False if the batch had been committed before.  An empty delta is a commit like any other."""
        name = f"batch={batch_id}"
        if name in self.batches() or self._merged([name]):
            return False
        return self._publish(name, lambda staged: _sum(delta).coalesce(1).write.parquet(staged))

    def _publish(self, name: str, write) -> bool:
        """Writes a folder of its own and renames it to name; False, and nothing left behind, if another was first.

        Some file systems move a folder into an existing one of that name: such a late comer is found inside and taken away.
        """
        own = f"_staged-{uuid.uuid4().hex}"
        write(f"{self.folder}/{own}")
        to = f"{self.folder}/{name}"
        done = not self._fs.exists(self._path(to)) and self._fs.rename(self._path(f"{self.folder}/{own}"), self._path(to))
        late = self._path(f"{to}/{own}")
        if done and self._fs.exists(late):
            self._fs.delete(late, True)
            done = False
        if not done:
            self._fs.delete(self._path(f"{self.folder}/{own}"), True)
        return bool(done)

    def totals(self) -> DataFrame:
        """Totals by key over all commits; keys whose counts are all zero are absent."""
        paths = [f"{self.folder}/{b}/totals" for b in self._bases()[-1:]] + [f"{self.folder}/{b}" for b in self._open()]
        if not paths:
            return self.spark.createDataFrame([], SCHEMA)
        return _sum(self.spark.read.schema(SCHEMA).parquet(*paths)).filter("docs <> 0 OR tokens <> 0 OR chars <> 0")

    def _open(self) -> list[str]:
        """Committed batches that no base holds; bounded by the commits since the last compaction."""
        listed = [b for b in self.batches() if b.startswith("batch=")]
        covered = self._merged(listed)
        return [b for b in listed if b not in covered]

    def compact(self) -> None:
        """Folds all commits into a new base; batch ids stay known, so a late repeat still changes nothing."""
        bases, opened = self._bases(), self._open()
        number = 1 + int(bases[-1].partition("=")[2]) if bases else 1
        names = self.spark.createDataFrame([(b,) for b in opened], "name string")
        if bases:
            names = names.unionByName(self.spark.read.schema("name string").parquet(f"{self.folder}/{bases[-1]}/merged"))

        def write(staged: str) -> None:
            self.totals().coalesce(1).write.parquet(f"{staged}/totals")
            names.write.parquet(f"{staged}/merged")

        if self._publish(f"base={number:09d}", write):
            for b in [*opened, *bases]:
                self._fs.delete(self._path(f"{self.folder}/{b}"), True)


#: The source whose documents the query revises, and the SQL of their revised text: runs of white space become one blank.
REVISED, REVISION = "src0", r"trim(regexp_replace(text, '\\s+', ' '))"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals of documents under two tokenizer versions after inserts, a deletion, a revision and repeats of every batch.

    All documents are inserted, those of one source are revised, those of another are deleted and inserted again.
    """
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    versions = {v: public_tokenizers.path(f) for v, f in (("byte_bpe_50k", "byte_bpe_50k.json"), ("byte_bpe_multi_50k", "byte_bpe_multi_50k.tiktoken"))}
    counts = scratch.table(counted(docs, versions), "rollup-counts")
    revised = scratch.table(counted(docs.filter(F.col("source") == REVISED).withColumn("text", F.expr(REVISION)), versions), "rollup-revised")
    store = Rollup(spark, scratch.path(spark, "rollup"))
    moved = counts.filter("source = 'src1'")
    for _ in range(2):
        store.commit("insert", signed(None, counts))
        store.commit("revise", signed(counts.filter(F.col("source") == REVISED), revised))
        store.commit("delete", signed(moved, None))
        store.commit("again", signed(None, moved))
    store.compact()
    store.commit("insert", signed(None, counts))
    return store.totals().select("source", "lang", "tokenizer", "docs", "tokens", "chars")
