"""The corpus pipeline: quality rules, language identification, near-duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import language, packing, quality, scratch, simhash


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Last stage: the pieces of all documents that the stages before kept, packed into windows."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


#: (name, function of (spark, docs, sf_dir)). All but the last return the columns of documents.
STAGES = [
    ("quality rules", quality.stage),
    ("language identification", language.stage),
    ("near-duplicates", simhash.stage),
    ("packing", pack),
]
#: Language identification, near-duplicates and packing are not expressible in SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each over the written table of what the one before kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.table(docs, f"pipeline-{i}")
    return docs
