"""Written tables that cut lineage.

They go to the shared folder named by ``spark.checkpoint.dir`` so that a lost executor
costs a re-read, not a recomputation.  Where that setting is unset (tests, one machine)
a temporary folder is made and recorded in the session.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared scratch folder of the session, as a URI without a trailing slash."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="lodestone-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def table(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Writes df as Parquet to the shared folder and returns the written table."""
    spark = df.sparkSession
    where = path(spark, name)
    df.write.parquet(where, compression=compression)
    return spark.read.schema(df.schema).parquet(where)
