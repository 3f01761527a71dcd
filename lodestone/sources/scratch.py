"""The shared folder for written tables and checkpoints, which spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder of the session; a temporary one only where none is set and the master is local."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="lodestone-"))


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet and returns the written table; cuts lineage and survives a lost executor."""
    where = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.schema(df.schema).parquet(where)


def bucketed(df: DataFrame, key: str, n: int, name: str) -> DataFrame:
    """Writes df in n buckets by the hash of key and returns the written table, which joins and groups by key without a shuffle.

    df should come in n partitions by that hash, so that a bucket is one file.
    """
    spark = df.sparkSession
    own = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(n, key).option("path", f"{folder(spark)}/{own}").saveAsTable(own, format="parquet")
    written = spark.table(own)
    spark.sql(f"DROP TABLE {own}")  # only the name: the files stay, and so does the plan that reads them
    return written


#: Bytes of files for each partition of a spread table; rows in memory take about seven times as much.
PART_BYTES = 16 << 20


def parts(df: DataFrame) -> int:
    """Partitions for a shuffle of df: as the size of the files that it reads asks for, and at least the setting's number."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), sum(n for n in sizes if n < 1 << 50) // PART_BYTES)  # an unknown size is larger


def spread(df: DataFrame, *keys: str, n: int | None = None) -> DataFrame:
    """df by the hash of the keys, in so many partitions (n, else as parts says) that one doesn't grow with the table; what then groups or joins by them shuffles no more."""
    n = n or parts(df)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df.repartition(*keys)


def swap(df: DataFrame, path: str) -> None:
    """Replaces a table by df, which may read that table: written beside it first, then renamed."""
    spark = df.sparkSession
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    beside, old = f"{path.rstrip('/')}-new-{uuid.uuid4().hex}", f"{path.rstrip('/')}-old-{uuid.uuid4().hex}"
    df.write.parquet(beside)
    system = path_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(path_of(path)):
        system.rename(path_of(path), path_of(old))
    system.rename(path_of(beside), path_of(path))
    system.delete(path_of(old), True)
