"""A graph store with an append-only log of changes beside it.

A change is a row per node or edge: op (upsert or delete), what (node or edge), the row itself and a sequence
number.  Reading replays the log over the base, the last change of a key wins and a deleted node takes its edges
along.  The log is folded into a new base when it gets long or large against the base.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources import scratch
from lodestone.sources.tables import EDGE, Graph, read_store, write_store

EDGE_KEY = ["source", "target", "type"]
#: Share of the base's rows, and number of appended batches, from which on the log is folded.
RATIO, BATCHES = 0.25, 64


class RemovalMatchedNothing(ValueError):
    """A removal that names nothing that is there."""


def changes(before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """The rows of after that are new or differ (op upsert) and the keys of before that are gone (op delete, other columns null)."""
    rest = [c for c in after.columns if c not in key]
    old = before.select(*key, F.struct(*rest).alias("_old"), F.lit(True).alias("_was"))
    new = after.select(*key, F.struct(*rest).alias("_new"), F.lit(True).alias("_is"))
    both = old.join(new, key, "full").filter(~F.col("_old").eqNullSafe(F.col("_new")) | F.col("_was").isNull() | F.col("_is").isNull())
    return both.select(F.when(F.col("_is"), "upsert").otherwise("delete").alias("op"), *key, "_new.*").select("op", *after.columns)


def between(before: Graph, after: Graph) -> tuple[DataFrame, DataFrame]:
    """(changes of nodes by id, changes of edges by source, target and type)."""
    return changes(before.nodes, after.nodes, ["id"]), changes(before.edges.select(*EDGE), after.edges.select(*EDGE), EDGE_KEY)


def replayed(base: DataFrame, log: DataFrame, key: list[str]) -> DataFrame:
    """base with a log of changes (op, seq and base's columns): the last change of each key wins."""
    columns = base.columns
    last = log.groupBy(*key).agg(F.max_by(F.struct("op", *(c for c in columns if c not in key)), "seq").alias("_c"))
    kept = base.join(last.select(*key), key, "left_anti")
    put = last.filter("_c.op = 'upsert'").select(*key, "_c.*").select(columns)
    return kept.unionByName(put)


class Store:
    """A graph in a folder: base=N folders, each whole, and batches of changes of the newest base."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def _named(self, prefix: str) -> list[str]:
        return sorted(n for s in self._fs.listStatus(self._path(self.path)) if (n := s.getPath().getName()).startswith(prefix))

    def _commit(self, write, name: str) -> None:
        """Writes beside the store's folders and renames: what was torn off is never read."""
        staged = f"{self.path}/_{uuid.uuid4().hex}"
        write(staged)
        if self._fs.exists(self._path(f"{self.path}/{name}")) or not self._fs.rename(self._path(staged), self._path(f"{self.path}/{name}")):
            self._fs.delete(self._path(staged), True)
            raise ValueError(f"{name} was written by another")

    def save(self, g: Graph) -> None:
        """A new base; older bases and the log before it are removed."""
        old = self._named("base=") + self._named("log=")
        number = 1 + max((int(n.partition("=")[2].partition("-")[0]) for n in old), default=0)
        self._commit(lambda at: write_store(g, at), f"base={number:09d}")
        for name in old:
            self._fs.delete(self._path(f"{self.path}/{name}"), True)

    def base(self) -> Graph:
        names = self._named("base=")
        if not names:
            raise ValueError(f"no graph in {self.path}")
        return read_store(self.spark, f"{self.path}/{names[-1]}")

    def append(self, nodes: DataFrame, edges: DataFrame) -> None:
        """One batch of changes, see between(); its number is its place in the log."""
        base, number = self._named("base=")[-1].partition("=")[2], len(self._batches())

        def write(at: str) -> None:
            nodes.withColumn("seq", F.lit(number)).write.parquet(f"{at}/nodes")
            edges.withColumn("seq", F.lit(number)).write.parquet(f"{at}/edges")

        self._commit(write, f"log={base}-{number:06d}")

    def _batches(self) -> list[str]:
        bases = self._named("base=")
        return self._named(f"log={bases[-1].partition('=')[2]}-") if bases else []

    def load(self) -> Graph:
        """The base with its log replayed; edges of deleted nodes go."""
        g, names = self.base(), self._batches()
        if not names:
            return g
        nodes, edges = (self.spark.read.parquet(*(f"{self.path}/{n}/{kind}" for n in names)) for kind in ("nodes", "edges"))
        gone = nodes.groupBy("id").agg(F.max_by("op", "seq").alias("op")).filter("op = 'delete'").select("id")
        kept = replayed(g.edges, edges, EDGE_KEY)
        for end in ("source", "target"):
            kept = kept.join(gone.withColumnRenamed("id", end), end, "left_anti")
        return Graph(replayed(g.nodes, nodes, ["id"]), kept.select(*EDGE))

    def update(self, after: Graph, ratio: float = RATIO, batches: int = BATCHES) -> str:
        """Brings the store to `after`: a batch of changes, or a new base where that is cheaper. Returns which: none, delta or base."""
        before = self.load()
        nodes, edges = (scratch.table(c, "delta") for c in between(before, after))
        changed = nodes.count() + edges.count()
        if not changed:
            return "none"
        g = self.base()
        if changed >= ratio * (g.nodes.count() + g.edges.count()) or len(self._batches()) + 1 >= batches:
            self.save(Graph(scratch.table(after.nodes, "nodes"), scratch.table(after.edges, "edges")))
            return "base"
        self.append(nodes, edges)
        return "delta"

    def remove(self, ids: DataFrame) -> None:
        """Deletes nodes (column id) and with them their edges; raises if none of them is there."""
        g = self.load()
        hit = scratch.table(g.nodes.join(ids.select("id").distinct(), "id", "left_semi"), "removed")
        if hit.isEmpty():
            raise RemovalMatchedNothing("no node has any of the ids")
        gone = hit.select(F.lit("delete").alias("op"), "id", *(F.lit(None).cast(t).alias(c) for c, t in hit.dtypes if c != "id"))
        none = g.edges.limit(0).select(F.lit("").alias("op"), "*")
        self.append(gone.select("op", *g.nodes.columns), none)
