"""SimHash near-duplicates with BK-trees.

Fingerprints of 64 bits link at RADIUS or fewer differing bits.  Equal fingerprints are one node.
The 64 bits fall into BLOCKS blocks; two fingerprints within the radius agree on at least
BLOCKS - RADIUS of them, so they meet in the shard of some combination of that many blocks.  Each
shard's fingerprints form a BK-tree: children keyed by their Hamming distance to the parent, and a
search follows only the edges within the radius of its own distance.  A shard emits the links of a
spanning forest of its linked fingerprints, never all pairs.  Components follow by
alternating large-star and small-star rounds over written tables; FEW links or less go to one task instead,
since every round's plans stay in the driver's memory for a while.

The pipeline stage (keep_one) links texts whose sets of five-word shingles have a Jaccard similarity of
SIMILAR or more, which 64 bits can't tell alone: such pairs differ by about 10 bits at 0.8, and by far more in
the tail.  First the BK-trees link fingerprints of the five-word shingles; each of these links is verified on
whole sets.  What they leave apart is found exactly: sorted in one global order, two such sets share one of
the first n - ceil(SIMILAR * n) + 1 shingles of each, so a join on these prefixes meets every pair.  In each of
ROUNDS rounds every prefix shingle links the texts that have it to one of them only, a star, and pairs that
are connected already are left out; then the pairs that are still apart are verified, so that a group of m
near copies costs m links a round and not m x m.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm import scratch
from lodestone.llm.text import lower_ascii

RADIUS = 4
BLOCKS = 6
#: Shards of more fingerprints than this are split by the finer combinations of FINE_BLOCKS blocks.
HOT = 4096
FINE_BLOCKS = 10
SEED = 42
#: Least Jaccard similarity, as a fraction, at which the pipeline stage takes two texts for copies.
SIMILAR = (4, 5)
#: Shingles found FREQUENT times or more in one of SAMPLE texts come last in the order of shingles, COMMON at
#: most. This is an order only: it keeps prefixes rare, and any order finds the same pairs.
SAMPLE, FREQUENT, COMMON = 16, 4, 200_000
#: Prefix shingles that a worker hands over at once.
ROOM = 500_000
#: Rounds of stars before the remaining pairs are met.
ROUNDS = 3
#: Links whose components one task finds at most.
FEW = 2_000_000
#: Nodes whose names are broadcast at most, to fetch their texts or sets; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _shingles(text: str | None, width: int) -> np.ndarray:
    """XXH64 values of the word shingles of a text, in its order; none for a text without words."""
    import xxhash

    w = lower_ascii(text).split()
    if not w:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*(w[i:] for i in range(width)))) if len(w) >= width else (b" ".join(w),)
    hash64 = xxhash.xxh64_intdigest
    return np.fromiter((hash64(g, SEED) for g in grams), np.uint64)


def _simhash(h: np.ndarray) -> np.uint64:
    """The bits set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits((2 * ones > len(h)).astype(np.uint8), bitorder="little").view(np.uint64)[0]


def fingerprint(text: str | None, width: int = 4) -> int:
    """SimHash of a whole text: bits set in over half of the XXH64 values of its word shingles."""
    return int(_simhash(_shingles(text, width)))


class BKTree:
    """Children keyed by integer Hamming distance to the parent."""

    def __init__(self):
        self.root: tuple[int, dict] | None = None

    def add(self, item: int) -> None:
        if self.root is None:
            self.root = (item, {})
            return
        node = self.root
        while True:
            d = (node[0] ^ item).bit_count()
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = (item, {})
                return
            node = child

    def near(self, item: int, radius: int) -> list[int]:
        """All members within the radius of item."""
        found, stack = [], [self.root] if self.root else []
        while stack:
            value, children = stack.pop()
            d = (value ^ item).bit_count()
            if d <= radius:
                found.append(value)
            if len(children) <= 2 * radius + 1:
                stack += [c for k, c in children.items() if d - radius <= k <= d + radius]
            else:
                stack += [children[k] for k in range(d - radius, d + radius + 1) if k in children]
        return found


def forest(members: list[int], radius: int) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest of the members within the radius of each other."""
    tree, root = BKTree(), {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for item in members:
        root[item] = item
        for other in tree.near(item, radius):
            a, b = find(item), find(other)
            if a != b:
                root[a] = b
                yield item, other
        tree.add(item)


def _keys(blocks: int, agree: int) -> list[str]:
    """SQL of the shard key of each combination of blocks: its number and the bits in its blocks."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    out = []
    for number, chosen in enumerate(combinations(range(blocks), agree)):
        mask = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        signed = mask - (1 << 64) if mask >= 1 << 63 else mask
        out.append(f"named_struct('c', {number}, 'v', fp & cast('{signed}' as bigint))")
    return out


def _shard_links(sharded: DataFrame, radius: int) -> DataFrame:
    """Links within shards (columns c, v, fp), reading each task's shards as sorted runs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, members = None, []

        def done() -> list[tuple[int, int]]:
            return list(forest(members, radius)) if len(members) > 1 else []

        for batch in batches:
            links: list[tuple[int, int]] = []
            for c, v, fp in zip(batch["c"].tolist(), batch["v"].tolist(), batch["fp"].tolist()):
                if (c, v) != key:
                    links += done()
                    key, members = (c, v), []
                members.append(fp & 0xFFFFFFFFFFFFFFFF)
            yield _links(links)
        yield _links(done())

    return sharded.repartition("c", "v").sortWithinPartitions("c", "v", "fp").mapInPandas(run, "a long, b long")


def _links(pairs: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame(np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64), columns=["a", "b"])


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, long) that connect all that lie within the radius.

    The pairs returned span each shard's linked groups, so components are exact; not every pair is
    returned.  Shards above HOT members are split by finer keys, which again meet every close pair.
    """
    distinct = scratch.table(fingerprints.select("fp").distinct(), "simhash-distinct")
    coarse = distinct.select("fp", F.explode(F.expr(f"array({', '.join(_keys(BLOCKS, BLOCKS - radius))})")).alias("k")).select("fp", "k.c", "k.v")
    sizes = scratch.table(coarse.groupBy("c", "v").count().filter("count > 1"), "simhash-shards")
    cold = _shard_links(coarse.join(sizes.filter(F.col("count") <= HOT).drop("count"), ["c", "v"], "left_semi"), radius)
    hot = sizes.filter(F.col("count") > HOT).drop("count")
    if hot.isEmpty():
        return cold
    crowded = coarse.join(hot, ["c", "v"], "left_semi").select("fp").distinct()
    fine = crowded.select("fp", F.explode(F.expr(f"array({', '.join(_keys(FINE_BLOCKS, FINE_BLOCKS - radius))})")).alias("k")).select("fp", "k.c", "k.v")
    return cold.unionByName(_shard_links(fine, radius))


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's component) of links a - b."""
    nodes, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = number[: len(a)], number[len(a) :], np.arange(len(nodes))
    while len(x):
        x, y = root[x], root[y]
        apart = x != y
        x, y = x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    return nodes, nodes[root]


def _components_of_few(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        links = pd.concat([*batches, _links([])])
        nodes, root = _roots(links["a"].to_numpy(np.int64), links["b"].to_numpy(np.int64))
        own = nodes != root
        yield pd.DataFrame({"node": nodes[own], "root": root[own]})

    return scratch.table(edges.coalesce(1).mapInPandas(run, "node long, root long"), "components")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each node's component, for all nodes of edges (a, b) but that node itself.

    Up to FEW links are one task's work.  Above, alternates large-star and small-star; every round is written,
    and a hub's star is spread over rows, never gathered in a group.  Ends when a round changes nothing.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = scratch.table(edges.filter("a <> b").select(low.alias("a"), high.alias("b")).distinct(), "links")
    if now.count() <= FEW:
        return _components_of_few(now)
    seen = None
    while True:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a AND b <> m").select(F.col("m").alias("a"), "b").distinct()
        large = scratch.table(large, "large-star")
        small_least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(small_least, "b").select(F.col("m").alias("a"), F.when(F.col("a") == F.col("m"), F.col("b")).otherwise(F.col("a")).alias("b"))
        now = scratch.table(small.filter("a <> b").distinct(), "small-star")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
        if mark == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
        seen = mark


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """Written table (doc_id, fp): the fingerprint of every whole text as a signed long."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fp = np.array([fingerprint(t if isinstance(t, str) else None, width) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "fp": fp})

    return scratch.table(docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInPandas(run, "doc_id long, fp long"), "simhash")


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of the component).

    docs: doc_id, text; extra columns are ignored.  Null, empty and blank texts have fingerprint zero
    and link like any other.  Repeated doc_ids give a row each; null doc_ids keep their fingerprint and
    never name a component of others (null only if all ids of a component are null).  An empty table
    gives no rows.
    """
    prints = fingerprints(docs, width)
    roots = components(links(prints, radius))
    root = F.coalesce(F.col("root"), F.col("fp"))
    least = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    rooted = scratch.table(least.join(roots, least["fp"] == roots["node"], "left").select("fp", root.alias("root"), "least"), "simhash-roots")
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    member = rooted.join(names, "root").select("fp", "component_id")
    return prints.join(member, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _node(shingles: np.ndarray) -> tuple[int, np.ndarray]:
    """(node, sorted distinct shingles): texts of equal sets have one node."""
    h = np.unique(shingles)
    return int.from_bytes(hashlib.md5(h.tobytes()).digest()[:8], "little", signed=True), h


def _common(docs: DataFrame, width: int) -> np.ndarray:
    """Sorted shingles that many texts of a sample share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                sets = [np.unique(_shingles(t, width)) for t in batch["text"].iloc[at : at + 256]]
                found, times = np.unique(np.concatenate(sets), return_counts=True)
                yield pd.DataFrame({"s": found.view(np.int64), "times": times})

    sample = docs.select("text").filter(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0)
    counts = sample.mapInPandas(run, "s long, times long").groupBy("s").agg(F.sum("times").alias("times")).filter(F.col("times") >= FREQUENT)
    found = counts.orderBy(F.desc("times"), "s").limit(COMMON).select("s").toPandas()["s"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def shingle_sets(docs: DataFrame, width: int) -> DataFrame:
    """Written table (doc_id, key, node, n, fp, prefix) of each text's set; key: the text's hash; prefix: its first shingles in the order."""
    shared = docs.sparkSession.sparkContext.broadcast(_common(docs, width))
    up, down = SIMILAR

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        common = shared.value

        def out(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["doc_id", "key", "node", "n", "fp", "prefix"]).astype({"doc_id": "Int64"})

        for batch in batches:
            rows, held = [], 0
            for doc, key, text in zip(batch["doc_id"], batch["key"], batch["text"]):
                every = _shingles(text, width)
                node, h = _node(every)
                if len(common) and len(h):
                    last = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
                    order = np.concatenate([h[~last], h[last]])
                else:
                    order = h
                prefix = order[: len(h) - -(-up * len(h) // down) + 1]
                rows.append((doc, key, node, len(h), _simhash(every).astype(np.int64), prefix.view(np.int64)))
                held += len(prefix)
                if held > ROOM:
                    yield out(rows)
                    rows, held = [], 0
            yield out(rows)

    texts = docs.selectExpr("cast(doc_id as long) doc_id", "xxhash64(text) key", "coalesce(text, '') text")
    return scratch.table(texts.mapInPandas(run, "doc_id long, key long, node long, n long, fp long, prefix array<long>"), "shingle-sets")


def _verified(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose whole sets (node, h) reach SIMILAR."""
    up, down = SIMILAR

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            keep = []
            for x, y in zip(batch["ha"], batch["hb"]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(down * both >= up * (len(x) + len(y) - both))
            yield batch.loc[keep, ["a", "b"]]

    both = pairs.join(full.select(F.col("node").alias("a"), F.col("h").alias("ha")), "a").join(full.select(F.col("node").alias("b"), F.col("h").alias("hb")), "b")
    return both.select("a", "b", "ha", "hb").mapInPandas(verify, "a long, b long")


def _only(df: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """The rows of df whose column is in the written table names."""
    return df.join(F.broadcast(names) if names.count() <= BROADCAST_ROWS else names, column, "left_semi")


class _Sets:
    """Whole shingle sets of nodes, computed from their texts when a pair first needs them."""

    def __init__(self, docs: DataFrame, slim: DataFrame, width: int):
        self.texts = docs.select("text", F.xxhash64("text").alias("key"))
        self.slim, self.width, self.full = slim, width, None

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Written table of the pairs (a, b) of a written table whose whole sets reach SIMILAR."""
        width = self.width
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
        need = scratch.table(ends, "shingle-need")
        missing = need if self.full is None else need.join(self.full.select("node"), "node", "left_anti")
        keys = scratch.table(self.slim.join(missing, "node").select("key"), "shingle-keys")

        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for at in range(0, len(batch), 256):
                    got = [_node(_shingles(t, width)) for t in batch["text"].iloc[at : at + 256]]
                    yield pd.DataFrame({"node": [g for g, _ in got], "h": [h.tobytes() for _, h in got]})

        texts = _only(self.texts, keys, "key").dropDuplicates(["key"]).select("text")
        more = scratch.table(texts.mapInPandas(whole, "node long, h binary"), "shingle-full")
        self.full = more if self.full is None else self.full.unionByName(more)
        return scratch.table(_verified(pairs, _only(self.full, need, "node")), "shingle-links")


def similar(docs: DataFrame, sets: DataFrame, width: int) -> DataFrame:
    """Links (a, b) between nodes of sets that connect all whose Jaccard similarity is SIMILAR or more.

    Every link is between two such nodes; pairs that others connect need not be among them.
    """
    up, down = SIMILAR
    slim = scratch.table(sets.groupBy("node").agg(F.min("key").alias("key"), F.min("fp").alias("fp")), "shingle-nodes")
    rows = sets.groupBy("node").agg(F.first(F.struct("n", "prefix")).alias("x")).select("node", "x.n", (F.col("x.n") - F.size("x.prefix")).alias("rest"), F.explode("x.prefix").alias("s"))
    # only nodes that share a prefix shingle with another are ever compared
    rows = scratch.table(rows.withColumn("times", F.count("*").over(Window.partitionBy("s"))).filter("times > 1").drop("times"), "shingle-rows")
    named = slim.groupBy("fp").agg(F.min("node").alias("node"))
    same = slim.join(named.withColumnRenamed("node", "b"), "fp").filter("node <> b").select(F.col("node").alias("a"), "b")
    near = links(slim.select("fp"))
    close = near.join(named.select(F.col("fp").alias("a"), F.col("node").alias("x")), "a").join(named.select(F.col("fp").alias("b"), F.col("node").alias("y")), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    whole = _Sets(docs, slim, width)
    found = whole.verified(scratch.table(same.unionByName(close), "shingle-close"))
    able = f"{up + down} * (count + greatest(resta, restb)) >= {up} * (na + nb)"  # what two sets share beyond their prefixes is at most what the longer rest holds
    sized = f"{down} * least(na, nb) >= {up} * greatest(na, nb)"
    pair = ["nodea", "nodeb", "na", "nb", "resta", "restb"]
    side = lambda x, of: of.select("s", *(F.col(c).alias(c + x) for c in ("node", "n", "rest", "root")))
    for turn in range(ROUNDS + 1):
        # what is connected stays so, hence only the rows that a round leaves apart are read by the next
        at = rows.join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node")).select("node", "n", "rest", "s", "root")
        # shingles whose nodes are all connected have nothing more to give
        one = Window.partitionBy("s")
        at = scratch.table(at.withColumn("apart", F.min("root").over(one) != F.max("root").over(one)).filter("apart").drop("apart"), "shingle-roots")
        rows = at.drop("root")
        if turn < ROUNDS:
            # a star per shingle, around the node that comes first in an order of this round's own; the shingles at which
            # a star meets a node are at most those they share, so what is passed over here is left to the end
            centre = at.groupBy("s").agg(F.min_by(F.struct("node", "n", "rest", "root"), F.xxhash64("node", F.lit(turn))).alias("c")).select("s", "c.*")
            met = side("a", at).join(side("b", centre), "s").filter(f"roota <> rootb AND {sized}")
        else:
            met = side("a", at).join(side("b", at), "s").filter(f"nodea < nodeb AND roota <> rootb AND {sized}")
        pairs = met.groupBy(*pair).count().filter(able).selectExpr("nodea a", "nodeb b")
        found = scratch.table(found.unionByName(whole.verified(scratch.table(pairs, "shingle-pairs"))), "shingle-found")
    return found


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """The documents of docs that stay: the one with the smallest doc_id, then text hash, of each component, whole rows.

    Components are linked by a shingle similarity of SIMILAR or more; texts without words are alike.
    Rows that share that doc_id are told apart by their text, so one row of a repeated row stays.
    Rows with a null doc_id stay as they are: they cannot be named as a duplicate of anything.
    """
    named = docs.filter("doc_id IS NOT NULL")
    sets = shingle_sets(named, width)
    roots = components(similar(named, sets, width)).withColumnRenamed("node", "_node")
    first = F.min(F.struct("doc_id", "key")).alias("first")
    least = sets.groupBy("node").agg(first).join(roots, F.col("node") == F.col("_node"), "left").select("first.*", F.coalesce("root", "node").alias("root"))
    keep = least.groupBy("root").agg(first).select("first.*").distinct()
    # the row itself travels as one struct, so that no column of docs can clash
    row = named.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    kept = row.join(keep, ["doc_id", "key"]).dropDuplicates(["doc_id", "key"]).select("row.*")
    return kept.unionByName(docs.filter("doc_id IS NULL"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each near-duplicate group (five-word shingles), with the columns of documents."""
    return keep_one(docs).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
