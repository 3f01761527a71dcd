"""Graph sources and sinks besides Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.relational import dedupe
from lodestone.sources import scratch
from lodestone.sources.tables import Graph


def edge_list(spark: SparkSession, path: str, separator: str = ",") -> Graph:
    """CSV or TSV edge list: source, target[, type[, weight]]; a header is skipped, bad weights are 1, first edge wins."""
    raw = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id())
    at = F.split("value", separator)
    part = lambda i, default: F.coalesce(F.nullif(F.trim(F.get(at, F.lit(i))), F.lit("")), F.lit(default))
    rows = raw.select(part(0, "").alias("source"), part(1, "").alias("target"), part(2, "relates").alias("type"), F.coalesce(part(3, "1").try_cast("double"), F.lit(1.0)).alias("weight"), "ord")
    rows = rows.filter("source <> '' AND target <> '' AND NOT (lower(source) IN ('source', 'from') AND lower(target) IN ('target', 'to'))")
    edges = dedupe(rows.withColumns({"confidence": F.lit(1.0), "provenance": F.lit("imported")}))
    ids = edges.select(F.explode(F.array("source", "target")).alias("id")).distinct()
    nodes = ids.select("id", F.col("id").alias("label"), F.lit("node").alias("kind"), F.lit("").alias("path"), F.lit("").alias("parent"), F.lit(True).alias("active"), F.lit(0).cast("long").alias("ord"))
    return Graph(nodes, edges)


def json_graph(spark: SparkSession, path: str) -> Graph:
    """{nodes, edges or links} documents with field aliases (name for label, relation for type)."""
    text = "string"
    node = f"struct<id:{text},label:{text},name:{text},kind:{text},path:{text},parent:{text},active:boolean>"
    edge = f"struct<source:{text},target:{text},type:{text},relation:{text},weight:double,confidence:double,provenance:{text}>"
    raw = spark.read.schema(f"nodes array<{node}>, edges array<{edge}>, links array<{edge}>").option("multiLine", True).json(path)
    n = raw.select(F.posexplode("nodes").alias("ord", "n"))
    e = raw.select(F.posexplode(F.coalesce("edges", "links")).alias("ord", "e"))
    or_else = lambda c, d: F.coalesce(c, F.lit(d))
    nodes = n.select("n.id", F.coalesce("n.label", "n.name", "n.id").alias("label"), or_else(F.col("n.kind"), "").alias("kind"), or_else(F.col("n.path"), "").alias("path"), or_else(F.col("n.parent"), "").alias("parent"), or_else(F.col("n.active"), True).alias("active"), F.col("ord").cast("long").alias("ord"))
    edges = e.select("e.source", "e.target", F.coalesce("e.type", "e.relation", F.lit("relates")).alias("type"), or_else(F.col("e.weight"), 1.0).alias("weight"), or_else(F.col("e.confidence"), 1.0).alias("confidence"), or_else(F.col("e.provenance"), "imported").alias("provenance"), F.col("ord").cast("long").alias("ord"))
    return Graph(nodes, edges)


def cypher(g: Graph) -> DataFrame:
    """Statements that create the graph, nodes first (column value, for a text sink)."""
    quoted = lambda c: F.to_json(F.struct(F.col(c).alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col(c).alias("v")))) - 6)
    nodes = g.nodes.select(F.concat(F.lit("CREATE (:Node {id: "), quoted("id"), F.lit(", label: "), quoted("label"), F.lit("});")).alias("value"))
    edges = g.edges.select(F.concat(F.lit("MATCH (a:Node {id: "), quoted("source"), F.lit("}), (b:Node {id: "), quoted("target"), F.lit("}) CREATE (a)-[:"), F.regexp_replace(F.upper("type"), "[^A-Z0-9_]", "_"), F.lit("]->(b);")).alias("value"))
    return nodes.unionByName(edges)


def safe_overwrite(df: DataFrame, path: str, ratio: float = 0.5, least: int = 25) -> None:
    """Overwrites a table unless it would shrink below a ratio of the rows now there; df may read that table."""
    spark = df.sparkSession
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        before, after = spark.read.parquet(path).count(), df.count()
        if before >= least and after < ratio * before:
            raise ValueError(f"{after} rows would replace {before}")
    scratch.swap(df, path)


def json_document(g: Graph) -> DataFrame:
    """The graph as one JSON object per node and edge (column value), in a fixed order, for a text sink or json_lines."""
    node = F.to_json(F.struct(F.lit("node").alias("record"), "id", "label", "kind", "path", "parent", "active"))
    edge = F.to_json(F.struct(F.lit("edge").alias("record"), "source", "target", "type", "weight", "confidence", "provenance"))
    nodes = g.nodes.select(F.lit(0).alias("part"), F.col("ord"), node.alias("value"))
    edges = g.edges.select(F.lit(1).alias("part"), F.col("ord"), edge.alias("value"))
    return nodes.unionByName(edges).orderBy("part", "ord", "value").select("value")


def json_lines(spark: SparkSession, path: str) -> Graph:
    """Reads what json_document wrote."""
    text = "id string, label string, kind string, path string, parent string, active boolean, source string, target string, type string, weight double, confidence double, provenance string, record string"
    raw = spark.read.text(path).select(F.from_json("value", text).alias("r"), F.monotonically_increasing_id().alias("ord")).select("r.*", "ord")
    nodes = raw.filter("record = 'node'").select("id", "label", "kind", "path", "parent", "active", "ord")
    return Graph(nodes, raw.filter("record = 'edge'").select("source", "target", "type", "weight", "confidence", "provenance", "ord"))


def graphml(g: Graph) -> DataFrame:
    """GraphML elements of nodes, then edges (column value); the frame around them is GRAPHML's."""

    def safe(c: str):
        out = F.coalesce(F.col(c).cast("string"), F.lit(""))
        for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
            out = F.replace(out, F.lit(plain), F.lit(entity))
        return out

    nodes = g.nodes.select(F.concat(F.lit('<node id="'), safe("id"), F.lit('"><data key="label">'), safe("label"), F.lit('</data><data key="kind">'), safe("kind"), F.lit("</data></node>")).alias("value"))
    edges = g.edges.select(F.concat(F.lit('<edge source="'), safe("source"), F.lit('" target="'), safe("target"), F.lit('"><data key="type">'), safe("type"), F.lit("</data></edge>")).alias("value"))
    return nodes.unionByName(edges)


GRAPHML = (
    '<graphml xmlns="http://graphml.graphdrawing.org/xmlns"><key id="label" for="node" attr.name="label" attr.type="string"/><key id="kind" for="node" attr.name="kind" attr.type="string"/>'
    '<key id="type" for="edge" attr.name="type" attr.type="string"/><graph edgedefault="directed">',
    "</graph></graphml>",
)


def load(spark: SparkSession, path: str) -> Graph:
    """Reads a graph by the suffix of its path: json, jsonl, csv, tsv, or a folder that is a store."""
    suffix = path.rstrip("/").rpartition(".")[2].lower()
    match suffix:
        case "json":
            return json_graph(spark, path)
        case "jsonl":
            return json_lines(spark, path)
        case "csv":
            return edge_list(spark, path)
        case "tsv":
            return edge_list(spark, path, "\t")
    from lodestone.sources.delta import Store

    return Store(spark, path).load()
