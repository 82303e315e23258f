"""Graphs whose sets are tables: documents, evidence and properties of nodes and edges as rows, never as arrays.

A hub is mentioned in most documents; its set of documents is so many rows of a bridge table, united by ``distinct`` on
the whole pair, so no group grows with the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.runtime import materialise

NONE = "map<string,string>"


@dataclass(frozen=True)
class Graph:
    """Tables of a graph, keyed by ``item_id``, the id of a node or an edge.

    ``nodes`` (item_id, text, node_type, confidence, times), ``edges`` (item_id, src, dst, edge_type, confidence, times), where ``times``
    counts mentions or relations; ``documents`` (item_id, doc_id) and ``evidence`` (item_id, evidence) are sets; ``properties``
    (item_id, name, value, set_once) has one row for each property.
    """

    nodes: DataFrame
    edges: DataFrame
    documents: DataFrame
    evidence: DataFrame
    properties: DataFrame


def stored(graph: Graph) -> Graph:
    """The same graph as written tables, for those who read it several times."""
    return Graph(*(materialise(getattr(graph, f.name), f"graph-{f.name}") for f in fields(Graph)))


def _with_map(df: DataFrame) -> DataFrame:
    return df if "properties" in df.columns else df.withColumn("properties", F.lit(None).cast(NONE))


def build(mentions: DataFrame, relations: DataFrame) -> Graph:
    """The graph of mentions and of relations between nodes.

    ``mentions`` has doc_id, text, entity_type, confidence, start_pos, end_pos and perhaps ``properties`` (a map); ``relations`` has doc_id, src,
    dst, edge_type, confidence, evidence and perhaps ``properties``. A node takes its text, and the properties start_pos and
    end_pos, from its first mention (by document, place, text); other properties come from the last one that has them. An edge takes its properties
    from its last relation (by document, evidence). Confidence is the greatest. Null evidence is none, null values of properties are none, rows
    that repeat count as further mentions. No rows give empty tables.
    """
    m = _with_map(mentions).withColumn("item_id", T.node_id(F.col("entity_type"), F.col("text")))
    place = F.struct("doc_id", "start_pos", "text")
    nodes = m.groupBy("item_id").agg(F.min_by("text", place).alias("text"), F.min("entity_type").alias("node_type"), F.max("confidence").alias("confidence"), F.count("*").alias("times"))
    first = m.groupBy("item_id").agg(F.min(F.struct("doc_id", "start_pos", "text", "end_pos")).alias("f")).select("item_id", F.col("f.start_pos").cast("string").alias("start_pos"), F.col("f.end_pos").cast("string").alias("end_pos"))
    once = first.select("item_id", F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in ("start_pos", "end_pos")))))
    r = _with_map(relations).withColumn("item_id", T.edge_id(F.col("src"), F.col("dst"), F.col("edge_type")))
    edges = r.groupBy("item_id", "src", "dst", "edge_type").agg(F.max("confidence").alias("confidence"), F.count("*").alias("times"))
    given = m.select("item_id", F.struct("doc_id", F.col("start_pos").cast("string").alias("at")).alias("o"), F.explode("properties").alias("name", "value"))
    given = given.unionByName(r.select("item_id", F.struct("doc_id", F.coalesce("evidence", F.lit("")).alias("at")).alias("o"), F.explode("properties").alias("name", "value")))
    # places of one document are compared as numbers where they are numbers
    order = F.struct("o.doc_id", F.expr("try_cast(o.at as long)").alias("n"), "o.at", "value")
    last = given.where("value is not null").groupBy("item_id", "name").agg(F.max_by("value", order).alias("value"))
    properties = once.where("value is not null").withColumn("set_once", F.lit(True)).unionByName(last.withColumn("set_once", F.lit(False)))
    properties = properties.groupBy("item_id", "name").agg(F.min_by(F.struct("value", "set_once"), "set_once").alias("p")).select("item_id", "name", "p.value", "p.set_once")
    return Graph(
        nodes,
        edges,
        m.select("item_id", "doc_id").unionByName(r.select("item_id", "doc_id")).where("doc_id is not null").distinct(),
        r.select("item_id", "evidence").where("evidence is not null").distinct(),
        properties,
    )


def _numbered(graphs: tuple[Graph, ...], table: str) -> DataFrame:
    parts = (getattr(g, table).withColumn("g", F.lit(k)) for k, g in enumerate(graphs))
    return reduce(DataFrame.unionByName, parts)


def merge(*graphs: Graph) -> Graph:
    """The union of graphs: greatest confidence, texts of the first graph that has a node, sets united, properties of the last graph that has them.

    A document, or a piece of evidence, that several graphs hold counts once.
    """
    nodes = _numbered(graphs, "nodes").groupBy("item_id").agg(F.min_by("text", "g").alias("text"), F.min_by("node_type", "g").alias("node_type"), F.max("confidence").alias("confidence"), F.sum("times").alias("times"))
    edges = _numbered(graphs, "edges").groupBy("item_id", "src", "dst", "edge_type").agg(F.max("confidence").alias("confidence"), F.sum("times").alias("times"))
    properties = _numbered(graphs, "properties").groupBy("item_id", "name").agg(F.max_by(F.struct("value", "set_once"), "g").alias("p"))
    return Graph(
        nodes,
        edges,
        _numbered(graphs, "documents").drop("g").distinct(),
        _numbered(graphs, "evidence").drop("g").distinct(),
        properties.select("item_id", "name", "p.value", "p.set_once"),
    )


def upsert(existing: Graph, batch: Graph) -> tuple[Graph, DataFrame]:
    """A batch added to a stored graph, and (kind, created, updated) for nodes and edges.

    Unlike in ``merge``, properties that are set once (places of the first mention) stay as the stored graph has them. Each mention of the batch that
    doesn't create its node is an update of it.
    """
    merged = merge(existing, batch)
    keep = existing.properties.where("set_once").select("item_id", "name", F.col("value").alias("was"))
    properties = merged.properties.join(keep, ["item_id", "name"], "left")
    stays = F.col("set_once") & F.col("was").isNotNull()
    properties = properties.select("item_id", "name", F.when(stays, F.col("was")).otherwise(F.col("value")).alias("value"), "set_once")

    def counted(kind: str, old: DataFrame, new: DataFrame) -> DataFrame:
        created = F.count_if(F.col("known").isNull())
        rows = new.select("item_id", "times").join(old.select("item_id", F.lit(True).alias("known")), "item_id", "left")
        return rows.agg(F.lit(kind).alias("kind"), created.alias("created"), (F.coalesce(F.sum("times"), F.lit(0)) - created).alias("updated"))

    counts = counted("node", existing.nodes, batch.nodes).unionByName(counted("edge", existing.edges, batch.edges))
    return Graph(merged.nodes, merged.edges, merged.documents, merged.evidence, properties), counts


def described(graph: Graph) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with their numbers of documents, edges with their number of pieces of evidence, both with their properties as a map.

    A map has one entry for each name, whatever the number of mentions.
    """
    documents = graph.documents.groupBy("item_id").agg(F.count("*").alias("n_documents"))
    evidence = graph.evidence.groupBy("item_id").agg(F.count("*").alias("n_evidence"))
    properties = graph.properties.groupBy("item_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("properties"))

    def whole(items: DataFrame, *more: DataFrame) -> DataFrame:
        for table in (documents, *more):
            items = items.join(table, "item_id", "left").fillna(0)
        return items.join(properties, "item_id", "left")

    return whole(graph.nodes), whole(graph.edges, evidence)


def statistics(graphs: DataFrame, documents: DataFrame) -> DataFrame:
    """(graph_id, node_type, n, mean_confidence, n_documents) by graph and type, and for each graph as a whole (null type).

    ``graphs`` has graph_id, item_id, node_type, confidence; ``documents`` has graph_id, item_id, doc_id. A document counts once for a graph, and once for a type.
    """
    rows = graphs.groupingSets([["graph_id"], ["graph_id", "node_type"]], "graph_id", "node_type").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    typed = documents.join(graphs.select("graph_id", "item_id", "node_type"), ["graph_id", "item_id"])
    both = F.explode(F.array(F.col("node_type"), F.lit(None).cast("string"))).alias("node_type")
    seen = typed.select("graph_id", "doc_id", both).distinct().groupBy("graph_id", F.col("node_type").alias("t")).agg(F.count("*").alias("n_documents"))
    found = rows.join(seen.withColumnRenamed("graph_id", "h"), (F.col("graph_id") == F.col("h")) & F.col("node_type").eqNullSafe(F.col("t")), "left")
    return found.select("graph_id", "node_type", "n", "mean_confidence", F.coalesce("n_documents", F.lit(0)).alias("n_documents"))


def document_bitmaps(documents: DataFrame, number: str = "doc_id") -> DataFrame:
    """(item_id, bucket, bits): the documents of each item as bitmaps of 32,768 numbers; ``number`` is a whole number from 0 on."""
    rows = documents.select("item_id", F.bitmap_bucket_number(number).alias("bucket"), F.bitmap_bit_position(number).alias("bit"))
    return rows.groupBy("item_id", "bucket").agg(F.bitmap_construct_agg("bit").alias("bits"))


def merge_bitmaps(*tables: DataFrame) -> DataFrame:
    """(item_id, n_documents) over several graphs from their bitmaps alone, without their bridge tables."""
    rows = reduce(DataFrame.unionByName, tables).groupBy("item_id", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    return rows.groupBy("item_id").agg(F.sum(F.bitmap_count("bits")).alias("n_documents"))
