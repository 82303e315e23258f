"""Queries of graphs as sets: merge, upsert, statistics and incremental refresh."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import extract, graphsets
from quillgraph.plans.corpus_queries import MENTIONS, TOKEN_TYPES, mentions_of
from quillgraph.plans.registry import query, table
from quillgraph.runtime import materialise, scratch_path
from quillgraph.streaming import refresh

WINDOW = 10
#: Two graphs: of the documents whose id modulo 3 is not 2, and of those where it is not 0; a third of the documents are in both.
_GRAPHS = f"""
{MENTIONS},
m as (select *, md5(entity_type || ':' || text)[1:16] item_id from mentions),
g as (select 0 g, * from m where doc_id % 3 <> 2 union all select 1, * from m where doc_id % 3 <> 0),
near as materialized (select *, start_pos // {WINDOW} k from m union all select *, start_pos // {WINDOW} + 1 from m),
rel as (
  select a.doc_id, a.item_id src, b.item_id dst, greatest(0.3, 0.7 - (b.start_pos - a.start_pos) / {WINDOW} * 0.4) confidence,
    a.text || ' ' || (b.start_pos - a.start_pos) || ' ' || b.text evidence
  from near a join m b on a.doc_id = b.doc_id and b.start_pos // {WINDOW} = a.k
  where a.item_id <> b.item_id and b.start_pos > a.start_pos and b.start_pos - a.start_pos <= {WINDOW}
),
gr as (select 0 g, * from rel where doc_id % 3 <> 2 union all select 1, * from rel where doc_id % 3 <> 0)
"""


def _mentions(spark, sf_dir):
    place = F.concat_ws(":", F.col("doc_id").cast("string"), F.col("start_pos").cast("string"))
    return mentions_of(spark, sf_dir).withColumn("properties", F.create_map(F.lit("at"), place))


def _relations(mentions):
    pairs = extract.cooccurrence(mentions, WINDOW)
    a, b = T.node_id(F.col("a_entity_type"), F.col("a_text")), T.node_id(F.col("b_entity_type"), F.col("b_text"))
    evidence = F.concat_ws(" ", "a_text", (F.col("b_start_pos") - F.col("a_start_pos")).cast("string"), "b_text")
    rows = pairs.select("doc_id", a.alias("src"), b.alias("dst"), F.lit("co_occurs_with").alias("edge_type"), "confidence", evidence.alias("evidence"))
    return rows.where("src <> dst")


def _graphs(spark, sf_dir):
    m = _mentions(spark, sf_dir)
    r = _relations(m)
    return [graphsets.build(m.where(F.col("doc_id") % 3 != k), r.where(F.col("doc_id") % 3 != k)) for k in (2, 0)]


@query(
    f"with {_GRAPHS} select item_id, arg_min(text, (g, doc_id, start_pos)) text, max(confidence) confidence, count(*) times, count(distinct doc_id) n_documents, "
    "arg_max(doc_id || ':' || start_pos, (g, doc_id, start_pos)) last_at, arg_max(start_pos, (g, -doc_id, -start_pos))::varchar first_start from g group by item_id"
)
def merged_nodes(spark, sf_dir):
    """Nodes of two graphs that share documents."""
    nodes, _ = graphsets.described(graphsets.merge(*_graphs(spark, sf_dir)))
    return nodes.select("item_id", "text", "confidence", "times", "n_documents", F.col("properties")["at"].alias("last_at"), F.col("properties")["start_pos"].alias("first_start"))


@query(
    f"with {_GRAPHS} select md5(src || ':' || dst || ':co_occurs_with')[1:16] item_id, src, dst, round(max(confidence), 6) confidence, count(*) times, count(distinct doc_id) n_documents, count(distinct evidence) n_evidence from gr group by src, dst"
)
def merged_edges(spark, sf_dir):
    """Edges of two graphs that share documents and evidence."""
    _, edges = graphsets.described(graphsets.merge(*_graphs(spark, sf_dir)))
    return edges.select("item_id", "src", "dst", F.round("confidence", 6).alias("confidence"), "times", "n_documents", "n_evidence")


@query(f"with {_GRAPHS} select item_id, n_documents from (select item_id, count(distinct doc_id)::bigint n_documents from g group by 1)")
def merged_document_counts(spark, sf_dir):
    """Distinct documents of the nodes of two graphs from their bitmaps."""
    graphs = _graphs(spark, sf_dir)
    nodes = [g.documents.join(g.nodes.select("item_id"), "item_id", "left_semi") for g in graphs]
    return graphsets.merge_bitmaps(*(graphsets.document_bitmaps(d) for d in nodes))



@query(
    f"with {_GRAPHS}, old as (select distinct item_id id, 'node' kind from g where g = 0 and text <> 'with' union all select distinct src || dst, 'edge' from gr where g = 0 and not contains(evidence, 'with')), "
    "new as (select item_id id, 'node' kind, count(*) times from g where g = 1 group by 1 union all select src || dst, 'edge', count(*) from gr where g = 1 group by 1) "
    "select kind, count(*) filter (old.id is null) created, (sum(times) - count(*) filter (old.id is null))::bigint updated from new left join old using (id, kind) group by kind"
)
def upsert_counts(spark, sf_dir):
    """A batch of documents against a graph that never saw one of the words."""
    m = _mentions(spark, sf_dir)
    r = _relations(m)
    old = graphsets.build(m.where("doc_id % 3 <> 2 and text <> 'with'"), r.where("doc_id % 3 <> 2 and not contains(evidence, 'with')"))
    return graphsets.upsert(old, graphsets.build(m.where("doc_id % 3 <> 0"), r.where("doc_id % 3 <> 0")))[1]


@query(
    f"with {_GRAPHS}, n as (select 'g' || g graph_id, item_id, any_value(entity_type) node_type, max(confidence) confidence from g group by all), d as (select distinct 'g' || g graph_id, entity_type node_type, doc_id from g) "
    "select x.*, y.n_documents from (select graph_id, node_type, count(*) n, round(avg(confidence), 6) mean_confidence from n group by grouping sets ((graph_id), (graph_id, node_type))) x "
    "join (select graph_id, node_type, count(distinct doc_id) n_documents from d group by grouping sets ((graph_id), (graph_id, node_type))) y on x.graph_id = y.graph_id and x.node_type is not distinct from y.node_type"
)
def statistics_by_graph(spark, sf_dir):
    """Two graphs as one table of graphs, with their numbers of documents."""
    named = [(F.lit(f"g{k}").alias("graph_id"), g) for k, g in enumerate(_graphs(spark, sf_dir))]
    nodes = [g.nodes.select(name, "item_id", "node_type", "confidence") for name, g in named]
    documents = [g.documents.select(name, "item_id", "doc_id") for name, g in named]
    return graphsets.statistics(nodes[0].unionByName(nodes[1]), documents[0].unionByName(documents[1]))


def extract_tokens(docs):
    """Mentions and relations of documents by the words of the invented corpus."""
    mentions = extract.token_entities(docs.select("doc_id", "text"), TOKEN_TYPES)
    return mentions, _relations(mentions)


@query(
    "with documents as (select doc_id, case when doc_id % 10 = 5 then text || ' with this' else text end as text from (from documents) where doc_id % 10 <> 7), "
    f"{MENTIONS} select md5(entity_type || ':' || text)[1:16] item_id, text, count(*) times, count(distinct doc_id) n_documents from mentions group by all".replace("from (from documents)", "from main.documents")
)
def refreshed_graph(spark, sf_dir):
    """The corpus as files: a first version, then new, changed and deleted ones, the same batch once more, and the graph that results."""
    root, d = scratch_path(spark, "refresh"), F.col("doc_id") % 10
    docs = table(spark, sf_dir, "documents")

    def files(rows, text, day):
        return rows.select(F.col("doc_id").cast("string").alias("path"), F.lit(day).cast("timestamp").alias("modificationTime"), F.length(text).cast("long").alias("length"), F.encode(text, "UTF-8").alias("content"))

    first = files(docs.where(d != 3), F.col("text"), "2024-01-01")
    second = files(docs.where(d.isin(3, 5)), F.when(d == 5, F.concat("text", F.lit(" with this"))).otherwise(F.col("text")), "2024-01-02")
    gone = docs.where(d == 7).select(F.col("doc_id").cast("string").alias("path"), F.lit(None).cast("string").alias("file_hash"), F.lit(None).cast("timestamp").alias("last_modified"), F.lit("deleted").alias("change"))
    for source, rows, left in (("0", first, None), ("1", materialise(second, "refresh-files"), gone), ("1", second, None)):
        refresh.merge_files(spark, root, source, rows, left, extract_tokens)
    nodes, _ = graphsets.described(refresh.graph(spark, root))
    return nodes.select("item_id", "text", "times", "n_documents")
