"""Question batches against a graph: search, traversal, evidence, answer and confidence in one pass over all questions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import confidence, graph, graphsets, retrieve
from quillgraph.runtime import materialise

#: Answers to questions that can't be asked or find nothing.
GUARDS = {
    "empty": "Please provide a valid question.",
    "too_long": "Query too long. Maximum length is {} characters.",
    "no_graph": "No knowledge graphs available. Please ingest some documents first.",
    "no_hit": "I couldn't find relevant information to answer your question.",
}
SEEDS, EDGES, PIECES = 5, 10, 2


@dataclass(frozen=True)
class Evidence:
    """What the questions found: ``hits`` (query_id, rank, node_id, relevance), ``edges`` (query_id, n, edge_id, src, dst, edge_type, confidence, evidence),
    ``documents`` (query_id, doc_id, of) where ``of`` is hit, entity or relation, and ``counts`` (query_id, n_edges, depth_reached) if they were asked for."""

    hits: DataFrame
    edges: DataFrame
    documents: DataFrame
    counts: DataFrame | None


def gather(questions: DataFrame, knowledge: graphsets.Graph, nodes: DataFrame, threshold: float = 0.5, k: int = 10, depth: int = 2, counted: bool = True) -> Evidence:
    """The best ``k`` nodes of each question, the edges around the best five within ``depth`` hops, and the documents of both.

    Of the traversed edges those nearest to the seeds count as relations (ties: the surer, then the smaller id), ten at most, each with its first two pieces of
    evidence. Edges, evidence and documents meet the questions as rows; arrays hold no more than these limits. Unless all edges and the depth are to be ``counted``, the
    same relations are found without reaching every node within ``depth``.
    """
    hits = materialise(retrieve.semantic_search(questions, nodes, threshold, k), "answer-hits")
    seeds = hits.where(F.col("rank") <= SEEDS)
    edges = knowledge.edges.select(F.col("item_id").alias("edge_id"), "src", "dst", "edge_type", "confidence")
    if counted:
        reached = graph.traverse(seeds.select("query_id", "node_id"), edges, depth)
        # questions and edges meet in numbers and in the best of each question only, never as rows of all edges around all questions
        counts = graph.count_edges(reached, edges, depth)
        counts = counts.join(reached.groupBy("query_id").agg(F.max("depth").alias("depth_reached")), "query_id", "full_outer").fillna(0)
        chosen = graph.nearest_edges(reached, edges, depth, EDGES)
    else:
        counts, chosen = None, graph.edges_around(seeds, edges, depth, EDGES)
    chosen = materialise(chosen.select("query_id", "n", "edge_id", F.col("from_node").alias("src"), F.col("to_node").alias("dst"), "edge_type", "confidence"), "answer-relations")
    wanted = chosen.select(F.col("edge_id").alias("item_id")).distinct()
    told = knowledge.evidence.join(wanted, "item_id", "left_semi").withColumn("place", F.row_number().over(Window.partitionBy("item_id").orderBy("evidence"))).where(F.col("place") <= PIECES)
    told = told.groupBy(F.col("item_id").alias("edge_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "evidence"))), lambda x: x["evidence"]).alias("evidence"))
    relations = materialise(chosen.join(told, "edge_id", "left"), "answer-told")
    items = seeds.select("query_id", F.col("node_id").alias("item_id"), F.lit("entity").alias("of")).unionByName(chosen.select("query_id", F.col("edge_id").alias("item_id"), F.lit("relation").alias("of")))
    items = items.unionByName(hits.select("query_id", F.col("node_id").alias("item_id"), F.lit("hit").alias("of")))
    documents = items.join(knowledge.documents, "item_id").select("query_id", "doc_id", "of").distinct()
    return Evidence(hits, relations, materialise(documents, "answer-documents"), counts)


def assembled(found: Evidence, nodes: DataFrame) -> DataFrame:
    """(query_id, part, n, item, text, score): the evidence of each question as rows.

    Entities are the best five hits with text and context, relations the chosen edges with both ends and their pieces of evidence, documents those of
    entities and relations, each once, without n, text and score. However many documents there are, they are rows.
    """
    none = lambda kind: F.lit(None).cast(kind)
    seeds = found.hits.where(F.col("rank") <= SEEDS).join(nodes.select("node_id", "text", "context"), "node_id")
    entities = seeds.select("query_id", F.lit("entity").alias("part"), F.col("rank").cast("long").alias("n"), F.col("node_id").alias("item"), F.concat_ws(": ", "text", "context").alias("text"), F.col("relevance").alias("score"))
    told = F.concat_ws(" | ", F.array(F.concat_ws(" ", "src", "edge_type", "dst")), F.col("evidence"))
    relations = found.edges.select("query_id", F.lit("relation").alias("part"), F.col("n").cast("long").alias("n"), F.col("edge_id").alias("item"), told.alias("text"), F.col("confidence").alias("score"))
    used = found.documents.where(F.col("of") != "hit").select("query_id", "doc_id").distinct()
    documents = used.select("query_id", F.lit("document").alias("part"), none("long").alias("n"), F.col("doc_id").cast("string").alias("item"), none("string").alias("text"), none("double").alias("score"))
    return entities.unionByName(relations).unionByName(documents)


def answer(questions: DataFrame, knowledge: graphsets.Graph, contexts: DataFrame | None = None, max_length: int = 1000, threshold: float = 0.5, k: int = 10, depth: int = 2, counted: bool = True) -> DataFrame:
    """(query_id, status, answer, base_confidence, confidence, n_entities, n_relations, n_documents, n_edges, depth_reached) of each question.

    ``questions`` has query_id, question; ``contexts`` (item_id, context) what is known of nodes beyond their texts. The status is empty, too_long, no_graph,
    no_hit or answered; all but the last have a fixed answer and confidence 0. The base confidence is the mean relevance of the best five hits, more for
    traversed edges (0.05 each, 0.2 at most) and for documents of hits (0.02, 0.1); the final one adds the five factors of
    evidence: relevance, relations' confidence, documents of the answer, documents that entities and relations share, and ends of relations for
    each entity. Without ``counted`` the last two columns are left out; what edges add to the base confidence is known from the relations, as four edges add the most. A null question is empty; rows that repeat an id are one question with the text that comes first. No questions give no rows.
    """
    asked = questions.groupBy("query_id").agg(F.min("question").alias("question"))
    status = F.when(F.trim(F.coalesce("question", F.lit(""))) == "", "empty").when(F.length("question") > max_length, "too_long")
    if knowledge.nodes.isEmpty():
        status = F.coalesce(status, F.lit("no_graph"))
    asked = asked.withColumn("status", status)
    nodes = knowledge.nodes.withColumnRenamed("item_id", "node_id")
    nodes = nodes.withColumn("context", F.lit("")) if contexts is None else nodes.join(contexts.select(F.col("item_id").alias("node_id"), "context"), "node_id", "left")
    found = gather(asked.where("status is null").select("query_id", "question"), knowledge, nodes, threshold, k, depth, counted)
    seeds = found.hits.where(F.col("rank") <= SEEDS)
    entity = F.struct("rank", "text", F.col("node_type").alias("type"), "context", "relevance")
    entities = seeds.join(nodes.select("node_id", "text", "node_type", "context"), "node_id").groupBy("query_id").agg(F.array_sort(F.collect_list(entity)).alias("entities"), F.avg("relevance").alias("relevance"))
    relation = F.struct("n", F.col("edge_type").alias("type"), "confidence", F.get("evidence", F.lit(0)).alias("evidence"))
    ends = F.size(F.array_union(F.collect_set("src"), F.collect_set("dst")))  # of ten relations
    relations = found.edges.groupBy("query_id").agg(F.array_sort(F.collect_list(relation)).alias("relations"), F.avg("confidence").alias("sure"), ends.alias("n_ends"))
    of = lambda kind: F.max(F.when(F.col("of") == kind, 1).otherwise(0)).alias(kind)
    kinds = found.documents.groupBy("query_id", "doc_id").agg(of("hit"), of("entity"), of("relation"))
    used = (F.col("entity") + F.col("relation")) > 0
    documents = kinds.groupBy("query_id").agg(F.sum("hit").alias("n_hit_documents"), F.count_if(used).alias("n_documents"), F.count_if((F.col("entity") + F.col("relation")) == 2).alias("n_shared"))
    rows = asked.join(entities, "query_id", "left").join(relations, "query_id", "left").join(documents, "query_id", "left")
    if counted:
        rows = rows.join(found.counts, "query_id", "left")
    number = lambda c: F.coalesce(c, F.lit(0))
    n_entities, n_relations = F.greatest(F.coalesce(F.size("entities"), F.lit(0)), F.lit(0)), F.greatest(F.coalesce(F.size("relations"), F.lit(0)), F.lit(0))
    n_edges = number("n_edges") if counted else n_relations
    base = F.least(F.coalesce("relevance", F.lit(0.0)) + F.least(0.05 * n_edges, F.lit(0.2)) + F.least(0.02 * number("n_hit_documents"), F.lit(0.1)), F.lit(1.0))
    shared = F.when((n_relations > 0) & (number("n_documents") > 0), number("n_shared") / F.greatest(number("n_documents"), F.lit(1))).otherwise(0.0)
    # ends of relations for each entity, on the scale of the short form's links
    links = F.when((n_entities > 1) & (n_relations > 0), F.col("n_ends") / F.greatest(n_entities, F.lit(1)) / 0.05).otherwise(0.0)
    final = confidence.enhanced_confidence(base, F.coalesce("relevance", F.lit(0.0)), F.coalesce("sure", F.lit(0.0)), number("n_documents"), links, shared)
    none = F.array().cast("array<struct<n:int,type:string,confidence:double,evidence:string>>")
    state = F.coalesce("status", F.when(n_entities == 0, "no_hit").otherwise("answered"))
    fixed = F.create_map(*(F.lit(x) for pair in GUARDS.items() for x in (pair[0], pair[1].format(max_length))))
    text = F.when(F.col("state") == "answered", retrieve.template_answer(T.question_type(F.col("question")), F.col("entities"), F.coalesce("relations", none))).otherwise(fixed[F.col("state")])
    answered = F.col("state") == "answered"
    return rows.withColumn("state", state).select(
        "query_id",
        F.col("state").alias("status"),
        text.alias("answer"),
        F.round(F.when(answered, base).otherwise(0.0), 6).alias("base_confidence"),
        F.round(F.when(answered, final).otherwise(0.0), 6).alias("confidence"),
        n_entities.alias("n_entities"),
        n_relations.alias("n_relations"),
        number("n_documents").cast("long").alias("n_documents"),
        *((n_edges.cast("long").alias("n_edges"), number("depth_reached").alias("depth_reached")) if counted else ()),
    )
