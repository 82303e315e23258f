"""Batch retrieval: scored search, evidence, answers, triples, vector neighbours, conversations."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.runtime import materialise

#: Vectors that a task of ``knn`` holds; query vectors that it compares with them at once.
PART, BLOCK = 50_000, 256


#: Letters by which terms and node texts meet; terms are at least so long.
GRAM = 3


def semantic_search(queries: DataFrame, nodes: DataFrame, threshold: float = 0.5, k: int = 10) -> DataFrame:
    """(query_id, rank, node_id, relevance): the best nodes of each question; ties by node id.

    Questions with the same terms are asked once, and nodes with the same text and weight are scored once: the best ``k`` of such nodes are those with the
    smallest ids, and only the best ``k`` groups can hold a hit. What grows with the copies is linear: one pass over the nodes and at most ``k`` rows for each question.

    A term can only occur in texts that hold its first letters: terms and groups are joined on these, and the exact test comes after. A group that reaches the threshold holds so
    many of a question's n terms that it holds one of the rarest ``n - needed + 1``: questions and groups meet through these only, and what
    meets is counted over all terms. A frequent term brings no pairs unless nearly all terms of its question are needed. Questions without
    terms have no rows; a node of two graphs is scored twice; null texts hold no term; no rows on either side give no rows.
    """
    if threshold <= 0:
        raise ValueError("a node without any of the terms is no hit")
    questions = queries.select("query_id", F.array_sort(T.query_terms(F.col("question"))).alias("terms")).where(F.size("terms") > 0)
    questions = materialise(questions, "search-questions")
    terms = materialise(questions.select("terms").distinct().withColumn("ask", F.monotonically_increasing_id()), "search-asks")
    asked = terms.select("ask", F.size("terms").alias("n"), F.explode("terms").alias("term")).groupBy("ask", "n", "term").agg(F.count("*").alias("times"))
    asked = materialise(asked, "search-terms")
    rows = nodes.select("node_id", T.node_body(F.col("text"), F.col("context")).alias("body"), T.node_weight(F.col("node_type"), F.col("confidence")).alias("weight"))
    alike = Window.partitionBy("body", "weight").orderBy("node_id")
    rows = rows.withColumn("row", F.monotonically_increasing_id()).withColumns({"place": F.row_number().over(alike), "row": F.first("row").over(alike.rowsBetween(Window.unboundedPreceding, 0))})
    rows = materialise(rows.where(F.col("place") <= k), "search-nodes")
    groups = rows.where("place = 1").select("row", "body", "weight", F.col("node_id").alias("least_id"))
    heaviest = groups.agg(F.max("weight")).first()[0] or 1.0
    bodies = groups.groupBy("body").agg(F.min("row").alias("text_id"))
    bodies = materialise(bodies, "search-bodies")
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("body") - GRAM + 1), lambda n: F.substring(F.col("body"), n, F.lit(GRAM))))
    spread = bodies.where(F.length("body") >= GRAM).select("text_id", F.explode(grams).alias("gram"))
    words = asked.select("term", F.substring("term", 1, GRAM).alias("gram")).distinct()
    held = materialise(spread.join(words, "gram").select("text_id", "term").join(bodies, "text_id").where(F.contains("body", F.col("term"))).select("text_id", "term"), "search-held")
    spread_of = held.groupBy("term").agg(F.count("*").alias("df"))
    needed = F.greatest(F.ceil(F.lit(threshold / heaviest) * F.col("n") - 1e-9), F.lit(1))
    rare = Window.partitionBy("ask").orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    # terms that no node holds come first: they use up places, but bring no rows
    first = asked.join(spread_of, "term", "left").fillna(0, ["df"]).withColumn("before", F.coalesce(F.sum("times").over(rare), F.lit(0))).where(F.col("before") <= F.col("n") - needed)
    met = first.where("df > 0").select("ask", "term").join(held, "term").select("ask", "text_id").distinct()
    share = F.size(F.filter("terms", lambda t: F.contains(F.col("body"), t))) / F.size("terms")
    shares = met.join(terms, "ask").join(bodies, "text_id").select("ask", "body", share.alias("share"))
    scored = shares.join(groups, "body").select("ask", "row", "least_id", F.least(F.col("share") * F.col("weight"), F.lit(1.0)).alias("relevance"))
    best_groups = Window.partitionBy("ask").orderBy(F.col("relevance").desc(), "least_id")
    kept = scored.where(F.col("relevance") >= threshold).withColumn("rank", F.row_number().over(best_groups)).where(F.col("rank") <= k)
    best = Window.partitionBy("ask").orderBy(F.col("relevance").desc(), "node_id")
    hits = kept.select("ask", "row", "relevance").join(rows.select("row", "node_id"), "row").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    hits = materialise(hits.select("ask", "rank", "node_id", "relevance").join(terms, "ask"), "search-hits")
    return questions.join(hits, "terms").select("query_id", "rank", "node_id", "relevance")


def answer_confidence(hits: DataFrame, edge_counts: DataFrame, source_counts: DataFrame) -> DataFrame:
    """Mean relevance of the five best hits, more for edges (0.05 each, 0.2 at most) and sources (0.02, 0.1), at most 1."""
    base = hits.where(F.col("rank") <= 5).groupBy("query_id").agg(F.avg("relevance").alias("base"))
    rows = base.join(edge_counts, "query_id", "left").join(source_counts, "query_id", "left").fillna(0)
    total = F.col("base") + F.least(F.col("n_edges") * 0.05, F.lit(0.2)) + F.least(F.col("n_sources") * 0.02, F.lit(0.1))
    return rows.select("query_id", F.round(F.least(total, F.lit(1.0)), 6).alias("confidence"))


def template_answer(kind: Column, entities: Column, relations: Column) -> Column:
    """An extractive answer from arrays of (text, type, context, relevance) and (type, confidence, evidence)."""
    def described(e, joint):
        return F.when(F.coalesce(e["context"], F.lit("")) != "", F.concat(e["text"], F.lit(joint), e["context"])).otherwise(F.concat(e["text"], F.lit(" is a "), e["type"]))

    def pieces(rels, n, cut):
        return F.transform(F.filter(F.slice(rels, 1, n), lambda r: F.coalesce(r["evidence"], F.lit("")) != ""), lambda r: F.substring(r["evidence"], 1, cut))

    def of(words):
        return F.filter(relations, lambda r: T.any_of(F.lower(r["type"]), words))

    def joined(parts, nothing):
        whole = F.filter(parts, lambda p: p.isNotNull() & (p != ""))
        return F.when(F.size(whole) == 0, nothing).otherwise(F.concat(F.array_join(whole, ". "), F.lit(".")))

    first = F.try_element_at(entities, F.lit(1))
    strong = F.filter(F.slice(entities, 2, 2), lambda e: e["relevance"] > 0.6)
    related = F.array_join(F.transform(strong, lambda e: F.concat(e["text"], F.lit(" ("), e["type"], F.lit(")"))), ", ")
    sure = F.filter(F.slice(relations, 1, 3), lambda r: r["confidence"] > 0.6)
    key = F.array_join(pieces(sure, 3, 100), ". ")
    definition = F.array(described(first, " is "), F.when(related != "", F.concat(F.lit("It is related to "), related)), F.when(key != "", F.concat(F.lit("Key relationships include: "), key)))
    process = F.try_element_at(F.filter(entities, lambda e: e["type"].isin("pathway", "process", "mechanism")), F.lit(1))
    mechanism = F.concat(F.array(F.concat(F.lit("The mechanism involves "), process["text"]), process["context"]), pieces(of(["regulates", "activates", "inhibits", "causes", "leads_to"]), 2, 150))
    causal = F.concat(pieces(of(["causes", "leads_to", "results_in", "triggers"]), 2, 150), F.array(F.when(F.coalesce(first["context"], F.lit("")) != "", F.concat(F.lit("This relates to "), first["text"], F.lit(": "), first["context"]))))
    info = F.array_join(pieces(relations, 2, 100), ". ")
    general = F.concat(F.transform(F.slice(entities, 1, 3), lambda e: described(e, ": ")), F.array(F.when(info != "", F.concat(F.lit("Related information: "), info))))
    return (
        F.when(F.size(entities) == 0, "I couldn't find relevant information to answer your question.")
        .when(kind == "definition", joined(definition, "I couldn't find a clear definition for your query."))
        .when(kind == "mechanism", joined(mechanism, "I found some relevant information but couldn't determine the specific mechanism."))
        .when(kind == "causal", joined(causal, "I found relevant information but couldn't identify clear causal relationships."))
        .otherwise(joined(general, "I found some relevant information but couldn't formulate a comprehensive answer."))
    )


def relations_for(subjects: DataFrame, sources: dict[str, tuple[DataFrame, str, str]], limit: int = 20) -> DataFrame:
    """Triples (subject, predicate, object) of upper-cased subjects; ``limit`` of each source and subject.

    ``sources``: predicate -> (table, subject column, object column).
    """
    wanted = subjects.select(F.upper("subject").alias("subject")).distinct()
    out = None
    for predicate, (table, s, o) in sorted(sources.items()):
        rows = table.select(F.upper(s).alias("subject"), F.lit(predicate).alias("predicate"), F.col(o).cast("string").alias("object")).join(wanted, "subject").where("object is not null")
        w = Window.partitionBy("subject").orderBy("object")
        rows = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit).drop("n")
        out = rows if out is None else out.unionByName(rows)
    return out


def longest_subjects(subjects: DataFrame) -> DataFrame:
    """Subjects of a question that are not part of a longer one of it."""
    a, b = subjects.alias("a"), subjects.alias("b")
    part = (F.col("a.query_id") == F.col("b.query_id")) & (F.length("b.subject") > F.length("a.subject")) & F.contains("b.subject", F.col("a.subject"))
    return a.join(b, part, "left_anti")


#: The relation types of the literature graph.
LITERATURE_TYPES = ["associate", "cause", "compare", "cotreat", "drug_interact", "inhibit", "interact", "negative_correlate", "positive_correlate", "prevent", "stimulate", "treat"]


def literature_relations(subjects: DataFrame, triples: DataFrame, forward: int = 20, reverse: int = 100) -> DataFrame:
    """(query_id, direction, rank, source, relation_type, target, pmids): literature relations of the subjects of each question.

    Subjects (query_id, subject) that are part of a longer one of their question are dropped. A triple (source, target, relation_type,
    pmids, source_is_disease, target_is_disease) has mentions joined by ``|`` at both ends. Forward ones start at a disease that
    the subjects name, reverse ones end at one; of each question those with the most articles count, ties in the order of the
    columns. Null mentions name nothing, null lists are empty, and other relation types are left out.
    """
    wanted = longest_subjects(subjects.distinct()).select("query_id", F.upper("subject").alias("subject")).distinct()
    known = triples.where(F.col("relation_type").isin(LITERATURE_TYPES)).distinct()
    out = None
    for direction, end, limit in (("forward", "source", forward), ("reverse", "target", reverse)):
        named = known.where(F.col(f"{end}_is_disease")).withColumn("subject", F.explode(F.array_distinct(F.split(F.upper(end), r"\|"))))
        columns = ["query_id", "source", "relation_type", "target", "pmids"]
        hits = named.join(wanted, "subject").select(*columns).distinct()
        best = Window.partitionBy("query_id").orderBy(F.coalesce(F.size("pmids"), F.lit(0)).desc(), "source", "relation_type", "target", "pmids")
        hits = hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)
        hits = hits.select("query_id", F.lit(direction).alias("direction"), "rank", "source", "relation_type", "target", "pmids")
        out = hits if out is None else out.unionByName(hits)
    return out


def knowledge_sequence(relations: DataFrame) -> DataFrame:
    """(subject, predicate, object, citations) rows of a relation map (subject, relations of predicate, object and citation).

    A citation string is cut at ``|``; null and empty ones give an empty array. A subject without relations gives no row.
    """
    rows = relations.select("subject", F.explode("relations").alias("r"))
    citations = F.when(F.coalesce(F.col("r.citation"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split("r.citation", r"\|"))
    return rows.select("subject", F.col("r.predicate").alias("predicate"), F.col("r.object").alias("object"), citations.alias("citations"))


def question_entities(questions: DataFrame, extract: Callable[[Column], Column] | None = None, synonyms: Callable[[Column], Column] | None = None, union: bool = True) -> DataFrame:
    """(query_id, entity): the distinct entities of each question (query_id, question).

    The built-in ones are the question's terms. ``extract`` maps the question to an array of a caller's entities, ``synonyms`` an entity to an array
    of others; either may be built from column functions or a pandas UDF. With ``union`` they join the built-in ones, else they
    replace them. Null and empty entities are left out.
    """
    found = T.query_terms(F.col("question"))
    if extract is not None:
        own = F.coalesce(extract(F.col("question")), F.array().cast("array<string>"))
        found = F.array_union(found, own) if union else own
    rows = questions.select("query_id", F.explode(F.array_distinct(found)).alias("entity"))
    if synonyms is not None:
        more = rows.select("query_id", F.explode(synonyms(F.col("entity"))).alias("entity"))
        rows = rows.unionByName(more) if union else more
    return rows.where(F.coalesce("entity", F.lit("")) != "").distinct()


def textualize(df: DataFrame, subject: str, predicate: str, labels: dict[str, str], citations: str | None = None) -> DataFrame:
    """Wide nullable records to (subject, predicate, object text): labelled lines of what is not null; records without any are dropped.

    With ``citations``, a column of ``[a,b]`` or ``a|b``, each row has the array of its citations; null ones give an empty array.
    """
    lines = F.concat_ws("\n", *(F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{label}: "), F.col(c).cast("string"))) for c, label in labels.items()))
    cited = [] if citations is None else [parse_citations(F.col(citations)).alias("citations")]
    return df.select(F.col(subject).alias("subject"), F.lit(predicate).alias("predicate"), lines.alias("object"), *cited).where("object <> ''")


#: The kinds of records that become text, with the columns of each and the labels of their lines.
RECORD_KINDS = {
    "phenotype": {"hpo_term": "Phenotype", "frequency": "Frequency", "onset": "Onset"},
    "prevalence": {"prevalence_type": "Type", "prevalence_class": "Class", "geographic_area": "Area", "mean_value": "Mean value"},
    "organisation": {"name": "Name", "address": "Address", "country": "Country", "url": "Website"},
    "relation": {"relation": "Relation", "target": "Target", "evidence": "Evidence"},
    "literature": {"relation": "Relation", "target": "Target", "pmids": "Articles"},
}


def textualize_kinds(records: dict[str, DataFrame], subject: str = "subject", citations: str = "citations") -> DataFrame:
    """(subject, predicate, object, citations) of the tables of several kinds of records, each by its labels; columns that a table doesn't have are null."""
    out = []
    for kind, df in sorted(records.items()):
        whole = df.withColumns({c: F.lit(None).cast("string") for c in [*RECORD_KINDS[kind], citations] if c not in df.columns})
        out.append(textualize(whole, subject, kind, RECORD_KINDS[kind], citations))
    return reduce(DataFrame.unionByName, out)


def parse_citations(col: Column) -> Column:
    """``[a,b]`` or ``a|b`` as an array, brackets dropped, Orphanet codes as ORPHA."""
    parts = F.split(F.regexp_replace(F.coalesce(col, F.lit("")), r"[\[\]]", ""), r"[,|]")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(F.trim(p), "^Orphanet", "ORPHA")), lambda p: p != "")


def clean_entity_names(names: Column) -> Column:
    """Each name and, where it differs, the name with other than letters and digits as spaces."""
    return F.array_distinct(F.flatten(F.transform(names, lambda n: F.array(n, F.regexp_replace(n, "[^A-Za-z0-9]", " ")))))


def best_alias(aliases: DataFrame, entities: DataFrame) -> DataFrame:
    """Of ``|``-separated aliases prefer those that are entities of the question, then the nearest, then by name."""
    rows = aliases.select("query_id", "row_id", F.explode(F.split("aliases", r"\|")).alias("alias"), "distance")
    named = rows.join(entities.select("query_id", F.col("entity").alias("alias"), F.lit(0).alias("tier")).distinct(), ["query_id", "alias"], "left")
    return named.groupBy("query_id", "row_id").agg(F.min_by("alias", F.struct(F.coalesce("tier", F.lit(1)), "distance", "alias")).alias("alias"))


def knn(queries: DataFrame, vectors: DataFrame, k: int = 30, query_id: str = "query_id", query_vector: str = "vector", vec_id: str = "vec_id", vector: str = "embedding", part: int = PART) -> DataFrame:
    """(query_id, rank, vec_id, distance): exact nearest neighbours by L2; ties by id.

    One pass: the vectors are dealt into parts of about ``part``, and every part meets all queries, which stream past it in blocks. A part keeps its own ``k`` best
    for each query, so what is shuffled again is k rows for each query and part, not a row for each pair; nothing is collected or broadcast.
    Null vectors are neither queries nor neighbours; rows that repeat an id are vectors of that id; no rows on either side give no rows.
    """
    known = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    asked = queries.select(F.col(query_id).cast("long").alias("id"), F.col(query_vector).cast("array<double>").alias("v")).where("v is not null")
    parts = max(1, -(-known.count() // part))
    dealt = known.select(F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part"), F.lit(0).alias("side"), "id", "v")
    dealt = dealt.unionByName(asked.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.lit(1).alias("side"), "id", "v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, own, data, square = None, [], None, None, None
        for batch in batches:
            place, side = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            cuts = np.append(np.flatnonzero(np.append(True, (place[1:] != place[:-1]) | (side[1:] != side[:-1]))), len(place))
            for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if i == j:
                    continue
                if place[i] != now:
                    now, held, own = place[i], [], None
                rows = batch.column(2).slice(i, j - i).to_numpy(zero_copy_only=False), np.stack(batch.column(3).slice(i, j - i).to_numpy(zero_copy_only=False))
                if side[i] == 0:
                    held.append(rows)
                    continue
                if not held:
                    continue
                if own is None:
                    own, data = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
                    square = (data * data).sum(1)
                ids, matrix = rows
                for at in range(0, len(ids), BLOCK):
                    some = matrix[at : at + BLOCK]
                    d2 = np.maximum((some * some).sum(1)[:, None] + square[None] - 2 * some @ data.T, 0)
                    order = np.lexsort((np.broadcast_to(own, d2.shape), np.round(d2, 9)), axis=1)[:, :k]
                    n = order.shape[1]
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[at : at + BLOCK], n)), pa.array(own[order].ravel()), pa.array(np.sqrt(np.take_along_axis(d2, order, 1)).ravel())], names=["query_id", "vec_id", "distance"])

    near = dealt.repartition("part").sortWithinPartitions("part", "side").mapInArrow(run, "query_id long, vec_id long, distance double")
    w = Window.partitionBy("query_id").orderBy(F.round("distance", 6), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def number_sources(turns: DataFrame, conversation: str = "conv_id", order: tuple[str, ...] = ("turn", "rank")) -> DataFrame:
    """Running source numbers over all turns of a conversation."""
    return turns.withColumn("source_no", F.row_number().over(Window.partitionBy(conversation).orderBy(*order)))


def context_block(retrieved: DataFrame, keys: tuple[str, ...] = ("conv_id", "turn")) -> DataFrame:
    """The texts retrieved for a turn, in rank order, with blank lines between."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"])
    return retrieved.groupBy(*keys).agg(F.array_join(parts, "\n\n").alias("context"))


def conversation_history(turns: DataFrame, most: int | None = None) -> DataFrame:
    """All messages before each user turn, oldest first, as ``role: text`` lines; with ``most``, the newest so many of them.

    Null texts are empty lines. Rows of one turn are in order of role and text. No rows give no rows.
    """
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding if most is None else -most, -1)
    line = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    return turns.withColumn("history", F.array_join(F.collect_list(line).over(w), "\n")).where("role = 'user'").select("conv_id", "turn", "history")
