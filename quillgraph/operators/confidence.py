"""Evidence scoring, citations and answer fusion as grouped tables."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T

#: Weights of the seven factors of a response's confidence, and of the five of the short form.
WEIGHTS = {"entity": 0.20, "relation": 0.20, "reliability": 0.25, "connectivity": 0.15, "consistency": 0.10, "citation": 0.05, "temporal": 0.05}


def document_confidence(docs: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Per (query_id, doc): mean of entity and relation scores, more for further references (0.05 each, 0.2 at most), at most 1.

    Documents without a reference have 0.3. ``entities`` and ``relations`` are exploded to (query_id, doc, score).
    """
    e = entities.groupBy("query_id", "doc").agg(F.avg("score").alias("e"), F.count("*").alias("ne"))
    r = relations.groupBy("query_id", "doc").agg(F.avg("score").alias("r"), F.count("*").alias("nr"))
    rows = docs.join(e, ["query_id", "doc"], "left").join(r, ["query_id", "doc"], "left")
    refs = F.coalesce("ne", F.lit(0)) + F.coalesce("nr", F.lit(0))
    mean = F.when(F.col("e").isNotNull() & F.col("r").isNotNull(), (F.col("e") + F.col("r")) / 2).otherwise(F.coalesce("e", "r"))
    score = F.when(refs == 0, 0.3).otherwise(F.least(mean + F.least(0.05 * (refs - 1), F.lit(0.2)), F.lit(1.0)))
    return rows.select("query_id", "doc", F.round(score, 6).alias("confidence"), refs.cast("long").alias("n_references"))


def source_reliability(docs: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """0.3 metadata + 0.4 min(references / 10, 1) + 0.3 mean evidence score (0.5 without any)."""
    every = entities.select("query_id", "doc", "score").unionByName(relations.select("query_id", "doc", "score"))
    refs = every.groupBy("query_id", "doc").agg(F.count("*").alias("n"), F.avg("score").alias("mean"))
    rows = docs.join(refs, ["query_id", "doc"], "left")
    score = 0.3 * T.metadata_quality(F.col("doc")) + 0.4 * F.least(F.coalesce("n", F.lit(0)) / 10, F.lit(1.0)) + 0.3 * F.coalesce("mean", F.lit(0.5))
    return rows.select("query_id", "doc", F.round(score, 6).alias("reliability"))


def graph_connectivity(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Share of an answer's entities that are an end of one of its relations."""
    ends = relations.select("query_id", F.col("src").alias("entity_id")).union(relations.select("query_id", "dst")).distinct()
    rows = entities.select("query_id", "entity_id").distinct().join(ends.withColumn("hit", F.lit(1.0)), ["query_id", "entity_id"], "left")
    return rows.groupBy("query_id").agg(F.round(F.avg(F.coalesce("hit", F.lit(0.0))), 6).alias("connectivity"))


def evidence_consistency(items: DataFrame) -> DataFrame:
    """Share of items that more than one document supports; ``items`` is (query_id, item_id, doc)."""
    n = items.groupBy("query_id", "item_id").agg(F.count_distinct("doc").alias("n"))
    return n.groupBy("query_id").agg(F.round(F.avg(F.when(F.col("n") > 1, 1.0).otherwise(0.0)), 6).alias("consistency"))


def response_confidence(base: Column, factors: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """base + 0.3 e (1 - base) with e the weighted sum of the factors, at most 1."""
    e = F.least(reduce(lambda a, b: a + b, (factors[k] * w for k, w in weights.items())), F.lit(1.0))
    return F.least(base + 0.3 * e * (1 - base), F.lit(1.0))


def scored_responses(bases: DataFrame, docs: DataFrame, entities: DataFrame, relations: DataFrame, as_of_year: int) -> DataFrame:
    """(query_id, base, entity, relation, reliability, connectivity, consistency, citation, temporal, confidence, good_sources, sources) of each response.

    ``bases`` has query_id, base; ``docs`` (query_id, doc), ``entities`` (query_id, entity_id, doc, score) and ``relations`` (query_id, relation_id, src, dst, doc, score) what it
    rests on. The factors are the means of the scores, of the documents' reliability, citation quality and recency, the share of entities that a relation ends at, and the share of items with
    more than one document. A factor without evidence is 0. Every group is added up before it is joined; rows of one response may be any number.
    """
    mean = lambda df, name: df.groupBy("query_id").agg(F.avg("score").alias(name))
    reliable = source_reliability(docs, entities, relations)
    located = entities.select("query_id", "doc").distinct().withColumn("located", F.lit(True))
    each = docs.join(located, ["query_id", "doc"], "left").select("query_id", T.citation_quality(F.col("doc"), F.coalesce("located", F.lit(False))).alias("c"), T.temporal_relevance(F.col("doc"), as_of_year, T.publication_year(F.col("doc"))).alias("t"))
    # these have few decimals, so their sums are exact as decimals and means at a half are rounded up
    exact = lambda name, places: F.sum(F.col(name).cast(f"decimal(18,{places})")).cast("double") / F.count(name)
    items = entities.select("query_id", F.concat(F.lit("e"), F.col("entity_id").cast("string")).alias("item_id"), "doc").unionByName(relations.select("query_id", F.concat(F.lit("r"), F.col("relation_id").cast("string")).alias("item_id"), "doc"))
    parts = [
        mean(entities, "entity"), mean(relations, "relation"), graph_connectivity(entities, relations), evidence_consistency(items),
        reliable.groupBy("query_id").agg(exact("reliability", 6).alias("reliability"), F.count_if(F.col("reliability") >= 0.8).alias("good_sources"), F.count("*").alias("sources")),
        each.groupBy("query_id").agg(exact("c", 1).alias("citation"), exact("t", 1).alias("temporal")),
    ]
    rows = reduce(lambda a, b: a.join(b, "query_id", "left"), parts, bases.select("query_id", "base")).fillna(0)
    final = response_confidence(F.col("base"), {k: F.col(k) for k in WEIGHTS})
    return rows.select("query_id", "base", *(F.round(k, 6).alias(k) for k in WEIGHTS), F.round(final, 6).alias("confidence"), "good_sources", "sources")


def enhanced_confidence(base: Column, entity: Column, relation: Column, n_docs: Column, n_links: Column, consistency: Column) -> Column:
    """The five-factor form: 0.25, 0.25, 0.2, 0.15, 0.15 with capped counts; base + 0.3 e, at most 1."""
    e = 0.25 * entity + 0.25 * relation + 0.2 * F.least(n_docs * 0.1, F.lit(0.3)) + 0.15 * F.least(n_links * 0.05, F.lit(0.2)) + 0.15 * consistency
    return F.least(base + 0.3 * e, F.lit(1.0))


def citation_mentions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, number, first_pos): ``[n]`` markers by their first appearance; places count markers.

    A number too large for a source (beyond an int) is no marker, though it keeps its place. Null texts have none, no rows give no rows.
    """
    found = F.regexp_extract_all(F.col(text_col), F.lit(r"\[([0-9]+)\]"), 1)
    rows = df.select(id_col, F.posexplode(found).alias("pos", "number")).withColumn("number", F.col("number").try_cast("int"))
    return rows.where("number is not null").groupBy(id_col, "number").agg(F.min("pos").cast("long").alias("first_pos"))


def collapse_ranges(numbers: DataFrame, id_col: str) -> DataFrame:
    """Sorted distinct numbers as ``[1-3, 5]``: gaps and islands."""
    island = F.col("number") - F.row_number().over(Window.partitionBy(id_col).orderBy("number"))
    runs = numbers.select(id_col, "number").distinct().withColumn("g", island).groupBy(id_col, "g").agg(F.min("number").alias("a"), F.max("number").alias("b"))
    shown = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("a", shown.alias("s")))), lambda x: x["s"])
    return runs.groupBy(id_col).agg(F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]")).alias("ranges"))


def consolidate_sources(sources: DataFrame) -> DataFrame:
    """Per (id, citation): the smallest source number, to which all its source numbers map."""
    low = sources.groupBy("id", "citation").agg(F.min("number").alias("to_number"))
    return sources.join(low, ["id", "citation"]).select("id", "number", "citation", "to_number")


def bibliography(sources: DataFrame, mentions: DataFrame) -> DataFrame:
    """Distinct citations numbered from 1 by first mention, unmentioned ones last: (id, citation, entry)."""
    rows = consolidate_sources(sources).join(mentions, ["id", "number"], "left")
    first = rows.groupBy("id", "citation").agg(F.min("first_pos").alias("pos"), F.min("number").alias("n"))
    order = Window.partitionBy("id").orderBy(F.col("pos").asc_nulls_last(), "n", "citation")
    return first.select("id", "citation", F.row_number().over(order).cast("long").alias("entry"))


def citation_link(col: Column) -> Column:
    """Address of an ORPHA, OMIM or UMLS code; everything else unchanged."""
    code = F.regexp_extract(col, r":\s*(\S+)$", 1)
    return (
        F.when(col.startswith("ORPHA"), F.concat(F.lit("https://www.orpha.net/en/disease/detail/"), code))
        .when(col.startswith("OMIM"), F.concat(F.lit("https://omim.org/entry/"), code))
        .when(col.startswith("UMLS"), F.concat(F.lit("https://uts.nlm.nih.gov/uts/umls/concept/"), code))
        .otherwise(col)
    )


def record_line(record: Column) -> Column:
    """A record of ``sources.files.bibliography_records`` as one line: authors, year, title, journal, DOI and address; what is null is left out."""
    dot = lambda value, before="", after="": F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(before), value, F.lit(after)))
    return F.concat_ws(" ", dot(record["authors"]), dot(record["year"].cast("string"), "(", ")."), dot(record["title"], "", "."), dot(record["journal"], "", "."), dot(record["doi"], "https://doi.org/"), dot(record["url"]))


def linked_citations(citations: DataFrame, records: DataFrame, col: str = "citation") -> DataFrame:
    """``citations`` with ``link``: the record of a ``PMID:`` citation as a line, the address of other known codes, everything else unchanged.

    ``records`` (pmid, authors, title, journal, year, doi, url) has one row for each id; a citation whose record is not there, or has no title,
    stays as it is. Each distinct citation meets the records once, however many rows cite it.
    """
    names = [c for c in records.columns if c != "pmid"]
    wanted = citations.select(col).where(F.col(col).startswith("PMID:")).distinct().withColumn("pmid", F.trim(F.substring(col, 6, 100)))
    lines = wanted.join(records.where("title is not null"), "pmid").select(F.col(col).alias("_cited"), record_line(F.struct(*names)).alias("_line"))
    return citations.join(lines, F.col(col) == F.col("_cited"), "left").withColumn("link", F.coalesce("_line", citation_link(F.col(col)))).drop("_cited", "_line")


#: Most numbers of a range, and most digits of a number, that are spelt out; what is beyond stays as it is written.
RANGE, DIGITS = 1000, 9
#: What begins a list of sources at the end of an answer.
SOURCE_LISTS = ("Sources:", "\n\nSource:", "References:")


def _numbers(text: str) -> list[int] | None:
    """The numbers of ``3,8,9-12``; None if one of them is too long, or a range runs backwards or too far."""
    out: list[int] = []
    for part in text.replace(" ", "").strip(",").split(","):
        low, _, high = part.partition("-")
        high = high or low
        if not (low.isdecimal() and high.isdecimal()) or max(len(low), len(high)) > DIGITS or not 0 <= int(high) - int(low) < RANGE:
            return None
        out += range(int(low), int(high) + 1)
    return out


def _expand(texts: pd.Series) -> pd.Series:
    many = re.compile(r"Sources? (\d+(?:\s*(?:, and|,|-|and)\s*\d+)+)")
    bracket = re.compile(r"\[(\d+(?:\s*(?:, and|,|-|and)\s*\d+)+)\]")

    def spelt(form: str):
        def replace(m: re.Match) -> str:
            numbers = _numbers(re.sub(r",?\s*and\s*", ",", m[1]))
            return m[0] if numbers is None else ", ".join(form.format(n) for n in numbers)

        return replace

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        for end in SOURCE_LISTS:
            text = text.split(end)[0].strip()
        return bracket.sub(spelt("[{}]"), many.sub(spelt("Source {}"), text))

    return texts.map(one)


def expand_citations(text: Column) -> Column:
    """``Sources 3, 8 and 9``, ``Sources 9-12`` and ``[3, 4, 5]`` as single markers; trailing source lists are cut.

    Numbers of more than ``DIGITS`` digits, ranges of more than ``RANGE`` numbers and ranges that run backwards stay as they are. Null stays null.
    """
    return F.pandas_udf(_expand, "string")(text)


#: Ways of writing a citation, and their form in brackets.
CITATION_FORMS = [
    (r"(?i)Source (\d+)", "[$1]"),
    (r"\(([\d, -]+)\)[., ]", "[$1]."),
    (r"\(\[", "["),
    (r"\]\)", "]"),
    (r"\[\[+", "["),
    (r"\]\]+", "]"),
]


def normalize_citations(text: Column) -> Column:
    """All citations in single square brackets; null stays null."""
    for pattern, form in CITATION_FORMS:
        text = F.regexp_replace(text, pattern, form)
    return text


def parse_web_citations(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``[n]: source (Confidence: x)`` lines as rows; confidence 0.8 where none, or none that can be read, is given.

    Lines whose number is beyond an int are left out; null texts have no lines, no rows give no rows.
    """
    lines = df.select(id_col, F.explode(F.split(text_col, "\n")).alias("line"))
    found = lines.where(F.col("line").rlike(r"^\s*\[[0-9]+\]:"))
    x = F.regexp_extract("line", r"(?i)\(confidence: *([0-9.]+)\)", 1).try_cast("double")
    source = F.trim(F.regexp_replace(F.regexp_extract("line", r"^\s*\[[0-9]+\]:\s*(.*)$", 1), r"(?i)\(confidence: *[0-9.]+\)", ""))
    rows = found.select(id_col, F.regexp_extract("line", r"\[([0-9]+)\]", 1).try_cast("int").alias("number"), source.alias("source"), F.coalesce(x, F.lit(0.8)).alias("confidence"))
    return rows.where("number is not null").withColumn("is_url", F.col("source").rlike("^https?://"))


#: How a text states the confidence of the references that follow, or on which it is based; how it names a source within the text, and a score.
INLINE_SCORE = r"(?i)confidence score:\s*([0-9.]+)(?:\s*\)\s*((?:\[\d+\]\s*)+)|\s+based on\s+(\[\d+\]))"
SOURCE_MARK = r"\[Source: ([^\]]+)\]"
PLAIN_SCORE = r"\(([0-9]+\.?[0-9]*)\)"


def inline_scores(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, number, confidence): scores that a text states for references, ``confidence score: x) [n] [m]`` or ``confidence score: x based on [n]``.

    Of several scores of a reference the first counts. Scores that are no numbers, and numbers beyond an int, are left out.
    """
    spots = df.select(id_col, F.posexplode(F.regexp_extract_all(text_col, F.lit(INLINE_SCORE), F.lit(0))).alias("place", "spot"))
    scored = spots.select(id_col, "place", F.regexp_extract("spot", r"(?i)score:\s*([0-9.]+)", 1).try_cast("double").alias("confidence"), F.explode(F.regexp_extract_all("spot", F.lit(r"\[(\d+)\]"), F.lit(1))).alias("number"))
    scored = scored.withColumn("number", F.col("number").try_cast("int")).where("confidence is not null and number is not null")
    return scored.groupBy(id_col, "number").agg(F.min_by("confidence", F.struct("place", "confidence")).alias("confidence"))


def scored_references(references: DataFrame, scores: DataFrame, id_col: str) -> DataFrame:
    """``references`` (id, number, source) with their inline ``confidence`` (null: none) and the ``section`` they belong to: References or Further Reading."""
    rows = references.join(scores.select(id_col, "number", "confidence"), [id_col, "number"], "left")
    return rows.withColumn("section", F.when(F.col("confidence").isNotNull(), "References").otherwise("Further Reading"))


def number_source_marks(text: Column) -> Column:
    """(text, sources, confidence): ``[Source: x]`` marks as ``[1]``, ``[2]`` and so on, in the order of the text, with what they name.

    ``confidence`` is the mean of the scores in parentheses from 0 to 1, 0.7 without any. Null stays null.
    """
    sources = F.regexp_extract_all(text, F.lit(SOURCE_MARK), F.lit(1))
    between = F.split(text, SOURCE_MARK, -1)
    pieces = F.transform(between, lambda part, k: F.when(k == 0, part).otherwise(F.concat(F.lit("["), k.cast("string"), F.lit("]"), part)))
    scores = F.filter(F.transform(F.regexp_extract_all(text, F.lit(PLAIN_SCORE), F.lit(1)), lambda x: x.try_cast("double")), lambda x: x.between(0, 1))
    mean = F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(scores), F.lit(1))).otherwise(0.7)
    return F.when(text.isNotNull(), F.struct(F.array_join(pieces, "").alias("text"), sources.alias("sources"), mean.alias("confidence")))


def citation_locations(evidence: DataFrame) -> DataFrame:
    """Per (query_id, doc): sorted distinct pages, from the ``page`` property or ``page N`` in the text, and sections."""
    named = F.when(F.col("page").isNotNull(), F.array(F.expr("try_cast(page as int)"))).otherwise(F.array().cast("array<int>"))
    told = F.transform(F.regexp_extract_all(F.lower(F.coalesce("evidence", F.lit(""))), F.lit(r"page ([0-9]{1,6})"), 1), lambda n: n.cast("int"))
    pages = evidence.select("query_id", "doc", "section", F.explode_outer(F.concat(named, told)).alias("p"))
    # a document has few pages and sections
    return pages.groupBy("query_id", "doc").agg(F.sort_array(F.collect_set("p")).alias("pages"), F.sort_array(F.collect_set("section")).alias("sections"))


def extract_citations(docs: DataFrame, entities: DataFrame, relations: DataFrame, locations: DataFrame) -> DataFrame:
    """One citation for each distinct document that is not blank: title, year of publication (the last in its name), confidence, locations and its place by confidence."""
    known = docs.where(F.trim("doc") != "").select("query_id", "doc").distinct()
    rows = document_confidence(known, entities, relations).join(locations, ["query_id", "doc"], "left")
    order = Window.partitionBy("query_id").orderBy(F.col("confidence").desc(), "doc")
    return rows.select("query_id", "doc", T.filename_title(F.col("doc")).alias("title"), T.publication_year(F.col("doc")).alias("year"), "confidence", "pages", "sections", F.row_number().over(order).alias("place"))


def citation_statistics(citations: DataFrame) -> DataFrame:
    """Per question: citations, how many are sure, likely and neither, mean, best and worst confidence, and how many have pages, authors, a DOI.

    Columns of details that are not there count as absent ones; null confidences are in no band. No rows give no rows.
    """
    c = F.col("confidence")
    has = lambda name: F.count_if(F.size(name) > 0) if name in citations.columns else F.lit(0).cast("long")
    doi = F.count_if(F.coalesce("doi", F.lit("")) != "") if "doi" in citations.columns else F.lit(0).cast("long")
    return citations.groupBy("query_id").agg(
        F.count("*").alias("n"), F.count_if(c >= 0.8).alias("high"), F.count_if((c >= 0.6) & (c < 0.8)).alias("medium"), F.count_if(c < 0.6).alias("low"), F.round(F.avg(c), 6).alias("mean"), F.max(c).alias("best"), F.min(c).alias("worst"),
        has("pages").alias("with_pages"), has("authors").alias("with_authors"), doi.alias("with_doi"),
    )


def citation_line(citations: DataFrame, most_authors: int = 3, longest: int = 100) -> Column:
    """One citation in a line: authors (at most ``most_authors``, then et al.), year, title, journal, DOI, pages, file and level of confidence.

    What a row doesn't have is left out; columns that are not there count as null. Titles are cut at ``longest`` characters.
    """
    col = lambda name, kind: F.col(name) if name in citations.columns else F.lit(None).cast(kind)
    authors, pages, title = col("authors", "array<string>"), col("pages", "array<int>"), col("title", "string")
    named = F.when(F.size(authors) > most_authors, F.concat(F.array_join(F.slice(authors, 1, most_authors), ", "), F.lit(", et al."))).when(F.size(authors) > 0, F.array_join(authors, ", "))
    short = F.when(F.length(title) > longest, F.concat(F.substring(title, 1, longest), F.lit("..."))).otherwise(title)
    place = F.when(F.size(pages) == 1, F.concat(F.lit("p. "), F.get(pages, F.lit(0)).cast("string"))).when(F.size(pages) > 1, F.concat(F.lit("pp. "), F.get(pages, F.lit(0)).cast("string"), F.lit("-"), F.get(pages, F.size(pages) - 1).cast("string")))
    some = lambda value, before="", after="": F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(before), value, F.lit(after)))
    return F.concat_ws(". ", named, some(col("year", "int").cast("string"), "(", ")"), some(short, "*", "*"), some(col("journal", "string"), "*", "*"), some(col("doi", "string"), "DOI: "), place, some(F.regexp_extract("doc", r"([^/]*)$", 1), "(", ")"), F.concat(F.lit("[Confidence: "), T.confidence_level(F.col("confidence")), F.lit("]")))


def full_bibliography(citations: DataFrame) -> DataFrame:
    """(query_id, section, place, line): every citation's line under its section (1 primary, 2 supporting, 3 additional), the surest first, numbered over all sections.

    Rows, not one text: a question with very many citations stays many rows. ``place`` is within a question. Ties are in order of documents.
    """
    section = F.when(F.col("confidence") >= 0.8, 1).when(F.col("confidence") >= 0.6, 2).otherwise(3)
    order = Window.partitionBy("query_id").orderBy(F.col("confidence").desc(), "doc")
    return citations.select("query_id", section.alias("section"), F.row_number().over(order).alias("place"), citation_line(citations).alias("line"))


def render_bibliography(citations: DataFrame) -> DataFrame:
    """Per question: lines by section (primary, supporting, additional), most confident first."""
    section = F.when(F.col("confidence") >= 0.8, "1 Primary").when(F.col("confidence") >= 0.6, "2 Supporting").otherwise("3 Additional")
    line = F.concat_ws(". ", "title", F.col("year").cast("string"), "doc")
    item = F.struct(section.alias("s"), (-F.col("confidence")).alias("c"), "doc", line.alias("line"))
    lines = F.transform(F.array_sort(F.collect_list(item)), lambda x: F.concat(F.substring(x["s"], 3, 20), F.lit(": "), x["line"]))
    return citations.groupBy("query_id").agg(F.array_join(lines, "\n").alias("bibliography"))


def insert_markers(content: Column, high: Column, medium: Column) -> Column:
    """Markers of sure citations after the first sentence (at the end of a single one), of likely ones at the end."""
    parts = F.split(content, r"\. ")
    many = F.size(parts) > 1
    rest = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), ". ")
    first = F.when(many, F.concat(parts[0], high, F.lit(". "), rest)).otherwise(F.concat(content, high))
    return F.concat(first, medium)


def combine_responses(kb: DataFrame, web: DataFrame) -> DataFrame:
    """Fuse two answers of each question: (query_id, strategy, confidence, quality).

    A quality gap above 0.3 makes the better one primary (0.7 / 0.3), two good ones stand side by side (mean), else
    the better one is taken alone; a missing side leaves the other.
    """
    a = kb.select("query_id", F.col("quality").alias("qa"), F.col("confidence").alias("ca"))
    b = web.select("query_id", F.col("quality").alias("qb"), F.col("confidence").alias("cb"))
    rows = a.join(b, "query_id", "full_outer")
    strategy = (
        F.when(F.col("qb").isNull(), "kb_only").when(F.col("qa").isNull(), "web_only")
        .when(F.col("qa") - F.col("qb") > 0.3, "kb_primary").when(F.col("qb") - F.col("qa") > 0.3, "web_primary")
        .when((F.col("qa") > 0.7) & (F.col("qb") > 0.7), "parallel").otherwise("quality")
    )
    rows = rows.withColumn("strategy", strategy)
    s = F.col("strategy")
    better = F.when(F.col("qa") >= F.col("qb"), F.col("ca")).otherwise(F.col("cb"))
    confidence = (
        F.when(s == "kb_only", F.col("ca")).when(s == "web_only", F.col("cb")).when(s == "kb_primary", 0.7 * F.col("ca") + 0.3 * F.col("cb"))
        .when(s == "web_primary", 0.7 * F.col("cb") + 0.3 * F.col("ca")).when(s == "parallel", (F.col("ca") + F.col("cb")) / 2).otherwise(better)
    )
    return rows.select("query_id", "strategy", F.round(confidence, 6).alias("confidence"), F.round(F.greatest("qa", "qb"), 6).alias("quality"))


#: Headings of fused answers, and what an answer says if no source has one.
ADDITIONAL, KNOWLEDGE_BASE, CURRENT = "**Additional Context:**", "**Knowledge Base Context:**", "**Current Information:**"
KNOWLEDGE_RESPONSE = "**Knowledge Base Response:**"
NO_RESPONSE = "No response is available from any source."


def fuse_responses(queries: DataFrame, kb: DataFrame, web: DataFrame) -> DataFrame:
    """(query_id, strategy, content, bibliography, confidence, quality, seconds, n_citations, sources) for every query.

    ``kb`` and ``web`` have query_id, content, bibliography, quality, confidence, seconds, n_citations, a row for each query at most. The strategy is that of ``combine_responses``. A primary
    answer is followed by the other one if that is better than 0.5; two good ones stand in sections; else the better one is followed by the first 200
    characters of the other if that is better than 0.4. Bibliographies, times and citations add up. A missing side leaves the other as it is; without
    both there is a row of an error with confidence 0. Null texts are empty.
    """
    side = lambda df, c: df.select("query_id", F.struct(F.coalesce("content", F.lit("")).alias("content"), F.coalesce("bibliography", F.lit("")).alias("bibliography"), "quality", "confidence", "seconds", "n_citations").alias(c))
    decided = combine_responses(kb, web).select("query_id", "strategy", "confidence")
    rows = queries.select("query_id").distinct().join(decided, "query_id", "left").join(side(kb, "a"), "query_id", "left").join(side(web, "b"), "query_id", "left")
    s, a, b = F.coalesce("strategy", F.lit("none")), F.col("a"), F.col("b")
    web_first = (s == "web_primary") | ((s == "quality") & (b["quality"] > a["quality"]))
    first, second = F.when(web_first, b).otherwise(a), F.when(web_first, a).otherwise(b)
    more = lambda heading, text: F.concat(F.lit(f"\n\n{heading}\n"), text)
    nothing = F.lit("")
    content = (
        F.when(s == "none", NO_RESPONSE).when(s == "kb_only", a["content"]).when(s == "web_only", b["content"])
        .when(s == "kb_primary", F.concat(a["content"], F.when(b["quality"] > 0.5, more(ADDITIONAL, b["content"])).otherwise(nothing)))
        .when(s == "web_primary", F.concat(b["content"], F.when(a["quality"] > 0.5, more(KNOWLEDGE_BASE, a["content"])).otherwise(nothing)))
        .when(s == "parallel", F.concat(F.lit(f"{KNOWLEDGE_RESPONSE}\n"), a["content"], more(CURRENT, b["content"])))
        .otherwise(F.concat(first["content"], F.when(second["quality"] > 0.4, more(ADDITIONAL, F.concat(F.substring(second["content"], 1, 200), F.lit("...")))).otherwise(nothing)))
    )
    lists = F.filter(F.array(first["bibliography"], second["bibliography"]), lambda x: F.coalesce(x, F.lit("")) != "")
    quality = (
        F.when(s.isin("kb_primary", "web_primary"), 0.7 * first["quality"] + 0.3 * second["quality"]).when(s == "parallel", (a["quality"] + b["quality"]) / 2)
        .when(s == "kb_only", a["quality"]).when(s == "web_only", b["quality"]).when(s == "quality", first["quality"]).otherwise(0.0)
    )
    both = lambda c: F.coalesce(a[c], F.lit(0)) + F.coalesce(b[c], F.lit(0))
    sources = F.array_compact(F.array(F.when(first.isNotNull(), F.when(web_first, "web").otherwise("kb")), F.when(second.isNotNull(), F.when(web_first, "kb").otherwise("web"))))
    return rows.select("query_id", s.alias("strategy"), content.alias("content"), F.array_join(lists, "\n").alias("bibliography"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.round(quality, 6).alias("quality"), F.round(both("seconds"), 6).alias("seconds"), both("n_citations").cast("long").alias("n_citations"), F.array_join(sources, ",").alias("sources"))


def select_best(responses: DataFrame) -> DataFrame:
    """The answer with the largest 0.6 quality + 0.4 confidence; ties by source."""
    w = Window.partitionBy("query_id").orderBy((0.6 * F.col("quality") + 0.4 * F.col("confidence")).desc(), "source")
    return responses.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def merge_n_responses(responses: DataFrame) -> DataFrame:
    """Any number of answers of a question in one: sections by source, mean confidence, summed time, and metadata under names with their source before them.

    A question has few sources. Without a column ``metadata`` (a map) there is none in the result; of rows that repeat a source and a name the largest value counts.
    """
    parts = F.transform(F.array_sort(F.collect_list(F.struct("source", "content"))), lambda x: F.concat(F.lit("## "), x["source"], F.lit("\n"), x["content"]))
    merged = responses.groupBy("query_id").agg(F.array_join(parts, "\n\n").alias("content"), F.round(F.avg("confidence"), 2).alias("confidence"), F.round(F.sum("seconds"), 6).alias("seconds"))
    if "metadata" not in responses.columns:
        return merged
    named = responses.select("query_id", F.lower("source").alias("source"), F.explode("metadata").alias("name", "value"))
    named = named.groupBy("query_id", F.concat_ws("_", "source", "name").alias("name")).agg(F.max("value").alias("value"))
    maps = named.groupBy("query_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("metadata"))
    return merged.join(maps, "query_id", "left")


def parse_classification(df: DataFrame, id_col: str, json_col: str, query_col: str) -> DataFrame:
    """(id, query_type, confidence, valid) from the outermost ``{...}``; invalid ones fall back to keywords with 0.3."""
    found = F.from_json(F.regexp_extract(F.coalesce(json_col, F.lit("")), r"(?s)(\{.*\})", 1), "query_type string, confidence_score double, reasoning string")
    rows = df.withColumn("_c", found)
    kind = F.lower(F.col("_c.query_type"))
    valid = F.coalesce(kind.isin("knowledge_base", "real_time", "hybrid") & F.col("_c.confidence_score").between(0, 1) & F.col("_c.reasoning").isNotNull(), F.lit(False))
    return rows.select(id_col, F.when(valid, kind).otherwise(T.classify_query(F.col(query_col))).alias("query_type"), F.when(valid, F.col("_c.confidence_score")).otherwise(0.3).alias("confidence"), valid.alias("valid"))


def routing_strategy(query_type: Column, confidence: Column, high: float = 0.8) -> Column:
    """Where a question goes: one source alone if its type is sure, else that source first; both for hybrid ones. Unknown and null types begin with the knowledge base; a null confidence is not sure."""
    sure = confidence >= high
    return (
        F.when(query_type == "knowledge_base", F.when(sure, "kb_only").otherwise("kb_first"))
        .when(query_type == "real_time", F.when(sure, "web_only").otherwise("web_first"))
        .when(query_type == "hybrid", "parallel").otherwise("kb_first")
    )


def routing_metrics(log: DataFrame, by: str) -> DataFrame:
    """Per strategy or source: requests, share, success rate, mean time. Totals come from an aggregate, not a window."""
    rows = log.groupBy(by).agg(F.count("*").alias("n"), F.avg(F.col("ok").cast("double")).alias("ok"), F.avg("seconds").alias("t"))
    total = log.agg(F.count("*").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select(by, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"), F.round("ok", 6).alias("success_rate"), F.round("t", 6).alias("mean_seconds"))  # one row on the right
