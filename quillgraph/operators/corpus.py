"""Document preparation: sections, chunks, keyword units, listings, language tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T


#: Where abstract and authors stand.
ABSTRACT = r"(?is)abstract\s*:?\s*(.*?)(?=\n\s*(?:keywords|introduction|1\.|background))"
AUTHORS = r"(?is)(?:authors?|by)\s*:?\s*(.*?)(?=\n\s*(?:abstract|affiliation))"


def extract_sections(df: DataFrame, text_col: str = "text", stem_col: str | None = None) -> DataFrame:
    """Add title, abstract and authors, read from the raw text.

    The title is the first of the first ten lines with 11 to 199 characters, else the file's stem; the abstract ends at the next
    heading and at 1000 characters; the first ten authors longer than two characters are kept.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.transform(F.slice(F.split(text, "\n"), 1, 10), lambda s: F.trim(s))
    good = F.filter(lines, lambda s: F.length(s).between(11, 199))
    title = F.when(F.size(good) > 0, good[0]).otherwise(F.col(stem_col) if stem_col else F.lit(None).cast("string"))
    abstract = F.regexp_extract(text, ABSTRACT, 1)
    authors = F.regexp_extract(text, AUTHORS, 1)
    names = F.filter(F.transform(F.split(authors, r",|;| and "), lambda a: F.trim(a)), lambda a: F.length(a) > 2)
    return df.withColumns({"title": title, "abstract": F.substring(F.trim(abstract), 1, 1000), "authors": F.slice(names, 1, 10)})


def chunk_text(df: DataFrame, text_col: str = "text", size: int = 1000, overlap: int = 200) -> DataFrame:
    """One row for each chunk of ``size`` characters, each starting ``size - overlap`` after the one before."""
    if not 0 <= overlap < size:
        raise ValueError("0 <= overlap < size")
    starts = F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(size - overlap))
    rows = df.where(F.length(text_col) > 0).select("*", F.posexplode(starts).alias("chunk_no", "chunk_start"))
    return rows.withColumn("chunk", F.substring(F.col(text_col), F.col("chunk_start") + 1, F.lit(size)))


def keyword_units(df: DataFrame, terms: Sequence[str], id_col: str = "doc_id", text_col: str = "text", unit: str = "sentence", min_len: int = 20, limit: int | None = None) -> DataFrame:
    """Sentences (or whole pages) that contain any term, numbered by place; the first ``limit`` of each document."""
    parts = T.sentences(F.col(text_col), min_len) if unit == "sentence" else F.array(F.col(text_col))
    rows = df.select(id_col, F.posexplode(parts).alias("unit_no", "unit")).where(T.any_of(F.lower("unit"), [t.lower() for t in terms]))
    if limit is None:
        return rows
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(id_col).orderBy("unit_no"))).where(F.col("n") <= limit).drop("n")


def filter_min_confidence(df: DataFrame, least: float, col: str = "confidence") -> DataFrame:
    return df.where(F.col(col) >= least)


def cap_entities(mentions: DataFrame, most: int = 50, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """At most ``most`` mentions of each group, the most confident and then the first."""
    w = Window.partitionBy(*keys).orderBy(F.col("confidence").desc(), "start_pos", "end_pos", "entity_type")
    return mentions.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def list_documents(df: DataFrame, search: str | None = None, sort_by: str = "doc_id", descending: bool = True, limit: int = 50, offset: int = 0, search_col: str = "text") -> DataFrame:
    """A page of the listing, with the number of all rows found; ties are broken by id."""
    found = df.where(F.contains(F.lower(search_col), F.lit(search.lower()))) if search else df
    order = F.col(sort_by).desc() if descending else F.col(sort_by).asc()
    page = found.orderBy(order, "doc_id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(found.agg(F.count("*").alias("total"))))  # one row on the right


def document_statistics(df: DataFrame, by: str = "source") -> DataFrame:
    """Totals and mean size, overall (null group) and by group."""
    return df.groupingSets([[], [by]], by).agg(F.count("*").alias("documents"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.max("n_chars").alias("max_chars"))


def language_scores(df: DataFrame, profiles: dict[str, Sequence[str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Share of each language among a text's stop words: (id, lang, score); texts without any are absent."""
    rows = [(w, lang) for lang, ws in profiles.items() for w in ws]
    table = df.sparkSession.createDataFrame(rows, "word string, lang string")
    found = df.select(id_col, F.explode(F.split(F.lower(text_col), r"[^\p{L}]+")).alias("word")).join(F.broadcast(table), "word")
    counted = found.groupBy(id_col, "lang").agg(F.count("*").alias("n"))
    return counted.withColumn("score", F.col("n") / F.sum("n").over(Window.partitionBy(id_col))).drop("n")


def pick_language(scores: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", default: str = "en") -> DataFrame:
    """The best language above the threshold, else the default, with the five best."""
    top = F.slice(F.sort_array(F.collect_list(F.struct(F.col("score"), F.col("lang"))), asc=False), 1, 5)
    rows = scores.groupBy(id_col).agg(top.alias("top"))
    return rows.select(id_col, F.when(F.col("top")[0]["score"] > threshold, F.col("top")[0]["lang"]).otherwise(default).alias("lang"), F.transform("top", lambda t: t["lang"]).alias("candidates"))


def label_accuracy(df: DataFrame, predicted: str, truth: str) -> DataFrame:
    """Share of correct labels overall (null) and by true label."""
    return df.rollup(truth).agg(F.count("*").alias("n"), F.avg(F.when(F.col(predicted) == F.col(truth), 1.0).otherwise(0.0)).alias("accuracy"))


def with_chinese_script(lang: Column, text: Column, traditional: str) -> Column:
    """``zh`` becomes ``zh-TW`` where a traditional character occurs, else ``zh-CN``."""
    return F.when(lang != "zh", lang).when(text.rlike(f"[{traditional}]"), "zh-TW").otherwise("zh-CN")
