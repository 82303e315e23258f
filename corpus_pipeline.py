"""Corpus pipeline: toxic documents go, one of each group of near duplicates stays, documents that hold benchmark
passages go, personal data is rewritten, and what is left is packed into training sequences.

Each stage reads what its predecessor kept. The tables that are not documents (labels, benchmark) are read from the input folder.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, jaccard, packing, privacy, toxicity
from quillgraph.runtime import materialise

#: No SQL: the first stage is a trained model.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model calls toxic go; the model learns from the labels that are not held out.

    Null and empty texts stay; without labels of both classes all documents stay.
    """
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if model is None:
        return docs
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id.

    Rows without an id, and texts without words, are in no group and stay; rows that repeat an id stay or go together.
    """
    groups = jaccard.similar_documents(docs, "doc_id", "text", n=5, per_cent=80)
    others = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose texts hold a passage of the benchmark go, whatever their ids; null texts stay."""
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def hide_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are rewritten without personal data and the words that give it away; ``n_chars`` follows, and is null for a null text."""
    clean = privacy.rewrite(docs, **privacy.SINGLE_TEXTS)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences of 2048 tokens."""
    packed = packing.pack(docs, "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))
    return packed.pieces.select("doc_id", "start", "length", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("private_data", hide_private_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; each one's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
