"""The registered queries of this subpackage: thin, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, fim, jaccard, merkle, oracles, packing, privacy, search, sharding, simhash, token_counts, toxicity, urls, warc

#: Fixed values of the URL query.
URL_RULES = [
    urls.Rule("allow", "org/"),
    urls.Rule("block", "example.org/es/"),
    urls.Rule("block", "example.org/en/1"),
    urls.Rule("allow", "com/fr/"),
    urls.Rule("block", "com/de/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.archive(_table(spark, sf_dir, "pages"), "page_id", "url", "html")
    records = warc.read_archives(manifest.repartition(max(1, manifest.count())))
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages"), "page_id", "url", URL_RULES).drop("p_block")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("word_bpe_49k.json"))
    digest = packed.tokens.select("piece_id", F.crc32("ids").alias("ids_crc32"))
    return packed.pieces.join(digest, "piece_id").select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"))


def op5_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    # most entities occur in one text only: they are protected too, from the rarest words of their texts
    found = privacy.sanitise(_table(spark, sf_dir, "documents").select("doc_id", "text"), **privacy.SINGLE_TEXTS)
    # added spans are listed by kind, then start, like the base ones
    counts = [privacy.count_of(F.col("base"), kind).alias(f"n_{kind}") for kind in privacy.KINDS]
    return found.select("doc_id", *counts, F.sha2(privacy.listed(F.col("base")), 256).alias("base_sha256"), privacy.listed(F.concat("base", F.array_sort("added"))).alias("spans"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(_table(spark, sf_dir, "documents"), "doc_id", "text", n=3, per_cent=90)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, toxicity.learn(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return search.search(docs, docs.where("doc_id % 100 = 0"), "doc_id", "text", "doc_id", "text").withColumn("score", F.round("score", 6))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.place(_table(spark, sf_dir, "documents"), "doc_id", [f"shard-{k:03d}" for k in range(64)])


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), "doc_id", "text")


#: What a leaf of the dataset manifest covers.
LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    proved = merkle.manifest(_table(spark, sf_dir, "documents"), "doc_id", "source", LEAF_COLUMNS, merkle.tampered_leaf(LEAF_COLUMNS, "doc_id", "text"))
    return proved.drop("proof")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    arranged = fim.fill_in_middle(_table(spark, sf_dir, "documents"), "doc_id", "text")
    return fim.restore(arranged).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


QUERIES = {
    "op1_warc": op1_warc,
    "op2_url_filter": op2_url_filter,
    "op3_packing": op3_packing,
    "op4_token_counts": op4_token_counts,
    "op5_private_data": op5_private_data,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_decontamination": op8_decontamination,
    "op9_search": op9_search,
    "op10_sharding": op10_sharding,
    "op11_simhash": op11_simhash,
    "op12_merkle": op12_merkle,
    "op13_fill_in_middle": op13_fill_in_middle,
}
#: The other queries rest on a tokenizer, a model, regular expressions with checks or a hash that SQL doesn't have.
ORACLES: dict[str, str] = {
    "op1_warc": oracles.ARCHIVES,
    "op6_jaccard_join": oracles.JACCARD,
    "op9_search": oracles.SEARCH,
    "op12_merkle": oracles.merkle(),
    "op13_fill_in_middle": oracles.FILL_IN_MIDDLE,
}
