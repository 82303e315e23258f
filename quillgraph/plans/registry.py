"""All registered queries of the library with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that states its result."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql:
            ORACLES[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents to a graph, and all benchmark questions to their best nodes in it; ``answered_questions`` goes on to answers."""
    return answer_queries.question_hits(spark, sf_dir)


from quillgraph.plans import answer_queries, corpus_queries, graph_queries, graphset_queries, score_queries, telemetry_queries, view_queries  # noqa: E402, F401
