"""Citations and fused answers that no table of the test data shows."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import confidence, evaluate


def column(spark, texts, make):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    return [r.x for r in df.select("id", make(F.col("t")).alias("x")).orderBy("id").collect()]


def test_numbers_beyond_all_sources_stay_as_they_are(spark):
    huge = "9" * 5000
    texts = [f"[{huge}, 3] Sources 1, {huge}", "[1-9999999999] [2, 1-5000]", "[5-3] [3-5]", "Sources 1-2", "", None, "[1, 2]\n\nSource: [9]"]
    assert column(spark, texts, confidence.expand_citations) == [texts[0], texts[1], "[5-3] [3], [4], [5]", "Source 1, Source 2", "", None, "[1], [2]"]


def test_markers_beyond_an_int_are_no_markers(spark):
    df = spark.createDataFrame([(1, "[3] [99999999999] [3] [4]"), (2, None)], "id long, t string")
    assert sorted(tuple(r) for r in confidence.citation_mentions(df, "id", "t").collect()) == [(1, 3, 0), (1, 4, 3)]


def test_unreadable_scores_of_web_citations(spark):
    text = "[1]: a (Confidence: 1.2.3)\n[2]: b (Confidence: .)\n[3]: https://c (Confidence: 0.5)\n[99999999999]: d\n[4] e"
    df = spark.createDataFrame([(1, text), (2, None), (3, "")], "id long, t string")
    got = sorted(tuple(r) for r in confidence.parse_web_citations(df, "id", "t").collect())
    assert got == [(1, 1, "a", 0.8, False), (1, 2, "b", 0.8, False), (1, 3, "https://c", 0.5, True)]


def test_inline_scores_and_source_marks(spark):
    df = spark.createDataFrame([(1, "x (confidence score: 0.9) [1][2] y, Confidence Score: 0.4 based on [3] (confidence score: ..) [4] (confidence score: 0.1) [1]"), (2, None), (3, "none [1]")], "id long, t string")
    assert sorted(tuple(r) for r in confidence.inline_scores(df, "id", "t").collect()) == [(1, 1, 0.9), (1, 2, 0.9), (1, 3, 0.4)]
    got = column(spark, ["[Source: a b] x (0.5) [Source: a b] (1.5) (1)", "plain", "", None], confidence.number_source_marks)
    assert [(g.text, g.sources, g.confidence) if g else None for g in got] == [("[1] x (0.5) [2] (1.5) (1)", ["a b", "a b"], 0.75), ("plain", [], 0.7), ("", [], 0.7), None]


def test_bounds_that_are_no_numbers_fail(spark):
    actual = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", None)], "name string, value double")
    expected = spark.createDataFrame([("a", "yes"), ("b", ">=1"), ("c", "1"), ("d", "1")], "name string, bound string")
    assert {r.name: r.ok for r in evaluate.expected_metrics(actual, expected).collect()} == {"a": False, "b": True, "c": False, "d": False}


def test_fused_answers(spark):
    schema = "query_id long, content string, bibliography string, quality double, confidence double, seconds double, n_citations long"
    kb = spark.createDataFrame([(1, "A", "[1] a", 0.9, 0.8, 1.0, 1), (2, "A", None, 0.8, 0.6, 1.0, 0), (3, "A", "", 0.5, 0.5, 1.0, 0), (4, None, None, 0.4, 0.4, 1.0, 0)], schema)
    web = spark.createDataFrame([(1, "B", "[1] b", 0.55, 0.4, 2.0, 2), (2, "B", "b", 0.9, 0.8, 2.0, 0), (3, "B" * 300, "b", 0.6, 0.7, 2.0, 0), (5, "B", "b", 0.2, 0.3, 2.0, 0)], schema)
    rows = {r.query_id: r for r in confidence.fuse_responses(spark.range(1, 7).toDF("query_id"), kb, web).collect()}
    assert (rows[1].strategy, rows[1].content, rows[1].bibliography, rows[1].sources, rows[1].n_citations) == ("kb_primary", "A\n\n**Additional Context:**\nB", "[1] a\n[1] b", "kb,web", 3)
    assert rows[1].confidence == pytest.approx(0.7 * 0.8 + 0.3 * 0.4)
    assert rows[2].content == "**Knowledge Base Response:**\nA\n\n**Current Information:**\nB" and rows[2].confidence == pytest.approx(0.7)
    assert rows[3].content == "B" * 300 + "\n\n**Additional Context:**\nA..." and rows[3].sources == "web,kb" and rows[3].seconds == 3.0
    assert (rows[4].strategy, rows[4].content, rows[5].content) == ("kb_only", "", "B")
    assert (rows[6].strategy, rows[6].content, rows[6].confidence, rows[6].sources) == ("none", confidence.NO_RESPONSE, 0.0, "")


def test_quantiles_by_brute_force(spark):
    import random

    import numpy as np

    draw = random.Random(4)
    data = [(k, v) for k, n in (("a", 1), ("b", 2), ("c", 997), (None, 50)) for v in [draw.choice([draw.gauss(0, 1), 10.0 ** draw.randrange(300), 3.0]) for _ in range(n)]]
    df = spark.createDataFrame([*data, ("c", None), ("empty", None)], "key string, v double")
    qs = [0.0, 0.25, 0.5, 0.95, 0.99, 1.0]
    for accuracy in (10_000, 3):  # a coarse sketch has to be repaired
        got = {(r.key, r.q): r.percentile for r in evaluate.percentiles(df, ["key"], "v", qs, accuracy=accuracy).collect()}
        want = {(k, q): np.percentile([v for n, v in data if n == k], 100 * q) for k in ("a", "b", "c", None) for q in qs}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    whole = evaluate.percentiles(df, [], "v", [0.5]).first().percentile
    assert whole == pytest.approx(float(np.median([v for _, v in data])))
    assert evaluate.percentiles(df.where("false"), ["key"], "v", [0.5]).count() == 0
    nearest = {r.key: r.percentile for r in evaluate.percentiles(df, ["key"], "v", [0.95], "nearest").collect()}
    c = sorted(v for k, v in data if k == "c")
    assert nearest["c"] == c[min(int(0.95 * len(c)), len(c) - 1)]


def test_numbers_that_look_like_years(spark):
    """A number before the year is part of the title, however long."""
    names = ["study_1977_2002.txt", "study_19771_2021.pdf", "a/b_2015.pdf", "notes_7.txt", "x20190.txt"]
    docs = spark.createDataFrame([(n,) for n in names], "doc string")
    got = [tuple(r) for r in docs.select(T.filename_title(F.col("doc")), T.publication_year(F.col("doc"))).collect()]
    assert got == [("Study 1977", 2002), ("Study 19771", 2021), ("B", 2015), ("Notes 7", None), ("X20190", 2019)]


def test_means_at_a_half_are_rounded_up(spark):
    """Tenths add up exactly."""
    docs = spark.createDataFrame([(1, f"research{k}_2023" + (".pdf" if k < 41 else ".txt")) for k in range(64)], "query_id long, doc string")
    entities = spark.createDataFrame([(1, 1, f"research{k}_2023.pdf", 0.5) for k in range(7)], "query_id long, entity_id long, doc string, score double")
    relations = spark.createDataFrame([], "query_id long, relation_id long, src long, dst long, doc string, score double")
    bases = spark.createDataFrame([(1, 0.5)], "query_id long, base double")
    row = confidence.scored_responses(bases, docs, entities, relations, 2024).first()
    assert row.citation == 0.839063 and row.temporal == 1.0  # (44.8 + 8.2 + 0.7) / 64 = 0.8390625
