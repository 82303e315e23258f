"""Fixtures with known results, in place of the SQL comparison of ``tests/test_queries.py``."""

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.operators import changes, confidence, corpus, extract, graph, retrieve, telemetry

TEXT = "Glucose levels are associated with diabetes. The glycolysis pathway produces pyruvate from glucose. Creatinine serves as a biomarker for kidney function."


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_ids_ignore_case_and_keep_type_and_direction(spark):
    a, b, c = (one(spark, T.node_id(F.lit(k), F.lit(t))) for k, t in (("metabolite", "Glucose"), ("metabolite", " glucose "), ("disease", "glucose")))
    assert a == b != c and len(a) == 16
    x, y = (one(spark, T.edge_id(F.lit(s), F.lit(d), F.lit("r"))) for s, d in (("a", "b"), ("b", "a")))
    assert x != y


@pytest.mark.parametrize(("a", "b", "score"), [("a b", "B a", 1.0), ("a", "b", 0.0), ("", "", 1.0), ("glucose", "", 0.0)])
def test_jaccard_of_names(spark, a, b, score):
    assert one(spark, T.text_jaccard(F.lit(a), F.lit(b))) == score


def test_cleaning(spark):
    assert one(spark, T.clean_text(F.lit(" a \n\n\x0c bé "))) == "a b"
    assert one(spark, T.clean_text(F.lit(None).cast("string"))) == ""
    assert one(spark, T.clean_text(F.lit("abcdef"), max_chars=3)) == "abc... [TRUNCATED]"


def test_sections(spark):
    text = "x\nA study of clinical things\nAuthors: Ann Lee; Bo and Cy Dee\nAbstract: short words\n Introduction\nrest"
    row = corpus.extract_sections(spark.createDataFrame([(text,)], "text string")).first()
    assert row.title == "A study of clinical things" and row.abstract == "short words" and row.authors == ["Ann Lee", "Cy Dee"]


def test_mentions_and_relations(spark):
    df = spark.createDataFrame([(1, TEXT), (2, ""), (3, None)], "doc_id long, text string")
    found = extract.vocab_entities(df)
    assert {(m.text, m.start_pos) for m in found.collect()} >= {("Glucose", 0), ("glucose", TEXT.rindex("glucose")), ("glycolysis", TEXT.index("glycolysis"))}
    assert found.where("doc_id > 1").count() == 0
    relations = {(r.left, r.relation_type, r.right) for r in extract.pattern_relations(df).collect()}
    assert ("glycolysis", "produces", "pyruvate") in relations and ("Creatinine", "biomarker_for", "kidney") in relations
    linked = extract.link_mentions(extract.pattern_relations(df), found).collect()
    assert [(r.source.text, r.target.text) for r in linked] == [("glycolysis", "pyruvate")]


def test_stronger_overlapping_mention_wins(spark):
    rows = [(1, "fatty acid", "a", 0.8, 0, 10), (1, "fatty acid oxidation", "b", 0.8, 0, 20), (1, "acid oxidation", "c", 0.9, 6, 20), (1, "x", "d", 0.1, 30, 31)]
    df = spark.createDataFrame(rows, extract.MENTION)
    assert [m.text for m in extract.resolve_overlaps(df).orderBy("start_pos").collect()] == ["acid oxidation", "x"]


def test_merged_graphs_keep_all_documents(spark):
    m = spark.createDataFrame([(d, t, k, c, 0, 1) for d in (1, 2) for t, k, c in (("glucose", "metabolite", 0.9), ("diabetes", "disease", 0.8), ("glycolysis", "pathway", 0.85))], extract.MENTION)
    parts = [graph.build_nodes(m.where(F.col("doc_id") == d)) for d in (1, 2)]
    rows = graph.merge_graphs(*parts).collect()
    assert len(rows) == 3 and all(r.n_documents == 2 for r in rows)
    again = graph.merge_graphs(parts[1], parts[0]).collect()
    assert sorted(rows) == sorted(again)


def test_search_and_guards(spark):
    nodes = spark.createDataFrame([("node1", "clinical metabolomics", "the study of metabolites in clinical settings", "field", 0.9), ("node2", "biomarker", "a measurable indicator", "metabolite", 0.8), ("node3", "diabetes", "a metabolic disorder", "disease", 0.85)], "node_id string, text string, context string, node_type string, confidence double")
    queries = spark.createDataFrame([(1, "What is clinical metabolomics?"), (2, ""), (3, "x" * 1001), (4, "quantum gravity"), (5, None)], "query_id long, question string")
    got = {r.query_id: r for r in retrieve.answer_queries(queries, nodes).collect()}
    assert [got[k].status for k in (1, 2, 3, 4, 5)] == ["answered", "empty", "too_long", "no_hit", "empty"]
    assert got[1].confidence > 0.5 and got[2].confidence == 0
    assert got[1].answer == "clinical metabolomics is the study of metabolites in clinical settings."


def test_breadth_first_search_gives_least_depths(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(6)] + [(0, 3)], "src long, dst long")
    starts = spark.createDataFrame([(1, 0), (2, 99)], "query_id long, node_id long")
    got = {(r.query_id, r.node_id): r.depth for r in graph.traverse(starts, edges, 2).collect()}
    assert got == {(1, 0): 0, (1, 1): 1, (1, 3): 1, (1, 2): 2, (1, 4): 2, (2, 99): 0}


def test_timings(spark):
    rows = [(k, "op", k, d, k < 4) for k, d in enumerate([0.1, 0.2, 0.15, 0.3, 0.05])]
    df = spark.createDataFrame(rows, "event_id long, operation string, t long, duration double, ok boolean").withColumn("ts", F.timestamp_seconds("t"))
    m = telemetry.operation_metrics(df).first()
    assert (m.calls, m.ok, m.failed, m.least, m.most) == (5, 4, 1, 0.05, 0.3) and m["mean"] == pytest.approx(0.16)


def test_manifest_changes(spark):
    old = changes.manifest(spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, content string"))
    new = changes.manifest(spark.createDataFrame([("a", "1"), ("b", "x"), ("d", "4")], "path string, content string"))
    assert sorted(tuple(r) for r in changes.diff_manifest(old, new).collect()) == [("b", "modified"), ("c", "deleted"), ("d", "new")]


def test_snapshots(spark, tmp_path):
    for v in ("v1", "v2"):
        changes.snapshot(spark.range(3 if v == "v1" else 5), str(tmp_path), v)
    assert changes.restore(spark, str(tmp_path), "v1").count() == 3


def test_citation_ranges(spark):
    df = spark.createDataFrame([("Sources 3, 8 and 9 say, [3, 4] too\n\nSource: x",), ("Sources 9-12",), (None,)], "t string")
    assert [r.x for r in df.select(confidence.expand_citations(F.col("t")).alias("x")).collect()] == ["Source 3, Source 8, Source 9 say, [3], [4] too", "Source 9, Source 10, Source 11, Source 12", None]


def test_classification_parsing(spark):
    good = '{"query_type": "KNOWLEDGE_BASE", "confidence_score": 0.9, "reasoning": "x"}'
    rows = [(1, "text " + good, "q"), (2, good.replace("0.9", "1.9"), "latest news"), (3, "{broken", "q"), (4, None, "q"), (5, good.replace("KNOWLEDGE_BASE", "OTHER"), "q")]
    got = {r.id: (r.query_type, r.confidence, r.valid) for r in confidence.parse_classification(spark.createDataFrame(rows, "id long, j string, q string"), "id", "j", "q").collect()}
    assert got[1] == ("knowledge_base", 0.9, True) and got[2] == ("real_time", 0.3, False) and not any(got[k][2] for k in (3, 4, 5))


def test_knn_keeps_ties_in_order(spark):
    v = spark.createDataFrame([(k, [float(k % 3), 0.0]) for k in range(9)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(1, [0.0, 0.0]), (2, None)], "query_id long, vector array<float>")
    got = retrieve.knn(q, v, 4).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 3, 6, 1] and got[3].distance == 1.0
    assert retrieve.knn(q.where("false"), v, 4).count() == 0


def test_rollback_keeps_a_safety_copy(spark, tmp_path):
    said = changes.snapshot(spark.range(30).repartition(3), str(tmp_path), "v1")
    assert said["version_id"] == "v1" and said["file_count"] == 3 and said["size_bytes"] == sum(p.stat().st_size for p in tmp_path.glob("version=v1/*.parquet"))
    current = spark.range(7)
    rows, kept = changes.rollback(current, str(tmp_path), "v1")
    assert rows.count() == 30 and kept["file_count"] >= 1 and changes.restore(spark, str(tmp_path), kept["version_id"]).count() == 7
    with pytest.raises(ValueError):
        changes.rollback(current, str(tmp_path), "v1", "v1")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        changes.rollback(current, str(tmp_path), "v9")
    assert changes.snapshot(spark.range(0), str(tmp_path), "empty")["size_bytes"] >= 0


def test_vocabulary_in_one_pass_matches_one_search_a_term(spark):
    import random
    import re

    r = random.Random(3)
    words = {"a": ["amino acid", "amino", "acid", "Glu"], "b": ["glucose", "acid rain", "amino"], "c": ["b-1", ""]}
    texts = ["".join(r.choice(["amino", " ", "acid", "glucose", "GLU", "rain", "-", "b-1", "_", "x", "é", "."]) for _ in range(r.randint(0, 14))) for _ in range(400)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for whole in (True, False):
        want = set()
        for k, text in enumerate(texts):
            for kind, terms in words.items():
                for t in terms:
                    for m in re.finditer(f"(?=({re.escape(t)}))", text or "", re.IGNORECASE) if t else ():
                        beside = [text[m.start() - 1 : m.start()], text[m.end(1) : m.end(1) + 1]]
                        if not whole or not any(c and c.isalnum() for c in beside):
                            want.add((k, m[1], kind, m.start(1), m.end(1)))
        got = extract.vocab_entities(df, words, whole).collect()
        assert {(x.doc_id, x.text, x.entity_type, x.start_pos, x.end_pos) for x in got} == want and len(got) == len(want)
