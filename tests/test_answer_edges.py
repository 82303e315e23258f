"""Edges around questions: counted in blocks and chosen from the nearest, never written for each question and edge."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillgraph.operators import answers, graph, graphsets
from quillgraph.plans import registry


def test_counts_and_nearest_edges_are_those_of_edge_paths(spark, monkeypatch):
    """More queries than one block, hubs, loops, opposite edges, ties, starts without edges."""
    draw = random.Random(3)
    ends = [(f"v{int(120 * draw.random() ** 2)}", f"v{draw.randrange(150)}") for _ in range(260)] + [("v0", f"v{k}") for k in range(0, 150, 2)] + [("v3", "v3"), ("v149", "v0")]
    rows = [(f"e{k:03d}", a, b, draw.choice([0.3, 0.5, None, 0.9])) for k, (a, b) in enumerate(ends)]
    edges = spark.createDataFrame(rows, "edge_id string, src string, dst string, confidence double")
    starts = spark.createDataFrame([(q, f"v{draw.randrange(160)}") for q in range(170) for _ in range(1 + q % 3)], "query_id long, node_id string")
    monkeypatch.setattr(graph, "NUMBERED", 60)
    for depth in (1, 3):
        reached = graph.traverse(starts, edges, depth)
        paths = graph.materialise(graph.edge_paths(reached, edges, depth), "paths")
        want = {r.query_id: r["count"] for r in paths.groupBy("query_id").count().collect()}
        assert {r.query_id: r.n_edges for r in graph.count_edges(reached, edges, depth).collect()} == want and len(want) > 128
        order = Window.partitionBy("query_id").orderBy("depth", F.col("confidence").desc(), "edge_id")
        best = paths.join(edges.select("edge_id", "confidence"), "edge_id").withColumn("n", F.row_number().over(order)).where("n <= 10")
        columns = ["query_id", "n", "edge_id", "from_node", "to_node", "depth", "confidence"]
        got = graph.nearest_edges(reached, edges, depth, 10).select(columns).collect()
        assert sorted(map(str, got)) == sorted(map(str, best.select(columns).collect())) and len(got) > 1000


def test_nothing_is_written_for_each_question_and_edge(spark, monkeypatch):
    """100 questions around two hubs with 600 edges: 60,000 rows before."""
    texts = [f"alpha{k:03d}" for k in range(300)]
    mentions = spark.createDataFrame([(k % 7, t, "thing", 0.5, k, k + 1) for k, t in enumerate(["hub", "bub", *texts])], "doc_id long, text string, entity_type string, confidence double, start_pos long, end_pos long")
    node = lambda c: graphsets.T.node_id(F.lit("thing"), F.col(c))
    pairs = spark.createDataFrame([(k % 7, h, t) for k, t in enumerate(texts) for h in ("hub", "bub")], "doc_id long, a string, b string")
    relations = pairs.select("doc_id", node("a").alias("src"), node("b").alias("dst"), F.lit("causes").alias("edge_type"), F.lit(0.5).alias("confidence"), F.col("b").alias("evidence"))
    sizes = {}

    def counted(df, label):
        out = real(df, label)
        sizes[label] = max(sizes.get(label, 0), out.count())
        return out

    real = answers.materialise
    for module in (answers, graph):
        monkeypatch.setattr(module, "materialise", counted)
    questions = spark.createDataFrame([(q, f"alpha{q:03d}") for q in range(100)], "query_id long, question string")
    found = answers.answer(questions, graphsets.stored(graphsets.build(mentions, relations)), threshold=0.3).collect()
    assert len(found) == 100 and {(r.n_edges, r.n_relations, r.depth_reached) for r in found} == {(600, 10, 2)}
    # what is reached is 302 nodes for each question; edges come as 10 rows
    assert max(n for label, n in sizes.items() if label not in ("frontier",)) <= 1000, sizes


def test_edges_around_are_the_nearest_without_reaching_all_nodes(spark, monkeypatch):
    """Hubs, loops, opposite edges, ties, starts without edges, at three depths; what is written is bounded by k for each query and depth."""
    draw = random.Random(5)
    ends = [(f"v{int(120 * draw.random() ** 2)}", f"v{draw.randrange(150)}") for _ in range(90)] + [("v0", f"v{k}") for k in range(0, 150, 2)] + [("v3", "v3"), ("v149", "v0"), ("v0", "v149")]
    edges = spark.createDataFrame([(f"e{k:03d}", a, b, draw.choice([0.3, 0.5, None, 0.9])) for k, (a, b) in enumerate(ends)], "edge_id string, src string, dst string, confidence double")
    starts = spark.createDataFrame([(q, f"v{draw.randrange(160)}") for q in range(90) for _ in range(1 + q % 3)], "query_id long, node_id string")
    columns = ["query_id", "n", "edge_id", "from_node", "to_node", "depth", "confidence"]
    for depth, k in ((1, 10), (2, 10), (3, 4)):
        want = graph.nearest_edges(graph.traverse(starts, edges, depth), edges, depth, k).select(columns).collect()
        with monkeypatch.context() as patch:
            sizes, real = [], graph.materialise
            patch.setattr(graph, "materialise", lambda df, label: sizes.append((out := real(df, label)).count()) or out)
            got = graph.edges_around(starts, edges, depth, k).select(columns).collect()
        assert sorted(map(str, got)) == sorted(map(str, want)) and len({r.depth for r in got}) == depth and len(got) > 250
        assert max(sizes) <= 90 * k


def test_queries_over_parts_take_every_step(spark):
    """Answers with relations and confidences beyond the mean relevance; evidence with pieces and documents."""
    data = "/root/testdata/sf0.01"
    rows = registry.QUERIES["answer_queries"](spark, data).collect()
    assert {r.status for r in rows} == {"empty", "too_long", "no_hit", "answered"}
    found = [r for r in rows if r.status == "answered"]
    assert all(r.n_relations == 10 and r.n_documents > 5 and r.confidence > r.base_confidence for r in found)
    assert any("This relates to " in r.answer for r in found) and all("order " in r.answer for r in found if " is " not in r.answer and "This relates" not in r.answer)
    parts = registry.QUERIES["assemble_evidence"](spark, data).groupBy("part").agg(F.count("*").alias("n"), F.count("score").alias("scored"), F.min("text").alias("text")).collect()
    assert {r.part: (r.n, r.scored) for r in parts if r.part != "document"} == {"entity": (100, 100), "relation": (200, 200)}
    assert all(" | order " in r.text for r in parts if r.part == "relation") and any(r.part == "document" and r.n > 1000 for r in parts)
