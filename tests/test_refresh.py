"""Graphs as sets, and their incremental refresh from a directory."""

import os
import time

import pytest
from pyspark.sql import functions as F

from quillgraph.operators import extract, graphsets
from quillgraph.plans import registry
from quillgraph.streaming import jobs, refresh

extract_tokens = registry.graphset_queries.extract_tokens
MENTION = extract.MENTION + ", properties map<string,string>"
RELATION = "doc_id long, src string, dst string, edge_type string, confidence double, evidence string, properties map<string,string>"


def one_document(spark, doc, at, seen=None):
    """The three mentions and two relations of the fixture, from one document."""
    kinds = [("glucose", "metabolite", 0.9), ("diabetes", "disease", 0.8), ("glycolysis", "pathway", 0.85)]
    mentions = spark.createDataFrame([(doc, t, k, c, at + n, at + n + 5, {"seen": seen} if seen else None) for n, (t, k, c) in enumerate(kinds)], MENTION)
    relations = spark.createDataFrame([(doc, "a", "b", "associated_with", 0.8, "glucose is associated with diabetes", {"by": f"d{doc}"}), (doc, "c", "a", "produces", 0.9, None if doc == 2 else "glycolysis produces glucose", None)], RELATION)
    return graphsets.build(mentions, relations)


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_graphs_of_one_document_are_united(spark):
    merged = graphsets.merge(one_document(spark, 1, 10, "first"), one_document(spark, 2, 3), one_document(spark, 1, 10, "again"))
    nodes, edges = graphsets.described(merged)
    assert rows(nodes, "text", "times", "n_documents") == [("diabetes", 3, 2), ("glucose", 3, 2), ("glycolysis", 3, 2)]
    assert rows(edges, "edge_type", "n_documents", "n_evidence", "times") == [("associated_with", 2, 1, 3), ("produces", 2, 1, 3)]
    # properties of the last graph that has them
    properties = {r.text: r.properties for r in nodes.collect()}
    assert properties["glucose"] == {"seen": "again", "start_pos": "10", "end_pos": "15"}
    assert {r.edge_type: r.properties for r in edges.collect()} == {"associated_with": {"by": "d1"}, "produces": None}
    assert rows(graphsets.merge_bitmaps(graphsets.document_bitmaps(merged.documents)), "n_documents") == [(2,)] * 5


def test_upsert_counts_and_keeps_places_of_the_first_mention(spark):
    old, batch = one_document(spark, 1, 10, "first"), one_document(spark, 2, 3, "second")
    graph, counts = graphsets.upsert(old, batch)
    assert rows(counts, "kind", "created", "updated") == [("edge", 0, 2), ("node", 0, 3)]
    nodes, _ = graphsets.described(graph)
    assert {r.text: r.properties for r in nodes.collect()}["glucose"] == {"seen": "second", "start_pos": "10", "end_pos": "15"}
    nothing = graphsets.build(spark.createDataFrame([], MENTION), spark.createDataFrame([], RELATION))
    fresh, counts = graphsets.upsert(nothing, batch)
    assert rows(counts, "kind", "created", "updated") == [("edge", 2, 0), ("node", 3, 0)]
    assert rows(graphsets.described(fresh)[0], "text", "n_documents") == rows(graphsets.described(batch)[0], "text", "n_documents")
    assert rows(graphsets.upsert(old, nothing)[1], "kind", "created", "updated") == [("edge", 0, 0), ("node", 0, 0)]
    assert graphsets.described(nothing)[0].count() == 0


def test_nulls_and_repeats_in_a_graph(spark):
    mentions = spark.createDataFrame([(None, "x", "k", 0.5, 1, 2, None), (1, "x", "k", None, 1, 2, {"p": None}), (1, "x", "k", None, 1, 2, None)], MENTION)
    nodes, _ = graphsets.described(graphsets.build(mentions, spark.createDataFrame([], RELATION)))
    assert rows(nodes, "text", "confidence", "times", "n_documents") == [("x", 0.5, 3, 1)]


def write(path, text, at):
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    os.utime(path, (at, at))


def graph_rows(graph):
    nodes, edges = graphsets.described(graph)
    return rows(nodes, "text", "node_type", "times", "n_documents"), rows(edges, "src", "dst", "times", "n_documents", "n_evidence")


def test_refreshed_graph_equals_one_built_from_scratch(spark, tmp_path):
    folder, root = tmp_path / "in", str(tmp_path / "store")
    folder.mkdir()
    now = int(time.time()) - 1000
    write(folder / "old.txt", "this was with them", now)
    assert refresh.begin(spark, root, str(folder))["known"] == 1
    assert refresh.begin(spark, root, str(folder)) is None
    for k in range(4):
        write(folder / f"d{k}.txt", f"from this that was with {k}", now + k)
    write(folder / "bad.txt", b"\xff\xfe with", now)
    handler, batches = refresh.batch_handler(root, extract_tokens), []

    def handle(df, number):
        kept = df.persist()
        handler(kept, number)
        before = refresh.commits(spark, root).count()
        handler(kept, number)  # handed over again
        assert refresh.commits(spark, root).count() == before
        batches.append(number)
        kept.unpersist()

    def stream():
        jobs.for_each_batch(jobs.watch_directory(spark, str(folder), batch=3), handle, str(tmp_path / "check")).awaitTermination(180)

    stream()
    assert len(batches) == 2
    # what was there at the start is known, not processed
    states = {r.path.rpartition("/")[2]: r.change for r in refresh.manifest(spark, root).collect()}
    assert states == {"old.txt": "known", "bad.txt": "failed", "d0.txt": "new", "d1.txt": "new", "d2.txt": "new", "d3.txt": "new"}
    mentions, _ = refresh.contributions(spark, root)
    assert mentions.where("doc_id like '%old.txt'").count() == 0
    asof = refresh.commits(spark, root).agg(F.max("version")).first()[0]
    before = graph_rows(refresh.graph(spark, root))
    # a new file through the stream; changed and deleted ones through the listing
    write(folder / "d9.txt", "are these from that", now + 20)
    stream()
    write(folder / "old.txt", "that was this", now + 30)
    write(folder / "d1.txt", "with with was", now + 30)
    (folder / "d2.txt").unlink()
    counts = refresh.reconcile(spark, root, str(folder), extract_tokens, "night")
    assert (counts["added"], counts["updated"], counts["deleted"], counts["failed"]) == (0, 2, 1, 0)
    assert refresh.reconcile(spark, root, str(folder), extract_tokens, "night") is None
    assert refresh.reconcile(spark, root, str(folder), extract_tokens, "next night") is None
    docs = refresh.list_files(spark, str(folder)).where("path not like '%bad.txt'").select(F.col("path").alias("doc_id"), F.col("content").cast("string").alias("text"))
    assert graph_rows(refresh.graph(spark, root)) == graph_rows(graphsets.build(*extract_tokens(docs)))
    assert graph_rows(refresh.graph(spark, root, asof)) == before
    # a deleted file that comes back is new
    write(folder / "d2.txt", "was", now + 40)
    assert refresh.reconcile(spark, root, str(folder), extract_tokens, "third night")["added"] == 1


def test_lost_run_is_written_over(spark, tmp_path):
    root = str(tmp_path / "store")
    files = spark.createDataFrame([("p", "with this", 1)], "path string, text string, t long").select("path", F.timestamp_seconds("t").alias("modificationTime"), F.length("text").cast("long").alias("length"), F.encode("text", "UTF-8").alias("content"))

    def fails(docs):
        mentions, relations = extract_tokens(docs)
        mentions.select(*(c.split()[0] for c in extract.MENTION.split(", "))).write.mode("overwrite").parquet(f"{root}/mentions/part=0")
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        refresh.merge_files(spark, root, "s:0", files, None, fails)
    assert refresh.commits(spark, root).count() == 0 and refresh.contributions(spark, root)[0].count() == 0
    assert refresh.merge_files(spark, root, "s:0", files, None, extract_tokens)["added"] == 1
    assert rows(refresh.contributions(spark, root)[0], "text") == [("this",), ("with",)]
