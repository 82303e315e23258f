"""Streams replayed from files give what the batch jobs give."""

from pyspark.sql import functions as F

from quillgraph.operators import telemetry
from quillgraph.sources import files
from quillgraph.streaming import jobs


def run(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return stream.sparkSession.table(name)


def events(spark, tmp_path, n=300):
    df = spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % 3).alias("user_id"), F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.concat(F.lit("op"), (F.col("id") % 2).cast("string")).alias("operation"), (F.col("id") % 5 > 2).alias("ok"), (F.col("id") % 11 / 10).alias("duration"))
    df.coalesce(1).write.mode("overwrite").parquet(str(tmp_path / "events"))
    path = str(tmp_path / "events")
    return spark.read.parquet(path), spark.readStream.schema(df.schema).parquet(path)


def test_rate_limits(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    got = run(jobs.stream_rate_limit(stream, 3, 20, 4), "limits").collect()
    want = telemetry.rate_limit(batch, 3, 20, 4).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r.allowed for r in got} == {True, False}


def test_breakers(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    got = {r.event_id: r.state for r in run(jobs.stream_circuit_breaker(stream, 2, 60), "breakers").collect()}
    want = {r.event_id: r.state for r in telemetry.circuit_breaker(batch, 2, 60).collect()}
    assert got == want and set(got.values()) == {"open", "closed"}


def test_windows_sessions_and_duplicates(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    got = run(jobs.stream_operation_metrics(stream, "10 minutes", "1 second"), "metrics").collect()
    calls = {(r.operation, r.calls) for r in batch.groupBy("operation", F.window("ts", "10 minutes")).agg(F.count("*").alias("calls")).collect()}
    assert got and {(r.operation, r.calls) for r in got} <= calls
    assert run(jobs.dedup_events(stream, ["user_id"]), "once").count() == 3
    assert run(jobs.stream_windowed_rates(stream, watermark="1 second"), "rates").count() > 0
    assert run(jobs.stream_sessions(stream, "5 seconds", "1 second"), "sessions").count() > 0


def test_directory_and_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(5):
        (tmp_path / "in" / f"d{k}.txt").write_text(f"text {k}")
    seen = []
    q = jobs.for_each_batch(jobs.watch_directory(spark, str(tmp_path / "in"), batch=2), lambda df, n: seen.append(df.count()), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert sum(seen) == 5 and max(seen) <= 2
    corpus = files.read_text_corpus(spark, str(tmp_path / "in"))
    assert {(r.doc_id, r.text) for r in corpus.collect()} == {(f"d{k}", f"text {k}") for k in range(5)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('PMID,abstract\n1,"one, two"\n2,\n')
    assert [(r.doc_id, r.text) for r in files.read_abstracts(spark, str(tmp_path / "a.csv")).collect()] == [("1", "one, two")]
    (tmp_path / "pdf").mkdir()
    (tmp_path / "pdf" / "x.pdf").write_bytes(b"%PDF-1.4 ...")
    (tmp_path / "pdf" / "y.pdf").write_bytes(b"nothing")
    row = files.file_inventory(spark, str(tmp_path / "pdf")).first()
    assert (row.files, row.valid, row.invalid) == (2, 1, 1)
    nodes = spark.createDataFrame([("g", "n1", "x")], "graph_id string, node_id string, text string")
    edges = spark.createDataFrame([("g", "e1", "n1", "n1")], "graph_id string, edge_id string, src string, dst string")
    files.write_graph(nodes, edges, str(tmp_path / "graph"))
    assert [d.count() for d in files.read_graph(spark, str(tmp_path / "graph"))] == [1, 1]
    (tmp_path / "g.json").write_text('{"graph_id": "g", "nodes": {"n": {"text": "t", "node_type": "k", "confidence": 0.5}}, "edges": {"e": {"source_node_id": "n", "target_node_id": "n"}}}')
    n, e = files.read_graph_json(spark, str(tmp_path / "g.json"))
    assert n.first().text == "t" and e.first().source_node_id == "n"
    files.write_report(nodes, str(tmp_path / "report"))
    assert spark.read.json(str(tmp_path / "report")).count() == 1
    for name, schema in files.CHAT_STORE.items():
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / "chat" / name))
    assert set(files.read_chat_store(spark, str(tmp_path / "chat"))) == set(files.CHAT_STORE)
    page = spark.createDataFrame([(1, "<html><title>T</title><body>a<script>no</script><p>b</body></html>"), (2, None)], "id long, html string")
    assert [r.text for r in files.article_text(page, "id", "html").collect()] == ["T\na b", ""]


def test_article_references_end_with_a_semicolon(spark):
    page = spark.createDataFrame([(1, "<title>a &amp; b&amp</title><body>x &lt; &#65; y & z&amp</body>")], "id long, html string")
    assert files.article_text(page, "id", "html").first().text == "a & b&amp\nx < A y & z&amp"
