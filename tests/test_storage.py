"""Replacement of single graphs and versions in storage, JDBC ranges, records and mixed metadata."""

from pyspark.sql import functions as F

from quillgraph.operators import changes, confidence
from quillgraph.sources import files

NODE, EDGE = "graph_id string, node_id string, text string", "graph_id string, edge_id string, src string, dst string"


def state(folder):
    return {p.relative_to(folder): p.stat().st_mtime_ns for p in folder.rglob("*.parquet")}


def test_other_graphs_are_untouched(spark, tmp_path):
    path = str(tmp_path / "graphs")
    nodes = spark.createDataFrame([("a/b", "1", "x"), ("g 2", "2", "y"), ("g3", "3", "z")], NODE)
    edges = spark.createDataFrame([("a/b", "e", "1", "1"), ("g 2", "f", "2", "2")], EDGE)
    files.write_graph(nodes, edges, path)
    before = state(tmp_path)
    files.replace_graphs(spark.createDataFrame([("a/b", "9", "new"), ("a/b", "8", "new")], NODE), spark.createDataFrame([], EDGE), path)
    after = state(tmp_path)
    assert {k: v for k, v in after.items() if "g" in k.parts[-2].split("=")[1][:1]} == {k: v for k, v in before.items() if "g" in k.parts[-2].split("=")[1][:1]}
    n, e = files.read_graph(spark, path)
    assert sorted((r.graph_id, r.node_id) for r in n.collect()) == [("a/b", "8"), ("a/b", "9"), ("g 2", "2"), ("g3", "3")]
    assert [r.graph_id for r in e.collect()] == ["g 2"]
    assert files.drop_stored_graph(spark, path, "g 2") == 2 and files.drop_stored_graph(spark, path, "g 2") == 0
    n, e = files.read_graph(spark, path)
    assert sorted(r.graph_id for r in n.select("graph_id").distinct().collect()) == ["a/b", "g3"]
    assert files.drop_stored(spark, str(tmp_path / "nothing"), "graph_id", "x") == 0


def test_old_versions_are_deleted(spark, tmp_path):
    rows = [changes.snapshot(spark.range(k + 1), str(tmp_path), f"v{k}") for k in range(4)]
    versions = spark.createDataFrame([(r["version_id"], k) for k, r in enumerate(rows)], "version_id string, t long").withColumn("created_at", F.timestamp_seconds("t"))
    assert changes.drop_versions(spark, str(tmp_path), versions, 2) == 2
    assert sorted(p.name for p in tmp_path.glob("version=*")) == ["version=v2", "version=v3"]
    assert changes.restore(spark, str(tmp_path), "v3").count() == 4
    assert [r.version_id for r in changes.list_versions(versions, 2).collect()] == ["v3", "v2"]


def test_inventory_names_invalid_files(spark, tmp_path):
    (tmp_path / "x.pdf").write_bytes(b"%PDF-1.4 ...")
    (tmp_path / "y.pdf").write_bytes(b"nothing")
    (tmp_path / "z.pdf").write_bytes(b"%PD")
    row = files.file_inventory(spark, str(tmp_path)).first()
    assert (row.files, row.valid, row.invalid) == (3, 1, 2) and [e.rpartition("/")[2] for e in row.errors] == ["y.pdf", "z.pdf"]
    listed = files.file_inventory(spark, str(tmp_path), check=False)
    assert (listed.first().files, listed.first().valid) == (3, None)


def test_jdbc_tables_in_ranges(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.range(100).select(F.col("id").cast("string").alias("id"), F.timestamp_seconds(F.col("id") * 1000).alias("createdAt"), (F.col("id") * 2).alias("n"))
    rows = rows.unionByName(spark.createDataFrame([("none", None, 1)], "id string, createdAt timestamp, n long"))
    options = {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    rows.write.format("jdbc").options(url=url, dbtable='"Step"', **options).save()
    got = files.read_jdbc_ranges(spark, url, "Step", "createdAt", 4, **options)
    assert got.rdd.getNumPartitions() == 4 and got.count() == 101
    assert got.agg(F.sum("n")).first()[0] == 2 * sum(range(100)) + 1
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) <= 27
    assert files.read_jdbc_ranges(spark, url, "Step", "createdAt", 1, **options).count() == 101


def test_records_and_links(spark):
    good = "<PubmedArticle><MedlineCitation><Article><ArticleTitle>T &lt; U</ArticleTitle></Article></MedlineCitation></PubmedArticle>"
    records = files.bibliography_records(spark.createDataFrame([("1", good), ("2", "<x>"), ("3", None), (None, good), ("1", good)], "id string, xml string"), "id", "xml")
    got = {r.pmid: (r.authors, r.title, r.year, r.doi) for r in records.collect()}
    assert got == {"1": ("Anonymous", "T < U", None, None), "2": (None, None, None, None), "3": (None, None, None, None)}
    cited = spark.createDataFrame([(1, "PMID:1"), (2, "PMID:2"), (3, "PMID:9"), (4, "ORPHA: 7"), (5, "book"), (6, None), (7, "PMID:1")], "id long, citation string")
    links = {r.id: r.link for r in confidence.linked_citations(cited, records).collect()}
    line = "Anonymous T < U. https://pubmed.ncbi.nlm.nih.gov/1/"
    assert links == {1: line, 2: "PMID:2", 3: "PMID:9", 4: "https://www.orpha.net/en/disease/detail/7", 5: "book", 6: None, 7: line}


def test_mixed_metadata(spark):
    texts = ['{"a": 1, "b": [1, "x"]}', '{"a": "one"}', '{"a": {"c": 2}}', "{", "", None, "null", "3"]
    rows = files.chat_metadata(spark.createDataFrame(list(enumerate(texts)), "id long, metadata string"), {"a": ("$.a", "int"), "b": ("$.b[1]", "string")})
    got = {r.id: (r.metadata_ok, r.a, r.b) for r in rows.collect()}
    assert got == {0: (True, 1, "x"), 1: (True, None, None), 2: (True, None, None), 3: (False, None, None), 4: (False, None, None), 5: (None, None, None), 6: (True, None, None), 7: (True, None, None)}
