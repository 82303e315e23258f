"""Views on small tables: nulls, ties, empty tables."""

from pyspark.sql import functions as F

from quillgraph.operators import graph, telemetry, views


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_health_score_counts_known_categories_and_states(spark):
    states = spark.createDataFrame([("system_info", "healthy"), ("resource_usage", "warning"), ("log_analysis", "critical"), ("process_status", "broken"), ("other", "healthy"), ("file_system", None)], "category string, status string")
    assert rows(views.health_score(states)) == [(25.5, round(100 * 25.5 / 130, 6))]
    assert rows(views.health_score(states.where("false"))) == [(0.0, 0.0)]


def test_views_of_nothing(spark):
    alerts = spark.createDataFrame([], "alert_id long, severity string, component string, ts timestamp, resolved boolean")
    assert rows(views.overall_health(alerts, "2024-01-01")) == [("healthy", 0, 0, 0, 0, 0)] and views.alert_list(alerts).count() == 0
    levels = spark.createDataFrame([], "users long, rate double, memory double, file string, errors long, warnings long, status string")
    assert rows(views.scalability_report(levels)) == [(None, None, None)]
    assert rows(views.worst_log(levels)) == [("healthy", 0, 0)]
    assert rows(views.criteria_verdict(spark.createDataFrame([], "criterion string, ok boolean"))) == [(True, "")]


def test_alerts_with_nulls_and_ties(spark):
    data = [(2, "critical", "c", 100, None), (1, "critical", "c", 100, False), (3, "error", "c", None, False), (4, "critical", "c", 50, True)]
    alerts = spark.createDataFrame(data, "alert_id long, severity string, component string, t long, resolved boolean").withColumn("ts", F.timestamp_seconds("t"))
    assert [(r.place, r.alert_id) for r in views.alert_list(alerts).collect()] == [(1, 1), (2, 2), (3, 4), (4, 3)]
    assert [r.alert_id for r in views.alert_list(alerts, active=True, severities=["critical"]).collect()] == [1, 2]
    assert views.overall_health(alerts, "1970-01-01 00:02:00").first().status == "critical"


def test_one_level_of_load(spark):
    one = spark.createDataFrame([(10, 5.0, 20.0)], "users long, rate double, memory double")
    assert rows(views.scalability_report(one)) == [(1.0, 10, 2.0)]


def test_values_are_compared_by_kind(spark):
    current = spark.createDataFrame([("a", "x"), ("b", "1.1"), ("c", None), ("d", "true")], "name string, value string")
    base = spark.createDataFrame([("a", "1", "number", 0.2), ("b", "1", "number", 0.2), ("c", "t", "text", 0.0), ("d", "True", "boolean", 0.0)], "name string, baseline string, kind string, tolerance double")
    assert {r.name: (r.deviation, r.passed) for r in views.tolerance_of_values(current, base).collect()} == {"a": (None, False), "b": (0.1, True), "c": (1.0, False), "d": (0.0, True)}


def test_trees_with_cycles_orphans_and_repeats(spark):
    data = [("a", None), ("b", "a"), ("c", "b"), ("c", "b"), ("d", "gone"), ("x", "y"), ("y", "x"), ("z", "x"), ("s", "s"), (None, "a")]
    steps = spark.createDataFrame([(i, p, 1.0, None) for i, p in data], "id string, parent_id string, seconds double, is_error boolean")
    got = {r.id: (r.depth, r.steps, r.seconds) for r in telemetry.step_tree(steps).collect()}
    lost = (None, None, None)
    assert got == {"a": (0, 3, 3.0), "b": (1, 2, 2.0), "c": (2, 1, 1.0), "d": (0, 1, 1.0), "x": lost, "y": lost, "z": lost, "s": lost}
    assert telemetry.step_tree(steps.where("false")).count() == 0
    chain = spark.range(200).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"))
    assert telemetry.step_depths(chain).agg(F.max("depth"), F.count("depth")).first()[:] == (199, 200)


def test_paths_are_the_smallest_of_the_shortest(spark):
    edges = spark.createDataFrame([("e1", "a", "c"), ("e2", "a", "b"), ("e3", "b", "d"), ("e4", "c", "d"), ("e5", "d", "d"), ("e6", None, "a")], "edge_id string, src string, dst string")
    starts = spark.createDataFrame([(1, "a"), (2, "zz"), (3, None)], "query_id long, node_id string")
    reached = graph.traverse_paths(starts, edges, 2)
    got = {(r.query_id, r.node_id): (r.depth, ">".join(r.path)) for r in reached.collect()}
    assert got == {(1, "a"): (0, "a"), (1, "b"): (1, "a>b"), (1, "c"): (1, "a>c"), (1, "d"): (2, "a>b>d"), (2, "zz"): (0, "zz")}
    assert sorted(rows(graph.traversal_summary(starts, reached))) == [(1, 4, 2), (2, 1, 0), (3, 0, 0)]
    around = {(r.edge_id, r.from_node, r.to_node, r.depth) for r in graph.edge_paths(reached, edges, 2).collect()}
    assert around == {("e1", "a", "c", 0), ("e2", "a", "b", 0), ("e3", "b", "d", 1), ("e4", "c", "d", 1)}
