"""Alert rules that hold for a time: in batch, across gaps, and as a stream."""

from pyspark.sql import functions as F

from quillgraph.operators import telemetry
from quillgraph.streaming import jobs

EVENT = "operation string, t long, duration double, ok boolean"


def events(spark, rows):
    return spark.createDataFrame(rows, EVENT).withColumn("ts", F.timestamp_seconds("t"))


def rules(spark):
    rows = [("slow", "p95", "above", 10.0, 180), ("failing", "errors_per_second", "above", 0.01, 120), ("cold", "success_share", "below", 0.5, 300)]
    return spark.createDataFrame(rows, "rule string, measure string, direction string, bound double, hold_seconds long")


def sample():
    """Half an hour of good calls, ten minutes of slow failures, an hour of silence, one failure, and calls much later."""
    good = [("q", 60 * k, 1.0, True) for k in range(30)]
    bad = [("q", 1800 + 20 * k, 20.0, k % 7 == 0) for k in range(30)]
    return good + bad + [("q", 6000, 20.0, False), ("other", 100, 50.0, False)] + [("q", 9000 + 60 * k, 1.0, True) for k in range(9)] + [("other", 90_000, 1.0, True), ("q", 90_000, 1.0, True)]


def rows(df):
    return sorted(tuple(r) for r in df.select("rule", "operation", F.unix_seconds("begins"), F.unix_seconds("ends"), "windows", F.round("worst", 6)).collect())


def test_a_gap_starts_anew(spark):
    """Two bad windows nine hours apart are not two in a row."""
    df = events(spark, [("q", 0, 1.0, False), ("q", 9 * 3600, 1.0, False)])
    found = telemetry.windowed_alerts(df, 0.5, "5 minutes", "5 minutes", 2).collect()
    assert len(found) == 2 and not any(r.firing for r in found)
    df = events(spark, [("q", 0, 1.0, False), ("q", 300, 1.0, False), ("q", 600, 1.0, None)])
    assert [r.firing for r in telemetry.windowed_alerts(df, 0.5, "5 minutes", "5 minutes", 2).orderBy("start").collect()] == [False, True, False]


def test_episodes_by_brute_force(spark):
    want, data, names = [], sample(), {"q", "other"}
    for name in names:
        for rule, measure, direction, bound, hold in [tuple(r) for r in rules(spark).collect()]:
            run = []
            for k in range(-10, 1600):
                inside = sorted((d, ok) for op, t, d, ok in data if op == name and 60 * k <= t < 60 * k + 300)
                value = None
                if inside:
                    value = {"p95": inside[-(-95 * len(inside) // 100) - 1][0], "errors_per_second": sum(not ok for _, ok in inside) / 300, "success_share": sum(ok for _, ok in inside) / len(inside)}[measure]
                bad = value is not None and (value > bound if direction == "above" else value < bound)
                if bad:
                    run.append((k, value))
                if run and not bad:
                    if len(run) * 60 >= hold:
                        want.append((rule, name, 60 * (run[0][0] + hold // 60 - 1), 60 * run[-1][0], len(run), round((max if direction == "above" else min)(v for _, v in run), 6)))
                    run = []
    got = rows(telemetry.alert_episodes(events(spark, data), rules(spark)))
    assert got == sorted(want) and {r[0] for r in got} == {"slow", "failing", "cold"}
    assert telemetry.alert_episodes(events(spark, []), rules(spark)).count() == 0


def test_stream_gives_the_episodes_of_the_batch(spark, tmp_path):
    path = str(tmp_path / "events")
    data = sorted(sample(), key=lambda r: r[1])
    for k in range(0, len(data), 15):
        events(spark, data[k : k + 15]).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(path)
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        found = jobs.stream_alert_episodes(stream, rules(spark), watermark="1 second")
        q = found.writeStream.outputMode("append").format("memory").queryName("episodes").trigger(availableNow=True).start()
        q.awaitTermination(240)
        assert rows(spark.table("episodes")) == rows(telemetry.alert_episodes(events(spark, sample()), rules(spark)))
    finally:
        spark.conf.unset(key)


def test_p95_of_a_full_window_is_exact(spark):
    """More calls in a window than a sketch can tell apart."""
    n = 400_000
    calls = spark.range(n).select(F.lit("q").alias("operation"), F.timestamp_seconds(F.col("id") % 300).alias("ts"), (F.pmod(F.xxhash64("id"), F.lit(10**9)) / 7.0).alias("duration"), F.lit(True).alias("ok"))
    got = [r.value for r in telemetry.window_measures(calls, "5 minutes", "5 minutes").where("measure = 'p95'").collect()]
    assert got == [sorted(r.duration for r in calls.select("duration").collect())[95 * n // 100 - 1]]
