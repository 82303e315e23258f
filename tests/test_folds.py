"""Caches and breakers of very many keys, each with few calls."""

from pyspark.sql import functions as F

from quillgraph.operators import telemetry


def test_many_small_keys_pass_as_rows(spark):
    """No plan with a pandas call for each key; the results are those of a plain fold."""
    rows = [(f"k{n % 700}", n % 3, n, 40 * (n * 7919 % 5000), n % 4 == 0) for n in range(5000)]
    df = spark.createDataFrame(rows, "key string, user_id long, event_id long, t long, ok boolean").withColumn("ts", F.timestamp_seconds("t"))
    hits, states = telemetry.cache_hits(df, 9000), telemetry.circuit_breaker(df.withColumnRenamed("key", "operation"), 2, 50_000)
    for found in (hits, states):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "FlatMapGroupsInPandas" not in plan
    want, held, state = {}, {}, {}
    for key, user, event, t, ok in sorted(rows, key=lambda r: (r[3], r[2])):
        hit = key in held and t - held[key] <= 9000
        held[key] = held[key] if hit else t
        want[event] = (hit, telemetry.breaker_step(state.setdefault((key, user), {}), t, ok, 2, 50_000))
    assert {r.event_id: r.hit for r in hits.collect()} == {e: v[0] for e, v in want.items()}
    assert {r.event_id: r.state for r in states.collect()} == {e: v[1] for e, v in want.items()}
    assert {v[0] for v in want.values()} == {True, False} and {v[1] for v in want.values()} == {"closed", "open"}
    assert telemetry.cache_hits(df.limit(0)).count() == 0
