"""Queries of telemetry, load tests and regressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import evaluate, telemetry
from quillgraph.plans.registry import query, table
from quillgraph.functions import text as T

AS_OF = "2024-01-20 12:00:00"
_OPS = "ops as (select event_id, event_type operation, ts, user_id, value duration, event_type <> 'error' and user_id % 9 > 0 ok from events)"


def _ops(spark, sf_dir):
    ok = (F.col("event_type") != "error") & (F.col("user_id") % 9 > 0)
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("operation"), "ts", "user_id", F.col("value").alias("duration"), ok.alias("ok"))


@query("select event_id, event_type name, sum(user_id) over (partition by event_type order by ts, event_id)::bigint running from events")
def counter_series(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("name"), "ts", F.col("user_id").alias("value"))
    return telemetry.counter_series(e).select("event_id", "name", "running")


@query("select event_type name, arg_max(value, (ts, event_id)) as value, max(epoch_us(ts)) us from events group by 1")
def gauge_latest(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumnRenamed("event_type", "name")
    return telemetry.gauge_latest(e).select("name", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query(f"select event_id, value from events where event_type = 'click' and ts >= timestamp '{AS_OF}'")
def metric_history(spark, sf_dir):
    return telemetry.metric_history(table(spark, sf_dir, "events"), "click", AS_OF, "event_type").select("event_id", "value")


_METRICS = (
    f"{_OPS}, l as (select *, row_number() over (partition by operation order by ts desc, event_id desc) n from ops), s as (select operation, list_sort(list(duration)) d from l "
    f"where n <= 1000 group by 1), met as (select operation, count(*) calls, count_if(ok)::bigint as ok, count_if(not ok)::bigint failed, sum(duration) total, min(duration) least, "
    f"max(duration) most, avg(duration) mean, any_value(d[least(floor(0.95 * len(d))::int + 1, len(d))]) p95, any_value(d[least(floor(0.99 * len(d))::int + 1, len(d))]) p99 from "
    f"ops join s using (operation) group by 1)"
)


@query(f"with {_METRICS} select operation, calls, ok, failed, round(total, 4) total, least, most, round(mean, 6) mean, p95, p99 from met")
def operation_metrics(spark, sf_dir):
    return telemetry.operation_metrics(_ops(spark, sf_dir)).withColumns({"total": F.round("total", 4), "mean": F.round("mean", 6)})


@query(f"with {_METRICS} select sum(calls)::bigint calls, round(100.0 * sum(failed) / sum(calls), 6) error_percent, count(*) operations from met")
def performance_summary(spark, sf_dir):
    return telemetry.performance_summary(telemetry.operation_metrics(_ops(spark, sf_dir)))


@query(f"with {_METRICS} select operation metric, p95 as value, 'gt' as operator, 50.0::double bound, 'warning' severity from met where p95 > 50 union all select operation, p95, 'lte', 60.0, 'info' from met where p95 <= 60")
def threshold_alerts(spark, sf_dir):
    values = telemetry.operation_metrics(_ops(spark, sf_dir)).select(F.col("operation").alias("metric"), F.col("p95").alias("value"))
    rules = values.select("metric").withColumn("r", F.explode(F.array(*(F.struct(F.lit(o).alias("operator"), F.lit(b).alias("bound"), F.lit(s).alias("severity")) for o, b, s in (("gt", 50.0, "warning"), ("lte", 60.0, "info"))))))
    return telemetry.threshold_alerts(values, rules.select("metric", "r.*"))


@query(f"select event_type severity, 'c' || user_id % 3 component, count(*) n, count_if(user_id % 5 > 0)::bigint active, count_if(ts >= timestamp '{AS_OF}' - interval 24 hours)::bigint last_day from events group by all")
def alert_views(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("severity"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("component"), "ts", (F.col("user_id") % 5 == 0).alias("resolved"))
    return telemetry.alert_views(rows, AS_OF)


@query(f"with {_METRICS} select operation, case when failed / calls > 0.05 then 'degraded' when mean > 2 then 'warning' else 'healthy' end health from met")
def health_status(spark, sf_dir):
    return telemetry.health_status(telemetry.operation_metrics(_ops(spark, sf_dir)))


@query(f"select 'k' || user_id % 10 category, count(*) n, count_if(ts >= timestamp '{AS_OF}' - interval 1 hour)::bigint last_hour, count_if(ts >= timestamp '{AS_OF}' - interval 24 hours)::bigint last_day from events where event_type = 'error' group by 1")
def error_statistics(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.concat(F.lit("k"), (F.col("user_id") % 10).cast("string")).alias("category"), "ts")
    return telemetry.error_statistics(rows, AS_OF)


@query(
    "with recursive o as (select sha256(lower(event_type) || '|' || user_id) as key, event_id, epoch_us(ts) t, row_number() over (partition by event_type, user_id order by ts, "
    "event_id) n from events), f as (select key, event_id, n, t as held, false hit from o where n = 1 union all select o.key, o.event_id, o.n, case when o.t - f.held <= 86400000000 "
    "then f.held else o.t end, o.t - f.held <= 86400000000 from f join o on o.key = f.key and o.n = f.n + 1) select key, event_id, hit from f"
)
def cache_hits(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(telemetry.cache_key(F.upper("event_type"), F.col("user_id").cast("string")).alias("key"), "event_id", "ts")
    return telemetry.cache_hits(log, 86400)


@query(
    "with recursive o as (select user_id, value v, row_number() over (partition by user_id order by ts, event_id) n from events), f as (select user_id, n, v::double a from o where "
    "n = 1 union all select o.user_id, o.n, 0.2 * o.v + 0.8 * f.a from f join o on o.user_id = f.user_id and o.n = f.n + 1) select user_id, round(arg_max(a, n), 6) average from "
    "f group by 1"
)
def ewma(spark, sf_dir):
    return telemetry.ewma(table(spark, sf_dir, "events"), "user_id", "value", ["ts", "event_id"], 0.2).withColumn("average", F.round("average", 6))


@query(
    "with s as (select (5 - left(o_orderpriority, 1)::int)::int priority, count(*) n from orders group by 1) select priority, n, round((coalesce(sum(n) over (order by priority "
    "desc rows between unbounded preceding and 1 preceding), 0) + n / 2) / 4 * 2.0, 6) wait_seconds from s"
)
def queue_view(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    rows = rows.select((5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), F.to_timestamp(F.lit(AS_OF)).alias("created_at"), F.lit(60).alias("timeout"))
    return telemetry.queue_view(rows, AS_OF)


@query(
    "with t as (select *, row_number() over (partition by source order by doc_id desc) n from documents) select *, case when errors > 10 then 'critical' when errors > 5 or warnings "
    "> 20 then 'warning' else 'healthy' end status from (select source as file, count_if(doc_id % 7 = 0)::bigint errors, count_if(doc_id % 5 = 0 and doc_id % 7 > 0)::bigint warnings "
    "from t where n <= 100 group by 1)"
)
def log_levels(spark, sf_dir):
    d = F.col("doc_id")
    line = F.when(d % 7 == 0, "ERROR x").when(d % 5 == 0, "WARNING y").otherwise("INFO")
    return telemetry.log_levels(table(spark, sf_dir, "documents").select(F.col("source").alias("file"), d.alias("line_no"), line.alias("line")))


@query(
    "select conv_id::varchar thread_id, role as type, count(*) steps, round(avg((turn % 4 = 0)::int), 6) error_share, round(avg(turn::double), 6) mean_seconds, round(avg(case "
    "when turn % 2 = 0 then turn / 10 end), 6) mean_mark from conversations group by all"
)
def thread_rollup(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    step = F.concat_ws("-", "conv_id", "turn")
    steps = c.select(step.alias("id"), F.col("conv_id").cast("string").alias("thread_id"), F.col("role").alias("type"), (F.col("turn") % 4 == 0).alias("is_error"), F.col("turn").cast("double").alias("seconds"))
    feedback = c.where("turn % 2 = 0").select(step.alias("step_id"), (F.col("turn") / 10).alias("value"))
    return telemetry.thread_rollup(steps, feedback)


@query(f"select lower(event_type) || ' ' || user_id % 20 query, count(*) n, round(avg(value), 6) mean_seconds from events where ts >= timestamp '{AS_OF}' - interval 24 hours group by 1 order by n desc, query limit 5")
def query_statistics(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.concat_ws(" ", F.upper("event_type"), (F.col("user_id") % 20).cast("string")).alias("query"), "ts", F.col("value").alias("seconds"))
    return telemetry.query_statistics(log, AS_OF)


@query(
    f"with {_OPS}, w as (select operation, time_bucket(interval 1 hour, ts) - k * interval 1 hour as start, avg((not ok)::int) rate from ops, range(6) r(k) group by all) select "
    f"operation, epoch_us(start) start, round(rate, 6) rate, coalesce(sum((rate > 0.12)::int) over p = 3, false) firing from w window p as (partition by operation order by start "
    f"range between interval 2 hours preceding and current row)"
)
def windowed_alerts(spark, sf_dir):
    rows = telemetry.windowed_alerts(_ops(spark, sf_dir), 0.12, "6 hours", "1 hour", 3)
    return rows.withColumn("start", F.unix_micros(F.col("start").cast("timestamp")))


_RULES_HELD = "rules(rule, measure, direction, bound, hold) as (values ('slow', 'p95', 'above', 30.0, 2), ('failing', 'errors_per_second', 'above', 0.0003, 3), ('cold', 'success_share', 'below', 0.9, 2))"


@query(
    f"with {_OPS}, {_RULES_HELD}, "
    "w as (select operation, epoch(time_bucket(interval 1 hour, ts))::bigint // 3600 - k number, quantile_disc(duration, 0.95)::double p95, count_if(not ok) / 21600.0 errors_per_second, avg(ok::int) success_share from ops, range(6) r(k) group by all), "
    "m as (unpivot w on p95, errors_per_second, success_share into name measure value v), "
    "bad as (select rule, operation, number, hold, direction, v from m join rules using (measure) where case direction when 'above' then v > bound else v < bound end), "
    "runs as (select *, number - row_number() over (partition by rule, operation order by number) run from bad) "
    "select rule, operation, (min(number) + any_value(hold) - 1)::bigint begins_hour, max(number)::bigint ends_hour, count(*) windows, round(case any_value(direction) when 'above' "
    "then max(v) else min(v) end, 6) worst from runs group by rule, operation, run having count(*) >= any_value(hold)"
)
def alert_episodes(spark, sf_dir):
    """Three rules on windows of six hours, each an hour after the other."""
    rules = spark.createDataFrame([("slow", "p95", "above", 30.0, 7200), ("failing", "errors_per_second", "above", 0.0003, 10800), ("cold", "success_share", "below", 0.9, 7200)], "rule string, measure string, direction string, bound double, hold_seconds long")
    rows = telemetry.alert_episodes(_ops(spark, sf_dir), rules, "6 hours", "1 hour")
    hour = lambda c: F.floor(F.unix_seconds(F.col(c)) / 3600)
    return rows.select("rule", "operation", hour("begins").alias("begins_hour"), hour("ends").alias("ends_hour"), "windows", F.round("worst", 6).alias("worst"))


_STEPS = "st as (select conv_id || '-' || turn id, case when turn = 6 and conv_id % 5 = 0 then conv_id || '-13' when turn > 0 then conv_id || '-' || (turn - 1) // 2 end parent, turn % 10 + 0.5 as seconds, turn % 4 = 0 is_error from conversations)"


@query(
    f"with recursive {_STEPS}, one as (select id, any_value(parent) parent, any_value(seconds)::double as seconds, any_value(is_error) is_error from st group by id), "
    "up as (select one.id, p.id anc from one join one p on one.parent = p.id union select up.id, p.id from up join one c on c.id = up.anc join one p on c.parent = p.id), "
    "loop_ as (select id from up where id = anc), lost as (select id from loop_ union select id from up where anc in (from loop_)), "
    "pairs as (select id, anc from up where id not in (from lost) union all select id, id from one where id not in (from lost)) "
    "select one.id, d.depth, n steps, s as seconds, e error_share from one left join (select id, count(*) - 1 depth from pairs group by 1) d using (id) "
    "left join (select anc id, count(*) n, round(sum(seconds), 6) s, round(avg(is_error::int), 6) e from pairs join one using (id) group by 1) t using (id)"
)
def step_tree(spark, sf_dir):
    """Turns as a tree of halves, with a cycle in every fifth conversation that is long enough."""
    turn, conv = F.col("turn"), F.col("conv_id").cast("string")
    named = lambda t: F.concat_ws("-", conv, t.cast("string"))
    parent = F.when((turn == 6) & (F.col("conv_id") % 5 == 0), named(F.lit(13))).when(turn > 0, named(F.floor((turn - 1) / 2)))
    rows = table(spark, sf_dir, "conversations").select(named(turn).alias("id"), parent.alias("parent_id"), (turn % 10 + 0.5).alias("seconds"), (turn % 4 == 0).alias("is_error"))
    return telemetry.step_tree(rows)


@query(
    "with g as (select *, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 2 hours then 1 else 0 end s from events window w as (partition by user_id order by "
    "ts)), k as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) k from g) select user_id, epoch_us(min(ts)) first_us, epoch_us(max(ts)) last_us, "
    "count(*) n from k group by user_id, k"
)
def user_sessions(spark, sf_dir):
    rows = telemetry.user_sessions(table(spark, sf_dir, "events"))
    return rows.select("user_id", F.unix_micros(F.col("first").cast("timestamp")).alias("first_us"), F.unix_micros(F.col("last").cast("timestamp")).alias("last_us"), "n")


_RULES = "r as (select event_type user_type, count(*)::bigint // 2000 + 1 per_minute, count(*)::bigint // 1000 + 1 per_hour from events where event_type <> 'error' group by 1)"


@query(
    f"with {_RULES}, u as (select user_id, event_type user_type, unit, case unit when 'minute' then date_trunc('minute', ts) else date_trunc('hour', ts) end begins, count(*) n "
    f"from events, (values ('minute'), ('hour')) x(unit) group by all) select u.user_id, u.user_type, u.unit, u.begins, u.n, coalesce(case unit when 'minute' then per_minute else "
    f"per_hour end, 1) allowed, greatest(u.n - coalesce(case unit when 'minute' then per_minute else per_hour end, 1), 0)::bigint as over from u left join r using (user_type)"
)
def rate_usage(spark, sf_dir):
    """Event types as types of users; those without an own rule fall under the general one."""
    e = table(spark, sf_dir, "events")
    n = F.count("*")
    own = e.where("event_type <> 'error'").groupBy(F.col("event_type").alias("user_type")).agg((F.floor(n / 2000) + 1).alias("per_minute"), (F.floor(n / 1000) + 1).alias("per_hour"))
    rest = e.agg(F.max(F.lit(None).cast("string")).alias("user_type"), F.lit(1).cast("long").alias("per_minute"), F.lit(1).cast("long").alias("per_hour"))
    return telemetry.rate_usage(e.withColumnRenamed("event_type", "user_type"), own.unionByName(rest))


@query()
def rate_limit(spark, sf_dir):
    """Requests of few users in quick succession: a day is taken as a minute."""
    e = table(spark, sf_dir, "events")
    fast = F.timestamp_micros((F.unix_micros(F.col("ts").cast("timestamp")) / 1440).cast("long"))
    return telemetry.rate_limit(e.withColumn("ts", fast), 10, 100, 5)


@query()
def circuit_breaker(spark, sf_dir):
    e = _ops(spark, sf_dir).withColumn("ok", F.col("event_id") % 3 == 0)
    return telemetry.circuit_breaker(e, 3, 86400.0)


_RUNS = "runs as (select event_type || '_response_time' metric, date_trunc('day', ts) ts, day(ts)::int run_id, avg(value) as value from events group by all)"


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.concat(F.col("event_type"), F.lit("_response_time")).alias("metric"), F.date_trunc("day", "ts").alias("ts"), F.dayofmonth("ts").alias("run_id")).agg(F.avg("value").alias("value"))


@query(
    f"with {_RUNS}, x as (select metric, arg_min(value, (ts, run_id)) as first, arg_max(value, (ts, run_id)) as last from runs group by 1) select metric, round(first, 6) as first, "
    f"round(last, 6) as last, round(last - first, 6) change, round(100 * (last - first) / first, 6) percent from x"
)
def run_trend(spark, sf_dir):
    return evaluate.run_trend(_runs(spark, sf_dir)).withColumns({"first": F.round("first", 6), "last": F.round("last", 6)})


@query(
    "select event_type test, count(*) n, count_if(user_id % 9 = 0)::bigint failed, round(count(*) / greatest(max(epoch_us(ts) // 1000000) - min(epoch_us(ts) // 1000000), 1), 6) "
    "rate, round(avg(value) filter (user_id % 9 > 0), 6) mean, min(value) filter (user_id % 9 > 0) least, max(value) filter (user_id % 9 > 0) most, round(quantile_cont(value, "
    "0.95) filter (user_id % 9 > 0), 6) p95, round(quantile_cont(value, 0.99) filter (user_id % 9 > 0), 6) p99 from events group by 1"
)
def load_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("test"), "ts", (F.col("user_id") % 9 > 0).alias("ok"), F.col("value").alias("seconds"))
    return evaluate.load_summary(rows)


@query(
    "with x as (select event_type, list_sort(list(value)) d from events group by 1), y as (select *, greatest(1.0, least(0.95 * (len(d) + 1), len(d)::double)) a from x) select "
    "event_type, round(d[floor(a)::int] + (a - floor(a)) * (d[least(floor(a)::int + 1, len(d))] - d[floor(a)::int]), 6) p95 from y"
)
def percentile_exclusive(spark, sf_dir):
    rows = evaluate.percentiles_exclusive(table(spark, sf_dir, "events"), "event_type", "value", 0.95)
    return rows.select("event_type", F.round("percentile", 6).alias("p95"))


@query(
    "select user_id, q, round(percentile, 6) percentile from (select user_id, unnest([0.0, 0.5, 0.9]) q, unnest([quantile_cont(x, 0.0), quantile_cont(x, 0.5), quantile_cont(x, "
    "0.9)]) percentile from (select user_id % 7 user_id, case when event_id % 997 = 0 then value * 1e9 else value end x from events) group by user_id)"
)
def heavy_percentiles(spark, sf_dir):
    """Few keys, some values a thousand million times as large as the others."""
    e = table(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("user_id"), F.when(F.col("event_id") % 997 == 0, F.col("value") * 1e9).otherwise(F.col("value")).alias("x"))
    return evaluate.percentiles(e, ["user_id"], "x", [0.0, 0.5, 0.9]).withColumn("percentile", F.round("percentile", 6))


_LEVELS = "lv as (select l_linenumber users, avg(l_quantity::double) + l_linenumber as seconds, l_linenumber < 5 stable from lineitem group by l_linenumber)"


@query(
    f"with {_LEVELS}, x as (select *, min(stable::int) over (order by users) so_far, first_value(seconds) over (order by users) base from lv) select round(regr_slope(seconds, users), "
    f"6) slope, max(case when so_far = 1 then users end) most_users, min(case when seconds > 2 * base then users end) breaking_users from x"
)
def scalability(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("users")).agg(F.avg(F.col("l_quantity").cast("double")).alias("s"))
    return evaluate.scalability(rows.select("users", (F.col("s") + F.col("users")).alias("seconds"), (F.col("users") < 5).alias("stable")))


@query(
    "with s as (select event_type test, ts, event_id, value memory, value seconds_, user_id % 9 > 0 as ok, row_number() over (partition by event_type order by ts, event_id) a, "
    "row_number() over (partition by event_type order by ts desc, event_id desc) z from events) select test, round(regr_slope(memory, (epoch_us(ts) // 1000000) / 3600.0), 6) memory_slope, "
    "round(avg(memory) filter (a <= 3), 6) as first, round(avg(memory) filter (z <= 3), 6) as last, avg(memory) filter (z <= 3) > 1.2 * avg(memory) filter (a <= 3) leak, round((least(1.0, "
    "avg(ok::int) / 0.95) + greatest(0.0, 1 - stddev_samp(seconds_) / avg(seconds_)) + greatest(0.0, 1 - 10 * avg((not ok)::int))) / 3, 6) stability from s group by 1"
)
def endurance(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("test"), "ts", F.col("event_id").alias("sample_id"), F.col("value").alias("memory"), F.col("value").alias("seconds"), (F.col("user_id") % 9 > 0).alias("ok"))
    return evaluate.endurance(rows)


@query(
    f"with {_OPS}, a as (select operation, avg(duration) x from ops where user_id % 2 = 0 group by 1), b as (select operation, avg(duration) y from ops where user_id % 2 = 1 group "
    f"by 1) select operation, round(x, 6) as now, round(y, 6) was, round((x - y) / y, 6) change, (x - y) / y > 0.2 regression from a join b using (operation)"
)
def compare_operations(spark, sf_dir):
    ops = _ops(spark, sf_dir)
    return evaluate.compare_operations(ops.where("user_id % 2 = 0"), ops.where("user_id % 2 = 1"))


_REG = (
    f"{_RUNS}, cur as (select metric, max(value) as value from runs group by 1), base as (select metric, min(value) baseline, count(*) samples from runs group by 1), reg as (select "
    f"metric, baseline, samples, value, (value - baseline) / baseline change from cur join base using (metric)), sev as (select *, case when change >= 1 then 'critical' when change "
    f">= 0.5 then 'severe' when change >= 0.25 then 'moderate' when change >= 0.1 then 'minor' else 'none' end severity from reg)"
)


def _regressions(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    current = runs.groupBy("metric").agg(F.max("value").alias("value"))
    base = runs.groupBy("metric").agg(F.min("value").alias("baseline"), F.count("*").alias("samples"))
    return current, base, evaluate.detect_regressions(current, base)


@query(f"with {_REG} select metric, round(change, 6) change, severity, round(greatest(0.1, least(0.95, least(0.9, samples / 10.0) * least(1.0, 2 * abs(change)))), 6) confidence from sev")
def detect_regressions(spark, sf_dir):
    return _regressions(spark, sf_dir)[2]


@query(
    f"with {_REG} select metric, round(case when (select count(*) from sev where severity = 'critical') > 0 then baseline else 0.2 * value + 0.8 * baseline end, 6) baseline, samples "
    f"+ case when (select count(*) from sev where severity = 'critical') > 0 then 0 else 1 end samples from sev"
)
def update_baselines(spark, sf_dir):
    current, base, found = _regressions(spark, sf_dir)
    return evaluate.update_baselines(base, current, found)


@query(
    f"with {_RUNS}, x as (select *, row_number() over (partition by metric order by ts desc, run_id desc) n from runs), y as (select metric, count(*) n, round(regr_slope(value, "
    f"-n), 6) slope, round(stddev_samp(value) / avg(value), 6) volatility, round(avg(value), 6) mean, round(avg(value) filter (n <= 5), 6) recent from x where n <= 30 group by "
    f"1) select *, case when slope < 0 then 'improving' when slope > 0 then 'degrading' else 'stable' end direction from y where n >= 5"
)
def metric_trends(spark, sf_dir):
    return evaluate.metric_trends(_runs(spark, sf_dir))


@query(f"with {_REG} select metric as name, round(abs(value - baseline) / abs(baseline), 6) deviation, abs(value - baseline) / abs(baseline) <= 0.3 passed from reg")
def tolerance_check(spark, sf_dir):
    current, base, _ = _regressions(spark, sf_dir)
    return evaluate.tolerance_check(current.withColumnRenamed("metric", "name"), base.withColumnRenamed("metric", "name").withColumn("tolerance", F.lit(0.3)))


_SAT = (
    "sat as (select l_orderkey, l_linenumber, greatest(1.0, least(5.0, 3.0 + (d * 10 - 0.5) * 2 + case when q / 50 > 0.9 then 0.3 when q / 50 < 0.6 then -0.5 else 0 end + case "
    "when q < 5 then 0.2 when q > 15 then -0.3 else 0 end + case when l_linenumber % 2 = 0 then 0.2 else 0 end)) score from (select *, l_discount::double d, l_quantity::double "
    "q from lineitem))"
)


def _satisfaction(spark, sf_dir):
    q = F.col("l_quantity").cast("double")
    score = evaluate.satisfaction(F.col("l_discount").cast("double") * 10, q / 50, q, F.col("l_linenumber") % 2 == 0)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(score, 6).alias("score"))


@query(f"with {_SAT} select l_orderkey, l_linenumber, round(score, 6) score from sat")
def satisfaction(spark, sf_dir):
    return _satisfaction(spark, sf_dir)


@query(
    f"with {_SAT} select case when round(score, 6) >= 4.5 then 'excellent' when round(score, 6) >= 3.5 then 'good' when round(score, 6) >= 2.5 then 'fair' else 'poor' end band, "
    f"count(*) n, round(100.0 * count(*) / (select count(*) from sat), 6) percent from sat group by 1"
)
def satisfaction_histogram(spark, sf_dir):
    return evaluate.satisfaction_histogram(_satisfaction(spark, sf_dir))


@query(
    "with t as (select l_linenumber * 10 users, avg((l_tax::double > 0.0)::int) success, avg(l_quantity::double) / 3 mean, count(*)::double rate from lineitem group by 1) select "
    "max(case when success >= 0.85 + 0.1 and mean <= 10 then users end)::bigint most_users, max(rate) peak_rate, round(max(case when users = 50 then mean end), 6) mean_at_50 from "
    "t"
)
def load_rollup(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy((F.col("l_linenumber") * 10).alias("users")).agg(F.avg((F.col("l_tax").cast("double") > 0.0).cast("double")).alias("success"), (F.avg(F.col("l_quantity").cast("double")) / 3).alias("mean"), F.count("*").cast("double").alias("rate"))
    return evaluate.load_rollup(rows).select(F.col("most_users").cast("long").alias("most_users"), "peak_rate", F.round("mean_at_50", 6).alias("mean_at_50"))


@query(f"with {_OPS} select count_if(ok)::bigint as ok, count_if(not ok)::bigint failed, round(avg(duration) filter (ok), 6) mean, max(duration) filter (ok) most, bool_and(not ok or duration <= 100000) as within from ops")
def benchmark_rollup(spark, sf_dir):
    return evaluate.benchmark_rollup(_ops(spark, sf_dir).select("ok", F.col("duration").alias("seconds"), F.lit(100000.0).alias("bound")))


@query("select c_custkey::varchar as name, case c_custkey % 4 when 0 then c_acctbal::double >= 100 when 1 then c_acctbal::double < 5000 when 2 then c_acctbal::double = 7 else false end ok from customer")
def expected_metrics(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer")
    actual = rows.where(k % 4 < 3).select(k.cast("string").alias("name"), F.col("c_acctbal").cast("double").alias("value"))
    expected = rows.select(k.cast("string").alias("name"), F.when(k % 4 == 0, ">=100").when(k % 4 == 1, "<5000").otherwise("7").alias("bound"))
    return evaluate.expected_metrics(actual, expected)


@query(
    "with s as (select case user_id % 3 when 0 then 'end_to_end' when 1 then 'regression' else 'other' end suite, user_id % 7 > 0 passed, user_id % 2 = 0 critical from events) "
    "select avg(passed::int) filter (suite = 'end_to_end') end_to_end, avg(passed::int) filter (suite = 'regression') regression, 0.0::double acceptance, count_if(critical and "
    "not passed)::bigint critical_failures, round((avg(passed::int) filter (suite = 'end_to_end') + avg(passed::int) filter (suite = 'regression')) / 3, 6) overall from s"
)
def quality_rollup(spark, sf_dir):
    u = F.col("user_id")
    rows = table(spark, sf_dir, "events").select(F.when(u % 3 == 0, "end_to_end").when(u % 3 == 1, "regression").otherwise("other").alias("suite"), (u % 7 > 0).alias("passed"), (u % 2 == 0).alias("critical"))
    return evaluate.quality_rollup(rows)


@query("select event_id, case when contains(event_type, 'view') or contains(event_type, 'sign') then 'real_time' else 'knowledge_base' end kind from events")
def keyword_kind(spark, sf_dir):
    """Keyword classification of event names with other words than the default ones."""
    return table(spark, sf_dir, "events").select("event_id", F.when(T.any_of(F.col("event_type"), ["view", "sign"]), "real_time").otherwise("knowledge_base").alias("kind"))
