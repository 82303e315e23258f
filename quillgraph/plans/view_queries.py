"""Queries of the views of alerts, errors, operations, logs, runs and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.operators import telemetry, views
from quillgraph.plans.registry import query, table
from quillgraph.plans.telemetry_queries import _METRICS, _OPS, _REG, AS_OF, _ops, _regressions, _runs

_ALERTS = "al as (select event_id alert_id, case event_type when 'error' then 'critical' when 'click' then 'error' when 'view' then 'warning' else 'info' end severity, 'c' || user_id % 3 component, ts, user_id % 5 = 0 resolved from events)"


def _alerts(spark, sf_dir):
    kind = F.col("event_type")
    severity = F.when(kind == "error", "critical").when(kind == "click", "error").when(kind == "view", "warning").otherwise("info")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("alert_id"), severity.alias("severity"), F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("component"), "ts", (F.col("user_id") % 5 == 0).alias("resolved"))


@query(
    f"with {_ALERTS} select row_number() over (order by ts desc, alert_id)::int place, alert_id, severity, component, epoch_us(ts) us, resolved from al where not resolved and severity "
    f"in ('critical', 'error') and ts >= timestamp '{AS_OF}' - interval 10 days order by ts desc, alert_id limit 50"
)
def active_alerts(spark, sf_dir):
    rows = views.alert_list(_alerts(spark, sf_dir), 50, True, ["critical", "error"], "2024-01-10 12:00:00")
    return rows.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp"))).drop("ts")


@query(
    f"with {_ALERTS} select 'critical' status, count_if(not resolved)::bigint active, count_if(not resolved and severity = 'critical')::bigint critical, count_if(not resolved and "
    f"severity = 'error')::bigint error, count_if(not resolved and severity = 'warning')::bigint warning, count_if(ts >= timestamp '{AS_OF}' - interval 24 hours)::bigint last_day "
    f"from al"
)
def overall_health(spark, sf_dir):
    return views.overall_health(_alerts(spark, sf_dir), AS_OF)


@query(
    f"with {_METRICS} select operation, case when failed * 100.0 / calls > 5 or mean > 2 then 'degraded' else 'healthy' end status, round(100.0 * failed / calls, 2) error_percent, "
    f"concat_ws('; ', case when round(100.0 * failed / calls, 2) > 5 then 'high error rate' end, case when mean > 2 then 'slow' end) issues from met"
)
def operation_health(spark, sf_dir):
    return views.operation_health(telemetry.operation_metrics(_ops(spark, sf_dir)))


@query(
    f"with {_METRICS}, li as (select 'slowest' list, operation, mean as value from met union all select 'slow', operation, mean from met where mean > 2 union all select 'error_prone', "
    f"operation, 100.0 * failed / calls from met where 100.0 * failed / calls > 5) "
    "select list, place::int place, operation, round(value, 6) as value from (select *, row_number() over (partition by list order by value desc, operation) place from li) where place <= 3"
)
def worst_operations(spark, sf_dir):
    return views.worst_operations(telemetry.operation_metrics(_ops(spark, sf_dir)), 3)


@query(
    "with s as (select 'h' || user_id % 50 host, arg_max(value * 2, (ts, event_id)) cpu, arg_max(100 - value, (ts, event_id)) memory, arg_max(value + 60, (ts, event_id)) disk "
    "from events group by 1), u as (unpivot s on cpu, memory, disk into name resource value percent) "
    "select host, resource, round(percent, 6) percent from u where percent > case resource when 'cpu' then 80 when 'memory' then 85 else 90 end"
)
def resource_warnings(spark, sf_dir):
    v = F.col("value")
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("h"), (F.col("user_id") % 50).cast("string")).alias("host"), "ts", F.col("event_id").alias("sample_id"), (v * 2).alias("cpu"), (100 - v).alias("memory"), (v + 60).alias("disk"))
    return views.resource_warnings(rows).withColumn("percent", F.round("percent", 6))


_ERRORS = "er as (select event_id, 'k' || user_id % 10 category, event_type severity, 't' || event_id % 4 error_type, ts from events)"


def _errors(spark, sf_dir):
    k = lambda p, c, m: F.concat(F.lit(p), (F.col(c) % m).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", k("k", "user_id", 10).alias("category"), F.col("event_type").alias("severity"), k("t", "event_id", 4).alias("error_type"), "ts")


@query(
    f"with {_ERRORS}, d as (select * from er where ts >= timestamp '{AS_OF}' - interval 24 hours) select 'category' \"by\", category as value, count(*) n from d group by category union all select 'severity', severity, count(*) from d group by severity "
    "union all select * from (select 'common', category || '_' || error_type v, count(*) c from er group by 2 order by c desc, v limit 5)"
)
def error_breakdown(spark, sf_dir):
    return views.error_breakdown(_errors(spark, sf_dir), AS_OF)


@query(
    f"with {_ERRORS} select count(*) total, count_if(ts >= timestamp '{AS_OF}' - interval 1 hour)::bigint last_hour, count_if(ts >= timestamp '{AS_OF}' - interval 24 hours)::bigint "
    f"last_day, count_if(ts >= timestamp '{AS_OF}' - interval 1 hour) > 10 high_error_rate, true breakers_open from er"
)
def error_totals(spark, sf_dir):
    return views.error_totals(_errors(spark, sf_dir), AS_OF, 2)


@query(f"with {_ERRORS} select event_id, category from er where ts >= timestamp '{AS_OF}' - interval 48 hours")
def retained_errors(spark, sf_dir):
    return views.retained_errors(_errors(spark, sf_dir), AS_OF, 48).select("event_id", "category")


_QUEUE = (
    "q as (select o_orderkey request_id, o_custkey user_id, (5 - left(o_orderpriority, 1)::int)::int priority, timestamp '2024-01-20 12:00:00' - (o_orderkey % 200) * interval "
    "1 second created_at, 30 + (o_orderkey % 3) * 50 timeout from orders), live as (select *, epoch(timestamp '2024-01-20 12:00:00' - created_at)::bigint age from q where epoch(timestamp "
    "'2024-01-20 12:00:00' - created_at) <= timeout)"
)


def _queue(spark, sf_dir):
    k = F.col("o_orderkey")
    created = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(secs=(k % 200).cast("decimal(18,6)"))
    return table(spark, sf_dir, "orders").select(k.alias("request_id"), F.col("o_custkey").alias("user_id"), (5 - F.substring("o_orderpriority", 1, 1).cast("int")).alias("priority"), created.alias("created_at"), (30 + k % 3 * 50).alias("timeout"))


@query(f"with {_QUEUE} select user_id, count(*) waiting, max(age) oldest_seconds from live group by 1")
def queue_users(spark, sf_dir):
    """Requests of different ages, of which some have expired."""
    return views.queue_users(_queue(spark, sf_dir), AS_OF)


@query(f"with {_QUEUE}, s as (select priority, count(*) n from live group by 1) select priority, n, round((coalesce(sum(n) over (order by priority desc rows between unbounded preceding and 1 preceding), 0) + n / 2) / 4 * 2.0, 6) wait_seconds from s")
def queue_with_expiry(spark, sf_dir):
    return telemetry.queue_view(_queue(spark, sf_dir), AS_OF)


@query(
    "with t as (select *, row_number() over (partition by source order by doc_id desc) n from documents), f as (select source, count_if(doc_id % 7 = 0)::bigint e, count_if(doc_id "
    "% 5 = 0 and doc_id % 7 > 0)::bigint w from t where n <= 100 group by 1) select case when max(e) > 10 then 'critical' when max(e) > 5 or max(w) > 20 then 'warning' else 'healthy' "
    "end status, sum(e)::bigint errors, sum(w)::bigint warnings from f"
)
def worst_log(spark, sf_dir):
    d = F.col("doc_id")
    line = F.when(d % 7 == 0, "ERROR x").when(d % 5 == 0, "WARNING y").otherwise("INFO")
    return views.worst_log(telemetry.log_levels(table(spark, sf_dir, "documents").select(F.col("source").alias("file"), d.alias("line_no"), line.alias("line"))))


@query(f"select event_type kind, count(*) queries, round(avg(value), 6) mean_seconds, round(avg((user_id % 4 > 0)::int), 6) success_rate from events where ts >= timestamp '{AS_OF}' - interval 24 hours group by rollup (event_type)")
def query_totals(spark, sf_dir):
    log = table(spark, sf_dir, "events").select(F.col("event_type").alias("kind"), "ts", F.col("value").alias("seconds"), (F.col("user_id") % 4 > 0).alias("ok"))
    return views.query_totals(log, AS_OF)


@query("select (date '2024-01-01' + (doc_id % 30)::int)::date as day, count(*) documents, round(avg(n_chars), 6) mean_chars from documents group by 1")
def ingestion_timeline(spark, sf_dir):
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 30).cast("int")).cast("timestamp")
    return views.ingestion_timeline(table(spark, sf_dir, "documents").withColumn("ingested_at", day))


@query(
    "select row_number() over (order by n desc, author)::int place, author, n documents from (select author, count(*) n from (select distinct doc_id, unnest([source, lang, source "
    "|| doc_id % 3]) author from documents) where author <> '' group by 1) order by n desc, author limit 10"
)
def top_authors(spark, sf_dir):
    names = F.array(F.concat(F.lit(" "), "source"), "lang", F.concat("source", (F.col("doc_id") % 3).cast("string")), "source")
    return views.top_authors(table(spark, sf_dir, "documents").withColumn("authors", names))


@query(
    "select event_type operation_type, n::int place, event_id operation_id, status, epoch_us(ts) us from (select *, case when user_id % 3 > 0 then 'completed' else 'failed' end "
    "status, row_number() over (partition by event_type order by ts desc, event_id) n from events) where n <= 7"
)
def operation_history(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("operation_type"), F.col("event_id").alias("operation_id"), F.when(F.col("user_id") % 3 > 0, "completed").otherwise("failed").alias("status"), F.col("ts").alias("started"))
    return views.operation_history(rows, 7).withColumn("us", F.unix_micros(F.col("started").cast("timestamp"))).drop("started")


@query(
    f"with r as (select *, case when ts >= timestamp '{AS_OF}' - interval 24 hours then epoch_us(ts) // 1000000 end t from events) select count(*) operations, round(avg((user_id "
    f"% 3 > 0)::int), 6) success_rate, round(avg(value) filter (user_id % 3 > 0), 6) mean_seconds, round(count(t) / ((epoch(timestamp '{AS_OF}') - min(t)) / 3600.0), 6) per_hour "
    f"from r"
)
def operation_pace(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.when(F.col("user_id") % 3 > 0, "completed").otherwise("failed").alias("status"), F.col("ts").alias("started"), F.col("value").alias("seconds"))
    return views.operation_pace(rows, AS_OF)


@query(f"with {_METRICS} select bool_and(mean <= 30) passed, coalesce(string_agg(operation, ',' order by operation) filter (not mean <= 30), '') failed from met")
def criteria_verdict(spark, sf_dir):
    rows = telemetry.operation_metrics(_ops(spark, sf_dir)).select(F.col("operation").alias("criterion"), (F.col("mean") <= 30).alias("ok"))
    return views.criteria_verdict(rows)


@query(
    "with runs as (select event_type || '_response_time' metric, date_trunc('day', ts) ts, day(ts)::int run_id, avg(value) as value from events group by all) select metric, n::int "
    "place, run_id, round(value, 6) as value from (select *, row_number() over (partition by metric order by ts desc, run_id desc) n from runs) where n <= 5"
)
def last_runs(spark, sf_dir):
    return views.last_runs(_runs(spark, sf_dir)).withColumn("value", F.round("value", 6))


@query(
    "with l as (select l_linenumber users, count(*)::double * l_linenumber rate, avg(l_quantity::double) * l_linenumber memory from lineitem group by 1), g as (select *, (rate "
    "- lag(rate) over w) / (users - lag(users) over w) growth, first_value(rate) over w / first_value(users) over w * users ideal, lag(users) over w before from l window w as "
    "(order by users)), "
    "h as (select *, growth < 0.5 * lag(growth) over (order by users) slows from g) select round(avg(rate / ideal), 6) efficiency, coalesce(min(before) filter (slows), max(users)) linear_up_to, round(avg(memory / users), 6) memory_per_user from h"
)
def scalability_report(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("users")).agg(F.count("*").cast("double").alias("n"), F.avg(F.col("l_quantity").cast("double")).alias("m"))
    return views.scalability_report(rows.select("users", (F.col("n") * F.col("users")).alias("rate"), (F.col("m") * F.col("users")).alias("memory")))


@query("select user_id, case when user_id % 7 = 0 then 'excellent' when user_id % 60 >= 50 then 'good' when user_id % 60 >= 25 then 'moderate' else 'poor' end grade from (select distinct user_id from events)")
def scalability_grade(spark, sf_dir):
    u = F.col("user_id")
    return table(spark, sf_dir, "events").select("user_id").distinct().select("user_id", views.scalability_grade(F.when(u % 7 > 0, u % 60)).alias("grade"))


@query(
    "with s as (select user_id test, value, row_number() over (partition by user_id order by ts, event_id) a, row_number() over (partition by user_id order by ts desc, event_id "
    "desc) z, count(*) over (partition by user_id) n from events), m as (select test, avg(value) filter (a <= case when n >= 3 then 3 else 1 end) f, avg(value) filter (z <= case "
    "when n >= 3 then 3 else 1 end) l from s group by 1) select test, round(f, 6) as first, round(l, 6) as last, round(100 * (l - f) / f, 6) percent, 100 * (l - f) / f > 50 degraded, "
    "100 * (l - f) / f < 20 stable from m"
)
def response_degradation(spark, sf_dir):
    return views.response_degradation(table(spark, sf_dir, "events").select(F.col("user_id").alias("test"), "ts", F.col("event_id").alias("sample_id"), F.col("value").alias("seconds")))


@query(f"with {_REG} select metric, round(case when contains(metric, 'e') then least(baseline * 0.9, value * 0.95) else value * 0.95 end, 6) low, round(case when contains(metric, 'e') then greatest(baseline * 1.1, value * 1.05) else value * 1.05 end, 6) high from reg union all select 'fresh', round(0.95 * 7, 6), round(1.05 * 7, 6)".replace("contains(metric, 'e')", "length(metric) % 2 = 0"))
def baseline_intervals(spark, sf_dir):
    """Every second metric rests on one sample only; one is new."""
    current, base, _ = _regressions(spark, sf_dir)
    base = base.select("metric", F.when(F.length("metric") % 2 == 0, 5).otherwise(1).alias("samples"), (F.col("baseline") * 0.9).alias("low"), (F.col("baseline") * 1.1).alias("high"))
    fresh = current.limit(0).unionByName(spark.createDataFrame([("fresh", 7.0)], "metric string, value double"))
    return views.baseline_intervals(base, current.unionByName(fresh))


@query(
    "select c_custkey::varchar as name, case c_custkey % 3 when 0 then round(case when c_custkey % 2 = 0 then abs(c_acctbal::double - 100) / 100 else abs(c_acctbal::double) end, "
    "6) when 1 then case when c_custkey % 2 = 0 then 0.0 else 1.0 end else case when c_mktsegment = 'BUILDING' then 0.0 else 1.0 end end deviation, case c_custkey % 3 when 0 then "
    "case when c_custkey % 2 = 0 then abs(c_acctbal::double - 100) / 100 <= 5 else abs(c_acctbal::double) <= 5 end when 1 then c_custkey % 2 = 0 else c_mktsegment = 'BUILDING' "
    "end passed from customer"
)
def tolerance_of_values(spark, sf_dir):
    """Balances as numbers, flags, and segments as text."""
    k, rows = F.col("c_custkey"), table(spark, sf_dir, "customer")
    value = F.when(k % 3 == 0, F.col("c_acctbal").cast("string")).when(k % 3 == 1, F.when(k % 2 == 0, "true").otherwise("false")).otherwise(F.col("c_mktsegment"))
    base = F.when(k % 3 == 0, F.when(k % 2 == 0, "100").otherwise("0")).when(k % 3 == 1, "True").otherwise("BUILDING")
    kind = F.when(k % 3 == 0, "number").when(k % 3 == 1, "boolean").otherwise("text")
    name = k.cast("string").alias("name")
    return views.tolerance_of_values(rows.select(name, value.alias("value")), rows.select(name, base.alias("baseline"), kind.alias("kind"), F.lit(5.0).alias("tolerance")))


@query("select c_custkey::varchar as name, c_acctbal::double baseline from customer where c_custkey % 2 = 0 and c_custkey % 3 > 0")
def new_baselines(spark, sf_dir):
    k, rows = F.col("c_custkey"), table(spark, sf_dir, "customer")
    name = k.cast("string").alias("name")
    return views.new_baselines(rows.select(name, F.col("c_acctbal").cast("double").alias("value"), (k % 2 == 0).alias("passed")), rows.where(k % 3 == 0).select(name))


@query(f"with {_OPS} select round(avg(duration * 3) filter (ok), 6) mean_memory, max(duration * 3) filter (ok) most_memory, bool_and(not ok or duration * 3 <= 100) memory_within from ops")
def memory_rollup(spark, sf_dir):
    return views.memory_rollup(_ops(spark, sf_dir).select("ok", (F.col("duration") * 3).alias("memory"), F.lit(100.0).alias("memory_bound")))


_STRATEGIES = "(['kb_only', 'kb_first', 'web_only', 'web_first', 'parallel'])[1 + event_id % 5]"


@query(
    f"select event_id, s strategy, case when s = 'parallel' then 'both' when s in ('web_only', 'web_first') then 'web' else 'kb' end \"primary\", case when s = 'parallel' then "
    f"null when s in ('web_only', 'web_first') then 'kb' else 'web' end fallback from (select event_id, {_STRATEGIES} s from events)"
)
def routing_sources(spark, sf_dir):
    strategy = F.get(F.array(*(F.lit(s) for s in ("kb_only", "kb_first", "web_only", "web_first", "parallel"))), (F.col("event_id") % 5).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", strategy.alias("strategy"))
    return rows.select("event_id", "strategy", views.routing_sources(F.col("strategy")).alias("s")).select("event_id", "strategy", "s.*")


@query("select count(*) requests, round(avg((user_id % 4 > 0)::int), 6) success_rate, round(avg((user_id % 5 = 0)::int), 6) fallback_rate, round(avg((user_id % 4 = 0)::int), 6) error_rate, round(avg(value), 6) mean_seconds from events")
def routing_totals(spark, sf_dir):
    u = F.col("user_id")
    return views.routing_totals(table(spark, sf_dir, "events").select((u % 4 > 0).alias("ok"), (u % 5 == 0).alias("fell_back"), F.col("value").alias("seconds")))


@query("select event_type query_type, case when user_id % 10 >= 8 then 'high' when user_id % 10 >= 5 then 'medium' else 'low' end band, count(*) n from events group by all")
def confidence_bands(spark, sf_dir):
    return views.confidence_bands(table(spark, sf_dir, "events").select(F.col("event_type").alias("query_type"), (F.col("user_id") % 10 / 10).alias("confidence")))


@query(
    "with s as (select o_orderkey id, unnest([1, 2, 3]) number, unnest([[o_orderkey % 4, o_orderkey % 3 + 10], [o_custkey % 4], [o_orderkey % 3 + 10, o_custkey % 5, 99]]) c from "
    "orders), r as (select id, number, unnest(range(len(c))) step, unnest(c)::varchar citation from s), "
    "f as (select id, citation, min((number, step)) m from r group by all) select r.id, r.number, r.citation, round(m[1] + 0.1 * m[2], 1)::double to_number from r join f using (id, citation)"
)
def consolidated_numbers(spark, sf_dir):
    """Three sources an order, with up to three citations each, some of them shared."""
    o, c = F.col("o_orderkey"), F.col("o_custkey")
    s = lambda *x: F.array(*(v.cast("string") for v in x))
    each = F.array(*(F.struct(F.lit(n).alias("number"), v.alias("citations")) for n, v in ((1, s(o % 4, o % 3 + 10)), (2, s(c % 4)), (3, s(o % 3 + 10, c % 5, F.lit(99))))))
    return views.consolidated_numbers(table(spark, sf_dir, "orders").select(o.alias("id"), F.inline(each))).withColumn("to_number", F.col("to_number").cast("double"))


@query(
    "select l_orderkey, l_linenumber, concat_ws('; ', 'Confidence is ' || case when f >= 0.8 then 'high' when f >= 0.6 then 'medium' when f >= 0.4 then 'low' else 'very low' end "
    "|| ' (' || format('{:.2f}', f) || ')', case when f <> b then 'raised from ' || format('{:.2f}', b) end, case when d > 0 then 'relevance: ' || format('{:.2f}', d) end, 'good "
    "sources: ' || l_linenumber || ' of 7') explanation "
    "from (select *, l_quantity::int / 50 b, l_quantity::int / 50 * case when l_linenumber % 2 = 0 then 1 else 1.02 end f, l_discount::double d from lineitem)"
)
def confidence_explanation(spark, sf_dir):
    b = F.col("l_quantity").cast("int") / 50
    text = views.confidence_explanation(b, b * F.when(F.col("l_linenumber") % 2 == 0, 1.0).otherwise(1.02), {"relevance": F.col("l_discount").cast("double")}, F.col("l_linenumber"), F.lit(7))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", text.alias("explanation"))


@query(
    "select page_id, case page_id % 3 when 0 then url when 1 then 'second' end as value, case page_id % 3 when 0 then 'layout' when 1 then 'plain' end as method, case page_id "
    "% 3 when 0 then '' when 1 then 'layout: broken' else 'layout: broken|plain: empty' end errors from pages where coalesce(trim(url), '') <> ''"
)
def extraction_with_errors(spark, sf_dir):
    k = F.col("page_id") % 3
    rows = table(spark, sf_dir, "pages").where(F.coalesce(F.trim("url"), F.lit("")) != "")
    found = views.extraction_with_errors({"layout": (F.when(k == 0, F.col("url")).otherwise(" "), F.when(k > 0, "broken")), "plain": (F.when(k < 2, "second"), F.lit("empty"))})
    return rows.select("page_id", found.alias("x")).select("page_id", "x.value", "x.method", F.array_join("x.errors", "|").alias("errors"))
