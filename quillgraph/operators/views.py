"""Views of alerts, errors, operations, logs, runs and routes: small tables out of large ones."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T

#: Bounds of the views, in per cent and seconds.
ERROR_PERCENT, SLOW_SECONDS = 5.0, 2.0
RESOURCES = {"cpu": 80.0, "memory": 85.0, "disk": 90.0}
ERRORS_AN_HOUR = 10
#: Points of the categories of a diagnosis, and the share that a status keeps.
HEALTH_POINTS = {"system_info": 10, "resource_usage": 20, "network_connectivity": 15, "process_status": 20, "file_system": 10, "database_connectivity": 15, "application_health": 20, "log_analysis": 5, "performance_metrics": 15}
HEALTH_SHARE = {"success": 1.0, "healthy": 1.0, "warning": 0.7, "critical": 0.3, "unhealthy": 0.3}


def _since(as_of: str, hours: int) -> Column:
    return F.lit(as_of).cast("timestamp") - F.expr(f"interval {hours} hours")


def _top(rows: DataFrame, by: Sequence[Column], most: int) -> DataFrame:
    """The first ``most`` rows in an order, with their place; only these are ever sorted in one task."""
    first = rows.orderBy(*by).limit(most)
    return first.withColumn("place", F.row_number().over(Window.orderBy(*by)))  # ``most`` rows


# ---- alerts and health


def alert_list(alerts: DataFrame, most: int = 50, active: bool | None = None, severities: Sequence[str] = (), since: str | None = None) -> DataFrame:
    """(place, alert_id, severity, component, ts, resolved), newest first: all alerts, or those that are active or not, of some severities, since a time.

    Ties in time are in order of ids; a null ``resolved`` is active; alerts without a time come last.
    """
    rows = alerts.withColumn("resolved", F.coalesce("resolved", F.lit(False)))
    if active is not None:
        rows = rows.where(F.col("resolved") != active)
    if severities:
        rows = rows.where(F.col("severity").isin(*severities))
    if since is not None:
        rows = rows.where(F.col("ts") >= F.lit(since).cast("timestamp"))
    return _top(rows, [F.col("ts").desc_nulls_last(), F.col("alert_id")], most).select("place", "alert_id", "severity", "component", "ts", "resolved")


def overall_health(alerts: DataFrame, as_of: str) -> DataFrame:
    """One row: (status, active, critical, error, warning, last_day). Active critical alerts make it critical, errors degraded, any others warning, none healthy."""
    open_ = ~F.coalesce("resolved", F.lit(False))
    of = lambda severity: F.count_if(open_ & (F.col("severity") == severity))
    row = alerts.agg(F.count_if(open_).alias("active"), of("critical").alias("critical"), of("error").alias("error"), of("warning").alias("warning"), F.count_if(F.col("ts") >= _since(as_of, 24)).alias("last_day"))
    status = F.when(F.col("critical") > 0, "critical").when(F.col("error") > 0, "degraded").when(F.col("active") > 0, "warning").otherwise("healthy")
    return row.select(status.alias("status"), "active", "critical", "error", "warning", "last_day")


def operation_health(metrics: DataFrame) -> DataFrame:
    """(operation, status, error_percent, issues) of each operation (calls, failed, mean): degraded by errors or time, inactive without calls."""
    percent = F.round(100.0 * F.col("failed") / F.greatest("calls", F.lit(1)), 2)
    failing, slow = percent > ERROR_PERCENT, F.col("mean") > SLOW_SECONDS
    status = F.when(F.col("calls") == 0, "inactive").when(failing | slow, "degraded").otherwise("healthy")
    issues = F.concat_ws("; ", F.when(failing, "high error rate"), F.when(slow, "slow"), F.when(F.col("calls") == 0, "no recent activity"))
    return metrics.select("operation", status.alias("status"), percent.alias("error_percent"), issues.alias("issues"))


def worst_operations(metrics: DataFrame, most: int = 5) -> DataFrame:
    """(list, place, operation, value): the slowest operations by mean, all of them, those beyond the bound, and those with most errors beyond the bound."""
    percent = 100.0 * F.col("failed") / F.greatest("calls", F.lit(1))
    lists = {"slowest": (F.col("mean"), F.col("mean").isNotNull()), "slow": (F.col("mean"), F.col("mean") > SLOW_SECONDS), "error_prone": (percent, percent > ERROR_PERCENT)}
    parts = []
    for name, (value, wanted) in lists.items():
        rows = metrics.where(wanted).select("operation", value.alias("value"))
        parts.append(_top(rows, [F.col("value").desc(), F.col("operation")], most).select(F.lit(name).alias("list"), "place", "operation", F.round("value", 6).alias("value")))
    return reduce(DataFrame.unionByName, parts)


def resource_warnings(samples: DataFrame, bounds: Mapping[str, float] = RESOURCES) -> DataFrame:
    """(host, resource, percent): the newest sample (ts, sample_id) of each host, where a resource is beyond its bound; nulls are not."""
    newest = samples.groupBy("host").agg(F.max_by(F.struct(*bounds), F.struct("ts", "sample_id")).alias("s"))
    each = F.array(*(F.struct(F.lit(r).alias("resource"), F.col(f"s.{r}").alias("percent"), F.lit(b).alias("bound")) for r, b in bounds.items()))
    return newest.select("host", F.inline(each)).where("percent > bound").select("host", "resource", "percent")


# ---- errors


def error_breakdown(errors: DataFrame, as_of: str, most: int = 5) -> DataFrame:
    """(by, value, n): errors of the last day by category and by severity, and the most common pairs of category and type of all time."""
    daily = errors.where(F.col("ts") >= _since(as_of, 24))
    parts = [daily.groupBy(F.col(c).alias("value")).agg(F.count("*").alias("n")).select(F.lit(c).alias("by"), "value", "n") for c in ("category", "severity")]
    common = errors.groupBy(F.concat_ws("_", "category", "error_type").alias("value")).agg(F.count("*").alias("n"))
    parts.append(_top(common, [F.col("n").desc(), F.col("value")], most).select(F.lit("common").alias("by"), "value", "n"))
    return reduce(DataFrame.unionByName, parts)


def error_totals(errors: DataFrame, as_of: str, open_breakers: int = 0) -> DataFrame:
    """One row: errors in all, of the last hour and day, and the alerts that follow from them (high_error_rate, breakers_open)."""
    row = errors.agg(F.count("*").alias("total"), F.count_if(F.col("ts") >= _since(as_of, 1)).alias("last_hour"), F.count_if(F.col("ts") >= _since(as_of, 24)).alias("last_day"))
    return row.withColumns({"high_error_rate": F.col("last_hour") > ERRORS_AN_HOUR, "breakers_open": F.lit(open_breakers > 0)})


def retained_errors(errors: DataFrame, as_of: str, hours: int = 24) -> DataFrame:
    """The errors that are kept; older ones, and those without a time, go."""
    return errors.where(F.col("ts") >= _since(as_of, hours))


# ---- queues, logs, queries


def queue_users(requests: DataFrame, as_of: str) -> DataFrame:
    """(user_id, waiting, oldest_seconds) of the requests that have not expired; a request without a time or a limit has."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("created_at")
    return requests.withColumn("age", age).where(F.col("age") <= F.col("timeout")).groupBy("user_id").agg(F.count("*").alias("waiting"), F.max("age").alias("oldest_seconds"))


def worst_log(levels: DataFrame) -> DataFrame:
    """One row: the worst status of all files, and the sums of errors and warnings; healthy without files."""
    rank = F.when(F.col("status") == "critical", 2).when(F.col("status") == "warning", 1).otherwise(0)
    row = levels.agg(F.coalesce(F.max(rank), F.lit(0)).alias("r"), F.coalesce(F.sum("errors"), F.lit(0)).alias("errors"), F.coalesce(F.sum("warnings"), F.lit(0)).alias("warnings"))
    return row.select(F.when(F.col("r") == 2, "critical").when(F.col("r") == 1, "warning").otherwise("healthy").alias("status"), "errors", "warnings")


def health_score(diagnostics: DataFrame) -> DataFrame:
    """One row: (points, percent) of categories (category, status): each gives its points by its status, one that is missing or has another status none."""
    points = F.create_map(*(F.lit(x) for pair in HEALTH_POINTS.items() for x in (pair[0], float(pair[1]))))
    share = F.create_map(*(F.lit(x) for pair in HEALTH_SHARE.items() for x in pair))
    one = diagnostics.groupBy("category").agg(F.min("status").alias("status"))
    total = F.coalesce(F.sum(F.try_element_at(points, F.col("category")) * F.coalesce(F.try_element_at(share, F.col("status")), F.lit(0.0))), F.lit(0.0))
    return one.agg(F.round(total, 6).alias("points"), F.round(100 * total / sum(HEALTH_POINTS.values()), 6).alias("percent"))


def query_totals(log: DataFrame, as_of: str) -> DataFrame:
    """(kind, queries, mean_seconds, success_rate) of the last day, for all queries (null kind) and by kind."""
    recent = log.where(F.col("ts") >= _since(as_of, 24))
    return recent.rollup("kind").agg(F.count("*").alias("queries"), F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.round(F.avg(F.col("ok").cast("double")), 6).alias("success_rate"))


# ---- documents and operations


def ingestion_timeline(docs: DataFrame, ts: str = "ingested_at") -> DataFrame:
    """(day, documents, mean_chars) by day of ingestion; a null day is a group of its own."""
    return docs.groupBy(F.to_date(ts).alias("day")).agg(F.count("*").alias("documents"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


def top_authors(docs: DataFrame, most: int = 10, authors: str = "authors") -> DataFrame:
    """(place, author, documents): who wrote most documents; an author counts once for a document, blank names don't count."""
    named = docs.select(F.explode(F.array_distinct(F.transform(authors, lambda a: F.trim(a)))).alias("author")).where("author <> ''")
    return _top(named.groupBy("author").agg(F.count("*").alias("documents")), [F.col("documents").desc(), F.col("author")], most).select("place", "author", "documents")


def operation_history(operations: DataFrame, most: int = 10) -> DataFrame:
    """(operation_type, place, operation_id, status, started): the newest operations of each type.

    The newest are taken within parts of a type first, so a type with most of the rows is not sorted in one task.
    """
    newest = [F.col("started").desc_nulls_last(), F.col("operation_id")]
    parts = operations.withColumn("part", F.pmod(F.xxhash64("operation_id"), F.lit(16)))
    some = parts.withColumn("place", F.row_number().over(Window.partitionBy("operation_type", "part").orderBy(*newest))).where(F.col("place") <= most)
    rows = some.withColumn("place", F.row_number().over(Window.partitionBy("operation_type").orderBy(*newest))).where(F.col("place") <= most)
    return rows.select("operation_type", "place", "operation_id", "status", "started")


def operation_pace(operations: DataFrame, as_of: str) -> DataFrame:
    """One row: (operations, success_rate, mean_seconds, per_hour): the mean is of completed ones, the pace of the last day over the span that it really has."""
    recent = F.when(F.col("started") >= _since(as_of, 24), F.unix_timestamp("started"))
    hours = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.min(recent)) / 3600.0
    done = F.col("status") == "completed"
    pace = F.when(hours > 0, F.count(recent) / hours).otherwise(0.0)
    return operations.agg(F.count("*").alias("operations"), F.round(F.avg(done.cast("double")), 6).alias("success_rate"), F.round(F.avg(F.when(done, F.col("seconds"))), 6).alias("mean_seconds"), F.round(F.coalesce(pace, F.lit(0.0)), 6).alias("per_hour"))


# ---- runs, criteria, baselines


def criteria_verdict(criteria: DataFrame) -> DataFrame:
    """One row: (passed, failed): whether all criteria (criterion, ok) hold, and those that don't in order; a null is no pass, no criteria are one."""
    bad = ~F.coalesce("ok", F.lit(False))
    return criteria.agg((F.count_if(bad) == 0).alias("passed"), F.array_join(F.array_sort(F.collect_list(F.when(bad, F.col("criterion")))), ",").alias("failed"))  # a handful of criteria


def last_runs(runs: DataFrame, most: int = 5) -> DataFrame:
    """(metric, place, run_id, value): the newest runs of each metric."""
    newest = Window.partitionBy("metric").orderBy(F.col("ts").desc(), F.col("run_id").desc())
    return runs.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most).select("metric", "place", "run_id", "value")


def scalability_report(levels: DataFrame) -> DataFrame:
    """One row over load levels (users, rate, memory): (efficiency, linear_up_to, memory_per_user).

    Efficiency is the mean share of the throughput that growth in line with the first level would give (1 for one level); throughput grows in line up to the level before the first
    whose growth is less than half of that before it, else up to the last. Levels without users are left out of both means. No rows give nulls.
    """
    w = Window.orderBy("users")  # a row for each load level
    first_rate, first_users = F.first("rate").over(w), F.first("users").over(w)
    growth = (F.col("rate") - F.lag("rate").over(w)) / (F.col("users") - F.lag("users").over(w))
    rows = levels.withColumn("ideal", first_rate / F.when(first_users > 0, first_users) * F.col("users")).withColumn("growth", growth)
    rows = rows.withColumn("slows", F.col("growth") < 0.5 * F.lag("growth").over(w)).withColumn("before", F.lag("users").over(w))
    efficiency = F.avg(F.when((F.col("users") > 0) & (F.col("ideal") > 0), F.col("rate") / F.col("ideal")))
    many = F.count("*") > 1
    return rows.agg(
        F.round(F.when(many, F.coalesce(efficiency, F.lit(1.0))).when(F.count("*") == 1, 1.0), 6).alias("efficiency"),
        F.coalesce(F.min(F.when(F.col("slows"), F.col("before"))), F.max("users")).alias("linear_up_to"),
        F.round(F.avg(F.when(F.col("users") > 0, F.col("memory") / F.col("users"))), 6).alias("memory_per_user"),
    )


def scalability_grade(breaking_users: Column) -> Column:
    """excellent without a breaking point, good from 50 users on, moderate from 25 on, else poor."""
    return F.when(breaking_users.isNull(), "excellent").when(breaking_users >= 50, "good").when(breaking_users >= 25, "moderate").otherwise("poor")


def response_degradation(samples: DataFrame, parts: int = 16) -> DataFrame:
    """(test, first, last, percent, degraded, stable): mean response time of the first and last three samples; degraded above 50 per cent, stable below 20.

    With fewer than three samples the first and the last one count. The ends are found within parts of a test first.
    """
    up, down = [F.col("ts"), F.col("sample_id")], [F.col("ts").desc(), F.col("sample_id").desc()]
    rows = samples.where("seconds is not null").select("test", "ts", "sample_id", "seconds", F.pmod(F.xxhash64("sample_id"), F.lit(parts)).alias("part"))
    sizes = rows.groupBy("test").agg(F.when(F.count("*") >= 3, 3).otherwise(1).alias("size"))
    for name, order in (("first", up), ("last", down)):
        some = rows.withColumn("n", F.row_number().over(Window.partitionBy("test", "part").orderBy(*order))).where("n <= 3")
        some = some.withColumn("n", F.row_number().over(Window.partitionBy("test").orderBy(*order)))
        ends = some.join(sizes.select(F.col("test").alias("of"), F.col("size").alias("most")), (F.col("test") == F.col("of")) & (F.col("n") <= F.col("most")))
        sizes = sizes.join(ends.groupBy("test").agg(F.avg("seconds").alias(name)), "test")
    percent = F.when(F.col("first") != 0, 100 * (F.col("last") - F.col("first")) / F.col("first"))
    return sizes.select("test", F.round("first", 6).alias("first"), F.round("last", 6).alias("last"), F.round(percent, 6).alias("percent"), (percent > 50).alias("degraded"), (percent < 20).alias("stable"))


def baseline_intervals(baselines: DataFrame, run: DataFrame) -> DataFrame:
    """(metric, low, high) after a run (metric, value): 5 per cent around the value, widened by what was there if that rests on more than one sample.

    ``baselines`` has metric, samples, low, high; metrics that are not in the run stay, new ones start at the run's.
    """
    rows = baselines.join(run.select("metric", "value"), "metric", "full_outer")
    around = lambda part: F.col("value") * part
    keep = F.coalesce(F.col("samples") > 1, F.lit(False))
    low = F.when(F.col("value").isNull(), F.col("low")).when(keep, F.least("low", around(0.95))).otherwise(around(0.95))
    high = F.when(F.col("value").isNull(), F.col("high")).when(keep, F.greatest("high", around(1.05))).otherwise(around(1.05))
    return rows.select("metric", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def tolerance_of_values(current: DataFrame, baselines: DataFrame) -> DataFrame:
    """(name, deviation, passed) for values of any kind as text: numbers by relative deviation (absolute where the baseline is 0), all else, as true and false, by equality.

    ``baselines`` has name, baseline, kind (number, boolean or text) and tolerance. A number that can't be read is no pass, with a null deviation.
    """
    v, b = F.col("value").try_cast("double"), F.col("baseline").try_cast("double")
    numeric = F.when(b == 0, F.abs(v)).otherwise(F.abs(v - b) / F.abs(b))
    equal = F.col("value").eqNullSafe(F.when(F.col("kind") == "boolean", F.lower("baseline")).otherwise(F.col("baseline")))
    deviation = F.when(F.col("kind") == "number", numeric).otherwise(F.when(equal, 0.0).otherwise(1.0))
    passed = F.when(F.col("kind") == "number", F.coalesce(numeric <= F.col("tolerance"), F.lit(False))).otherwise(equal)
    return current.join(baselines, "name").select("name", F.round(deviation, 6).alias("deviation"), passed.alias("passed"))


def new_baselines(results: DataFrame, known: DataFrame) -> DataFrame:
    """(name, baseline) of the tests that passed and have none yet; failed tests set no baseline."""
    return results.where("passed").join(known.select("name"), "name", "left_anti").groupBy("name").agg(F.min("value").alias("baseline"))


def memory_rollup(metrics: DataFrame) -> DataFrame:
    """One row: (mean_memory, most_memory, memory_within) of the operations that went well (ok, memory, memory_bound)."""
    good = F.when(F.col("ok"), F.col("memory"))
    return metrics.agg(F.round(F.avg(good), 6).alias("mean_memory"), F.max(good).alias("most_memory"), F.bool_and(~F.col("ok") | (F.col("memory") <= F.col("memory_bound"))).alias("memory_within"))


# ---- routes and confidence


def routing_sources(strategy: Column) -> Column:
    """(primary, fallback) of a routing strategy: which source is asked first, and which one if it fails; none for parallel questions."""
    web = strategy.isin("web_only", "web_first")
    primary = F.when(strategy == "parallel", "both").when(web, "web").otherwise("kb")
    fallback = F.when(strategy == "parallel", F.lit(None).cast("string")).when(web, "kb").otherwise("web")
    return F.struct(primary.alias("primary"), fallback.alias("fallback"))


def routing_totals(log: DataFrame) -> DataFrame:
    """One row: (requests, success_rate, fallback_rate, error_rate, mean_seconds) of a log (ok, fell_back, seconds)."""
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return log.agg(F.count("*").alias("requests"), rate(F.col("ok")).alias("success_rate"), rate(F.col("fell_back")).alias("fallback_rate"), rate(~F.col("ok")).alias("error_rate"), F.round(F.avg("seconds"), 6).alias("mean_seconds"))


def confidence_bands(classified: DataFrame) -> DataFrame:
    """(query_type, band, n): classifications by type and band of confidence (high from 0.8 on, medium from 0.5 on, low); a null confidence is low."""
    c = F.col("confidence")
    band = F.when(c >= 0.8, "high").when(c >= 0.5, "medium").otherwise("low")
    return classified.groupBy("query_type", band.alias("band")).agg(F.count("*").alias("n"))


def consolidated_numbers(sources: DataFrame) -> DataFrame:
    """(id, number, citation, to_number): numbers of sources that may cite several articles.

    A citation takes the smallest source number that cites it; the second, third and further citation of one source, in their order, take steps of 0.1 above
    it. ``sources`` has id, number and citations (an array).
    """
    rows = sources.select("id", "number", F.posexplode("citations").alias("step", "citation"))
    low = rows.groupBy("id", "citation").agg(F.min(F.struct("number", "step")).alias("f"))
    first = F.round(F.col("f.number") + 0.1 * F.col("f.step"), 1).alias("to_number")
    return rows.join(low.select("id", "citation", first), ["id", "citation"]).select("id", "number", "citation", "to_number")


def confidence_explanation(base: Column, final: Column, factors: Mapping[str, Column], good: Column, total: Column) -> Column:
    """A confidence in words: its level, how far it is above its base, the factors that are not 0, and how many of the sources are good."""
    shown = lambda c: F.format_number(c, 2)
    lines = [F.concat(F.lit("Confidence is "), F.lower(T.confidence_level(final)), F.lit(" ("), shown(final), F.lit(")"))]
    lines.append(F.when(final != base, F.concat(F.lit("raised from "), shown(base))))
    lines += [F.when(c > 0, F.concat(F.lit(f"{name}: "), shown(c))) for name, c in factors.items()]
    lines.append(F.when(total > 0, F.concat(F.lit("good sources: "), good.cast("string"), F.lit(" of "), total.cast("string"))))
    return F.concat_ws("; ", *lines)


def extraction_with_errors(candidates: Mapping[str, tuple[Column, Column]]) -> Column:
    """(value, method, errors): the first of several extractions (name -> value, error) that is not blank, and the errors of those before it."""
    value = F.coalesce(*(F.when(F.trim(v) != "", v) for v, _ in candidates.values()))
    method = F.coalesce(*(F.when(F.trim(v) != "", F.lit(n)) for n, (v, _) in candidates.items()))
    failed, errors = F.lit(True), []
    for name, (v, e) in candidates.items():
        failed = failed & (F.coalesce(F.trim(v), F.lit("")) == "")
        errors.append(F.when(failed & e.isNotNull(), F.concat(F.lit(f"{name}: "), e)))
    return F.struct(value.alias("value"), method.alias("method"), F.array_compact(F.array(*errors)).alias("errors"))
