"""Telemetry in batch: metrics, alerts, caches, queues, sessions, rate limits, breakers."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.runtime import materialise


#: Seconds of a stretch of a key's history: stretches are ordered on their own, then only their sums are.
STRETCH = 3600.0


def _stretch(df: DataFrame, order: str, width: float) -> Column:
    """The number of the stretch that a row's place in time (or any number) falls into; null comes first."""
    place = F.col(order)
    if df.schema[order].dataType.typeName() in ("timestamp", "timestamp_ntz", "date"):
        place = place.cast("timestamp")
    return F.coalesce(F.floor(place.cast("double") / width), F.lit(-(2**62)))


def counter_series(events: DataFrame, name: str = "name", ts: str = "ts", value: str = "value", tie: str = "event_id", width: float = STRETCH) -> DataFrame:
    """``events`` with the ``running`` sum of each counter, in order of time and tie.

    Sums run within stretches of a counter's time, and stretches add up before that: no counter is in one task. Null values add
    nothing, null times come first, null names are one counter; a column called running gives way. No rows give no rows.
    """
    rows = events.drop("running").withColumn("_stretch", _stretch(events, ts, width))
    within = Window.partitionBy(name, "_stretch").orderBy(ts, tie).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("_name").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(F.col(name).alias("_name"), F.col("_stretch").alias("_at")).agg(F.sum(value).alias("_sum"))
    before = sums.select("_name", "_at", F.sum("_sum").over(earlier).alias("_before"))
    own = rows.withColumn("_own", F.sum(value).over(within))
    joined = own.join(before, F.col(name).eqNullSafe(F.col("_name")) & (F.col("_stretch") == F.col("_at")))
    return joined.withColumn("running", F.coalesce(F.col("_own") + F.col("_before"), "_own", "_before")).drop("_stretch", "_own", "_name", "_at", "_before")


def gauge_latest(events: DataFrame, name: str = "name", ts: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """The last value of each gauge, by time and tie; events without a time come before all others, a null name is a gauge. No rows give no rows."""
    return events.groupBy(name).agg(F.max_by(value, F.struct(ts, tie)).alias("value"), F.max(ts).alias("ts"))


def metric_history(events: DataFrame, wanted: str, since: str, name: str = "name", ts: str = "ts") -> DataFrame:
    """The events of one metric since a time, that time included; events without a name or a time are in no history. Repeated events stay."""
    return events.where((F.col(name) == wanted) & (F.col(ts) >= F.lit(since).cast("timestamp")))


def operation_metrics(timings: DataFrame, last_n: int = 1000, salts: int = 16) -> DataFrame:
    """Per operation: calls, ok, failed, total, least, most, mean; p95 and p99 (nearest rank) of the last ``last_n`` calls.

    There are few operations and each may have most of the rows: sums combine before the shuffle, and the last calls are
    first taken within salts of an operation, so no task sorts a whole operation.
    """
    sums = timings.groupBy("operation").agg(F.count("*").alias("calls"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.sum("duration").alias("total"), F.min("duration").alias("least"), F.max("duration").alias("most"), F.avg("duration").alias("mean"))
    newest = [F.col("ts").desc(), F.col("event_id").desc()]
    salted = timings.withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(salts)))
    first = salted.withColumn("n", F.row_number().over(Window.partitionBy("operation", "salt").orderBy(*newest))).where(F.col("n") <= last_n)
    last = first.withColumn("n", F.row_number().over(Window.partitionBy("operation").orderBy(*newest))).where(F.col("n") <= last_n)
    ranks = last.groupBy("operation").agg(F.collect_list("duration").alias("d"))
    p = ranks.select("operation", T.percentile_nearest(F.col("d"), 0.95).alias("p95"), T.percentile_nearest(F.col("d"), 0.99).alias("p99"))
    return sums.join(p, "operation")


def performance_summary(metrics: DataFrame) -> DataFrame:
    """One row: calls, per cent of failures and number of operations; without calls the first two are null. ``views.worst_operations`` has the slowest."""
    return metrics.agg(F.sum("calls").alias("calls"), F.round(100.0 * F.sum("failed") / F.sum("calls"), 6).alias("error_percent"), F.count("*").alias("operations"))


def threshold_alerts(values: DataFrame, rules: DataFrame) -> DataFrame:
    """Values (metric, value) that violate a rule (metric, operator, bound, severity); the rule table is small and checked by the planner."""
    joined = values.join(rules, "metric")
    op, v, b = F.col("operator"), F.col("value"), F.col("bound")
    hit = F.when(op == "gt", v > b).when(op == "lt", v < b).when(op == "gte", v >= b).when(op == "lte", v <= b).when(op == "eq", v == b).otherwise(False)
    return joined.where(hit)


def alert_views(alerts: DataFrame, as_of: str) -> DataFrame:
    """Counts by severity and component: all, active, of the last day."""
    recent = F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr("interval 24 hours")
    return alerts.groupBy("severity", "component").agg(F.count("*").alias("n"), F.count_if(~F.col("resolved")).alias("active"), F.count_if(recent).alias("last_day"))


def health_status(metrics: DataFrame) -> DataFrame:
    """Per operation: healthy, warning (mean above 2) or degraded (errors above 5 percent)."""
    rate = F.col("failed") / F.col("calls")
    return metrics.select("operation", F.when(rate > 0.05, "degraded").when(F.col("mean") > 2.0, "warning").otherwise("healthy").alias("health"))


def error_statistics(errors: DataFrame, as_of: str) -> DataFrame:
    """By category: total, last hour, last day."""
    now = F.lit(as_of).cast("timestamp")
    return errors.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("ts") >= now - F.expr("interval 1 hour")).alias("last_hour"), F.count_if(F.col("ts") >= now - F.expr("interval 24 hours")).alias("last_day"))


def cache_key(query: Column, context: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lower(F.trim(query)), context), 256)


def _folded(rows: DataFrame, keys: list[str], output: str, start: Callable[[], Callable]) -> DataFrame:
    """``rows`` of ``keys``, event_id, ts and perhaps more, folded in order of time within each key: (keys, event_id, output).

    ``start`` gives a function of (seconds, *more) for each new key. Keys are sorted within partitions and pass in Arrow batches, so many small keys cost no more than one large
    one, and a task holds a batch and one key's state.
    """
    more = [c for c in rows.columns if c not in (*keys, "event_id", "ts")]
    value = "boolean" if output == "hit" else "string"
    kinds = [f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys]
    passed = rows.select(*keys, F.col("event_id").cast("long").alias("event_id"), "ts", *more).repartition(*keys).sortWithinPartitions(*keys, F.col("ts").asc_nulls_last(), F.col("event_id").asc_nulls_last())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, step = None, None
        for batch in batches:
            n = len(keys)
            at = batch.column(n + 1).cast(pa.int64()).to_pylist()
            found = []
            for key, t, *rest in zip(zip(*(batch.column(i).to_pylist() for i in range(n)), strict=True), at, *(batch.column(i).to_pylist() for i in range(n + 2, batch.num_columns)), strict=True):
                if step is None or key != now:
                    now, step = key, start()
                found.append(step(math.nan if t is None else t / 1e6, *rest))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n + 1)), pa.array(found, pa.bool_() if value == "boolean" else pa.string())], names=[*keys, "event_id", output])

    return passed.mapInArrow(run, ", ".join([*kinds, "event_id long", f"{output} {value}"]))


def cache_hits(log: DataFrame, ttl: float = 3600) -> DataFrame:
    """(key, event_id, hit): a request hits if an entry of its key, inserted at most ``ttl`` seconds ago, is there.

    A miss inserts anew, so a key's requests are folded in order; keys are hashes of single queries.
    """

    def start():
        held = None

        def step(at):
            nonlocal held
            hit = held is not None and at - held <= ttl
            held = held if hit else at
            return hit

        return step

    return _folded(log.select("key", "event_id", "ts"), ["key"], "hit", start)


def ewma(df: DataFrame, key: str, value: str, order: Iterable[str], alpha: float, width: float = STRETCH) -> DataFrame:
    """(key, average): exponential moving average of each key's values in order, started at the first.

    A value weighs alpha (1 - alpha) ** (values after it), the first one without the alpha. How many come after it is counted within
    a stretch of the first column of ``order`` and over the later stretches, so no key's history is in one row or task. A null value makes the average
    null. No rows give no rows.
    """
    order = list(order)
    rows = df.select(F.col(key).alias("k"), F.col(value).cast("double").alias("v"), _stretch(df, order[0], width).alias("s"), *(F.col(c).alias(f"o{n}") for n, c in enumerate(order)))
    counts = rows.groupBy("k", "s").agg(F.count("*").alias("n"))
    later = Window.partitionBy("k").orderBy(F.col("s").desc()).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(F.col("k").alias("k2"), F.col("s").alias("s2"), F.coalesce(F.sum("n").over(later), F.lit(0)).alias("later"), F.sum("n").over(Window.partitionBy("k")).alias("all"))
    back = F.row_number().over(Window.partitionBy("k", "s").orderBy(*(F.col(f"o{n}").desc() for n in range(len(order))), F.col("v").desc())) - 1
    placed = rows.withColumn("back", back).join(counts, F.col("k").eqNullSafe(F.col("k2")) & (F.col("s") == F.col("s2"))).withColumn("after", F.col("back") + F.col("later"))
    weight = F.pow(F.lit(1 - alpha), F.col("after")) * F.when(F.col("after") == F.col("all") - 1, 1.0).otherwise(alpha)
    total = F.when(F.count_if(F.col("v").isNull()) == 0, F.sum(weight * F.col("v")))
    return placed.groupBy(F.col("k").alias(key)).agg(total.alias("average"))


def queue_view(requests: DataFrame, as_of: str, workers: int = 4) -> DataFrame:
    """By priority: waiting requests that have not expired and the estimated wait, 2 s for each request ahead."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("created_at")
    sizes = requests.where(age <= F.col("timeout")).groupBy("priority").agg(F.count("*").alias("n"))
    ahead = F.coalesce(F.sum("n").over(Window.orderBy(F.col("priority").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for each priority
    return sizes.withColumn("wait_seconds", F.round((ahead + F.col("n") / 2) / max(1, workers) * 2.0, 6))


def log_levels(lines: DataFrame, tail: int = 100) -> DataFrame:
    """Per file: errors and warnings of the last ``tail`` lines, and a status."""
    w = Window.partitionBy("file").orderBy(F.col("line_no").desc())
    last = lines.withColumn("n", F.row_number().over(w)).where(F.col("n") <= tail)
    counts = last.groupBy("file").agg(F.count_if(F.contains("line", F.lit("ERROR"))).alias("errors"), F.count_if(F.contains("line", F.lit("WARNING"))).alias("warnings"))
    status = F.when(F.col("errors") > 10, "critical").when((F.col("errors") > 5) | (F.col("warnings") > 20), "warning").otherwise("healthy")
    return counts.withColumn("status", status)


def thread_rollup(steps: DataFrame, feedback: DataFrame) -> DataFrame:
    """Per thread and step type: steps, share of errors, mean seconds, mean feedback."""
    marks = feedback.groupBy("step_id").agg(F.avg("value").alias("mark"))
    rows = steps.join(marks, steps["id"] == marks["step_id"], "left")
    return rows.groupBy("thread_id", "type").agg(F.count("*").alias("steps"), F.round(F.avg(F.col("is_error").cast("double")), 6).alias("error_share"), F.round(F.avg("seconds"), 6).alias("mean_seconds"), F.round(F.avg("mark"), 6).alias("mean_mark"))


def step_depths(steps: DataFrame, id_col: str = "id", parent_col: str = "parent_id") -> DataFrame:
    """(id, depth) by pointer jumping: every round doubles the distance looked back, so a chain of n steps takes log(n) rounds.

    A step without a parent, or whose parent is not there, is a root of depth 0. Steps on a cycle, or below one, have a null depth.
    """
    ids = steps.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up")).where("id is not null").dropDuplicates(["id"])
    known = ids.select(F.col("id").alias("up"), F.lit(True).alias("there"))
    rows = ids.join(known, "up", "left").select("id", F.when(F.col("there"), F.col("up")).alias("up"))
    rows = materialise(rows.withColumn("hops", F.when(F.col("up").isNull(), 0).otherwise(1).cast("long")), "step-parents")
    for _ in range(max(1, rows.count()).bit_length() + 1):
        if rows.where("up is not null").isEmpty():
            break
        far = rows.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("hops").alias("more"))
        rows = materialise(rows.join(far, "up", "left").select("id", F.col("further").alias("up"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "step-parents")
    return rows.select("id", F.when(F.col("up").isNull(), F.col("hops")).alias("depth"))


def step_tree(steps: DataFrame, id_col: str = "id", parent_col: str = "parent_id", seconds_col: str = "seconds", error_col: str = "is_error") -> DataFrame:
    """(id, depth, steps, seconds, error_share): each step with all steps below it.

    Sums rise one level at a time, and only the rows of that level move, so the rounds are those of the deepest step. Steps on or below a cycle have nulls;
    steps whose parent is not there are roots; null seconds and errors are 0 and false; of rows that repeat an id one counts. No rows give no rows.
    """
    one = steps.select(F.col(id_col).alias("id"), F.col(parent_col).alias("parent"), F.coalesce(F.col(seconds_col).cast("double"), F.lit(0.0)).alias("seconds"), F.coalesce(F.col(error_col), F.lit(False)).cast("long").alias("errors"))
    placed = materialise(one.where("id is not null").dropDuplicates(["id"]).join(step_depths(steps, id_col, parent_col), "id"), "step-levels")
    deepest = placed.agg(F.max("depth")).first()[0] or 0
    done, below = None, None
    for depth in range(deepest, -1, -1):
        level = placed.where(F.col("depth") == depth).withColumn("steps", F.lit(1).cast("long"))
        if below is not None:
            sums = below.groupBy(F.col("parent").alias("id")).agg(*(F.sum(c).alias(f"more_{c}") for c in ("steps", "seconds", "errors")))
            level = level.join(sums, "id", "left").select("id", "parent", "depth", *((F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in ("steps", "seconds", "errors")))
        below = materialise(level.select("id", "parent", "depth", "steps", "seconds", "errors"), "step-sums")
        done = below if done is None else done.unionByName(below)
    none = placed.where("depth is null").select("id", "parent", "depth", *(F.lit(None).cast(t).alias(c) for c, t in (("steps", "long"), ("seconds", "double"), ("errors", "long"))))
    rows = done.unionByName(none)
    return rows.select("id", "depth", "steps", F.round("seconds", 6).alias("seconds"), F.round(F.col("errors") / F.col("steps"), 6).alias("error_share"))


def query_statistics(log: DataFrame, as_of: str, top: int = 5) -> DataFrame:
    """The most frequent normalised queries of the last day, with their number and mean time."""
    recent = log.where(F.col("ts") >= F.lit(as_of).cast("timestamp") - F.expr("interval 24 hours"))
    return recent.groupBy(F.lower(F.trim("query")).alias("query")).agg(F.count("*").alias("n"), F.round(F.avg("seconds"), 6).alias("mean_seconds")).orderBy(F.col("n").desc(), "query").limit(top)


def windowed_alerts(events: DataFrame, bound: float, window: str = "5 minutes", slide: str = "1 minute", hold: int = 2) -> DataFrame:
    """(operation, start, rate, firing): share of failures in sliding windows; firing once ``hold`` windows in a row exceed the bound.

    In a row means one slide apart: a window without events is no failure, so a gap starts anew. A null ``ok`` is left out of a share, null
    times are in no window. No rows give no rows. ``alert_episodes`` has rules on other measures.
    """
    w = events.groupBy("operation", F.window("ts", window, slide).alias("w")).agg(F.avg((~F.col("ok")).cast("double")).alias("rate"))
    rows = w.select("operation", F.col("w.start").alias("start"), F.round("rate", 6).alias("rate"), (F.col("rate") > bound).cast("int").alias("bad"))
    step = seconds_of(slide)
    at = F.unix_micros(F.col("start").cast("timestamp"))
    last = Window.partitionBy("operation").orderBy(at).rangeBetween(-(hold - 1) * step * 1_000_000, 0)
    return rows.withColumn("firing", F.coalesce(F.sum("bad").over(last) == hold, F.lit(False))).drop("bad")


def seconds_of(duration: str) -> int:
    """Whole seconds of a duration such as ``5 minutes``."""
    number, unit = duration.split()
    return int(number) * {"second": 1, "minute": 60, "hour": 3600, "day": 86400}[unit.rstrip("s")]


def window_measures(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """(operation, w, measure, value) of sliding windows: p95 of the duration, errors a second, share of successes; batch or stream.

    Windows without events have no rows; null durations are left out of p95, which is the exact value of its rank: a window holds the counts of its
    distinct durations, which its length bounds.
    """
    w = events.groupBy("operation", F.window("ts", window, slide).alias("w")).agg(
        F.expr("percentile_disc(0.95) within group (order by duration)").cast("double").alias("p95"),
        (F.count_if(~F.col("ok")) / float(seconds_of(window))).alias("errors_per_second"),
        F.avg(F.col("ok").cast("double")).alias("success_share"),
    )
    measures = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(m).alias("value")) for m in ("p95", "errors_per_second", "success_share")))
    return w.select("operation", "w", F.explode(measures).alias("m")).select("operation", "w", "m.measure", "m.value")


def judged_windows(measures: DataFrame, rules: DataFrame) -> DataFrame:
    """The measures that a rule is about, with ``bad``: above or below the rule's bound.

    ``rules`` has rule, measure, direction (above or below), bound, hold_seconds; a null value is not bad.
    """
    v, b = F.col("value"), F.col("bound")
    bad = F.when(F.col("direction") == "above", v > b).when(F.col("direction") == "below", v < b)
    return measures.join(rules, "measure").withColumn("bad", F.coalesce(bad, F.lit(False)))


def alert_episodes(events: DataFrame, rules: DataFrame, window: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """(rule, operation, begins, ends, windows, worst): the times in which a rule was broken for as long as it asks.

    A window breaks a rule if its measure is beyond the bound. An episode is a run of such windows, each one slide after the other, that lasts ``hold_seconds`` (so many
    slides); it begins with the window that fills this time and ends with the last one of the run. A window within the bounds, or
    without events, ends the run. Runs are islands of consecutive window numbers, so no grid of all windows is made.
    """
    step = seconds_of(slide)
    number = F.floor(F.unix_seconds(F.col("w.start").cast("timestamp")) / step)
    bad = judged_windows(window_measures(events, window, slide), rules).where("bad").withColumn("number", number)
    order = Window.partitionBy("rule", "operation").orderBy("number")
    runs = bad.withColumn("run", F.col("number") - F.row_number().over(order)).groupBy("rule", "operation", "run", "direction", "hold_seconds")
    found = runs.agg(F.min("number").alias("low"), F.max("number").alias("high"), F.count("*").alias("windows"), F.max("value").alias("most"), F.min("value").alias("least"))
    needed = F.greatest(F.ceil(F.col("hold_seconds") / step), F.lit(1))
    begins = F.timestamp_seconds((F.col("low") + needed - 1) * step)
    worst = F.when(F.col("direction") == "above", F.col("most")).otherwise(F.col("least"))
    return found.where(F.col("windows") >= needed).select("rule", "operation", begins.alias("begins"), F.timestamp_seconds(F.col("high") * step).alias("ends"), "windows", worst.alias("worst"))


def user_sessions(requests: DataFrame, gap: str = "2 hours") -> DataFrame:
    """(user_id, first, last, n): requests of a user with less than ``gap`` between them; batch or stream."""
    s = requests.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return s.select("user_id", "first", "last", "n")


def bucket_step(state: dict, at: float, rpm: int, rph: int, burst: int) -> tuple[bool, str]:
    """One request of a user: token bucket, then the minute's and the hour's count; only allowed requests are recorded."""
    state["tokens"] = min(burst, state.get("tokens", float(burst)) + (at - state.get("at", at)) / 60 * rpm / 60)
    state["at"] = at
    seen = state["seen"] = [t for t in state.get("seen", []) if at - t < 3600]
    if state["tokens"] < 1:
        return False, "burst"
    if sum(at - t < 60 for t in seen) >= rpm:
        return False, "minute"
    if len(seen) >= rph:
        return False, "hour"
    state["tokens"] -= 1
    seen.append(at)
    return True, "ok"


def rate_usage(requests: DataFrame, rules: DataFrame) -> DataFrame:
    """(user_id, user_type, unit, begins, n, allowed, over): requests of each user in each minute and hour against the rules.

    ``rules`` (user_type, per_minute, per_hour) has a row for each type of user, and one with a null type for all others; types without
    any rule have no limit. ``over`` counts the requests beyond it. Requests without a time are left out. Requests are counted before
    they meet the rules, so a user's history is never in one place.
    """
    units = F.explode(F.array(F.lit("minute"), F.lit("hour")))
    rows = requests.where("ts is not null").select("user_id", "user_type", "ts", units.alias("unit"))
    begins = F.when(F.col("unit") == "minute", F.date_trunc("minute", "ts")).otherwise(F.date_trunc("hour", "ts"))
    counted = rows.groupBy("user_id", "user_type", "unit", begins.alias("begins")).agg(F.count("*").alias("n"))
    limit = F.when(F.col("unit") == "minute", F.col("per_minute")).otherwise(F.col("per_hour"))
    own = rules.where("user_type is not null").withColumn("unit", units).select("user_type", "unit", limit.alias("own"))
    rest = rules.where("user_type is null").withColumn("unit", units).groupBy("unit").agg(F.min(limit).alias("rest"))
    held = counted.join(own, ["user_type", "unit"], "left").join(rest, "unit", "left").withColumn("allowed", F.coalesce("own", "rest"))
    over = F.greatest(F.coalesce(F.col("n") - F.col("allowed"), F.lit(0)), F.lit(0))
    return held.select("user_id", "user_type", "unit", "begins", "n", "allowed", over.cast("long").alias("over"))


def rate_limit(requests: DataFrame, rpm: int = 10, rph: int = 100, burst: int = 5) -> DataFrame:
    """(user_id, event_id, allowed, reason): each user's requests in order; a user's state is bounded by the hour's limit."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        state: dict = {}
        pdf = pdf.sort_values(["ts", "event_id"])
        times = (pdf["ts"] - pd.Timestamp(0)).dt.total_seconds()
        found = [bucket_step(state, at, rpm, rph, burst) for at in times]
        return pd.DataFrame({"user_id": pdf["user_id"], "event_id": pdf["event_id"], "allowed": [f[0] for f in found], "reason": [f[1] for f in found]})

    return requests.select("user_id", "event_id", "ts").groupBy("user_id").applyInPandas(run, "user_id long, event_id long, allowed boolean, reason string")


def breaker_step(state: dict, at: float, ok: bool, threshold: int, timeout: float) -> str:
    """One call: closed or open; ``threshold`` failures open the breaker for ``timeout`` seconds, a success resets it."""
    if state.get("opened") is not None:
        if at - state["opened"] < timeout:
            return "open"
        state["opened"], state["failures"] = None, 0
    state["failures"] = 0 if ok else state.get("failures", 0) + 1
    if state["failures"] >= threshold:
        state["opened"] = at
    return "closed"


def circuit_breaker(events: DataFrame, threshold: int = 5, timeout: float = 300) -> DataFrame:
    """(operation, event_id, state) of each call, by operation and user, in order."""

    def start():
        state: dict = {}
        return lambda at, ok: breaker_step(state, at, ok, threshold, timeout)

    rows = events.select("operation", "user_id", "event_id", "ts", "ok")
    return _folded(rows, ["operation", "user_id"], "state", start).drop("user_id")
