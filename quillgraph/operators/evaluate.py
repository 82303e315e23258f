"""Answer scoring, load tests, trends, regressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgraph.functions import text as T
from quillgraph.runtime import materialise

#: Relative changes that are minor, moderate, severe, critical, by kind of metric.
THRESHOLDS = {
    "response_time": (0.10, 0.25, 0.50, 1.00),
    "throughput": (-0.10, -0.25, -0.50, -0.75),
    "success_rate": (-0.02, -0.05, -0.10, -0.20),
    "memory_usage": (0.15, 0.30, 0.60, 1.20),
    "cpu_usage": (0.15, 0.30, 0.60, 1.20),
}


def score_answers(answers: DataFrame) -> DataFrame:
    """Adds keyword share, concept share, accuracy and passed to (answer, confidence, keywords, concepts, minimum)."""
    low = F.lower(F.coalesce("answer", F.lit("")))
    k = F.when(F.size("keywords") > 0, F.size(F.filter("keywords", lambda w: F.contains(low, F.lower(w)))) / F.size("keywords")).otherwise(0.0)
    c = F.when(F.size("concepts") > 0, F.size(F.filter("concepts", lambda p: F.exists(F.split(F.lower(p), " "), lambda w: F.contains(low, w)))) / F.size("concepts")).otherwise(0.0)
    rows = answers.withColumns({"keyword_share": F.round(k, 6), "concept_share": F.round(c, 6)})
    accuracy = F.least(0.4 * k + 0.4 * c + 0.2 * F.least("confidence", F.lit(1.0)), F.lit(1.0))
    rows = rows.withColumn("accuracy", F.round(accuracy, 6))
    return rows.withColumn("passed", (F.col("accuracy") >= 0.6) & (F.col("confidence") >= F.col("minimum")) & (F.length(low) > 50))


def suite_summary(results: DataFrame) -> DataFrame:
    """Overall (null, null), by category and by difficulty: number, pass rate; mean, median, deviation, least and most of accuracy; mean of the positive confidences and of time.

    ``results`` has category, difficulty, accuracy, passed, and perhaps confidence and seconds. Medians are exact by ``percentiles``; a null category
    or difficulty is one of its own, told apart from the totals by ``level``.
    """
    a = F.col("accuracy")
    for name in ("confidence", "seconds"):
        if name not in results.columns:
            results = results.withColumn(name, F.lit(None).cast("double"))
    levels = F.array(*(F.struct(F.lit(level).alias("level"), (F.col("category") if level == "category" else F.lit(None).cast("string")).alias("category"), (F.col("difficulty") if level == "difficulty" else F.lit(None).cast("string")).alias("difficulty")) for level in ("all", "category", "difficulty")))
    rows = results.select("accuracy", "passed", "confidence", "seconds", F.inline(levels))
    keys = ["level", "category", "difficulty"]
    sums = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), F.round(F.avg(F.col("passed").cast("double")), 6).alias("pass_rate"), F.round(F.avg(a), 6).alias("mean"), F.round(F.stddev_samp(a), 6).alias("deviation"),
        F.min(a).alias("least"), F.max(a).alias("most"), F.round(F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))), 6).alias("mean_confidence"), F.round(F.avg("seconds"), 6).alias("mean_seconds"),
    )
    medians = percentiles(rows, keys, "accuracy", [0.5]).select(*(F.col(k).alias(f"m_{k}") for k in keys), F.round("percentile", 6).alias("median"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"m_{k}"))
    return sums.join(medians, on, "left").drop(*(f"m_{k}" for k in keys))


def success_criteria(summary: DataFrame, criteria: dict[str, tuple[str, float]]) -> DataFrame:
    """(criterion, value, ok) for each criterion ``>=`` or ``<=`` of a one-row summary."""
    rows = F.array(*(F.struct(F.lit(n).alias("criterion"), F.col(n).cast("double").alias("value"), (F.col(n) >= b if op == ">=" else F.col(n) <= b).alias("ok")) for n, (op, b) in criteria.items()))
    return summary.select(F.inline(rows))


def run_trend(runs: DataFrame) -> DataFrame:
    """Per metric: first and last value, change and relative change."""
    rows = runs.groupBy("metric").agg(F.min_by("value", F.struct("ts", "run_id")).alias("first"), F.max_by("value", F.struct("ts", "run_id")).alias("last"))
    change = F.col("last") - F.col("first")
    return rows.withColumn("change", F.round(change, 6)).withColumn("percent", F.round(F.when(F.col("first") != 0, 100 * change / F.col("first")).otherwise(0.0), 6))


def load_summary(requests: DataFrame, method: str = "linear") -> DataFrame:
    """Per test: requests, failures, rate; mean, least, most, and 95th and 99th percentile of successful times, by either definition of a percentile.

    Percentiles are exact, by ``percentiles``: no test is gathered. A test without a successful request has null times; a null ``ok`` is neither. No rows give no rows.
    """
    t = F.when(F.col("ok"), F.col("seconds"))
    span = F.greatest(F.unix_timestamp(F.max("ts")) - F.unix_timestamp(F.min("ts")), F.lit(1))
    sums = requests.groupBy("test").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.count("*") / span, 6).alias("rate"), F.round(F.avg(t), 6).alias("mean"), F.min(t).alias("least"), F.max(t).alias("most"))
    tails = percentiles(requests.where("ok"), ["test"], "seconds", [0.95, 0.99], method).groupBy(F.col("test").alias("of")).agg(*(F.round(F.max(F.when(F.col("q") == q, F.col("percentile"))), 6).alias(name) for name, q in (("p95", 0.95), ("p99", 0.99))))
    return sums.join(tails, F.col("test").eqNullSafe(F.col("of")), "left").drop("of")


def percentile_exclusive(values: Column, q: float) -> Column:
    """Exclusive interpolation at ``q (n + 1)`` of an array, clamped to its ends."""
    s, n = F.sort_array(values), F.size(values)
    at = F.greatest(F.lit(1.0), F.least(q * (n + 1), n.cast("double")))
    low = F.floor(at).cast("int")
    a, b = F.element_at(s, low), F.element_at(s, F.least(low + 1, n))
    return a + (at - low) * (b - a)


def scalability(levels: DataFrame) -> DataFrame:
    """(slope, most_users, breaking_users): response time by users; the largest stable level with all below it stable; first level above twice the first one's time."""
    w = Window.orderBy("users")  # a row for each load level
    rows = levels.withColumn("so_far", F.min(F.col("stable").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("base", F.first("seconds").over(w))
    return rows.agg(F.round(F.regr_slope("seconds", "users"), 6).alias("slope"), F.max(F.when(F.col("so_far") == 1, F.col("users"))).alias("most_users"), F.min(F.when(F.col("seconds") > 2 * F.col("base"), F.col("users"))).alias("breaking_users"))


def endurance(samples: DataFrame, salts: int = 16) -> DataFrame:
    """Per test: memory slope an hour, mean of the first and last three samples, leak above 20 percent, stability score.

    The first and last samples are found in salted parts of a test and then among these, so no test is sorted in one task.
    """
    salt = F.pmod(F.xxhash64("sample_id"), F.lit(salts)).alias("salt")
    rows = samples.select("test", "ts", "sample_id", "memory", salt)
    up, down = (F.col("ts"), F.col("sample_id")), (F.col("ts").desc(), F.col("sample_id").desc())
    ends = None
    for name, order in (("a", up), ("z", down)):
        some = rows.withColumn("n", F.row_number().over(Window.partitionBy("test", "salt").orderBy(*order))).where("n <= 3")
        some = some.withColumn("n", F.row_number().over(Window.partitionBy("test").orderBy(*order))).where("n <= 3").groupBy("test").agg(F.avg("memory").alias(name))
        ends = some if ends is None else ends.join(some, "test")
    ok = F.least(F.lit(1.0), F.avg(F.col("ok").cast("double")) / 0.95)
    even = F.greatest(F.lit(0.0), 1 - F.stddev_samp("seconds") / F.avg("seconds"))
    errors = F.greatest(F.lit(0.0), 1 - 10 * F.avg((~F.col("ok")).cast("double")))
    whole = samples.groupBy("test").agg(F.round(F.regr_slope("memory", F.unix_timestamp("ts") / 3600.0), 6).alias("memory_slope"), F.round((ok + even + errors) / 3, 6).alias("stability"))
    return whole.join(ends, "test").select("test", "memory_slope", F.round("a", 6).alias("first"), F.round("z", 6).alias("last"), (F.col("z") > 1.2 * F.col("a")).alias("leak"), "stability")


#: Ranks of the sketch's brackets: a sketch of this accuracy is right to one row in so many.
ACCURACY = 10_000
BROADCAST_KEYS = 100_000


def order_positions(method: str, q: Column, n: Column) -> Column:
    """The place, from 1 to n and perhaps between two ranks, of a quantile among n sorted values.

    ``linear`` is 1 + (n - 1) q, ``exclusive`` q (n + 1) within the ends, ``nearest`` the rank floor(q n) + 1.
    """
    if method == "linear":
        return 1 + (n - 1) * q
    if method == "exclusive":
        return F.greatest(F.lit(1.0), F.least(q * (n + 1), n.cast("double")))
    if method == "nearest":
        return F.least(F.floor(q * n) + 1, n).cast("double")
    raise ValueError(f"no such method: {method}")


def percentiles(df: DataFrame, keys: list[str], value: str, quantiles: list[float], method: str = "linear", accuracy: int = ACCURACY) -> DataFrame:
    """(keys, q, percentile): exact quantiles of the values of each key, without gathering a key's values anywhere.

    A mergeable sketch gives two values between which the wanted ranks lie, whatever the values' scale. What is below the bracket is counted;
    within it, about two rows in ``accuracy``, distinct values are counted and put in order. If the counts show that a
    bracket missed its ranks, that key is done again over all of its distinct values. Null values are left out, null keys are a key, a key without
    values has no row.
    """
    named = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), F.col(value).cast("double").alias("_v")).where("_v is not null")
    marks = [m for q in quantiles for m in (max(q - 4 / accuracy, 0.0), min(q + 4 / accuracy, 1.0))]
    sketch = rows.groupBy(*named).agg(F.count("*").alias("_n"), F.percentile_approx("_v", marks, accuracy).alias("_m"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    wanted = F.array(*(F.struct(F.lit(q).alias("q"), F.get("_m", F.lit(2 * i)).alias("low"), F.get("_m", F.lit(2 * i + 1)).alias("high")) for i, q in enumerate(quantiles)))
    brackets = materialise(sketch.select(*(F.col(n).alias(f"_b{n}") for n in named), "_n", "_least", "_most", F.inline(wanted)), "quantile-brackets")

    def found(brackets: DataFrame) -> DataFrame:
        on = F.lit(True)
        for n in named:
            on = on & F.col(n).eqNullSafe(F.col(f"_b{n}"))
        side = F.broadcast(brackets) if brackets.count() <= BROADCAST_KEYS else brackets
        joined = rows.join(side, on).where("_v <= high") if named else rows.crossJoin(side).where("_v <= high")  # without keys, a row for each quantile
        # what lies below is one value of its own
        counted = joined.groupBy(*named, "q", "_n", F.when(F.col("_v") >= F.col("low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("times"))
        upto = F.sum("times").over(Window.partitionBy(*named, "q").orderBy(F.col("_v").asc_nulls_first()))
        counted = counted.withColumn("last", upto).withColumn("first", upto - F.col("times") + 1).withColumn("place", order_positions(method, F.col("q"), F.col("_n")))
        below = F.floor("place")
        at = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("_v")))
        ends = counted.groupBy(*named, "q").agg(at(below).alias("a"), at(F.least(below + 1, F.col("_n"))).alias("b"), (F.max("place") - F.max(below)).alias("part"))
        exact = F.when(F.col("part") > 0, F.col("a") + F.col("part") * (F.col("b") - F.col("a"))).otherwise(F.col("a"))
        return ends.select(*named, "q", exact.alias("percentile"))

    first = materialise(found(brackets), "quantiles")
    again = first.where("percentile is null").select(*(F.col(n).alias(f"_c{n}") for n in named), F.col("q").alias("_cq"))
    if not again.isEmpty():
        on = F.col("q") == F.col("_cq")
        for n in named:
            on = on & F.col(f"_b{n}").eqNullSafe(F.col(f"_c{n}"))
        whole = brackets.join(again, on, "left_semi").withColumn("low", F.col("_least")).withColumn("high", F.col("_most"))
        first = first.where("percentile is not null").unionByName(found(materialise(whole, "quantile-brackets")))
    return first.select(*(F.col(n).alias(k) for k, n in zip(keys, named, strict=True)), "q", "percentile")


def percentiles_exclusive(df: DataFrame, key: str, value: str, q: float) -> DataFrame:
    """(key, percentile) as ``percentile_exclusive`` of all values of a key, without gathering them. Null values are left out; a key without values has no row."""
    return percentiles(df, [key], value, [q], "exclusive").select(key, "percentile")


def compare_operations(current: DataFrame, baseline: DataFrame, limit: float = 0.2) -> DataFrame:
    """Per operation: mean duration on both sides, relative change, regression above the limit."""
    a = current.groupBy("operation").agg(F.avg("duration").alias("now"))
    b = baseline.groupBy("operation").agg(F.avg("duration").alias("was"))
    change = (F.col("now") - F.col("was")) / F.col("was")
    return a.join(b, "operation").select("operation", F.round("now", 6).alias("now"), F.round("was", 6).alias("was"), F.round(change, 6).alias("change"), (change > limit).alias("regression"))


def metric_kind(name: Column) -> Column:
    return (
        F.when(T.any_of(name, ["response_time", "latency"]), "response_time").when(T.any_of(name, ["throughput", "requests_per_second"]), "throughput")
        .when(T.any_of(name, ["success_rate", "error_rate"]), "success_rate").when(F.contains(name, F.lit("memory")), "memory_usage")
        .when(F.contains(name, F.lit("cpu")), "cpu_usage").otherwise("response_time")
    )


def detect_regressions(current: DataFrame, baselines: DataFrame) -> DataFrame:
    """(metric, change, severity, confidence) for metrics on both sides; severity by kind of metric and direction."""
    change = F.when(F.col("baseline") != 0, (F.col("value") - F.col("baseline")) / F.col("baseline")).otherwise(0.0)
    rows = current.join(baselines, "metric").withColumn("kind", metric_kind(F.col("metric"))).withColumn("change", change)
    severity = F.lit("none")
    for kind, bounds in THRESHOLDS.items():
        for name, bound in zip(("minor", "moderate", "severe", "critical"), bounds, strict=True):
            worse = F.col("change") >= bound if bound > 0 else F.col("change") <= bound
            severity = F.when((F.col("kind") == kind) & worse, name).otherwise(severity)
    sure = F.least(F.lit(0.9), F.col("samples") / 10.0) * F.least(F.lit(1.0), 2 * F.abs("change"))
    return rows.select("metric", F.round("change", 6).alias("change"), severity.alias("severity"), F.round(F.greatest(F.lit(0.1), F.least(F.lit(0.95), sure)), 6).alias("confidence"))


def update_baselines(baselines: DataFrame, run: DataFrame, regressions: DataFrame, alpha: float = 0.2) -> DataFrame:
    """Moving average of each metric; new metrics start at their value; nothing changes while a regression is critical."""
    blocked = regressions.where("severity = 'critical'").agg((F.count("*") > 0).alias("blocked"))
    rows = baselines.join(run, "metric", "full_outer").crossJoin(F.broadcast(blocked))  # one row on the right
    fresh = F.when(F.col("baseline").isNull(), F.col("value")).when(F.col("value").isNull(), F.col("baseline")).otherwise(alpha * F.col("value") + (1 - alpha) * F.col("baseline"))
    keep = F.col("blocked") | F.col("value").isNull()
    return rows.where("not (blocked and baseline is null)").select("metric", F.round(F.when(keep, F.col("baseline")).otherwise(fresh), 6).alias("baseline"), (F.coalesce("samples", F.lit(0)) + F.when(keep, 0).otherwise(1)).cast("long").alias("samples"))


def metric_trends(history: DataFrame, last_n: int = 30, least: int = 5) -> DataFrame:
    """Per metric over its last values: slope over the run's index, direction, volatility, mean; ``least`` values at least."""
    w = Window.partitionBy("metric").orderBy(F.col("ts").desc(), F.col("run_id").desc())
    rows = history.withColumn("n", F.row_number().over(w)).where(F.col("n") <= last_n).withColumn("i", -F.col("n"))
    out = rows.groupBy("metric").agg(F.count("*").alias("n"), F.round(F.regr_slope("value", "i"), 6).alias("slope"), F.round(F.stddev_samp("value") / F.avg("value"), 6).alias("volatility"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.avg(F.when(F.col("n") <= 5, F.col("value"))), 6).alias("recent"))
    return out.where(F.col("n") >= least).withColumn("direction", F.when(F.col("slope") < 0, "improving").when(F.col("slope") > 0, "degrading").otherwise("stable"))


def tolerance_check(current: DataFrame, baselines: DataFrame) -> DataFrame:
    """(name, deviation, passed): relative deviation within the tolerance, absolute where the baseline is 0."""
    d = F.when(F.col("baseline") == 0, F.abs("value")).otherwise(F.abs(F.col("value") - F.col("baseline")) / F.abs("baseline"))
    return current.join(baselines, "name").select("name", F.round(d, 6).alias("deviation"), (d <= F.col("tolerance")).alias("passed"))


def satisfaction(criteria_share: Column, accuracy: Column, seconds: Column, cited: Column) -> Column:
    """3, moved by the share of criteria met, accuracy, time and citations, from 1 to 5."""
    score = 3.0 + (criteria_share - 0.5) * 2
    score = score + F.when(accuracy > 0.9, 0.3).when(accuracy < 0.6, -0.5).otherwise(0.0)
    score = score + F.when(seconds < 5, 0.2).when(seconds > 15, -0.3).otherwise(0.0) + F.when(cited, 0.2).otherwise(0.0)
    return F.greatest(F.lit(1.0), F.least(F.lit(5.0), score))


def satisfaction_histogram(scores: DataFrame, col: str = "score") -> DataFrame:
    """Number and per cent of the scores in four bands; bands without a score have no row, null scores are poor. No rows give no rows."""
    band = F.when(F.col(col) >= 4.5, "excellent").when(F.col(col) >= 3.5, "good").when(F.col(col) >= 2.5, "fair").otherwise("poor")
    rows = scores.groupBy(band.alias("band")).agg(F.count("*").alias("n"))
    return rows.crossJoin(F.broadcast(scores.agg(F.count("*").alias("t")))).select("band", "n", F.round(100.0 * F.col("n") / F.col("t"), 6).alias("percent"))  # one row on the right


def load_rollup(tests: DataFrame) -> DataFrame:
    fine = (F.col("success") >= 0.95) & (F.col("mean") <= 10)
    return tests.agg(F.max(F.when(fine, F.col("users"))).alias("most_users"), F.max("rate").alias("peak_rate"), F.max(F.when(F.col("users") == 50, F.col("mean"))).alias("mean_at_50"))


def benchmark_rollup(metrics: DataFrame) -> DataFrame:
    good = F.when(F.col("ok"), F.col("seconds"))
    return metrics.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.round(F.avg(good), 6).alias("mean"), F.max(good).alias("most"), F.bool_and(~F.col("ok") | (F.col("seconds") <= F.col("bound"))).alias("within"))


def expected_metrics(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(name, ok): values against bounds such as ``>=0.9``; a metric without a value, or a bound that is no number, fails."""
    op, bound = F.regexp_extract("bound", r"^(>=|<=|>|<)?", 1), F.regexp_replace("bound", r"^(>=|<=|>|<)", "").try_cast("double")
    v = F.col("value")
    ok = F.when(op == ">=", v >= bound).when(op == "<=", v <= bound).when(op == ">", v > bound).when(op == "<", v < bound).otherwise(v == bound)
    return expected.join(actual, "name", "left").select("name", F.coalesce(ok, F.lit(False)).alias("ok"))


def quality_rollup(suites: DataFrame) -> DataFrame:
    """Pass rate of each suite in one row, and the overall quality: mean of end-to-end, regression and 0.8 acceptance rate."""
    rate = {s: F.coalesce(F.avg(F.when(F.col("suite") == s, F.col("passed").cast("double"))), F.lit(0.0)) for s in ("end_to_end", "regression", "acceptance")}
    row = suites.agg(*(r.alias(s) for s, r in rate.items()), F.count_if(F.col("critical") & ~F.col("passed")).alias("critical_failures"))
    return row.withColumn("overall", F.round((F.col("end_to_end") + F.col("regression") + 0.8 * F.col("acceptance")) / 3, 6))
