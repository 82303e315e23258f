"""Streaming forms of the telemetry jobs: event time, watermarks, keyed state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.query import StreamingQuery

from quillgraph.operators import telemetry

WATERMARK = "10 minutes"


def watch_directory(spark: SparkSession, path: str, glob: str = "*.txt", batch: int = 10, max_age: str = "24h") -> DataFrame:
    """New files of a directory as a stream of (path, modificationTime, length, content), ``batch`` files at a time."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return reader.option("pathGlobFilter", glob).option("maxFilesPerTrigger", batch).option("maxFileAge", max_age).option("recursiveFileLookup", True).load(path)


def stream_operation_metrics(events: DataFrame, window: str = "1 hour", watermark: str = WATERMARK) -> DataFrame:
    """Per operation and window: calls, failures, mean and approximate p95."""
    w = events.withWatermark("ts", watermark).groupBy(F.window("ts", window).alias("w"), "operation")
    return w.agg(F.count("*").alias("calls"), F.count_if(~F.col("ok")).alias("failed"), F.avg("duration").alias("mean"), F.percentile_approx("duration", 0.95).alias("p95")).select("operation", F.col("w.start").alias("start"), "calls", "failed", "mean", "p95")


def stream_windowed_rates(events: DataFrame, window: str = "5 minutes", slide: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """Error rate of sliding windows; the rule on top of them is ``telemetry.windowed_alerts`` over what was written."""
    w = events.withWatermark("ts", watermark).groupBy(F.window("ts", window, slide).alias("w"), "operation")
    return w.agg(F.avg((~F.col("ok")).cast("double")).alias("rate")).select("operation", F.col("w.start").alias("start"), "rate")


def stream_sessions(requests: DataFrame, gap: str = "2 hours", watermark: str = WATERMARK) -> DataFrame:
    return telemetry.user_sessions(requests.withWatermark("ts", watermark), gap)


def dedup_events(events: DataFrame, keys: list[str], watermark: str = WATERMARK) -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(keys)


def _stateful(rows: DataFrame, key: str, schema: str, state_schema: str, load: Callable, save: Callable, step: Callable) -> DataFrame:
    def run(keys: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = load(state.get) if state.exists else {}
        for pdf in parts:
            pdf = pdf.sort_values(["ts", "event_id"])
            times = (pdf["ts"] - pd.Timestamp(0)).dt.total_seconds()
            yield step(keys[0], held, pdf, times)
        state.update(save(held))

    return rows.groupBy(key).applyInPandasWithState(run, schema, state_schema, "append", GroupStateTimeout.NoTimeout)


def stream_rate_limit(requests: DataFrame, rpm: int = 10, rph: int = 100, burst: int = 5) -> DataFrame:
    """``telemetry.rate_limit`` with a user's tokens and last hour of allowed requests as keyed state."""

    def step(user, held, pdf, times):
        found = [telemetry.bucket_step(held, at, rpm, rph, burst) for at in times]
        return pd.DataFrame({"user_id": user, "event_id": pdf["event_id"], "allowed": [f[0] for f in found], "reason": [f[1] for f in found]})

    load = lambda s: {"tokens": s[0], "at": s[1], "seen": list(s[2])}
    save = lambda h: (h["tokens"], h["at"], h["seen"])
    rows = requests.select("user_id", "event_id", "ts")
    return _stateful(rows, "user_id", "user_id long, event_id long, allowed boolean, reason string", "tokens double, at double, seen array<double>", load, save, step)


def stream_circuit_breaker(events: DataFrame, threshold: int = 5, timeout: float = 300) -> DataFrame:
    """``telemetry.circuit_breaker`` for each key ``operation:user_id`` as keyed state."""

    def step(key, held, pdf, times):
        states = [telemetry.breaker_step(held, at, ok, threshold, timeout) for at, ok in zip(times, pdf["ok"], strict=True)]
        return pd.DataFrame({"breaker": key, "event_id": pdf["event_id"], "state": states})

    load = lambda s: {"failures": s[0], "opened": s[1]}
    save = lambda h: (h.get("failures", 0), h.get("opened"))
    rows = events.select(F.concat_ws(":", "operation", "user_id").alias("breaker"), "event_id", "ts", "ok")
    return _stateful(rows, "breaker", "breaker string, event_id long, state string", "failures long, opened double", load, save, step)


def for_each_batch(stream: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand every micro-batch to ``handler``: notifications, upserts, manifest updates."""
    return stream.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Episodes(StatefulProcessor):
    """The run of broken windows of a rule and an operation; what ends it is a good window, or the time at which the next one is due."""

    def __init__(self, window: int, slide: int):
        self.window, self.slide = window, slide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "low long, high long, worst double, needed long, above boolean")

    def _ended(self, key: tuple, run: tuple | None) -> list[tuple]:
        if run is None or run[1] - run[0] + 1 < run[3]:
            return []
        low, high, worst, needed, _ = run
        return [(*key, pd.Timestamp((low + needed - 1) * self.slide, unit="s"), pd.Timestamp(high * self.slide, unit="s"), high - low + 1, worst)]

    def _frame(self, rows: list[tuple]) -> Iterator[pd.DataFrame]:
        if rows:
            yield pd.DataFrame(rows, columns=["rule", "operation", "begins", "ends", "windows", "worst"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        run, out = self.run.get() if self.run.exists() else None, []
        for r in pd.concat(list(rows)).sort_values("number").itertuples():
            if run is not None and (not r.bad or r.number != run[1] + 1):
                out += self._ended(key, run)
                run = None
            if r.bad:
                above = r.direction == "above"
                worst = r.value if run is None else (max if above else min)(run[2], r.value)
                run = (run[0] if run else r.number, r.number, float(worst), max(1, -(-r.hold_seconds // self.slide)), above)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if run is None:
            self.run.clear()
        else:
            self.run.update(tuple(run))
            # by then the next window has been handed over, if it has any events
            self.handle.registerTimer(((run[1] + 2) * self.slide + self.window) * 1000)
        yield from self._frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        run = self.run.get() if self.run.exists() else None
        self.run.clear()
        yield from self._frame(self._ended(key, run))

    def close(self) -> None:
        pass


def stream_alert_episodes(events: DataFrame, rules: DataFrame, window: str = "5 minutes", slide: str = "1 minute", watermark: str = WATERMARK) -> DataFrame:
    """``telemetry.alert_episodes`` as a stream: an episode is given out once it has ended.

    State is one run for each rule and operation, and an event-time timer that ends it when a gap follows. The session
    needs the RocksDB state store.
    """
    step = telemetry.seconds_of(slide)
    measures = telemetry.window_measures(events.withWatermark("ts", watermark), window, slide)
    timed = measures.withColumn("number", F.floor(F.unix_seconds(F.col("w.start").cast("timestamp")) / step)).withColumn("at", F.window_time("w"))
    judged = telemetry.judged_windows(timed, rules).select("rule", "operation", "number", "value", "bad", "direction", "hold_seconds", "at")
    schema = "rule string, operation string, begins timestamp, ends timestamp, windows long, worst double"
    return judged.groupBy("rule", "operation").transformWithStateInPandas(_Episodes(telemetry.seconds_of(window), step), schema, "append", "eventTime")
