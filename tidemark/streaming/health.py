"""Source health, absences and errors over streams, with state and timers for each key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.time import business_day
from ..operators.health import EMPTY_THRESHOLD, FAILURE_THRESHOLD

OUTPUT = "source_id long, seq long, failures int, empties int, failure_alert boolean, empty_alert boolean"
STATE = "failures int, empties int, failure_alerted int, empty_alerted int, last_ms long"
#: Days after which the state of a source that is no longer fetched goes.
TTL_DAYS, DAY_MS = 90, 86_400_000


def warn_again(count: int, threshold: int, alerted: int) -> bool:
    """First at the threshold, then whenever the count has doubled since the last alert."""
    return count >= threshold and (alerted == 0 or count >= 2 * alerted)


def step(state: tuple[int, int, int, int], failed: bool, empty: bool) -> tuple[tuple[int, int, int, int], bool, bool]:
    """The state after one fetch, and whether it raises a failure alert or an alert about empty listings."""
    failures, empties, failure_alerted, empty_alerted = state
    if failed:
        failures += 1
        alert = warn_again(failures, FAILURE_THRESHOLD, failure_alerted)
        return (failures, empties, failures if alert else failure_alerted, empty_alerted), alert, False
    empties = empties + 1 if empty else 0
    alert = empty and warn_again(empties, EMPTY_THRESHOLD, empty_alerted)
    return (0, empties, 0, empties if alert else empty_alerted if empty else 0), False, alert


class SourceHealth(StatefulProcessor):
    """Streaks of one source. Its state goes once the stream's time is `ttl_ms` past its last fetch."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("health", STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803  Spark's names
        *now, last = self.state.get() if self.state.exists() else (0, 0, 0, 0, None)
        if last is not None:
            self.handle.deleteTimer(last + self.ttl_ms)
        now, out = tuple(now), []
        fetches = pd.concat(list(rows)).sort_values(["ts", "seq"])
        for r in fetches.itertuples(index=False):
            now, failure, empty = step(now, bool(r.failed), bool(r.empty))
            out.append((key[0], r.seq, now[0], now[1], failure, empty))
        seen = fetches["ts"].iloc[-1].tz_localize("UTC") if fetches["ts"].iloc[-1].tzinfo is None else fetches["ts"].iloc[-1]
        last = max(last or 0, int(seen.timestamp() * 1000))
        self.state.update((*now, last))
        self.handle.registerTimer(last + self.ttl_ms)
        yield pd.DataFrame(out, columns=["source_id", "seq", "failures", "empties", "failure_alert", "empty_alert"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.state.clear()
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def with_timers(spark: SparkSession) -> None:
    """Have the session keep streams' state in RocksDB, which timers need, if it keeps it in memory."""
    conf = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(conf):
        spark.conf.set(conf, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def health_stream(fetches: DataFrame, late: str = "3 days", ttl_days: int = TTL_DAYS) -> DataFrame:
    """fetches (source_id, ts, seq, failed, empty), a stream; a row for each with the streaks that end there.

    Rows of a micro-batch are taken in time order; a source's rows of one micro-batch are sorted in one task, so a long log is
    replayed a bounded number of files at a time (maxFilesPerTrigger). Rows later than `late` are dropped. A source that
    was silent for ttl_days begins anew.
    """
    with_timers(fetches.sparkSession)
    grouped = fetches.withWatermark("ts", late).groupBy("source_id")
    return grouped.transformWithStateInPandas(SourceHealth(ttl_days * DAY_MS), OUTPUT, "Append", "EventTime")


class Absence(StatefulProcessor):
    """Days of one key with too few rows that count. A day is judged once the stream's time has passed its end, whether or not
    a row of the key has come since: a timer stands for the earliest open day."""

    def __init__(self, least: int):
        self.least = least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "day long")
        self.counts = handle.getMapState("counts", "day long", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        log = pd.concat(list(rows))
        ts = log["ts"].dt.tz_localize("UTC") if log["ts"].dt.tz is None else log["ts"]
        log = log.assign(day=ts.map(lambda t: int(t.timestamp() * 1000) // DAY_MS))
        first = int(log["day"].min())
        if not self.open.exists():
            self.open.update((first,))
            self.handle.registerTimer((first + 1) * DAY_MS)
        for day, n in log[log["sent"].astype(bool)].groupby("day").size().items():
            before = self.counts.getValue((int(day),))[0] if self.counts.containsKey((int(day),)) else 0
            self.counts.updateValue((int(day),), (before + int(n),))
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        day, out = self.open.get()[0], []
        while (day + 1) * DAY_MS <= timerValues.getCurrentWatermarkInMs():
            n = self.counts.getValue((day,))[0] if self.counts.containsKey((day,)) else 0
            self.counts.removeKey((day,))
            if n < self.least:
                out.append((key[0], pd.Timestamp(day * DAY_MS, unit="ms").date(), n))
            day += 1
        self.open.update((day,))
        self.handle.registerTimer((day + 1) * DAY_MS)
        yield pd.DataFrame(out, columns=["key", "day", "sent"])

    def close(self) -> None:
        pass


def absence_stream(log: DataFrame, least: int = 1, late: str = "1 hour") -> DataFrame:
    """log (key, ts, sent), a stream; (key, day, sent) of each day on which fewer than `least` rows of a key were sent, as soon as
    the stream's time is `late` past the day's end. Any key's rows move that time. Days before a key's first row don't count."""
    with_timers(log.sparkSession)
    return log.withWatermark("ts", late).groupBy("key").transformWithStateInPandas(Absence(least), "key string, day date, sent long", "Append", "EventTime")


def error_stream(log: DataFrame, width: str = "5 minutes", keys: list[str] = (), threshold: int = 1, late: str = "1 minute") -> DataFrame:
    """log (ts, failed, keys), a stream; windows with at least `threshold` errors, once they are over: `runs.error_windows` as it runs."""
    w = F.window("ts", width)
    rows = log.where("failed").withWatermark("ts", late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("errors")).where(F.col("errors") >= threshold)
    return rows.select(F.col("w.start").alias("window_start"), *keys, "errors")


def daily_counts(events: DataFrame, late: str = "3 days") -> DataFrame:
    """Events of each business day, which ends at 22:00 UTC, closed once nothing of it can come any more."""
    day = F.window("ts", "1 day", startTime="22 hours")
    return events.withWatermark("ts", late).groupBy(day, "event_type").agg(F.count("*").alias("n")).select(F.col("window.end").alias("day_end"), "event_type", "n")


def sliding_totals(events: DataFrame, start, end, key: str = "user_id") -> DataFrame:
    """Events and their total value by key in a half-open window of days, as a weekly digest looks back."""
    inside = events.where((F.col("ts") >= start) & (F.col("ts") < end))
    return inside.groupBy(key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def business_days(events: DataFrame, keys: list[str]) -> DataFrame:
    """Events by business day, in batch; `daily_counts` closes the same days over a stream."""
    return events.groupBy(business_day(F.col("ts")).cast("string").alias("day"), *keys).agg(F.count("*").alias("n"))
