"""The run log: runs begin as running and end in a final state; alerts on what is logged."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import SnapshotStore

COUNTERS = ("sources_total", "sources_succeeded", "sources_failed", "fetched", "new_items", "updated_items", "classified", "digests_generated", "excluded", "sent", "skipped")
SCHEMA = "id string, job string, started_at timestamp_ntz, finished_at timestamp_ntz, status string, errors array<string>, " + ", ".join(f"{c} int" for c in COUNTERS) + ", version double"


def _row(spark: SparkSession, **values) -> DataFrame:
    names = [p.split(" ")[0] for p in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(values.get(n, 0 if n in COUNTERS else None) for n in names)], SCHEMA)


def begin(store: SnapshotStore, run_id: str, job: str, now: datetime) -> None:
    store.upsert("runs", _row(store.spark, id=run_id, job=job, started_at=now, status="running", errors=[], version=0.0))


def finish(store: SnapshotStore, run_id: str, status: str, now: datetime, counts: dict[str, int] | None = None, errors: list[str] = ()) -> None:
    """The final record of a run; also for one that failed, before its error is raised again."""
    old = store.read("runs").where(F.col("id") == run_id).first()
    store.upsert("runs", _row(store.spark, id=run_id, job=old.job, started_at=old.started_at, finished_at=now, status=status, errors=list(errors), version=1.0, **(counts or {})))


def counters(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of runs from a row for each outcome (kind)."""
    return outcomes.groupBy(*keys).agg(*(F.count_if(F.col("kind") == c).cast("int").alias(c) for c in COUNTERS))


def error_windows(log: DataFrame, width: str, keys: list[str], threshold: int = 1) -> DataFrame:
    """Windows of a log (ts, failed, keys) with at least `threshold` errors."""
    w = F.window(F.col("ts").cast("timestamp"), width)
    rows = log.where("failed").groupBy(w.alias("w"), *keys).agg(F.count("*").alias("errors")).where(F.col("errors") >= threshold)
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), *keys, "errors")


def missing_days(log: DataFrame, sent: Column, least: int) -> DataFrame:
    """Days of a log's span (ts) on which fewer than `least` rows of `sent` were logged, days without any row too."""
    span = log.agg(F.min("ts").cast("date").alias("a"), F.max("ts").cast("date").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    done = log.where(sent).groupBy(F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"))
    return days.join(done, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("sent")).where(F.col("sent") < least)
