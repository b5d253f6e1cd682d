"""Source health from fetch logs: streaks, alerts, latest state, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .store import ordinals

FAILURE_THRESHOLD, EMPTY_THRESHOLD = 3, 4


def _run_lengths(rows: DataFrame, counts: Column, resets: Column, name: str) -> DataFrame:
    """rows (source_id, __block, ts, seq) with `name`: how many rows that count there were since the last that resets.

    A source's rows are numbered by block; what a block hands on to the next one follows from sums of blocks, so a
    source with very many rows is never in one task as a whole.
    """
    place = W.partitionBy("source_id", "__block").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumns({"__c": F.coalesce(counts, F.lit(False)).cast("int"), "__r": F.coalesce(resets, F.lit(False)).cast("int")})
    rows = rows.withColumn("__g", F.sum("__r").over(place))
    inside = W.partitionBy("source_id", "__block", "__g").orderBy("ts", "seq").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("__n", F.sum("__c").over(inside))
    last = F.struct("ts", "seq")
    blocks = rows.groupBy("source_id", "__block").agg(F.max("__r").alias("any"), F.max_by("__n", last).alias("tail"))
    by = W.partitionBy("source_id").orderBy("__block")
    blocks = blocks.withColumn("group", F.sum("any").over(by.rowsBetween(W.unboundedPreceding, 0)))
    sums = F.sum("tail").over(W.partitionBy("source_id", "group").orderBy("__block").rowsBetween(W.unboundedPreceding, 0))
    carry = blocks.withColumn("end", sums).select("source_id", "__block", F.coalesce(F.lag("end").over(by), F.lit(0)).alias("__carry"))
    rows = rows.join(carry, ["source_id", "__block"])
    return rows.withColumn(name, (F.col("__n") + F.when(F.col("__g") == 0, F.col("__carry")).otherwise(0)).cast("int")).drop("__c", "__r", "__g", "__n", "__carry")


def streaks(fetches: DataFrame, block: str = "day") -> DataFrame:
    """fetches (source_id, ts, seq, failed, empty) with failures and empties: the lengths of the unbroken runs that end
    there. A success ends failures; an empty listing counts up, any other success resets it; a failure leaves it."""
    rows = fetches.withColumn("__block", F.date_trunc(block, F.col("ts")))
    failed, empty = F.col("failed"), F.col("empty")
    rows = _run_lengths(rows, failed, ~failed, "failures")
    return _run_lengths(rows, ~failed & empty, ~failed & ~empty, "empties").drop("__block")


def alerts_at(count: Column, threshold: int) -> Column:
    """Whether a run that grows by one alerts at this length: first at the threshold, then each time it has doubled."""
    ratio = count / F.lit(threshold)
    return (count >= threshold) & (F.pmod(count, F.lit(threshold)) == 0) & (F.pow(F.lit(2), F.round(F.log2(F.greatest(ratio, F.lit(1))))) == ratio)


def latest_state(health: DataFrame) -> DataFrame:
    """The last state of each source, of `streaks` rows, with the time of its last success."""
    return health.groupBy("source_id").agg(
        F.max_by("ts", F.struct("ts", "seq")).alias("last_fetched_at"),
        F.max(F.when(~F.col("failed"), F.col("ts"))).alias("last_success_at"),
        F.max_by("failures", F.struct("ts", "seq")).alias("consecutive_failures"),
        F.max_by("empties", F.struct("ts", "seq")).alias("consecutive_empty"),
    )


def silent(states: DataFrame, threshold: int = EMPTY_THRESHOLD) -> DataFrame:
    """Sources that answer but have listed nothing for a while."""
    return states.where((F.col("consecutive_failures") == 0) & (F.col("consecutive_empty") >= threshold))


def coverage(runs: DataFrame, n_silent: Column) -> DataFrame:
    """Per day: total sources of the latest run, and the most that succeeded, no more than total, less the silent ones."""
    latest = F.struct("started_at", "id")
    day = runs.groupBy("day").agg(F.max("succeeded").alias("best"), F.max_by("total", latest).alias("total"), F.max("started_at").alias("last_run_at"))
    return day.withColumn("succeeded", F.greatest(F.least("best", "total") - n_silent, F.lit(0))).drop("best")


def run_status(job: str, total: Column, failed: Column, sent: Column, errors: Column) -> Column:
    """The end state of a run. A collection without sources fails; a delivery fails if it has errors and sent nothing."""
    if job == "deliver":
        return F.when(errors == 0, "succeeded").when(sent > 0, "partial").otherwise("failed")
    none_left = failed == total if job == "collect" else (total > 0) & (failed == total)
    return F.when(none_left, "failed").when((failed > 0) | (errors > 0), "partial").otherwise("succeeded")


def report(states: DataFrame) -> DataFrame:
    """Failing sources with their position: most failures first, then by id. Positions follow from the numbers of sources by
    failures and by range of ids, so no task numbers all of them."""
    failing = states.where("consecutive_failures > 0").withColumn("__range", F.floor(F.col("source_id") / 4096))
    return ordinals(failing, [F.desc("consecutive_failures"), F.col("__range")], ["consecutive_failures", "__range"], [F.col("source_id")], "position").drop("__range")


def from_states(fetches: DataFrame, day: Column) -> DataFrame:
    """Coverage of days without a run: per day how many sources succeeded, and the last success."""
    ok = fetches.where("not failed").groupBy(day.alias("day"), "source_id").agg(F.max("ts").alias("last"))
    return ok.groupBy("day").agg(F.count("*").alias("succeeded"), F.max("last").alias("last_success_at"))


def named_states(states: DataFrame, sources: DataFrame) -> DataFrame:
    """The states of enabled sources only, with their names, or their ids where they have none. sources: id, name, enabled."""
    wanted = sources.where("enabled").select(F.col("id").alias("source_id"), F.coalesce(F.when(F.trim("name") != "", F.col("name")), F.col("id").cast("string")).alias("name"))
    return states.join(wanted, "source_id")
