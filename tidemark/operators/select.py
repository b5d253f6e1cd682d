"""Selection of digest candidates: windows, carry-over, updates, suppression, ranking."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.time import WEEKDAYS, window_of

TOP, URGENT_TOP = 20, 5
CARRY_DAYS, UPDATE_DAYS, REDELIVER_DAYS, URGENT_DAYS = 3, 14, 7, 3


@dataclass(frozen=True)
class Channel:
    id: str
    relevance_threshold: float = 0.5
    max_items: int = 10
    max_chars: int = 5000
    weekly_on: int | None = None  # 0 for Sunday
    urgent_within_days: int = 3
    send_when_empty: bool = True
    require_approval: bool = False
    name: str = ""


def mode_of(channel: Channel, day: date) -> str:
    """daily, weekly on the channel's day, else urgent."""
    if channel.weekly_on is None:
        return "daily"
    return "weekly" if (day.weekday() + 1) % len(WEEKDAYS) == channel.weekly_on else "urgent"


def last_digested(digested_in: Column, channel_id: str) -> Column:
    """The latest date in marks of the form channel_date; other channels whose ids begin alike don't count."""
    prefix = channel_id + "_"
    dates = F.transform(F.filter(digested_in, lambda x: x.startswith(prefix)), lambda x: F.substr(x, F.lit(len(prefix) + 1)))
    valid = F.filter(dates, lambda d: d.rlike(r"^\d{4}-\d{2}-\d{2}$") & d.try_cast("date").isNotNull())
    return F.array_max(valid).try_cast("date")


def reason(channel_id: str, day: date, days: int = 1, since: date | None = None, marks: Column | None = None) -> Column:
    """fresh, updated, carried or null, by the row's own times and marks: one scan serves all three."""
    start, end = window_of(day, days)
    carry_from = start - timedelta(days=CARRY_DAYS)
    if since is not None:
        carry_from = min(carry_from, window_of(since)[0])
    t = lambda x: F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
    detected, updated, classified = F.col("detected_at"), F.col("updated_at"), F.col("classified_at")
    last = last_digested(F.col("digested_in") if marks is None else marks, channel_id)
    fresh = (detected >= t(start)) & (detected < t(end)) & last.isNull()
    again = (updated > last.cast("timestamp_ntz") + F.expr("INTERVAL 15 HOURS")) & (F.lit(day.isoformat()).cast("date") >= F.date_add(last, REDELIVER_DAYS))
    changed = (updated >= t(start - timedelta(days=UPDATE_DAYS))) & (updated < t(end)) & (detected < t(start)) & classified.isNotNull() & (classified >= updated)
    changed = changed & F.when(last.isNull(), updated >= t(start)).otherwise(again)
    carried = (detected >= t(carry_from)) & (detected < t(start)) & last.isNull()
    return F.when(fresh, "fresh").when(changed, "updated").when(carried, "carried")


def pool(items: DataFrame, channel_id: str, day: date, days: int = 1, since: date | None = None) -> DataFrame:
    """Window items with their reason; those of no reason are left out."""
    return items.withColumn("reason", reason(channel_id, day, days, since)).where("reason is not null")


def candidates(window_items: DataFrame, channel: Channel, digest_id: str) -> DataFrame:
    """Classified members of the channel above its threshold and not in this digest yet. A regional copy of a national
    notice is dropped where the pool has any national item at all. The pool's number of unclassified items is carried
    along, so that a failed classification is not taken for a quiet day."""
    # scalar subqueries: a window without a key would bring all rows to one task
    has_national = window_items.agg(F.coalesce(F.bool_or(F.col("region").isNull()), F.lit(False))).scalar()
    unclassified = window_items.agg(F.count_if(F.col("classified_at").isNull())).scalar()
    member = F.col("classified_at").isNotNull() & F.array_contains("channels", channel.id) & (F.col("relevance") >= channel.relevance_threshold) & ~F.array_contains("digested_in", digest_id)
    copy = F.col("is_duplicate_of_national") & F.col("region").isNotNull() & has_national
    return window_items.where(member & ~copy).withColumn("unclassified", unclassified)



def ranked(rows: DataFrame, limit: int = TOP) -> DataFrame:
    """The best `limit`: importance, relevance, detection newest first, id."""
    best = [F.desc("importance_rank"), F.desc("relevance"), F.desc("detected_at"), F.col("id")]
    # the limit is applied in every task before the few rows that are left are numbered
    top = rows.orderBy(*best).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*best)))


def urgent(items: DataFrame, channel: Channel, day: date, limit: int = URGENT_TOP) -> DataFrame:
    """On days between weekly digests: important items whose deadline is near and that were never sent here."""
    start, end = window_of(day)[1] - timedelta(days=URGENT_DAYS), window_of(day)[1]
    t = lambda x: F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")
    inside = items.where((F.col("detected_at") >= t(start)) & (F.col("detected_at") < t(end)))
    found = candidates(inside, channel, f"{channel.id}_{day}")
    d = F.lit(day.isoformat()).cast("date")
    near = F.col("deadline").between(d, F.date_add(d, channel.urgent_within_days))
    best = [F.col("deadline"), F.desc("relevance"), F.col("id")]
    top = found.where(near & (F.col("importance_rank") == 3) & last_digested(F.col("digested_in"), channel.id).isNull()).orderBy(*best).limit(limit)
    return top.withColumn("rank", F.row_number().over(W.orderBy(*best)))


def item_cap(entries: DataFrame, limit: int, key: list[str]) -> DataFrame:
    """The `limit` most important entries of each digest; of equal ones the earlier; in their old order, renumbered."""
    kept = entries.withColumn("__r", F.row_number().over(W.partitionBy(*key).orderBy(F.desc("importance_rank"), "idx"))).where(F.col("__r") <= limit)
    return kept.withColumn("number", F.row_number().over(W.partitionBy(*key).orderBy("idx"))).drop("__r")


def items_by_channel(items: DataFrame, channels: DataFrame) -> DataFrame:
    """(channel_id, items): for each of channels (channel_id, least) how many classified items reach its threshold; one row each,
    those without any too. Items are counted by their own channels, in one pass."""
    rows = items.where("classified_at is not null").select(F.explode("channels").alias("channel_id"), "relevance")
    n = rows.join(channels, "channel_id").where(F.col("relevance") >= F.col("least")).groupBy("channel_id").agg(F.count("*").alias("items"))
    return channels.join(n, "channel_id", "left").withColumn("items", F.coalesce("items", F.lit(0)))
