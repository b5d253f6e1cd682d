"""Change detection over listings: identities, new and changed items, quotas and rechecks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

NEW_PER_SOURCE, RECHECK_PER_SOURCE, UPDATES_PER_SOURCE = 50, 5, 50


def first_per_key(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in listing order."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def new_candidates(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates whose id no item has."""
    return candidates.join(items.select("id"), "id", "left_anti")


def known_candidates(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates with the item of their id; the item's other columns get the prefix old_."""
    old = items.select("id", *(F.col(c).alias(f"old_{c}") for c in items.columns if c != "id"))
    return candidates.join(old, "id")


def capped_new(candidates: DataFrame, limit: int = NEW_PER_SOURCE) -> DataFrame:
    """The first `limit` new candidates of each source in listing order, with the source's number of those left over."""
    # the rank alone is limited in every task before the shuffle, so a source with very many rows sends few
    first = candidates.withColumn("rank", F.row_number().over(W.partitionBy("source_id").orderBy("ord"))).where(F.col("rank") <= limit)
    counted = candidates.groupBy("source_id").agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("overflow"))
    return first.join(counted, "source_id")


def oldest_known(known: DataFrame, limit: int = RECHECK_PER_SOURCE) -> DataFrame:
    """The `limit` known items of each source that were updated longest ago; ties in listing order."""
    ranked = known.withColumn("rank", F.row_number().over(W.partitionBy("source_id").orderBy("updated_at", "ord")))
    return ranked.where(F.col("rank") <= limit)


def rechecks(known: DataFrame, refetched: DataFrame, limit: int = RECHECK_PER_SOURCE) -> DataFrame:
    """`oldest_known` without those refetched already: they use up places of the limit."""
    return oldest_known(known, limit).join(refetched.select("id"), "id", "left_anti")


def update_quota(known: DataFrame, changed: Column, limit: int = UPDATES_PER_SOURCE) -> DataFrame:
    """Known candidates in listing order, as long as fewer than `limit` before them had changed; later ones wait. `before`
    tells how many had. Of a source only the places of its first `limit` changed ones are gathered, ranked in every
    task before the shuffle."""
    rows = known.withColumn("changed", F.coalesce(changed.cast("int"), F.lit(0)))
    first = rows.where("changed = 1").select("source_id", "ord", F.row_number().over(W.partitionBy("source_id").orderBy("ord")).alias("r")).where(F.col("r") <= limit)
    places = first.groupBy("source_id").agg(F.collect_list("ord").alias("places"))
    counted = rows.join(places, "source_id", "left").withColumn("before", F.size(F.filter(F.coalesce("places", F.array().cast("array<long>")), lambda x: x < F.col("ord"))).cast("long"))
    return counted.where(F.col("before") < limit).drop("places")


def source_names(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with source_name: the name of their source, or its id where it is not configured."""
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("__name"))
    return rows.join(names, "source_id", "left").withColumn("source_name", F.coalesce("__name", "source_id")).drop("__name")


def counted_first(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """Per key the least of `order` and the number of rows, as `n`; summed up in every task first."""
    return rows.groupBy(*key).agg(F.min(order).alias(order), F.count("*").alias("n"))


def apply_updates(pairs: DataFrame, now: Column, compat: bool = True) -> DataFrame:
    """New values of known items that were refetched.

    pairs: id, the item's columns with the prefix old_, and the new source_id, title, published_at, content_text,
    content_hash, region. Title, date and region follow the source that found the item first; changed content
    undoes the classification; detection and digest marks stay. compat: updated_at moves with every refetch, as
    older stores have it; else only with content, and checked_at tells of the refetch.
    """
    same = F.col("source_id") == F.col("old_source_id")
    changed = ~F.col("content_hash").eqNullSafe(F.col("old_content_hash"))
    pick = lambda c: F.when(same, F.coalesce(c, "old_" + c)).otherwise(F.col("old_" + c))
    return pairs.select(
        "id",
        F.col("old_source_id").alias("source_id"),
        F.when(same & (F.coalesce("title", F.lit("")) != ""), F.col("title")).otherwise(F.col("old_title")).alias("title"),
        pick("published_at").alias("published_at"),
        F.when(same, F.col("region")).otherwise(F.col("old_region")).alias("region"),
        "content_text",
        "content_hash",
        F.col("old_detected_at").alias("detected_at"),
        (now if compat else F.when(changed, now).otherwise(F.col("old_updated_at"))).alias("updated_at"),
        now.alias("checked_at"),
        F.when(~changed, F.col("old_classified_at")).alias("classified_at"),
        F.col("old_digested_in").alias("digested_in"),
        changed.alias("content_changed"),
    )


def unclassified_queue(items: DataFrame, since: Column, limit: int, batch: int = 20) -> DataFrame:
    """Unclassified items updated at or after `since`, oldest first, at most `limit`, with their batch's number. The limit
    bounds what is numbered in one task."""
    if limit <= 0:
        return items.where(F.lit(False)).withColumn("batch_id", F.lit(0))
    queue = items.where(F.col("classified_at").isNull() & (F.col("updated_at") >= since)).orderBy("updated_at", "id").limit(limit)
    return queue.withColumn("batch_id", F.floor((F.row_number().over(W.orderBy("updated_at", "id")) - 1) / batch).cast("int"))


def lookback_days(period_days: Column) -> Column:
    """Days of unclassified items worth classifying: the longest channel period, carry-over and a margin."""
    return F.greatest(F.max(period_days), F.lit(1)) + 3 + 1


def enabled_sources(sources: DataFrame, requested: list[str] | None = None) -> DataFrame:
    out = sources.where("enabled")
    return out.where(F.col("id").isin(requested)) if requested else out


def bootstrap(items: DataFrame, on: Column, now: Column) -> DataFrame:
    """On a source's first run its items count as classified and irrelevant, so that no backlog is sent."""
    return items.withColumns({
        "relevance": F.when(on, F.lit(0.0)).otherwise(F.col("relevance")),
        "channels": F.when(on, F.array().cast("array<string>")).otherwise(F.col("channels")),
        "classified_at": F.when(on, now).otherwise(F.col("classified_at")),
    })
