"""The gate that generated entries pass: first failed check of each, and what is left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import BANNED, annotate_region, first_banned, is_blank

FIELDS = ("headline", "summary", "affected", "date_note")


def static_check(items: DataFrame, entries: DataFrame, patterns: tuple[str, ...] = BANNED) -> DataFrame:
    """entries (digest_id, idx, item_id, source_url, headline, ...) with `failed`: Q1, Q3, Q4, Q5, Q8 or null.

    Q1: the URL is that of no item. Q3: the item is unknown or has another URL. Q4: headline, summary or URL is
    blank. Q5: a banned expression. Q8: a later entry of the same URL, among those that pass all of these.
    """
    by_id = items.select(F.col("id").alias("item_id"), F.col("canonical_url").alias("item_url"))
    urls = items.select(F.col("canonical_url").alias("source_url")).distinct().withColumn("url_known", F.lit(True))
    banned = first_banned([(f, F.col(f)) for f in FIELDS], patterns)
    rows = entries.join(urls, "source_url", "left").join(by_id, "item_id", "left").withColumn("banned", banned)
    first = F.coalesce(
        F.when(is_blank(F.col("source_url")) | F.col("url_known").isNull(), "Q1"),
        F.when(F.col("item_url").isNull() | (F.col("item_url") != F.col("source_url")), "Q3"),
        F.when(is_blank(F.col("headline")) | is_blank(F.col("summary")), "Q4"),
        F.when(F.col("banned").isNotNull(), "Q5"),
    )
    rows = rows.withColumn("failed", first)
    turn = F.row_number().over(W.partitionBy("digest_id", "source_url", F.col("failed").isNull()).orderBy("idx"))
    return rows.withColumn("failed", F.coalesce("failed", F.when(turn > 1, "Q8"))).drop("url_known", "item_url")


def reachability_check(checked: DataFrame, reached: DataFrame) -> DataFrame:
    """Q2 after all others, so that an unreachable first entry still suppresses its copies. reached: source_url, ok,
    robots_disallowed, one row for each URL that passed; a refusal by robots rules passes."""
    rows = checked.join(reached, "source_url", "left")
    bad = F.col("failed").isNull() & ~F.coalesce("ok", F.lit(False)) & ~F.coalesce("robots_disallowed", F.lit(False))
    return rows.withColumn("failed", F.when(bad, "Q2").otherwise(F.col("failed"))).drop("ok", "robots_disallowed")


def transient(status: Column) -> Column:
    """Whether a failed reachability test is worth one more try."""
    return status.isNull() | (status >= 500) | (status == 429)


def passed(checked: DataFrame, regions: DataFrame) -> DataFrame:
    """Entries without a failed check, with their region named. regions: source_url, region."""
    one = regions.groupBy("source_url").agg(F.max_by("region", "ord").alias("region"))
    rows = checked.where("failed is null").join(one, "source_url", "left")
    return rows.withColumn("affected", annotate_region(F.col("headline"), F.col("summary"), F.col("affected"), F.col("region")))


def breakdown(checked: DataFrame) -> DataFrame:
    """How many entries each check failed."""
    return checked.where("failed is not null").groupBy("failed").agg(F.count("*").alias("n"))
