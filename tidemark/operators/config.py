"""Checks of the configuration, as tables of violations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_ID = r"^[a-z0-9][a-z0-9_]*$"


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with how often."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def undefined_references(sources: DataFrame, channels: DataFrame) -> DataFrame:
    """Distinct (source_id, channel_id) of references to channels that are not there."""
    pairs = sources.select(F.col("id").alias("source_id"), F.explode("channels").alias("channel_id")).distinct()
    return pairs.join(channels.select(F.col("id").alias("channel_id")), "channel_id", "left_anti")


def unreferenced_channels(sources: DataFrame, channels: DataFrame) -> DataFrame:
    """Channels that no source feeds."""
    used = sources.select(F.explode("channels").alias("id")).distinct()
    return channels.join(used, "id", "left_anti")


def _violations(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items())))
    return rows.select("id", F.explode(found).alias("violation"))


def source_violations(sources: DataFrame) -> DataFrame:
    """(id, violation) for sources: id, name, type, url, channels, html.item_selector, law.lookback_days."""
    return _violations(sources, {
        "id pattern": F.col("id").isNull() | ~F.col("id").rlike(_ID),
        "name empty": F.coalesce(F.col("name"), F.lit("")) == "",
        "type unknown": ~F.col("type").isin("feed", "html", "law"),
        "url not http": ~F.coalesce(F.col("url"), F.lit("")).rlike(r"^https?://"),
        "no channels": F.size("channels") <= 0,
        "html block missing": (F.col("type") == "html") & F.col("html").isNull(),
        "html block not allowed": (F.col("type") != "html") & F.col("html").isNotNull(),
        "law block missing": (F.col("type") == "law") & F.col("law").isNull(),
        "law block not allowed": (F.col("type") != "law") & F.col("law").isNotNull(),
        "lookback range": ~F.col("law.lookback_days").between(1, 365),
    })


def channel_violations(channels: DataFrame) -> DataFrame:
    """(id, violation) for channels."""
    return _violations(channels, {
        "id pattern": F.col("id").isNull() | ~F.col("id").rlike(_ID),
        "threshold range": ~F.col("relevance_threshold").between(0.0, 1.0),
        "items range": (F.col("min_items") > F.col("max_items")) | (F.col("max_items") < 1),
        "chars range": ~F.col("max_chars").between(100, 5000),
        "urgent without weekly": F.col("urgent_within_days").isNotNull() & F.col("weekly_on").isNull(),
    })


def unknown_requested(configured: DataFrame, requested: DataFrame) -> DataFrame:
    """Ids that were asked for and are not configured."""
    return requested.select("id").distinct().join(configured.select("id"), "id", "left_anti")


def summary(sources: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per type: sources, those that are enabled, and those whose verification was not ok, with their share."""
    rows = sources.join(verdicts.select("id", "verdict"), "id", "left")
    bad = F.count_if(F.col("verdict") != "ok")
    return rows.groupBy("type").agg(F.count("*").alias("sources"), F.count_if("enabled").alias("enabled"), bad.alias("not_ok"), F.round(bad / F.count("*"), 4).alias("share"))


def to_disable(verdicts: DataFrame, most: float = 0.5) -> DataFrame:
    """Sources that a repair would switch off; none if more than the share `most` of all would be."""
    bad = verdicts.where("verdict <> 'ok'")
    share = verdicts.agg(F.count_if(F.col("verdict") != "ok") / F.greatest(F.count("*"), F.lit(1))).scalar()
    return bad.where(share <= most)


def repairs(verdicts: DataFrame, sources: DataFrame, most: float = 0.5) -> DataFrame:
    """(id, reason, configured): what a repair would note at each source that it switches off; of verdicts for sources that the
    configuration doesn't have, configured is false, and the caller is to be warned."""
    known = sources.select("id", F.lit(True).alias("configured"))
    reasons = to_disable(verdicts, most).select("id", F.col("verdict").alias("reason"))
    return reasons.join(known, "id", "left").withColumn("configured", F.coalesce("configured", F.lit(False)))


def none_enabled(sources: DataFrame) -> DataFrame:
    """A violation, (id, violation), where no source is enabled; an empty configuration has none either."""
    return sources.agg(F.count_if("enabled").alias("n")).where("n = 0").select(F.lit(None).cast("string").alias("id"), F.lit("no source enabled").alias("violation"))


SOURCE = "id string, name string, type string, url string, enabled boolean, region string, channels array<string>, html struct<item_selector: string, date_selector: string, title_from: string>, law struct<lookback_days: int>, include array<string>, exclude array<string>"
CHANNEL = "id string, name string, relevance_threshold double, min_items int, max_items int, max_chars int, urgent_within_days int, weekly_on int"


def records(rows: DataFrame, kind: str, schema: str) -> DataFrame:
    """Records of one kind, of configuration rows (record, a JSON string); values of another type are null."""
    parsed = rows.where(F.get_json_object("record", "$.kind") == kind).select(F.from_json("record", schema).alias("r")).select("r.*")
    return parsed.withColumn("enabled", F.coalesce("enabled", F.lit(True))) if "enabled" in parsed.columns else parsed


def all_violations(sources: DataFrame, channels: DataFrame) -> DataFrame:
    """(kind, id, violation): all that is wrong with sources and channels, by themselves, among each other and with their references."""
    no_channels = F.array().cast("array<string>")
    sources = sources.withColumn("channels", F.coalesce("channels", no_channels))
    rows = [
        ("source", source_violations(sources)), ("channel", channel_violations(channels)),
        ("source", duplicates(sources, "id").select("id", F.lit("repeated id").alias("violation"))), ("channel", duplicates(channels, "id").select("id", F.lit("repeated id").alias("violation"))),
        ("source", undefined_references(sources, channels).select(F.col("source_id").alias("id"), F.concat(F.lit("unknown channel "), "channel_id").alias("violation"))),
        ("channel", unreferenced_channels(sources, channels).select("id", F.lit("no source feeds it").alias("violation"))), ("source", none_enabled(sources)),
    ]
    return reduce(DataFrame.unionByName, (r.select(F.lit(kind).alias("kind"), "id", "violation") for kind, r in rows))
