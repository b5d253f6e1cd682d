"""What comes back from a language model: parsing, validation and joining to what was asked."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import one_line
from ..functions.time import valid_date
from .store import ordinals

RESULT = "array<struct<id: string, channels: array<string>, relevance: double, importance: string, kind: string, isDuplicateOfNational: boolean, effectiveDate: string, deadline: string, reason: string>>"
IMPORTANCE = ("low", "medium", "high")
REASON_CHARS = 200


def batches(queue: DataFrame, size: int = 20) -> DataFrame:
    """A row for each batch of a queue with batch_id: the ids that are asked about, in order."""
    return queue.groupBy("batch_id").agg(F.sort_array(F.collect_list(F.struct("updated_at", "id"))).alias("rows")).select("batch_id", F.transform("rows", lambda r: r["id"]).alias("ids"))


def parse(responses: DataFrame, known_channels: list[str]) -> DataFrame:
    """responses (batch_id, body) as rows (batch_id, id, channels, relevance, importance_rank, ...), the first of each id.

    Channels that are not known are dropped, as are repeated ones; a relevance outside 0..1 is clamped; what is no
    date is null; a body that can't be read gives no rows.
    """
    rows = responses.select("batch_id", F.posexplode(F.from_json("body", RESULT)).alias("at", "r")).where("r.id is not null")
    first = rows.groupBy("batch_id", "r.id").agg(F.min_by("r", "at").alias("r"))
    known = F.array(*map(F.lit, known_channels))
    rank = F.coalesce(*(F.when(F.col("r.importance") == name, k) for k, name in enumerate(IMPORTANCE, 1)))
    return first.select(
        "batch_id", F.col("r.id").alias("id"), F.array_intersect(F.coalesce("r.channels", F.array().cast("array<string>")), known).alias("channels"),
        F.least(F.greatest(F.coalesce("r.relevance", F.lit(0.0)), F.lit(0.0)), F.lit(1.0)).alias("relevance"), F.coalesce(rank, F.lit(1)).alias("importance_rank"),
        F.coalesce("r.isDuplicateOfNational", F.lit(False)).alias("is_duplicate_of_national"), valid_date(F.col("r.effectiveDate")).alias("effective_date"),
        valid_date(F.col("r.deadline")).alias("deadline"), F.left(one_line(F.coalesce("r.reason", F.lit(""))), F.lit(REASON_CHARS)).alias("reason"),
    )


def join_results(asked: DataFrame, results: DataFrame) -> DataFrame:
    """asked (batch_id, id) with its result, if any; results for ids that the batch did not ask about fall away."""
    return asked.join(results, ["batch_id", "id"], "left")


def missing(joined: DataFrame, result: str = "relevance") -> DataFrame:
    """Per batch: how many were asked about, and how many have no result."""
    return joined.groupBy("batch_id").agg(F.count("*").alias("asked"), F.count_if(F.col(result).isNull()).alias("missing"))


def apply(items: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """items with new classifications; classified items move their updated_at."""
    names = [c for c in ("channels", "relevance", "importance_rank", "is_duplicate_of_national", "deadline") if c in items.columns]
    got = results.select("id", *(F.col(c).alias(f"__{c}") for c in names))
    hit = F.col("__relevance").isNotNull()
    out = items.join(got, "id", "left").withColumns({c: F.when(hit, F.col(f"__{c}")).otherwise(F.col(c)) for c in names})
    out = out.withColumns({c: F.when(F.col("__relevance").isNotNull(), now).otherwise(F.col(c)) for c in ("classified_at", "updated_at")})
    return out.select(items.columns)


def error_kind(status: Column, detail: Column) -> Column:
    """What a failed call of a model calls for: retry (no answer, a rate limit, a server's fault), billing, or refused."""
    bill = F.coalesce(detail, F.lit("")).rlike("(?i)credit balance|billing")
    return F.when(status.isNull() | (status == 429) | (status >= 500), "retry").when(bill, "billing").otherwise("refused")


def merged_text(parts: DataFrame, key: str, order: str, text: str, separator: str = "\n---\n") -> DataFrame:
    """The audit text of each key: its parts in order."""
    rows = parts.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(order, text))).alias("__parts"))
    return rows.select(key, F.array_join(F.transform("__parts", lambda p: p[text]), separator).alias("merged"))


USAGE = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def usage(calls: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Sums of token usage and calls by key; a sum is null where no call reported any."""
    return calls.groupBy(*keys).agg(*(F.sum(c).cast("long").alias(c) for c in USAGE if c in calls.columns), F.count("*").alias("calls"))


def batched(rows: DataFrame, key: str = "id", size: int = 20) -> DataFrame:
    """rows with the number of their batch, `size` at a time in order of a numeric key, whatever gaps it has."""
    ranged = rows.withColumn("__range", F.floor(F.col(key) / 4096))
    numbered = ordinals(ranged, [F.col("__range")], ["__range"], [F.col(key)], "__k")
    return numbered.withColumn("batch_id", F.floor((F.col("__k") - 1) / size).cast("long")).drop("__range", "__k")


def omitted(by_model: Column, by_gate: Column, over_top: Column, over_cap: Column, by_fit: Column) -> Column:
    """The number of items that a message says were left out."""
    return by_model + by_gate + over_top + over_cap + by_fit
