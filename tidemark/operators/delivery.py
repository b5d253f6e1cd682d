"""Decisions about digests and deliveries, as columns over joined records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def decision(digests: DataFrame, deliveries: DataFrame, require_approval: Column, dry_run: bool = False) -> DataFrame:
    """What to do for each (id) of digests joined with its delivery record: the first rule that applies.

    digests: id, status (null where there is no digest); deliveries: id, delivery_status.
    """
    rows = digests.join(deliveries, "id", "left")
    status = F.col("status")
    first = (
        F.when(status.isNull(), "missing")
        .when(status.isin("delivered", "skipped", "failed"), status)
        .when(require_approval & (status != "approved"), "awaiting_approval")
        .when(F.coalesce(F.col("delivery_status") == "sent", F.lit(False)), "already_sent")
    )
    return rows.withColumn("decision", first.otherwise("dry_run" if dry_run else "send"))


def pending(decided: DataFrame, now: Column) -> DataFrame:
    """The records written before anything is sent: stored as failed, one more attempt, and the retry key kept."""
    return decided.where("decision = 'send'").select(
        "id", F.coalesce("retry_key", F.expr("uuid()")).alias("retry_key"), F.lit("failed").alias("delivery_status"),
        (F.coalesce("attempts", F.lit(0)) + 1).alias("attempts"), now.alias("updated_at"),
    )


def settled(pending_rows: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """Delivery records after sending. results: id, ok, error. A record without a result stays failed."""
    rows = pending_rows.join(results, "id", "left")
    ok = F.coalesce("ok", F.lit(False))
    return rows.select("id", "retry_key", F.when(ok, "sent").otherwise("failed").alias("delivery_status"), "attempts", F.when(ok, now).alias("sent_at"), F.when(~ok, F.col("error")).alias("error"))


def approve(digests: DataFrame, digest_id: str) -> DataFrame:
    """digests with one approved; one that is delivered stays so."""
    hit = (F.col("id") == digest_id) & (F.col("status") == "generated")
    return digests.withColumn("status", F.when(hit, "approved").otherwise(F.col("status")))


def digest_outcome(exists: Column, mode: Column, n_candidates: Column, n_unclassified: Column, n_passed: Column, send_when_empty: Column) -> Column:
    """The state a digest ends in. With nothing to send, unclassified items mean a failure and not a quiet day."""
    quiet = F.when(n_unclassified > 0, "failed").when(send_when_empty, "generated").otherwise("skipped")
    return F.when(exists, "kept").when((mode == "urgent") & (n_candidates == 0), "skipped").when(n_candidates == 0, quiet).when(n_passed == 0, "failed").otherwise("generated")


def verification(url: Column, ok: Column, status: Column, n_candidates: Column, kind: Column, parsed: Column) -> Column:
    """The verdict on a configured source."""
    return (
        F.when(url.isNull() | (url == ""), "unset")
        .when(~F.coalesce(ok, F.lit(False)), "unreachable")
        .when(~F.coalesce(parsed, F.lit(False)), "unparsable")
        .when((n_candidates == 0) & (kind != "law"), "no_candidates")
        .otherwise("ok")
    )
