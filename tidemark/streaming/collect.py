"""Incremental collection: candidates that arrive as files become items, each URL once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import content_hash
from ..functions.urls import canonical_url, item_id
from ..operators.collect import first_per_key
from ..operators.store import SnapshotStore

CANDIDATE = "source_id string, ord int, url string, title string, published_at timestamp_ntz, content_text string"


def items_of(candidates: DataFrame, now: datetime) -> DataFrame:
    """New item rows of candidates: URLs made canonical, unreadable ones dropped, the first of each kept."""
    rows = candidates.withColumn("canonical_url", canonical_url(F.col("url"))).where("canonical_url is not null").withColumn("id", item_id(F.col("canonical_url")))
    at = F.lit(str(now)).cast("timestamp_ntz")
    rows = first_per_key(rows, ["id"], ["source_id", "ord"])
    return rows.select("id", "source_id", "ord", "canonical_url", "title", "published_at", at.alias("detected_at"), at.alias("updated_at"), content_hash(F.col("content_text"), F.col("title")).alias("content_hash"), "content_text")


def start(spark: SparkSession, folder: str, store: SnapshotStore, checkpoint: str, clock=datetime.now) -> StreamingQuery:
    """Take all candidate files of a folder that have not been taken yet, and stop. A batch that is run again after a
    failure finds its items in the store and adds nothing."""

    def batch(rows: DataFrame, _: int) -> None:
        store.insert("items", items_of(rows, clock()).drop("ord"))

    stream = spark.readStream.schema(CANDIDATE).json(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
