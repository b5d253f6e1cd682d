"""The domain tables, built from the driver's tables by fixed rules (see FIXTURES.md, part C), and the same rules in SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.select import Channel

DAY = date(2024, 1, 15)
CHANNEL = Channel("main", relevance_threshold=0.2, max_items=5, max_chars=1500, weekly_on=1, urgent_within_days=3)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items from documents; labelled ones are classified, English ones national."""
    d, l_ = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "l_id")
    minutes = F.expr("make_dt_interval(0, 0, CAST(doc_id * 7919 % 43200 AS INT), 0)")
    rows = d.join(l_, F.col("doc_id") == F.col("l_id"), "left").withColumn("detected_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + minutes)
    rows = rows.withColumn("updated_at", F.col("detected_at") + F.expr("make_dt_interval(CAST(doc_id % 5 AS INT), 0, 0, 0)"))
    mark = F.concat(F.lit("main_"), F.date_format(F.col("detected_at") + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd"))
    none = F.array().cast("array<string>")
    return rows.select(
        F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("id"),
        F.col("source").alias("source_id"),
        F.col("doc_id").alias("ord"),
        F.left("text", F.lit(60)).alias("title"),
        F.col("text").alias("content_text"),
        F.when(F.col("lang") != "en", F.col("lang")).alias("region"),
        "detected_at",
        "updated_at",
        F.when(F.col("l_id").isNotNull(), F.col("updated_at") + F.expr("INTERVAL 1 HOUR")).alias("classified_at"),
        F.when(F.col("quality") == 1, F.array(F.lit("main"))).otherwise(none).alias("channels"),
        F.least(F.lit(1.0), F.col("n_chars") / F.lit(4000.0)).alias("relevance"),
        (F.col("doc_id") % 3 + 1).cast("int").alias("importance_rank"),
        F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("is_duplicate_of_national"),
        F.date_add(F.col("detected_at").cast("date"), (F.col("doc_id") % 10).cast("int")).alias("deadline"),
        F.when(F.col("doc_id") % 6 == 0, F.array(mark)).otherwise(none).alias("digested_in"),
    )


ITEMS = """items AS (
    SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0') AS id, source AS source_id, doc_id AS ord, left(text, 60) AS title, text AS content_text,
        CASE WHEN lang <> 'en' THEN lang END AS region, detected_at, updated_at,
        CASE WHEN l_id IS NOT NULL THEN updated_at + INTERVAL 1 HOUR END AS classified_at,
        CASE WHEN quality = 1 THEN ['main'] ELSE CAST([] AS VARCHAR[]) END AS channels,
        least(CAST(1 AS DOUBLE), CAST(n_chars AS DOUBLE) / CAST(4000 AS DOUBLE)) AS relevance, CAST(doc_id % 3 + 1 AS INTEGER) AS importance_rank,
        coalesce(toxic = 1, false) AS is_duplicate_of_national, CAST(detected_at AS DATE) + CAST(doc_id % 10 AS INTEGER) AS deadline,
        CASE WHEN doc_id % 6 = 0 THEN ['main_' || strftime(detected_at + INTERVAL 9 HOUR, '%Y-%m-%d')] ELSE CAST([] AS VARCHAR[]) END AS digested_in
    FROM (SELECT *, detected_at + to_days(CAST(doc_id % 5 AS INTEGER)) AS updated_at
          FROM (SELECT d.*, l.doc_id AS l_id, l.quality, l.toxic, TIMESTAMP '2024-01-01' + to_minutes(CAST(d.doc_id * 7919 % 43200 AS INTEGER)) AS detected_at
                FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)))"""


def fetches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fetch log from events: a source for each user, errors are failures, cheap views are empty listings."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("source_id"), "ts", F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"), ((F.col("event_type") == "view") & (F.col("value") < 5)).alias("empty"))


FETCHES = """fetches AS (SELECT user_id AS source_id, ts, event_id AS seq, event_type = 'error' AS failed,
        event_type = 'view' AND value < 5 AS empty FROM events)"""

HEALTH = (
    FETCHES
    + """, marked AS (
    SELECT *, sum(CAST(NOT failed AS INT)) OVER w AS f, sum(CAST(NOT failed AND NOT empty AS INT)) OVER w AS e
    FROM fetches WINDOW w AS (PARTITION BY source_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
health AS (
    SELECT source_id, ts, seq, failed, empty,
        CAST(sum(CAST(failed AS INT)) OVER (PARTITION BY source_id, f ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS INT) AS failures,
        CAST(sum(CAST(NOT failed AND empty AS INT)) OVER (PARTITION BY source_id, e ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS INT) AS empties
    FROM marked)"""
)

STATES = (
    HEALTH
    + """, states AS (
    SELECT source_id, arg_max(ts, (ts, seq)) AS last_fetched_at, max(CASE WHEN NOT failed THEN ts END) AS last_success_at,
        arg_max(failures, (ts, seq)) AS consecutive_failures, arg_max(empties, (ts, seq)) AS consecutive_empty
    FROM health GROUP BY source_id)"""
)


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run for each user and civil day; its counters from the event types."""
    e = table(spark, sf_dir, "events").withColumn("day", (F.col("ts") + F.expr("INTERVAL 9 HOURS")).cast("date"))
    n = lambda *kinds: F.count_if(F.col("event_type").isin(*kinds))
    return e.groupBy("day", "user_id").agg(F.min("ts").alias("started_at"), F.count("*").alias("total"), n("view", "click", "purchase").alias("succeeded"), n("error").alias("failed"), n("purchase").alias("sent"), n("signup").alias("errors")).withColumnRenamed("user_id", "id")


RUNS = """runs AS (
    SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, user_id AS id, min(ts) AS started_at, count(*) AS total,
        count(*) FILTER (event_type IN ('view', 'click', 'purchase')) AS succeeded, count(*) FILTER (event_type = 'error') AS failed,
        count(*) FILTER (event_type = 'purchase') AS sent, count(*) FILTER (event_type = 'signup') AS errors
    FROM events GROUP BY ALL)"""


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated entries, 20 for each digest, with faults that each gate check is to find."""
    d = table(spark, sf_dir, "documents")
    url = lambda x: F.concat(F.lit("https://site.example/"), x.cast("string"))
    k = F.col("doc_id")
    return d.select(
        F.floor(k / 20).cast("long").alias("digest_id"),
        k.alias("idx"),
        F.lpad(F.when(k % 11 == 3, k + 1).otherwise(k).cast("string"), 10, "0").alias("item_id"),
        F.when(k % 7 == 2, F.lit("https://nowhere.example/x")).otherwise(url(F.when(k % 13 == 5, k - 1).otherwise(k))).alias("source_url"),
        F.when(k % 17 == 4, F.lit(" 　")).otherwise(F.left("text", F.lit(60))).alias("headline"),
        F.substr("text", F.lit(61)).alias("summary"),
        F.when(k % 3 == 0, F.col("source")).otherwise("").alias("affected"),
        F.when(k % 4 == 1, F.lit("from 4/1")).alias("date_note"),
        (k % 3 + 1).cast("int").alias("importance_rank"),
        F.when(F.col("lang") != "en", F.concat(F.col("lang"), F.lit("(x)"))).alias("region"),
    )


ENTRIES = """entries AS (
    SELECT doc_id // 20 AS digest_id, doc_id AS idx, lpad(CAST(CASE WHEN doc_id % 11 = 3 THEN doc_id + 1 ELSE doc_id END AS VARCHAR), 10, '0') AS item_id,
        CASE WHEN doc_id % 7 = 2 THEN 'https://nowhere.example/x'
             ELSE 'https://site.example/' || CAST(CASE WHEN doc_id % 13 = 5 THEN doc_id - 1 ELSE doc_id END AS VARCHAR) END AS source_url,
        CASE WHEN doc_id % 17 = 4 THEN ' 　' ELSE left(text, 60) END AS headline, substr(text, 61) AS summary,
        CASE WHEN doc_id % 3 = 0 THEN source ELSE '' END AS affected, CASE WHEN doc_id % 4 = 1 THEN 'from 4/1' END AS date_note,
        CAST(doc_id % 3 + 1 AS INTEGER) AS importance_rank, CASE WHEN lang <> 'en' THEN lang || '(x)' END AS region
    FROM documents),
gate_items AS (SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0') AS id, 'https://site.example/' || CAST(CASE WHEN doc_id % 13 = 5 THEN doc_id - 1 ELSE doc_id END AS VARCHAR) AS canonical_url FROM documents)"""


def gate_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.lpad(k.cast("string"), 10, "0").alias("id"), F.concat(F.lit("https://site.example/"), F.when(k % 13 == 5, k - 1).otherwise(k).cast("string")).alias("canonical_url"))
