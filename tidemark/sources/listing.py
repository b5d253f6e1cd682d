"""Candidates from fetched snapshots of listings, feeds and law APIs, as one DataFrame."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import one_line
from ..functions.time import page_date, to_utc
from ..functions.urls import title_from_url
from . import feed, fetch, html, law, nodes

#: A batch of texts ends with the one that fills it to so many characters.
BATCH_CHARS = 1 << 20

SNAPSHOT = T.StructType([
    T.StructField("source_id", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("final_url", T.StringType()), T.StructField("status", T.IntegerType()), T.StructField("content_type", T.StringType()),
    T.StructField("body", T.BinaryType()), T.StructField("item_selector", T.StringType()), T.StructField("date_selector", T.StringType()),
    T.StructField("title_from", T.StringType()), T.StructField("include", T.ArrayType(T.StringType())), T.StructField("exclude", T.ArrayType(T.StringType())),
    T.StructField("lookback_days", T.IntegerType()),
])


def candidates(snapshots: DataFrame, now: datetime) -> DataFrame:
    """(source_id, ord, url, title, published_at) of snapshots in the schema SNAPSHOT.

    A 304 or an unreadable body gives no rows. Markup is read per page, in Arrow batches, where the pages are; a snapshot that comes twice counts once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            rows = []
            for p in pages.itertuples(index=False):
                for r in feed.read(fetch.decode(bytes(p.body), p.content_type or ""), p.final_url or p.url):
                    at = r.get("published_at")
                    rows.append((p.source_id, r["ord"], r["url"], r["title"], at.replace(tzinfo=None) if at else None))
            yield pd.DataFrame(rows, columns=["source_id", "ord", "url", "title", "published_at"]).astype({"published_at": "datetime64[ns]"})

    there = snapshots.where("coalesce(status, 200) <> 304")
    laws = law.records(there.where("kind = 'law'"), now)
    some = there.where("body is not null and length(body) > 0")
    feeds = some.where("kind = 'feed'").mapInPandas(run, "source_id string, ord int, url string, title string, published_at timestamp_ntz")
    none = F.array().cast("array<string>")
    shown = some.where("kind not in ('feed', 'law')")
    pages = nodes.dealt(shown.select(
        F.to_json(F.struct("source_id", "url", "final_url", "item_selector", "date_selector")).alias("key"), "source_id", F.coalesce("final_url", "url").alias("url"), "content_type", "body",
        "item_selector", "date_selector", F.coalesce("title_from", F.lit("text")).alias("title_from"), F.coalesce("include", none).alias("include"), F.coalesce("exclude", none).alias("exclude"),
    )).dropDuplicates(["key"])
    on_page = to_utc(page_date(F.col("date_text")).cast("timestamp_ntz"))
    found = nodes.listed(pages, nodes.steps_of(shown)).select(F.get_json_object("key", "$.source_id").alias("source_id"), "ord", "url", "title", on_page.alias("published_at"))
    entries = feeds.unionByName(found)
    return entries.withColumn("title", F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(title_from_url(F.col("url")))).unionByName(laws)


def fetch_status(snapshots: DataFrame, found: DataFrame) -> DataFrame:
    """A row for each snapshot: source_id, ok, not_modified, n_candidates."""
    n = found.groupBy("source_id").agg(F.count("*").cast("int").alias("n_candidates"))
    ok = F.col("status").between(200, 299) | (F.col("status") == 304)
    return snapshots.select("source_id", F.coalesce(ok, F.lit(False)).alias("ok"), F.coalesce(F.col("status") == 304, F.lit(False)).alias("not_modified")).join(n, "source_id", "left").fillna({"n_candidates": 0})


def extracted(pages: DataFrame, limit: int | None = None, key: str = "url") -> DataFrame:
    """pages (url, content_type, body) with text, kind (html, text, pdf) and title, a row for each URL. Texts are whole, or of at most `limit`
    characters. PDF gives an empty text: there is no reader for it here; so does what can't be read, and never an error. A URL that comes
    twice counts once; where URLs don't tell pages apart, `key` names the column of text that does, and stands in the URL's place."""
    rows = pages.select(F.col(key).alias("url"), "content_type", "body").dropDuplicates(["url"])
    mime = F.lower(F.coalesce("content_type", F.lit("")))
    pdf = F.contains(mime, F.lit("pdf")) | F.coalesce(F.substring("body", 1, 5) == F.lit(b"%PDF-"), F.lit(False))
    rows = rows.withColumn("kind", F.when(pdf, "pdf").when(F.startswith(mime, F.lit("text/plain")), "text").otherwise("html"))
    empty = F.lit("")
    articles = nodes.articles(rows.where("kind = 'html'").withColumnRenamed("url", "key"), limit).select(F.col("key").alias("url"), "text", F.lit("html").alias("kind"), "title")
    line = one_line(F.col("text"))
    texts = decoded(rows.where("kind = 'text'")).select("url", (line if limit is None else F.left(line, F.lit(limit))).alias("text"), F.lit("text").alias("kind"), empty.alias("title"))
    return articles.unionByName(texts).unionByName(rows.where("kind = 'pdf'").select("url", empty.alias("text"), "kind", empty.alias("title"))).withColumnRenamed("url", key)


def page_texts(fetched: DataFrame, limit: int = 6000) -> DataFrame:
    """(id, title, content_text) of pages as `fetch.read_pages` gives them: what a collection stores of a page, `limit` characters at most. A page that no
    time was left for has no row; one that could not be read has an empty text, as a page without any."""
    rows = fetched.where(~F.col("error").eqNullSafe(fetch.LATE))
    got = extracted(rows.select(F.col("id").alias("url"), "content_type", F.when(F.col("status") == 200, F.col("body")).alias("body")), limit)
    return got.select(F.col("url").alias("id"), "title", F.col("text").alias("content_text"))


def decoded_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Batches (url, text) of batches (url, content_type, body): one body at a time, and a batch ends with the text that fills it."""
    kinds = pa.schema([("url", pa.string()), ("text", pa.string())])
    for part in batches:
        held, size = [], 0
        for url, kind, body in zip(*part.columns, strict=True):
            text = fetch.decode(body.as_py(), kind.as_py() or "") if body.is_valid else ""
            held.append({"url": url.as_py(), "text": text})
            size += len(text)
            if size >= limit:
                yield pa.RecordBatch.from_pylist(held, kinds)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, kinds)


def decoded(pages: DataFrame) -> DataFrame:
    """pages (url, content_type, body) with their text as `fetch.decode` reads it."""
    fetch.short_batches(pages.sparkSession)
    return pages.select("url", "content_type", "body").mapInArrow(decoded_batches, "url string, text string")


def feeds_of(pages: DataFrame) -> DataFrame:
    """(page_id, ord, url) of the feeds that pages (page_id, url, html) name in their heads."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            rows = [(p.page_id, k, x) for p in part.itertuples(index=False) for k, x in enumerate(html.advertised_feeds(p.html or "", p.url or ""))]
            yield pd.DataFrame(rows, columns=["page_id", "ord", "url"])

    return pages.select("page_id", "url", "html").mapInPandas(run, "page_id long, ord int, url string")


def selectors(pages: DataFrame, limit: int = 6, least: int = 3) -> DataFrame:
    """pages (page_id, url, html): the containers of each that could be listings, with the number of their distinct links: of
    those that one selector names the fullest, of equally full ones the deepest, most links first, at most `limit`."""

    kinds = pa.schema([("page_id", pa.int64()), ("node", pa.int32()), ("path", pa.string()), ("depth", pa.int32()), ("href", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
        rows: list[tuple] = []
        for part in batches:
            for page, url, text in zip(*part.columns, strict=True):
                number = page.as_py()
                rows += [(number, *r) for r in html.container_links(text.as_py() or "", url.as_py() or "")]
                if len(rows) >= nodes.BATCH_ROWS:
                    yield batch(rows)
                    rows = []
        if rows:
            yield batch(rows)

    fetch.short_batches(pages.sparkSession)
    # all that follows is within pages, so links are dealt by page once
    rows = pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, node int, path string, depth int, href string").repartition("page_id")
    full = rows.groupBy("page_id", "node", "path", "depth").agg(F.count_distinct("href").cast("int").alias("links")).where(F.col("links") >= least)
    best = full.groupBy("page_id", "path").agg(F.max(F.struct("links", "depth")).alias("top"), F.min("node").alias("node")).select("page_id", "path", "top.*", "node")
    deep = best.groupBy("page_id", "links").agg(F.min_by(F.struct("path", "depth"), F.struct((-F.col("depth")).alias("d"), "node")).alias("one"))
    place = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("links"))) - 1
    return deep.select("page_id", place.cast("int").alias("position"), F.concat("one.path", F.lit(" a")).alias("selector"), "links", "one.depth").where(F.col("position") < limit)
