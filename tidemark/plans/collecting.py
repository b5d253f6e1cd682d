"""What a collection does with its listings: which pages to read, and the items that come of them.

An effect, such as reading pages, happens once: its rows are written as a stage of the run before anything reads them, and
a run that starts again under its id finds them there. All decisions before and after are plain DataFrame work on stages.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, is_blank, or_null
from ..functions.urls import canonical_url, item_id, title_from_url
from ..operators import collect as co
from ..operators.store import SnapshotStore

#: (id, canonical_url) of pages to (id, title, content_text), a row at most for each; no row or a null text: not read.
Pages = Callable[[DataFrame], DataFrame]

#: Sources named at most in a run's messages about what was put off.
NAMED = 200


class Stages:
    """Tables of one run in the store's folder, each written once and read by all later steps."""

    def __init__(self, store: SnapshotStore, run_id: str):
        self.spark, self.root = store.spark, f"{store.root}/_stages/{run_id}"
        self._path = self.spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def keep(self, name: str, rows: DataFrame) -> DataFrame:
        """rows as they were first written under this name."""
        path = f"{self.root}/{name}"
        if not self._fs.exists(self._path(f"{path}/_SUCCESS")):
            rows.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def clear(self) -> None:
        self._fs.delete(self._path(self.root), True)


def listed_of(candidates: DataFrame) -> DataFrame:
    """Candidates with canonical URL and id, the first of each source and URL in listing order; unreadable URLs dropped."""
    rows = candidates.withColumn("canonical_url", canonical_url(F.col("url"))).where("canonical_url is not null").withColumn("id", item_id(F.col("canonical_url")))
    rows = co.first_per_key(rows, ["source_id", "id"], ["ord"])
    return rows.select("id", "source_id", "ord", "canonical_url", F.trim(F.coalesce("title", F.lit(""))).alias("title"), "published_at", "content_text")


def known_of(listed: DataFrame, items: DataFrame) -> DataFrame:
    """Listed items that the store has, each once, as the source that found it first lists it, if that does; with what tells
    whether the listing has changed. Only a title or date of that source counts."""
    old = items.select("id", F.col("source_id").alias("old_source_id"), F.col("title").alias("old_title"), F.col("published_at").alias("old_published_at"), F.col("updated_at").alias("old_updated_at"))
    own = F.col("source_id") == F.col("old_source_id")
    rows = co.first_per_key(listed.join(old, "id"), ["id"], [~own, "source_id", "ord"])
    titled = (F.col("title") != "") & ~F.col("title").eqNullSafe(F.col("old_title"))
    dated = F.col("published_at").isNotNull() & ~F.col("published_at").eqNullSafe(F.col("old_published_at"))
    return rows.withColumn("listing_changed", own & (titled | dated))


def fetch_plan(listed: DataFrame, known: DataFrame | None, first_run: Column, new_limit: int, update_limit: int, recheck_limit: int) -> DataFrame:
    """Listed rows with a reason: `new`, the first of each source; `changed` by its listing, within the quota; `recheck`, of listed
    known items those updated longest ago; `new_later` and `later`, which wait for another run. Sources on their
    first run have `seen` instead of `new`, and nothing of theirs is updated. Unchanged items are not in it."""
    columns = listed.columns
    fresh = listed if known is None else co.new_candidates(listed, known)
    fresh = co.first_per_key(fresh, ["id"], ["source_id", "ord"])
    taken = co.capped_new(fresh, new_limit)
    rows = [
        taken.select(*columns, F.when(first_run, "seen").otherwise("new").alias("reason")),
        fresh.join(taken.select("id"), "id", "left_anti").select(*columns, F.lit("new_later").alias("reason")),
    ]
    if known is not None:
        own = known.where(~first_run)
        within = co.update_quota(own, F.col("listing_changed"), update_limit)
        changed = within.where("changed = 1")
        stale = co.rechecks(own.withColumn("updated_at", F.col("old_updated_at")), changed, recheck_limit)
        later = own.join(within.select("id"), "id", "left_anti").join(stale.select("id"), "id", "left_anti")
        rows += [x.select(*columns, F.lit(reason).alias("reason")) for x, reason in ((changed, "changed"), (stale, "recheck"), (later, "later"))]
    return reduce(DataFrame.unionByName, rows)


def put_off(plan: DataFrame) -> list[str]:
    """A message for each source that had more new or changed candidates than a run takes."""
    some = plan.where(F.col("reason").isin("new_later", "later")).groupBy("source_id", "reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "source_id", "reason")
    what = {"new_later": "new candidates", "later": "candidates for an update"}
    return [f"source {r.source_id}: {r.n} {what[r.reason]} left for the next run" for r in some.limit(NAMED).collect()]


def from_listing(plan: DataFrame) -> Pages:
    """Pages of a collection that brings its texts along, as a file of candidates may."""
    return lambda asked: asked.select("id").join(plan.select("id", F.lit(None).cast("string").alias("title"), F.coalesce("content_text", F.lit("")).alias("content_text")), "id")


def _title(listed: Column, page: Column, url: Column) -> Column:
    return F.coalesce(or_null(listed), or_null(page), title_from_url(url))


def _read(plan: DataFrame, pages: DataFrame) -> DataFrame:
    page = pages.select("id", F.col("title").alias("page_title"), F.col("content_text").alias("page_text"))
    return plan.drop("content_text").join(page, "id", "left")


def new_items(plan: DataFrame, pages: DataFrame, now: datetime) -> DataFrame:
    """Items of the new candidates: title by the listing, else the page, else the URL; a page that was not read has no text."""
    at = F.lit(str(now)).cast("timestamp_ntz")
    rows = _read(plan.where(F.col("reason").isin("new", "seen")), pages)
    rows = rows.withColumns({"title": _title(F.col("title"), F.col("page_title"), F.col("canonical_url")), "content_text": F.coalesce("page_text", F.lit(""))})
    return rows.select("id", "source_id", "canonical_url", "title", "published_at", at.alias("detected_at"), at.alias("updated_at"), content_hash(F.col("content_text"), F.col("title")).alias("content_hash"), "content_text", (F.col("reason") == "seen").alias("seen"))


def updated_items(plan: DataFrame, pages: DataFrame, items: DataFrame, now: datetime, labels: list[str]) -> DataFrame:
    """Items whose page was read again, with all their columns and content_changed. Text and hash are the page's; title and date
    follow the source that found the item first; labels fall only with changed content. Pages that
    could not be read leave their items as they are."""
    rows = _read(plan.where(F.col("reason").isin("changed", "recheck")), pages).where("page_text is not null")
    pairs = co.known_candidates(rows.withColumnRenamed("page_text", "content_text").drop("canonical_url"), items)
    own = F.col("source_id") == F.col("old_source_id")
    pairs = pairs.withColumn("title", F.when(own, _title(F.col("title"), F.col("page_title"), F.col("old_canonical_url"))).otherwise(F.col("old_title")))
    pairs = pairs.withColumns({"content_hash": content_hash(F.col("content_text"), F.col("title")), "region": F.col("old_region")})
    out = co.apply_updates(pairs, F.lit(str(now)).cast("timestamp_ntz"))
    # of columns that an update does not speak of, the item's stay
    rest = items.select("id", *(c for c in items.columns if c != "id" and c not in out.columns))
    out = out.join(rest, "id").select(*items.columns, "content_changed")
    return out.withColumns({c: F.when(~F.col("content_changed"), F.col(c)) for c in labels})
