"""The jobs over a snapshot store: collect, summarise, deliver, and the verification of sources.

A model and a sender are interfaces. They are called from the driver, for bounded numbers of rows, and never from
tasks, which Spark may run twice.
"""

from __future__ import annotations

import json
import time
import urllib.error
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from functools import reduce
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import redacted, truncate
from ..functions.time import business_day
from ..operators import collect as co
from ..operators import delivery, gate, health, message, runs, select
from ..operators import model as results
from ..operators.store import SnapshotStore, mark, unmark
from ..sources import listing
from ..sources.fetch import open_url, retryable
from ..sources.settings import Settings
from . import collecting
from .collecting import Pages, Stages

EXCERPT = 3000


class Model(Protocol):
    def classify(self, items: DataFrame, channels: list[str]) -> DataFrame: ...
    def digest(self, candidates: DataFrame, digest_id: str) -> DataFrame: ...


class StubModel:
    """A deterministic stand-in, in native expressions: relevance by length, importance by a hash of the id."""

    def classify(self, items: DataFrame, channels: list[str]) -> DataFrame:
        return items.select(
            "id",
            F.array(*map(F.lit, channels)).alias("channels"),
            F.least(F.lit(1.0), F.lit(0.5) + F.char_length(F.coalesce("content_text", F.lit(""))) / F.lit(4000.0)).alias("relevance"),
            (F.pmod(F.crc32(F.col("id").cast("binary")), F.lit(3)) + 1).cast("int").alias("importance_rank"),
            F.lit(False).alias("is_duplicate_of_national"),
            F.lit(None).cast("date").alias("deadline"),
        )

    def digest(self, candidates: DataFrame, digest_id: str) -> DataFrame:
        return candidates.select(
            F.lit(digest_id).alias("digest_id"), F.col("rank").alias("idx"), F.col("id").alias("item_id"), F.col("canonical_url").alias("source_url"), F.col("title").alias("headline"),
            truncate(F.when(F.coalesce(F.col("content_text"), F.lit("")) != "", F.col("content_text")).otherwise(F.col("title")), 120).alias("summary"),
            F.lit("").alias("affected"), F.lit(None).cast("string").alias("date_note"), "importance_rank",
        )


def _at(t: datetime):
    return F.lit(str(t)).cast("timestamp_ntz")


_EMPTY = {
    "region": "string", "classified_at": "timestamp_ntz", "channels": "array<string>", "relevance": "double", "importance_rank": "int",
    "is_duplicate_of_national": "boolean", "deadline": "date", "digested_in": "array<string>",
}


#: Unclassified items, at most, that a run asks the model about, and how many at a time.
CLASSIFY_LIMIT, CLASSIFY_BATCH = 200, 20
_LABELS = [c for c in _EMPTY if c not in ("region", "classified_at", "digested_in")]
#: One attempt, and the pauses in seconds before further ones.
SEND_PAUSES = (2, 4, 8)


def _state(old: DataFrame | None, fetches: DataFrame, now: datetime) -> DataFrame:
    """Source states after a run: fetches has source_id, ok, not_modified, n_candidates and, where known, etag and
    last_modified. A failure counts up and leaves empty listings as they are; an unchanged page is neither empty nor full."""
    names = [c for c in ("etag", "last_modified") if c in fetches.columns]
    got = fetches.select("source_id", "ok", "not_modified", "n_candidates", *names, *(F.lit(None).cast("string").alias(c) for c in ("etag", "last_modified") if c not in names))
    before = old if old is not None else fetches.sparkSession.createDataFrame([], STATE)
    before = before.select(F.col("id").alias("source_id"), *(F.col(c).alias(f"old_{c}") for c in before.columns if c != "id"))
    rows = got.join(before, "source_id", "left")
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    failures = F.when(F.col("ok"), 0).otherwise(count("old_consecutive_failures") + 1)
    empty = F.when(~F.col("ok") | F.col("not_modified"), count("old_consecutive_empty")).when(F.col("n_candidates") == 0, count("old_consecutive_empty") + 1).otherwise(0)
    rows = rows.withColumns({"consecutive_failures": failures, "consecutive_empty": empty})
    again = lambda n, mark, least: (F.col(n) >= least) & ((count(mark) == 0) | (F.col(n) >= 2 * count(mark)))
    alert = lambda n, mark, least: F.when(F.col(n) == 0, 0).when(again(n, mark, least), F.col(n)).otherwise(count(mark)).cast("int")
    return rows.select(
        F.col("source_id").alias("id"), _at(now).alias("last_fetched_at"), F.when(F.col("ok"), _at(now)).otherwise(F.col("old_last_success_at")).alias("last_success_at"),
        F.col("consecutive_failures").cast("int"), F.col("consecutive_empty").cast("int"), F.coalesce("etag", "old_etag").alias("etag"), F.coalesce("last_modified", "old_last_modified").alias("last_modified"),
        F.col("n_candidates").cast("int").alias("last_candidate_count"),
        alert("consecutive_failures", "old_warned_at_failure_count", health.FAILURE_THRESHOLD).alias("warned_at_failure_count"),
        alert("consecutive_empty", "old_warned_at_empty_count", health.EMPTY_THRESHOLD).alias("warned_at_empty_count"), F.lit(now.timestamp()).alias("version"),
    )


STATE = "id string, last_fetched_at timestamp_ntz, last_success_at timestamp_ntz, consecutive_failures int, consecutive_empty int, etag string, last_modified string, last_candidate_count int, warned_at_failure_count int, warned_at_empty_count int, version double"


class ModelError(Exception):
    """A call of a model that failed: the HTTP status, None where there was no answer, and what it said."""

    def __init__(self, status: int | None, detail: str):
        super().__init__(detail)
        self.status = status


def _failure(store: SnapshotStore, e: Exception) -> tuple[str, str]:
    """The kind of a model's failure, and its text without secrets. What is no answer of a model is not worth another try."""
    detail = redacted(str(e))[:200]
    if not isinstance(e, ModelError):
        return "refused", detail
    status = F.lit(e.status).cast("int")
    return store.spark.range(1).select(results.error_kind(status, F.lit(detail))).first()[0], detail


def classify(store: SnapshotStore, model: Model, channels: list[str], now: datetime, limit: int = CLASSIFY_LIMIT, days: int | None = None, period_days: int = 1, stages: Stages | None = None, pause: Callable[[float], None] = time.sleep) -> tuple[int, list[str]]:
    """Ask the model about waiting items, the oldest first, at most `limit` and CLASSIFY_BATCH at a time, none from before the
    days that a digest can still hold. Returns how many were classified, and an error for each batch that lacks results.

    A call without an answer, over a rate limit or failed by the server is repeated after each of SEND_PAUSES; a refused one
    loses its batch, which waits for the next run, and the others go on; one refused for want of credit ends the asking.
    Answers are stored before the items are changed, and a run that starts again asks only about batches without one.
    """
    if limit <= 0:
        return 0, []
    if not channels:
        return 0, ["no channel is configured, so nothing can be classified"]
    spark = store.spark
    days = spark.range(1).agg(co.lookback_days(F.lit(period_days))).first()[0] if days is None else days
    stages = stages or Stages(store, f"classify_{now:%Y%m%dT%H%M%S%f}")
    # at most `limit` rows, read from the items once
    queue = stages.keep("queue", co.unclassified_queue(store.read("items"), _at(now - timedelta(days=days)), limit, CLASSIFY_BATCH))
    sizes = {r.batch_id: r.n for r in queue.groupBy("batch_id").agg(F.count("*").alias("n")).collect()}
    parts, errors = [], []
    for k in sorted(sizes):
        batch = queue.where(F.col("batch_id") == k).coalesce(1)  # CLASSIFY_BATCH rows at most

        def ask(batch=batch, k=k) -> DataFrame:
            # the first answer for each id that was asked about; what else a model returns is not looked at
            got = model.classify(batch.drop("batch_id"), channels).select("id", *_LABELS).join(F.broadcast(batch.select("id")), "id", "left_semi").dropDuplicates(["id"])
            return stages.keep(f"answers_{k}", got.withColumn("batch_id", F.lit(k)))

        kind, detail = None, ""
        for wait in (*SEND_PAUSES, None):
            try:
                parts.append(ask())
                kind = None
                break
            except Exception as e:  # one batch must not stop the others
                kind, detail = _failure(store, e)
                if kind != "retry" or wait is None:
                    break
                pause(wait)
        if kind:
            errors.append(f"batch {k}: {kind}: {detail}")
        if kind == "billing":
            errors += [f"batch {j}: not asked" for j in sorted(sizes) if j > k]
            break
    if not parts:
        return 0, errors
    joined = results.join_results(queue.select("id", "batch_id"), reduce(DataFrame.unionByName, parts))
    failed = {e.split(":")[0] for e in errors}
    errors += [f"batch {r.batch_id}: {r.missing} of {r.asked} items without a result" for r in results.missing(joined).where("missing > 0").orderBy("batch_id").collect() if f"batch {r.batch_id}" not in failed]
    hits = joined.where("relevance is not null").drop("batch_id")
    classified = hits.count()
    if classified:
        rows = store.read("items").join(F.broadcast(hits.select("id")), "id", "left_semi")
        store.replace("items", stages.keep("classified", results.apply(rows, hits, _at(now))))
    return classified, errors


def collect(store: SnapshotStore, candidates: DataFrame, model: Model, channels: list[str], now: datetime, limit: int = co.NEW_PER_SOURCE, fetches: DataFrame | None = None, pages: Pages | None = None, first_run: list[str] = (), classify_limit: int = CLASSIFY_LIMIT, period_days: int = 1, update_limit: int = co.UPDATES_PER_SOURCE, recheck_limit: int = co.RECHECK_PER_SOURCE) -> dict[str, int]:
    """One collection, from listings to classified items. Returns the run's counters.

    New candidates are added, the first `limit` of each source. Of known ones, those whose source lists another title or date are
    read again, in listing order and up to update_limit a source, and so are the recheck_limit listed ones that were updated longest ago; all
    others stay untouched. `pages` reads pages, each once; without it texts are the candidates' own. A classification falls only
    with changed content. What goes beyond a limit waits for the next run and is told among the run's errors. Items of sources
    in `first_run` count as read, unread.
    """
    run_id = f"collect_{now:%Y%m%dT%H%M%S%f}"
    runs.begin(store, run_id, "collect", now)
    counts: dict[str, int] = dict.fromkeys(runs.COUNTERS, 0)
    errors: list[str] = []
    stages = Stages(store, run_id)
    try:
        listed = stages.keep("listed", collecting.listed_of(candidates))
        items = store.read("items")
        known = None if items is None else stages.keep("known", collecting.known_of(listed, items))
        at_first = F.col("source_id").isin(list(first_run))
        plan = stages.keep("plan", collecting.fetch_plan(listed, known, at_first, limit, update_limit, recheck_limit))
        asked = plan.where(F.col("reason").isin("new", "changed", "recheck")).select("id", "canonical_url")
        texts = stages.keep("pages", (pages or collecting.from_listing(plan))(asked).select("id", "title", "content_text"))
        fresh = stages.keep("new", collecting.new_items(plan, texts, now))
        if known is not None:
            changed = stages.keep("updated", collecting.updated_items(plan, texts, items, now, _LABELS))
            if not changed.isEmpty():
                store.replace("items", changed.drop("content_changed"))
                counts["updated_items"] = changed.where("content_changed").count()
        made = fresh.withColumns({c: F.array().cast(t) if c == "digested_in" else F.lit(None).cast(t) for c, t in _EMPTY.items()})
        made = co.bootstrap(made, F.col("seen"), _at(now)).drop("seen")
        store.append("items", made) if items is None else store.insert("items", made.select(items.columns))
        counts |= {"fetched": listed.count(), "new_items": fresh.count(), "skipped": plan.where("reason = 'new_later'").count()}
        errors = collecting.put_off(plan)
        if fetches is not None:
            store.upsert("source_states", _state(store.read("source_states"), fetches, now))
            n = fetches.agg(F.count("*").alias("total"), F.count_if("ok").alias("ok")).first()
            counts |= {"sources_total": n.total, "sources_succeeded": n.ok, "sources_failed": n.total - n.ok}
        counts["classified"], failed = classify(store, model, channels, now, classify_limit, period_days=period_days, stages=stages)
    except Exception as e:
        runs.finish(store, run_id, "failed", now, counts, [redacted(str(e))[:500]])
        raise
    status = store.spark.range(1).select(health.run_status("collect", *(F.lit(x) for x in (max(1, counts["sources_total"]), counts["sources_failed"], 0, len(failed))))).first()[0]
    runs.finish(store, run_id, status, now, counts, errors + failed)
    stages.clear()
    return counts


#: Reads pages (id, canonical_url, etag, last_modified) in the schema fetch.FETCHED.
Fetch = Callable[[DataFrame], DataFrame]


def collect_sources(store: SnapshotStore, sources: DataFrame, fetch: Fetch, model: Model, channels: list[str], now: datetime, **options) -> dict[str, int]:
    """A collection from configured sources (config.SOURCE): the enabled ones' pages are asked for with the validators of the last
    run, once; what they list goes through `collect`, whose new and changed pages are read by the same `fetch`."""
    stages = Stages(store, f"collect_{now:%Y%m%dT%H%M%S%f}")
    on = co.enabled_sources(sources)
    old = store.read("source_states")
    known = old.select("id", "etag", "last_modified") if old is not None else store.spark.createDataFrame([], "id string, etag string, last_modified string")
    asked = on.select("id", F.col("url").alias("canonical_url")).join(known, "id", "left")
    got = stages.keep("snapshots", fetch(asked)).select("id", "final_url", "status", "content_type", "body", "etag", "last_modified")
    rows = on.join(got, "id").select(
        F.col("id").alias("source_id"), F.col("type").alias("kind"), "url", "final_url", "status", "content_type", "body", "html.item_selector", "html.date_selector", "html.title_from",
        F.coalesce("include", F.array().cast("array<string>")).alias("include"), F.coalesce("exclude", F.array().cast("array<string>")).alias("exclude"), F.coalesce("law.lookback_days", F.lit(30)).alias("lookback_days"), "etag", "last_modified",
    )
    snapshots = rows.drop("etag", "last_modified")
    found = stages.keep("candidates", listing.candidates(snapshots.where(F.col("status").between(200, 299)), now).withColumn("content_text", F.lit(None).cast("string")))
    fetches = listing.fetch_status(snapshots, found).join(rows.select("source_id", "etag", "last_modified"), "source_id")
    return collect(store, found, model, channels, now, fetches=fetches, pages=lambda some: listing.page_texts(fetch(some)), **options)


def coverage_of(store: SnapshotStore, day: date) -> tuple[int, int, str | None]:
    """(sources, those that could be read, the last collection's time) of a business day: by its collections, or by the sources'
    own states where there was none. What is not known counts as not read."""
    states, log = store.read("source_states"), store.read("runs")
    silent = 0 if states is None else health.silent(states).count()
    if log is not None:
        runs_ = log.where("job = 'collect' and status <> 'running'").select("id", "started_at", business_day(F.col("started_at")).alias("day"), F.col("sources_total").alias("total"), F.col("sources_succeeded").alias("succeeded"))
        found = health.coverage(runs_.where((F.col("day") == F.lit(day)) & (F.col("total") > 0)), F.lit(silent)).first()
        if found is not None:
            return found.total, found.succeeded, str(found.last_run_at)
    if states is None:
        return 0, 0, None
    read = F.coalesce(business_day(F.col("last_success_at")) == F.lit(day), F.lit(False))
    n = states.agg(F.count("*").alias("total"), F.count_if(read).alias("succeeded"), F.max(F.when(read, F.col("last_success_at"))).alias("at")).first()
    return n.total, max(0, n.succeeded - silent), None if n.at is None else str(n.at)


def summarise(store: SnapshotStore, channel: select.Channel, day: date, model: Model, now: datetime, reach: Callable[[DataFrame], DataFrame] | None = None, force: bool = False) -> str:
    """Build a channel's digest of a day, and return its status. Items that the message holds are marked before the digest is
    stored, so a crash between the two can't send them twice. What gate, limits and length leave out is counted in the
    message and stays for later days. force: a digest that is not delivered yet is built again, as if it had never
    been, and items that it no longer holds lose its mark."""
    digest_id = f"{channel.id}_{day}"
    digests = store.read("digests")
    old = digests.where(F.col("id") == digest_id).first() if digests is not None else None
    exists = old is not None and (not force or old.status == "delivered")
    if exists:
        return "kept"
    stored = store.read("items")
    items = stored.withColumn("digested_in", unmark(F.col("digested_in"), F.lit(digest_id))) if force else stored
    mode = select.mode_of(channel, day)
    if mode == "urgent":
        top = select.urgent(items, channel, day)
        unclassified, n_found = 0, top.count()
    else:
        pool = select.pool(items, channel.id, day, 7 if mode == "weekly" else 1)
        found = select.candidates(pool, channel, digest_id)
        top = select.ranked(found)
        unclassified, n_found = pool.where("classified_at is null").count(), found.count()
    n = top.count()
    kept, text, omitted, passed = [], "", 0, 0
    if n:
        entries = model.digest(top, digest_id)
        checked = gate.static_check(items.select("id", "canonical_url"), entries)
        if reach is not None:
            asked = reach(checked.where("failed is null").select("source_url").distinct())
            checked = gate.reachability_check(checked, asked.select("source_url", "ok", "robots_disallowed"))
        regions = items.select(F.col("canonical_url").alias("source_url"), "region", F.lit(0).alias("ord"))
        through = gate.passed(checked, regions)
        good = select.item_cap(through, channel.max_items, ["digest_id"])
        header = F.lit(f"{message.Template().header}{day} {channel.name or channel.id}")
        by_gate, passed = checked.where("failed is not null").count(), through.count()
        left = n - checked.select("item_id").distinct().count(), by_gate, n_found - n, max(0, passed - channel.max_items), 0
        omitted = store.spark.range(1).select(results.omitted(*map(F.lit, left))).first()[0]
        made = message.fit(good, message.Template(), header, F.lit(omitted), channel.max_chars).collect()
        if made:  # a row for the one digest, with at most max_items ids
            text, kept, omitted = made[0].message, list(made[0].kept), omitted + made[0].dropped
    status = store.spark.range(1).select(delivery.digest_outcome(F.lit(exists), F.lit(mode), F.lit(n), F.lit(unclassified), F.lit(passed), F.lit(channel.send_when_empty))).first()[0]
    if status == "generated" and not n:
        text = message.Template().empty
    mine = F.array_contains("digested_in", digest_id)
    used = F.col("id").isin(kept)
    touched = stored.where(used | mine if force else used)
    touched = touched.withColumn("digested_in", F.when(used, mark(F.col("digested_in"), F.lit(digest_id))).otherwise(unmark(F.col("digested_in"), F.lit(digest_id))))
    if kept or force:
        store.replace("items", touched)
    total, succeeded, collected = coverage_of(store, day)
    row = store.spark.createDataFrame(
        [(digest_id, channel.id, status, text, len(kept), int(omitted), total, succeeded, collected, now.timestamp())],
        "id string, channel_id string, status string, message string, n_entries int, omitted int, sources_total int, sources_read int, last_collected_at string, version double",
    )
    store.upsert("digests", row)
    return status


@dataclass
class DryRunSender:
    """Keeps what would have been sent."""

    sent: list

    def send(self, rows: Iterable) -> list[tuple[str, bool, str | None]]:
        rows = list(rows)
        self.sent += [(r.id, r.message, r.retry_key) for r in rows]
        return [(r.id, True, None) for r in rows]


@dataclass
class RetryingSender:
    """Sends by `call(id, message, retry_key) -> HTTP status or None`, once more after each of SEND_PAUSES where it is worth
    it; the receiver tells repeats by the retry key, and one that it already has (409) counts as sent."""

    call: Callable[[str, str, str], int | None]
    pause: Callable[[float], None] = time.sleep

    def send(self, rows: Iterable) -> list[tuple[str, bool, str | None]]:
        return [(r.id, *self._one(r)) for r in rows]

    def _one(self, r) -> tuple[bool, str | None]:
        for wait in (*SEND_PAUSES, None):
            status = self.call(r.id, r.message, r.retry_key)
            if status is not None and (200 <= status < 300 or status == 409):
                return True, None
            if wait is None or not retryable(status):
                return False, "no answer" if status is None else f"HTTP {status}"
            self.pause(wait)
        return False, None


def broadcaster(url: str, token: str, opener=open_url) -> Callable[[str, str, str], int | None]:
    """A call for RetryingSender that posts a message to a broadcast endpoint; the retry key goes along as a header."""

    def call(_: str, text: str, retry_key: str) -> int | None:
        headers = {"Authorization": f"Bearer {token}", "Content-Type": "application/json", "X-Retry-Key": retry_key}
        try:
            with opener(url, headers, "POST", data=json.dumps({"messages": [{"type": "text", "text": text}]}).encode()) as r:
                return r.status
        except urllib.error.HTTPError as e:
            return e.code
        except OSError:
            return None

    return call


def sender_of(settings: Settings, opener=open_url):
    """What a deployment sends with: nothing really, unless DRY_RUN is off and an endpoint with its token is set."""
    if settings.dry_run or not settings.broadcast_url or not settings.broadcast_token:
        return DryRunSender([])
    return RetryingSender(broadcaster(settings.broadcast_url, settings.broadcast_token, opener))


def notifications(lines: DataFrame, post: Callable[[str], None], checkpoint: str) -> StreamingQuery:
    """Post a stream of (line) to an operators' channel: a body for each micro-batch, of a bounded number of lines."""

    def batch(rows: DataFrame, _: int) -> None:
        n = rows.count()
        shown = [redacted(r.line) for r in rows.limit(message.OPS_LINES).collect()]
        if n:
            post("\n".join(shown + [f"... {n - len(shown)} more"] * (n > len(shown)))[: message.OPS_CHARS])

    return lines.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def verify(snapshots: DataFrame, found: DataFrame) -> DataFrame:
    """(id, type, verdict) of configured sources, of their fetched pages and what was read of them."""
    n = found.groupBy("source_id").agg(F.count("*").alias("n"))
    rows = snapshots.join(n, "source_id", "left")
    ok = F.col("status").between(200, 299) | (F.col("status") == 304)
    verdict = delivery.verification(F.col("url"), ok, F.col("status"), F.coalesce("n", F.lit(0)), F.col("kind"), F.col("body").isNotNull() & (F.length("body") > 0))
    return rows.select(F.col("source_id").alias("id"), F.col("kind").alias("type"), verdict.alias("verdict"))


def verify_with_retry(snapshots: DataFrame, read: Callable[[DataFrame], DataFrame], refetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """`verify`, after one more fetch of the sources whose failure may be a passing one."""
    again = snapshots.where(~F.coalesce(F.col("status").between(200, 299) | (F.col("status") == 304), F.lit(False)) & gate.transient(F.col("status")))
    fresh = snapshots.join(again.select("source_id"), "source_id", "left_anti").select(snapshots.columns).unionByName(refetch(again).select(snapshots.columns))
    return verify(fresh, read(fresh))


def deliver(store: SnapshotStore, channels: list[select.Channel], day: date, sender, now: datetime) -> dict[str, str]:
    """Send each channel's digest of a day once. The delivery record with its retry key is stored before the call, so
    that a repeated run sends with the same key. Returns the decision for each digest."""
    spark = store.spark
    wanted = spark.createDataFrame([(f"{c.id}_{day}", c.require_approval) for c in channels], "id string, require_approval boolean")
    digests = store.read("digests")
    known = wanted.join(digests.select("id", "status", "message"), "id", "left") if digests is not None else wanted.withColumns({"status": F.lit(None).cast("string"), "message": F.lit(None).cast("string")})
    old = store.read("deliveries")
    records = old.select("id", "delivery_status", "attempts", "retry_key") if old is not None else spark.createDataFrame([], "id string, delivery_status string, attempts int, retry_key string")
    decided = delivery.decision(known, records, F.col("require_approval"))
    out = {r.id: r.decision for r in decided.select("id", "decision").collect()}  # a row for each channel
    pending = delivery.pending(decided, _at(now)).withColumn("version", F.lit(now.timestamp()))
    store.upsert("deliveries", pending)
    ahead = store.read("deliveries").where(F.col("id").isin([k for k, d in out.items() if d == "send"]))
    results = sender.send(ahead.join(known.select("id", "message"), "id").collect())
    if results:
        back = spark.createDataFrame(results, "id string, ok boolean, error string")
        done = delivery.settled(ahead, back, _at(now)).select("id", "retry_key", "delivery_status", "attempts", _at(now).alias("updated_at"), F.lit(now.timestamp() + 0.001).alias("version"))
        store.upsert("deliveries", done)
        sent = [i for i, ok, _ in results if ok]
        store.upsert("digests", digests.where(F.col("id").isin(sent)).withColumns({"status": F.lit("delivered"), "version": F.lit(now.timestamp() + 0.001)}))
    return out
