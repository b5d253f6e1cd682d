"""Command line: python -m tidemark.cli COMMAND --store DIR --config DIR ...

collect, summarise, deliver, approve, preview, validate-config, health, verify, diagnose, test-broadcast. The configuration is a folder of JSON files with
records of kind "channel" or "source". The exit code is 1 where a job failed, 2 where the configuration is wrong.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import uuid
from dataclasses import fields
from datetime import UTC, date, datetime

from pyspark.sql import Row, SparkSession
from pyspark.sql import functions as F

from .operators import config as rules
from .operators import delivery, health, message
from .operators.select import Channel
from .operators.store import SnapshotStore
from .plans import jobs, outbox
from .sources import fetch, listing
from .sources.settings import ConfigError, Settings, config_rows, load_folder
from .streaming.collect import CANDIDATE


def channels_of(records: list[dict]) -> list[Channel]:
    known = {f.name for f in fields(Channel)}
    return [Channel(**{k: v for k, v in r.items() if k in known}) for r in records if r.get("kind") == "channel"]


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out=print) -> int:
    p = argparse.ArgumentParser(prog="tidemark", description=__doc__)
    p.add_argument("command", choices=("collect", "summarise", "deliver", "approve", "preview", "validate-config", "health", "verify", "diagnose", "test-broadcast"))
    p.add_argument("--store")
    p.add_argument("--config")
    p.add_argument("--candidates", help="JSON lines of candidates, for collect")
    p.add_argument("--allow-network", action="store_true", help="collect: ask the configured sources")
    p.add_argument("--fetches", help="Parquet of a fetch log, for health")
    p.add_argument("--snapshots", help="Parquet of fetched pages, for verify")
    p.add_argument("--pages", help="Parquet of (page_id, url, html), for diagnose")
    p.add_argument("--outbox", help="deliver, test-broadcast: a folder that keeps what was sent, so that nothing is sent twice")
    p.add_argument("--force", action="store_true", help="summarise: build digests again that are not delivered")
    p.add_argument("--date", type=date.fromisoformat)
    p.add_argument("--channel", action="append")
    p.add_argument("--now", type=datetime.fromisoformat, default=None)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    now = a.now or datetime.now(UTC).replace(tzinfo=None)
    if a.command == "validate-config":
        rows = config_rows(spark, a.config).cache()  # a deployment's own files
        found = [(r.file, r.error) for r in rows.where("error is not null").orderBy("file", "ord").collect()]
        sources, known = rules.records(rows, "source", rules.SOURCE), rules.records(rows, "channel", rules.CHANNEL)
        found += [(f"{r.kind} {r.id}" if r.id else r.kind, r.violation) for r in rules.all_violations(sources, known).orderBy("kind", "id", "violation").collect()]
        rows.unpersist()
        for i, what in found:
            out(f"{i}: {what}")
        return 2 if found else 0
    try:
        records = load_folder(a.config) if a.config else []
        settings = Settings.from_env(os.environ)
    except ConfigError as e:
        out(str(e))
        return 2
    channels = [c for c in channels_of(records) if not a.channel or c.id in a.channel]
    if missing := set(a.channel or []) - {c.id for c in channels}:
        out(f"not configured: {', '.join(sorted(missing))}")
        return 2
    if a.command == "health":
        states = health.latest_state(health.streaks(spark.read.parquet(a.fetches)))
        for r in states.where("consecutive_failures > 0").orderBy(F.desc("consecutive_failures"), "source_id").collect():  # failing sources only
            out(json.dumps({"source": r.source_id, "failures": r.consecutive_failures}))
        return 0
    if a.command == "verify":
        snaps = spark.read.parquet(a.snapshots)
        verdicts = jobs.verify(snaps, listing.candidates(snaps, now))
        bad = verdicts.where("verdict <> 'ok'").orderBy("id").collect()  # of configured sources
        for r in bad:
            out(json.dumps({"source": r.id, "verdict": r.verdict}))
        return int(bool(bad))
    if a.command == "diagnose":
        for r in listing.selectors(spark.read.parquet(a.pages)).orderBy("page_id", "position").toLocalIterator():
            out(json.dumps({"page": r.page_id, "selector": r.selector, "links": r.links}))
        return 0
    sender = outbox.sender_of(spark, a.outbox, settings) if a.outbox else jobs.sender_of(settings)
    if a.command == "test-broadcast":
        rows = [Row(id=f"test_{c.id}", message=message.Template().empty, retry_key=str(uuid.uuid4())) for c in channels]
        out(json.dumps({i: ok for i, ok, _ in sender.send(rows)}))
        return 0
    store = SnapshotStore(spark, a.store)
    if a.command == "collect":
        ids, limits = [c.id for c in channels], {"limit": settings.max_new_items_per_source, "update_limit": settings.max_new_items_per_source, "recheck_limit": settings.recheck_per_source, "classify_limit": settings.classify_limit}
        if a.candidates:
            counts = jobs.collect(store, spark.read.schema(CANDIDATE).json(a.candidates), jobs.StubModel(), ids, now, **limits)
        elif not a.allow_network:
            out("collect asks the configured sources only with --allow-network; --candidates takes a file instead")
            return 2
        else:
            read = lambda asked: fetch.read_pages(asked, budget_s=settings.collect_budget_s, hosts_at_once=settings.host_concurrency, pause_s=settings.host_delay_ms / 1000)
            counts = jobs.collect_sources(store, rules.records(config_rows(spark, a.config), "source", rules.SOURCE), read, jobs.StubModel(), ids, now, **limits)
        out(json.dumps({k: v for k, v in counts.items() if v}))
        return 0
    if a.command == "summarise":
        ends = {c.id: jobs.summarise(store, c, a.date, jobs.StubModel(), now, force=a.force) for c in channels}
        out(json.dumps(ends))
        return int("failed" in ends.values())
    if a.command == "deliver":
        out(json.dumps(jobs.deliver(store, channels, a.date, sender, now)))
        return 0
    digests = store.read("digests")
    for c in channels:
        key = f"{c.id}_{a.date}"
        if a.command == "approve":
            store.commit("digests", delivery.approve(digests, key))
            digests = store.read("digests")
        row = digests.where(F.col("id") == key).first()
        out(f"{key}: {row.status if row else 'missing'}" + (f"\n{row.message}" if row and a.command == "preview" else ""))
    return 0


if __name__ == "__main__":
    sys.exit(main())
