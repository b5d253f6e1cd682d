import json
from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.operators.select import Channel
from tidemark.operators.store import SnapshotStore
from tidemark.plans import jobs
from tidemark.streaming import collect as stream
from tidemark.streaming import health as sh


def _candidates(spark, n, first=0):
    rows = [("s", k, f"http://e.com/{k}/?utm_source=x", f"Title {k}", None, "text " * 20) for k in range(first, n)]
    return spark.createDataFrame(rows, stream.CANDIDATE)


def test_two_rounds_deliver_once(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    channel, model, sender = Channel("m", max_items=3), jobs.StubModel(), jobs.DryRunSender([])
    assert jobs.collect(store, _candidates(spark, 5), model, ["m"], datetime(2026, 9, 12, 21))["new_items"] == 5
    assert jobs.collect(store, _candidates(spark, 5), model, ["m"], datetime(2026, 9, 12, 21, 30))["new_items"] == 0
    assert jobs.summarise(store, channel, date(2026, 9, 13), model, datetime(2026, 9, 12, 22)) == "generated"
    assert jobs.summarise(store, channel, date(2026, 9, 13), model, datetime(2026, 9, 12, 22, 1)) == "kept"
    assert store.read("items").where("size(digested_in) > 0").count() == 3
    assert jobs.deliver(store, [channel], date(2026, 9, 13), sender, datetime(2026, 9, 12, 22, 30)) == {"m_2026-09-13": "send"}
    assert jobs.deliver(store, [channel], date(2026, 9, 13), sender, datetime(2026, 9, 12, 22, 40)) == {"m_2026-09-13": "delivered"}
    assert len(sender.sent) == 1 and "Title" in sender.sent[0][1]
    # the next day sends what was left over
    assert jobs.summarise(store, channel, date(2026, 9, 14), model, datetime(2026, 9, 13, 22)) == "generated"
    assert store.read("items").where("size(digested_in) > 0").count() == 5


def test_only_entries_of_the_message_are_marked(spark, tmp_path):
    store, model = SnapshotStore(spark, str(tmp_path / "store"), 4), jobs.StubModel()
    jobs.collect(store, _candidates(spark, 8), model, ["m"], datetime(2026, 9, 12, 21))
    short = Channel("m", max_items=6, max_chars=420)
    assert jobs.summarise(store, short, date(2026, 9, 13), model, datetime(2026, 9, 12, 22)) == "generated"
    row = store.read("digests").first()
    marked = [r.canonical_url for r in store.read("items").where("size(digested_in) > 0").collect()]
    assert 0 < len(marked) == row.n_entries < 6 and all(u in row.message for u in marked) and row.message.count("Source: ") == len(marked)
    assert row.omitted == 8 - len(marked) and f"And {row.omitted} more" in row.message
    # built again with room for more, and then for less: the marks follow the message
    assert jobs.summarise(store, short, date(2026, 9, 13), model, datetime(2026, 9, 12, 23)) == "kept"
    assert jobs.summarise(store, Channel("m", max_items=5), date(2026, 9, 13), model, datetime(2026, 9, 12, 23), force=True) == "generated"
    assert store.read("items").where("size(digested_in) > 0").count() == 5
    assert jobs.summarise(store, Channel("m", max_items=2), date(2026, 9, 13), model, datetime(2026, 9, 12, 23, 1), force=True) == "generated"
    assert store.read("items").where("size(digested_in) > 0").count() == 2


class Picky(jobs.StubModel):
    """Fails on one batch, and leaves an item out of another."""

    def __init__(self):
        self.sizes = []

    def classify(self, items, channels):
        self.sizes.append(items.count())
        if len(self.sizes) == 2:
            raise RuntimeError("over capacity, Bearer abc123")
        out = super().classify(items, channels)
        return out.where(F.col("id") != items.agg(F.min("id")).first()[0]) if len(self.sizes) == 1 else out


def test_classification_is_limited_and_batched(spark, tmp_path):
    store, model = SnapshotStore(spark, str(tmp_path / "store"), 2), Picky()
    got = jobs.collect(store, _candidates(spark, 49), model, ["m"], datetime(2026, 9, 12, 21), classify_limit=45)
    assert model.sizes == [20, 20, 5] and got["classified"] == 19 + 5
    run = store.read("runs").first()
    assert run.status == "partial" and run.classified == 24 and run.finished_at is not None
    assert sorted(e.split(":")[0] for e in run.errors) == ["batch 0", "batch 1"] and not any("abc123" in e for e in run.errors)
    # what is older than a digest can hold is not asked about again
    late = jobs.collect(store, _candidates(spark, 0), jobs.StubModel(), ["m"], datetime(2026, 9, 30))
    assert late["classified"] == 0


class Site:
    """Pages by URL, which count how often they are read."""

    def __init__(self, spark, folder):
        self.spark, self.folder, self.texts, self.asks = spark, folder, {}, 0

    def __call__(self, asked):
        self.asks += 1
        texts, folder = dict(self.texts), self.folder / str(self.asks)
        folder.mkdir(parents=True)

        def run(batches):
            for part in batches:
                for r in part.itertuples(index=False):
                    with open(folder / r.id, "a") as f:
                        f.write("x")
                yield part.assign(title="", content_text=[texts.get(u) for u in part.canonical_url])[["id", "title", "content_text"]]

        return asked.mapInPandas(run, "id string, title string, content_text string")

    def reads(self):
        """How many pages were read, and how often at most one was in a run."""
        size = [f.stat().st_size for f in self.folder.rglob("*") if f.is_file()]
        return len(size), max(size, default=0)


def _listed(spark, titles, source="s", start=0):
    return spark.createDataFrame([(source, k, f"http://e.com/{k}", t, None, None) for k, t in enumerate(titles, start)], stream.CANDIDATE)


def test_unchanged_items_stay_and_listed_ones_are_rechecked(spark, tmp_path):
    store, model, site = SnapshotStore(spark, str(tmp_path / "store"), 4), jobs.StubModel(), Site(spark, tmp_path / "reads")
    site.texts = {f"https://e.com/{k}": f"text {k}" for k in range(9)}
    rows = lambda: {int(r.canonical_url.rsplit("/", 1)[1]): r for r in store.read("items").collect()}
    assert jobs.collect(store, _listed(spark, "ABCD"), model, ["m"], datetime(2026, 9, 12, 21), pages=site)["new_items"] == 4
    before = rows()
    assert site.reads() == (4, 1) and [before[k].content_text for k in range(4)] == [f"text {k}" for k in range(4)]
    # 0 and 1 are listed again, unchanged, and none is due: nothing is read or touched
    run = lambda listing, hour, **o: jobs.collect(store, listing, model, ["m"], datetime(2026, 9, 13, hour), pages=site, **o)
    got = run(_listed(spark, "AB"), 3, recheck_limit=0)
    assert rows() == before and site.reads() == (4, 1) and (got["new_items"], got["updated_items"]) == (0, 0)
    # a new title with the same text: title and time move, the classification stays; a changed text falls with its own
    site.texts["https://e.com/1"] = "other"
    got = run(_listed(spark, ["A2", "B"]), 4, recheck_limit=1)
    after = rows()
    assert got["updated_items"] == 0 and after[0].title == "A2" and after[0].content_hash == before[0].content_hash and after[0].classified_at == before[0].classified_at
    assert after[1] == before[1]  # 0 took the one place of the recheck
    got = run(_listed(spark, ["A2", "B"]), 5, recheck_limit=1, classify_limit=0)
    after = rows()
    assert got["updated_items"] == 1 and after[1].content_text == "other" and after[1].classified_at is None and after[1].relevance is None
    assert after[2] == before[2] and after[3] == before[3] and after[1].detected_at == before[1].detected_at
    assert site.reads() == (4 + 1 + 1, 1)


def test_updates_keep_to_quota_source_and_readable_pages(spark, tmp_path):
    store, model, site = SnapshotStore(spark, str(tmp_path / "store"), 4), jobs.StubModel(), Site(spark, tmp_path / "reads")
    site.texts = {f"https://e.com/{k}": f"text {k}" for k in range(9)}
    jobs.collect(store, _listed(spark, "ABCDE"), model, ["m"], datetime(2026, 9, 12, 21), pages=site)
    before = {r.title[0]: r for r in store.read("items").collect()}
    del site.texts["https://e.com/1"]
    # another source lists the same pages under other titles, and one that can't be read now
    both = _listed(spark, ["A2", "B2", "C2", "D2", "E"]).unionByName(_listed(spark, ["elsewhere"] * 5, source="a"))
    got = jobs.collect(store, both, model, ["m"], datetime(2026, 9, 13, 3), pages=site, update_limit=3, recheck_limit=0, classify_limit=0)
    after = {r.canonical_url[-1]: r for r in store.read("items").collect()}
    assert [after[str(k)].title for k in range(5)] == ["A2", "B", "C2", "D", "E"] and {r.source_id for r in after.values()} == {"s"}
    assert after["1"] == before["B"] and got["updated_items"] == 0
    assert store.read("runs").where("started_at > '2026-09-13'").first().errors == ["source s: 2 candidates for an update left for the next run"]
    # new ones beyond the limit are counted and named, and come next time
    more = _listed(spark, "FGHI", start=5)
    got = jobs.collect(store, more, model, ["m"], datetime(2026, 9, 13, 4), limit=3, pages=site)
    assert (got["new_items"], got["skipped"]) == (3, 1) and any("1 new candidates" in e for e in store.read("runs").orderBy("started_at").collect()[-1].errors)
    assert jobs.collect(store, more, model, ["m"], datetime(2026, 9, 13, 5), limit=3, pages=site)["new_items"] == 1


def test_a_run_that_starts_again_reads_no_page_twice(spark, tmp_path):
    store, site = SnapshotStore(spark, str(tmp_path / "store"), 4), Site(spark, tmp_path / "reads")
    site.texts = {f"https://e.com/{k}": f"text {k}" for k in range(3)}
    now = datetime(2026, 9, 12, 21)
    finish, jobs.runs.finish = jobs.runs.finish, None
    try:
        jobs.collect(store, _listed(spark, "ABC"), jobs.StubModel(), ["m"], now, pages=site)
    except TypeError:  # it died before its end
        pass
    finally:
        jobs.runs.finish = finish
    again = jobs.collect(store, _listed(spark, "ABC"), jobs.StubModel(), ["m"], now, pages=site)
    assert again["new_items"] == 3 and store.read("items").count() == 3 and site.reads() == (3, 1)
    assert not list((tmp_path / "store" / "_stages").iterdir())


def test_first_runs_and_source_states(spark, tmp_path):
    store, model, site = SnapshotStore(spark, str(tmp_path / "store"), 4), jobs.StubModel(), Site(spark, tmp_path / "reads")
    fetches = spark.createDataFrame([("s", True, False, 4), ("t", False, False, 0)], "source_id string, ok boolean, not_modified boolean, n_candidates int")
    got = jobs.collect(store, _listed(spark, ["A", ""]), model, ["m"], datetime(2026, 9, 13, 3), fetches=fetches, pages=site, first_run=["s"])
    assert (got["new_items"], got["sources_failed"], got["classified"]) == (2, 1, 0) and site.reads() == (0, 0)
    rows = sorted(store.read("items").collect(), key=lambda r: r.canonical_url)
    assert [r.title for r in rows] == ["A", "1"] and all(r.classified_at is not None and r.relevance == 0.0 for r in rows)
    for at in (9, 15, 21):
        jobs.collect(store, _listed(spark, ["A2"]), model, ["m"], datetime(2026, 9, 13, at), fetches=fetches, pages=site, first_run=["s"])
    assert site.reads() == (0, 0) and sorted(store.read("items").collect(), key=lambda r: r.canonical_url) == rows
    states = {r.id: r for r in store.read("source_states").collect()}
    assert (states["t"].consecutive_failures, states["t"].warned_at_failure_count, states["s"].consecutive_failures) == (4, 3, 0)


class Failing(jobs.StubModel):
    """Answers in turn as told: None is an answer."""

    def __init__(self, *turns):
        self.turns, self.asked = list(turns), []

    def classify(self, items, channels):
        self.asked.append(items.count())
        turn = self.turns.pop(0) if self.turns else None
        if turn is not None:
            raise turn
        return super().classify(items, channels)


def test_model_failures_are_told_apart(spark, tmp_path):
    waits, at = [], datetime(2026, 9, 12, 21)

    def run(name, *turns):
        store, model = SnapshotStore(spark, str(tmp_path / name), 2), Failing(*turns)
        jobs.collect(store, _candidates(spark, 49), jobs.StubModel(), ["m"], at, classify_limit=0)
        waits.clear()
        n, errors = jobs.classify(store, model, ["m"], at, pause=waits.append)
        return n, errors, model.asked, list(waits), store.read("items").where("classified_at is not null").count()

    busy, gone = jobs.ModelError(429, "slow down"), jobs.ModelError(None, "reset")
    assert run("again", busy, gone) == (49, [], [20, 20, 20, 20, 9], [2, 4], 49)
    n, errors, asked, waited, stored = run("refused", None, jobs.ModelError(400, "bad input, Bearer abc123"))
    assert (n, stored, asked, waited) == (29, 29, [20, 20, 9], []) and len(errors) == 1 and errors[0].startswith("batch 1: refused: bad input") and "abc123" not in errors[0]
    n, errors, asked, waited, stored = run("billing", None, jobs.ModelError(400, "Your credit balance is too low"))
    assert (n, stored, asked, waited) == (20, 20, [20, 20], []) and [e.split(":")[1] for e in errors] == [" billing", " not asked"]
    n, errors, asked, waited, stored = run("down", *[jobs.ModelError(503, "no")] * 4)
    assert (n, asked, waited) == (29, [20] * 4 + [20, 9], [2, 4, 8]) and errors == ["batch 0: retry: no"]
    assert jobs.classify(SnapshotStore(spark, str(tmp_path / "down"), 2), jobs.StubModel(), [], at) == (0, ["no channel is configured, so nothing can be classified"])


def test_store_rewrites_touched_buckets_only(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), 8)
    rows = lambda ids, v, value: spark.createDataFrame([(str(i), value, v) for i in ids], "id string, value string, version int")
    store.commit("t", rows(range(200), 1, "a"))
    files = lambda: {b: f for b, f in store._manifest("t", store.version("t"))["buckets"].items()}
    old = files()
    store.upsert("t", rows([7], 2, "b"))
    assert sum(files()[b] != old[b] for b in old) == 1
    store.insert("t", rows([7, 500], 3, "c"))
    assert {r.id: r.value for r in store.read("t").where("id in ('7', '500', '8')").collect()} == {"7": "b", "500": "c", "8": "a"}
    for k in range(5):
        store.upsert("t", rows([k], 9 + k, "d"))
    assert store.read("t").count() == 201 and store.read("t").where("value = 'd'").count() == 5
    kept = sorted(int(p.name) for p in (tmp_path / "store" / "t" / "manifests").iterdir() if not p.name.startswith("."))
    assert kept == list(range(store.version("t") - 2, store.version("t") + 1))
    for k in range(store.FILES + 2):
        store.append("t", rows([1000 + 8 * k], 1, "e"))
    assert store.read("t").count() == 201 + store.FILES + 2 and max(map(len, files().values())) <= store.FILES
    copy = SnapshotStore(spark, str(tmp_path / "copy"))
    copy.seed(store.dump(["t", "none"]))
    assert sorted(map(tuple, copy.read("t").collect())) == sorted(map(tuple, store.read("t").collect()))
    empty = SnapshotStore(spark, str(tmp_path / "empty"))
    empty.commit("t", rows([], 1, "x"))
    assert empty.read("t").count() == 0 and empty.read("none") is None


def test_sending_is_repeated_where_it_is_worth_it():
    from types import SimpleNamespace

    row, waits = SimpleNamespace(id="d", message="m", retry_key="k"), []
    for answers, want, pauses in (([503, None, 200], (True, None), [2, 4]), ([400], (False, "HTTP 400"), []), ([500] * 4, (False, "HTTP 500"), [2, 4, 8]), ([409], (True, None), [])):
        left, waits = list(answers), []
        keys = []

        def call(i, m, key, left=left, keys=keys):
            keys.append(key)
            return left.pop(0)

        sender = jobs.RetryingSender(call, waits.append)
        assert sender.send([row]) == [("d", *want)] and waits == pauses and set(keys) == {"k"}


def test_verification_fetches_passing_failures_once_more(spark):
    from tidemark.sources import listing

    row = lambda s, status: (s, "html", "https://e.com/", None, status, "text/html", bytearray(b"<a href=/1>x</a>"), "a", None, None, None, None, 30)
    snaps = spark.createDataFrame([row("ok", 200), row("gone", 404), row("busy", 503)], listing.SNAPSHOT)
    asked = []

    def refetch(some):
        asked.extend(r.source_id for r in some.collect())
        return some.withColumn("status", F.lit(200))

    got = jobs.verify_with_retry(snaps, lambda s: listing.candidates(s.where("status = 200"), datetime(2026, 1, 1)), refetch)
    assert {r.id: r.verdict for r in got.collect()} == {"ok": "ok", "gone": "unreachable", "busy": "ok"} and asked == ["busy"]


def test_notifications_are_bounded(spark, tmp_path):
    folder, posted = tmp_path / "lines", []
    folder.mkdir()
    (folder / "1.json").write_text("\n".join(json.dumps({"line": f"error {k} Bearer abc"}) for k in range(30)))
    jobs.notifications(spark.readStream.schema("line string").json(str(folder)), posted.append, str(tmp_path / "cp")).awaitTermination()
    assert len(posted) == 1 and posted[0].endswith("... 10 more") and "abc" not in posted[0]


def test_stream_takes_each_url_once(spark, tmp_path):
    store, folder = SnapshotStore(spark, str(tmp_path / "store")), tmp_path / "in"
    folder.mkdir()
    row = lambda k: json.dumps({"source_id": "s", "ord": k, "url": f"https://e.com/{k}", "title": "t", "content_text": "x"})
    (folder / "1.json").write_text("\n".join(map(row, (1, 2, 2))))
    for _ in range(2):
        stream.start(spark, str(folder), store, str(tmp_path / "cp")).awaitTermination()
    (folder / "2.json").write_text("\n".join(map(row, (2, 3))))
    stream.start(spark, str(folder), store, str(tmp_path / "cp")).awaitTermination()
    assert sorted(r.canonical_url for r in store.read("items").collect()) == [f"https://e.com/{k}" for k in (1, 2, 3)]


def test_command_line(spark, tmp_path):
    from tidemark.cli import main

    (tmp_path / "config").mkdir()
    (tmp_path / "config" / "a.json").write_text(json.dumps([{"kind": "channel", "id": "m", "max_items": 2}, {"kind": "source", "id": "s", "name": "S", "type": "feed", "url": "https://e.com/", "channels": ["m"]}]))
    (tmp_path / "in.json").write_text("\n".join(json.dumps({"source_id": "s", "ord": k, "url": f"https://e.com/{k}", "title": f"T{k}", "content_text": "x"}) for k in range(4)))
    said: list[str] = []
    run = lambda *a: main([*a, "--store", str(tmp_path / "st"), "--config", str(tmp_path / "config"), "--date", "2026-09-13", "--now", "2026-09-12 21:00:00"], spark, said.append)
    assert run("validate-config") == 0 and run("collect", "--candidates", str(tmp_path / "in.json")) == 0
    assert run("summarise") == 0 and run("preview") == 0 and "T" in said[-1] and "generated" in said[-1]
    assert run("approve") == 0 and said[-1].endswith("approved")
    assert run("summarise", "--force") == 0 and run("approve") == 0
    assert run("test-broadcast") == 0 and said[-1] == '{"test_m": true}'
    page = [(1, "https://e.com/", "<ul class=l>" + "".join(f"<li><a href=/{k}>x</a>" for k in range(4)) + "</ul>")]
    spark.createDataFrame(page, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages"))
    assert run("diagnose", "--pages", str(tmp_path / "pages")) == 0 and '"ul.l a"' in said[-1]
    from tidemark.sources import listing

    spark.createDataFrame([("s", "html", "https://e.com/", None, 404, "text/html", bytearray(b"x"), "a", None, None, None, None, 30)], listing.SNAPSHOT).write.parquet(str(tmp_path / "snaps"))
    assert run("verify", "--snapshots", str(tmp_path / "snaps")) == 1 and "unreachable" in said[-1]
    assert run("deliver") == 0 and '"send"' in said[-1] and run("deliver") == 0 and '"delivered"' in said[-1]
    assert run("collect", "--channel", "nope") == 2
    assert run("collect") == 2 and "--allow-network" in said[-1]
    (tmp_path / "config" / "b.json").write_text(json.dumps([{"kind": "source", "id": "t", "channels": ["zz"]}]))
    assert run("validate-config") == 2 and said[-4:] == ["source t: name empty", "source t: type unknown", "source t: unknown channel zz", "source t: url not http"] or said[-1] == "source t: url not http"


def test_collection_from_configured_sources(spark, tmp_path):
    from tidemark.operators import config
    from tidemark.sources import fetch

    there = {"https://e.com/feed": "<rss><channel>" + "".join(f"<item><title>T{k}</title><link>/{k}</link></item>" for k in range(3)) + "</channel></rss>", "https://f.com/list": "<ul><li><a href=/x>X</a></ul>"}
    there |= {f"https://e.com/{k}": f"<title>t</title><body><p>Text of page {k}, which is long enough to count as a paragraph.</p></body>" for k in range(3)}
    seen = str(tmp_path / "seen")

    def opener(url, headers, method="GET"):
        import io
        import urllib.error

        with open(seen, "a") as f:
            f.write(f"{url} {headers.get('If-None-Match')}\n")
        status = 304 if headers.get("If-None-Match") == "v1" else 200 if url in there else 404
        if status != 200:
            raise urllib.error.HTTPError(url, status, "x", {}, io.BytesIO())
        r = io.BytesIO(there[url].encode())
        r.status, r.url, r.headers = 200, url, {"Content-Type": "text/html", "ETag": "v1"}
        return r

    rows = spark.createDataFrame([(json.dumps(r),) for r in (
        {"kind": "source", "id": "feed", "type": "feed", "url": "https://e.com/feed"}, {"kind": "source", "id": "list", "type": "html", "url": "https://f.com/list", "html": {"item_selector": "li a"}},
        {"kind": "source", "id": "gone", "type": "feed", "url": "https://e.com/gone"}, {"kind": "source", "id": "off", "type": "feed", "url": "https://g.com/", "enabled": False}, {"kind": "channel", "id": "m"})], "record string")
    sources, store = config.records(rows, "source", config.SOURCE), SnapshotStore(spark, str(tmp_path / "store"), 2)
    read = lambda asked: fetch.read_pages(asked, opener, pause_s=0)
    got = jobs.collect_sources(store, sources, read, jobs.StubModel(), ["m"], datetime(2026, 9, 12, 21))
    assert (got["new_items"], got["sources_total"], got["sources_succeeded"], got["sources_failed"]) == (4, 3, 2, 1)
    texts = {r.canonical_url: r.content_text for r in store.read("items").collect()}
    assert texts["https://e.com/1"].startswith("Text of page 1") and texts["https://f.com/x"] == ""
    asked = [line.split(" ")[0] for line in open(seen)]
    assert all(asked.count(u) == 1 for u in asked if "robots" not in u) and len([u for u in asked if "robots" not in u]) == 7 and "https://g.com/" not in asked
    # unchanged pages are told by their validators, and list nothing anew
    again = jobs.collect_sources(store, sources, read, jobs.StubModel(), ["m"], datetime(2026, 9, 13, 3))
    states = {r.id: r for r in store.read("source_states").collect()}
    assert again["new_items"] == 0 and again["sources_succeeded"] == 2 and states["feed"].etag == "v1" and states["feed"].consecutive_empty == 0 and states["gone"].consecutive_failures == 2


def test_digests_say_how_much_was_read(spark, tmp_path):
    store, day = SnapshotStore(spark, str(tmp_path / "store"), 2), date(2026, 9, 13)
    assert jobs.coverage_of(store, day) == (0, 0, None)
    fetches = lambda ok: spark.createDataFrame([(f"s{k}", k < ok, False, 0 if k == 0 else 1) for k in range(4)], "source_id string, ok boolean, not_modified boolean, n_candidates int")
    for hour, ok in ((2, 2), (8, 3), (14, 3)):
        jobs.collect(store, _candidates(spark, 2), jobs.StubModel(), ["m"], datetime(2026, 9, 12, hour), fetches=fetches(ok))
    assert jobs.coverage_of(store, day) == (4, 3, "2026-09-12 14:00:00")
    # the best of the day's runs, less a source that has long listed nothing
    silent = F.when(F.col("id") == "s0", 99).otherwise(F.col("consecutive_empty"))
    store.commit("source_states", store.read("source_states").withColumn("consecutive_empty", silent))
    assert jobs.coverage_of(store, day)[:2] == (4, 2) and jobs.coverage_of(store, date(2026, 9, 20))[:2] == (4, 0)
    jobs.summarise(store, Channel("m"), day, jobs.StubModel(), datetime(2026, 9, 12, 22))
    assert tuple(store.read("digests").select("sources_total", "sources_read").first()) == (4, 2)


def test_senders_are_dry_unless_told(spark):
    import io

    from tidemark.sources.settings import Settings

    assert isinstance(jobs.sender_of(Settings()), jobs.DryRunSender) and isinstance(jobs.sender_of(Settings(dry_run=False)), jobs.DryRunSender)
    posted = []

    def opener(url, headers, method, data):
        posted.append((url, headers["X-Retry-Key"], method, json.loads(data)["messages"][0]["text"]))
        r = io.BytesIO()
        r.status = 200
        return r

    from types import SimpleNamespace

    sender = jobs.sender_of(Settings(dry_run=False, broadcast_url="https://b.example/send", broadcast_token="t"), opener)
    assert sender.send([SimpleNamespace(id="d", message="hello", retry_key="k")]) == [("d", True, None)] and posted == [("https://b.example/send", "k", "POST", "hello")]
