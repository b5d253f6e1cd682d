from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.operators import health, runs
from tidemark.streaming import health as sh

SF = "/root/testdata/sf0.001"
START = datetime(2024, 1, 1)


def _drain(spark, rows, build, folder, parts, restart_after=None):
    """Rows of a stream over files written from `rows` in `parts` pieces by time, a file a micro-batch; the query is
    stopped and started again after some of them."""
    source, seen = folder / "in", []
    source.mkdir(parents=True)
    rows.createOrReplaceTempView("all_rows")
    cut = spark.sql(f"SELECT *, ntile({parts}) OVER (ORDER BY ts) AS part FROM all_rows").toPandas()
    for k in range(1, parts + 1):
        spark.createDataFrame(cut[cut["part"] == k].drop(columns="part"), rows.schema).coalesce(1).write.mode("append").parquet(str(source))
        if k in (restart_after or ()) or k == parts:
            stream = build(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(source)))
            stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(folder / "cp")).trigger(availableNow=True).start().awaitTermination()
    return seen


def _fetches(spark, rows):
    return spark.createDataFrame([(s, START + timedelta(days=d), k, f, e) for k, (s, d, f, e) in enumerate(rows)], "source_id long, ts timestamp, seq long, failed boolean, empty boolean")


def test_streaks_over_restarts_are_those_of_batch(spark, tmp_path):
    rows = [(k % 2, k / 10, k % 7 in (1, 2, 3, 4), k % 5 == 0) for k in range(60)]
    fetches = _fetches(spark, rows)
    got = _drain(spark, fetches, sh.health_stream, tmp_path, 4, restart_after=(2,))
    want = health.streaks(fetches.withColumn("ts", F.col("ts").cast("timestamp_ntz"))).select("source_id", "seq", "failures", "empties").collect()
    assert sorted((r.source_id, r.seq, r.failures, r.empties) for r in got) == sorted(map(tuple, want)) and len(got) == 60


def test_a_silent_source_begins_anew(spark, tmp_path):
    rows = [(1, 0, True, False), (1, 1, True, False), (2, 2, True, False), (2, 80, True, False), (2, 100, True, False), (2, 110, True, False), (1, 112, True, False), (2, 113, True, False)]
    got = _drain(spark, _fetches(spark, rows), sh.health_stream, tmp_path, 8, restart_after=(3, 6))
    assert [r.failures for r in sorted(got, key=lambda r: r.seq)] == [1, 2, 1, 2, 3, 4, 1, 5]


def test_absences_as_they_happen_are_those_of_the_whole_log(spark, tmp_path):
    log = spark.read.parquet(f"{SF}/events.parquet").where("ts < '2024-01-20'").select(F.lit("broadcast").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.expr("event_type = 'purchase' and value > 200").alias("sent"))
    got = _drain(spark, log, lambda s: sh.absence_stream(s, 2), tmp_path, 5, restart_after=(2, 4))
    last = log.agg(F.max("ts")).first()[0] - timedelta(hours=1)
    want = runs.missing_days(log, F.col("sent"), 2).where(F.date_add("day", 1) <= F.lit(last)).collect()
    assert sorted((r.day, r.sent) for r in got) == sorted(map(tuple, want)) and len(want) >= 3


def test_absence_of_a_key_without_rows(spark, tmp_path):
    rows = [("a", START, True), ("b", START, True)] + [("b", START + timedelta(days=d), True) for d in range(1, 5)]
    log = spark.createDataFrame(rows, "key string, ts timestamp, sent boolean")
    got = _drain(spark, log, sh.absence_stream, tmp_path, 3)
    assert sorted((r.key, (r.day - START.date()).days, r.sent) for r in got) == [("a", 1, 0), ("a", 2, 0)]


def test_error_windows_as_they_close(spark, tmp_path):
    log = spark.read.parquet(f"{SF}/events.parquet").where("ts < '2024-01-04'").select(F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") == "error").alias("failed"))
    got = _drain(spark, log, lambda s: sh.error_stream(s, "1 hour"), tmp_path, 4)
    want = {(r.window_start, r.errors) for r in runs.error_windows(log, "1 hour", []).collect()}
    assert {(r.window_start, r.errors) for r in got} <= want and len(got) >= len(want) - 1 > 3


def _site(folder):
    """A reader whose pages are files of a folder; an ETag is a page's own text. It writes down what it was asked."""
    from tidemark.streaming import pages

    def opener(url, headers, method="GET"):
        import io
        import os
        import urllib.error

        name = url.rsplit("/", 1)[1]
        if name == "robots.txt" or not os.path.exists(f"{folder}/{name}"):
            raise urllib.error.HTTPError(url, 404, "x", {}, io.BytesIO())
        with open(f"{folder}/{name}") as f:
            text = f.read()
        with open(f"{folder}/asked", "a") as f:
            f.write(f"{name} {headers.get('If-None-Match')}\n")
        if headers.get("If-None-Match") == text:
            raise urllib.error.HTTPError(url, 304, "x", {}, io.BytesIO())
        r = io.BytesIO(text.encode())
        r.status, r.url, r.headers = 200, url, {"Content-Type": "text/html", "ETag": text}
        return r

    class Reader(pages.ChangedPagesReader):
        pass

    Reader.opener = staticmethod(opener)

    class Source(pages.ChangedPages):
        def simpleStreamReader(self, schema):  # noqa: N802
            return Reader(self.options)

    return Reader, Source


def test_polls_send_validators_and_replay_the_same_rows(tmp_path):
    import json

    site = tmp_path / "site"
    site.mkdir()
    (site / "a").write_text("a1")
    (site / "b").write_text("b1")
    make = lambda: _site(str(site))[0]({"sources": json.dumps([["s", "https://e.com/a"], ["t", "https://e.com/b"]]), "allow_network": "true", "pause_s": "0", "spool": str(tmp_path / "spool")})
    start = make().initialOffset()
    rows, one = make().read(start)
    assert [(r[0], r[5]) for r in rows] == [("s", b"a1"), ("t", b"b1")] and one["polls"] == 1
    # nothing has changed: the validators are sent, no rows come, and the offset stays
    rows, same = make().read(one)
    assert list(rows) == [] and same == one and (site / "asked").read_text().splitlines()[2:] == ["a a1", "b b1"]
    (site / "b").write_text("b2")
    rows, two = make().read(one)
    assert [(r[0], r[5]) for r in rows] == [("t", b"b2")] and two["known"]["https://e.com/b"]["etag"] == "b2"
    # the pages change again, but offsets that come again give the rows that they gave, without asking
    (site / "a").write_text("a2")
    asked = (site / "asked").read_text()
    assert [r[5] for r in make().readBetweenOffsets(start, two)] == [b"a1", b"b1", b"b2"] and [r[5] for r in make().read(one)[0]] == [b"b2"]
    assert (site / "asked").read_text() == asked
    make().commit(two)
    assert [r[5] for r in make().readBetweenOffsets(one, two)] == [b"b2"]


def test_a_stream_of_changed_pages_over_restarts(spark, tmp_path):
    import json

    site, seen = tmp_path / "site", []
    site.mkdir()
    (site / "a").write_text("a1")
    (site / "b").write_text("b1")
    spark.dataSource.register(_site(str(site))[1])

    def run():
        before = len(seen)
        stream = spark.readStream.format("changed_pages").option("sources", json.dumps([["s", "https://e.com/a"], ["t", "https://e.com/b"], ["u", "https://e.com/gone"]])).option("allow_network", "true").option("pause_s", "0").option("spool", str(tmp_path / "spool")).load()
        stream.where("status = 200").writeStream.foreachBatch(lambda df, _: seen.extend((r.source_id, bytes(r.body)) for r in df.collect())).option("checkpointLocation", str(tmp_path / "cp")).trigger(once=True).start().awaitTermination()
        return sorted(seen[before:])

    assert run() == [("s", b"a1"), ("t", b"b1")]
    (site / "b").write_text("b2")
    assert run() == [("t", b"b2")]
