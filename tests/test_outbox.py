"""Messages through the outbox: sent when their write commits, once for each key, over killed attempts, crashes and restarts."""

import os
from datetime import date, datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.operators.select import Channel
from tidemark.operators.store import SnapshotStore
from tidemark.plans import jobs, outbox


def _row(key, text="hello"):
    return Row(id=f"d{key}", message=text, retry_key=key)


class Receiver:
    """Notes what arrives; the keys of `down` get no answer, and with `dies_at` the sender dies before that call."""

    def __init__(self, dies_at=None):
        self.got, self.down, self.dies_at = [], set(), dies_at

    def send(self, rows):
        out = []
        for r in rows:
            if self.dies_at == len(self.got):
                raise RuntimeError("the driver died")
            self.got.append(r.retry_key)
            out.append((r.id, r.retry_key not in self.down, "no answer" if r.retry_key in self.down else None))
        return out


def _writer(path, receiver):
    w = outbox.OutboxWriter({"path": str(path), "send": "true"})
    w.sender = lambda: receiver
    return w


def _staged(path):
    return [f for _, _, files in os.walk(path / "staged") for f in files]


def test_killed_and_repeated_attempts_send_nothing_twice(tmp_path):
    receiver = Receiver()
    w = _writer(tmp_path, receiver)

    def dying():
        for k in range(outbox.BATCH + 1):
            yield _row(f"k{k}")
        raise RuntimeError("the executor is lost")

    with pytest.raises(RuntimeError):
        w.write(dying())
    lost = w.write(iter([_row("a"), _row("b")]))  # finished, but another attempt of the task was faster
    kept, none = w.write(iter([_row("a"), _row("b"), _row("a")])), w.write(iter([]))
    assert lost.file != kept.file and none.file is None and len(_staged(tmp_path)) == 3 and receiver.got == []
    w.commit([kept, none, None])
    assert receiver.got == ["a", "b"] and _staged(tmp_path) == []
    again = _writer(tmp_path, receiver)
    again.commit([again.write(iter([_row("b"), _row("c")]))])
    assert receiver.got == ["a", "b", "c"]


def test_a_failed_write_sends_nothing(spark, tmp_path):
    spark.dataSource.register(outbox.Outbox)
    bad = spark.range(40).select(F.lit("i").alias("id"), F.lit("m").alias("message"), F.when(F.col("id") != 17, F.col("id").cast("string")).alias("retry_key"))
    with pytest.raises(Exception, match="retry key"):
        bad.write.format("outbox").mode("append").save(str(tmp_path))
    assert outbox.outcomes(spark, str(tmp_path), True).count() == 0 and _staged(tmp_path) == []
    with pytest.raises(Exception, match="added to"):
        bad.where("retry_key is not null").write.format("outbox").mode("overwrite").save(str(tmp_path))
    # real sending without settings is an error, not a silent dry run
    with pytest.raises(Exception, match="DRY_RUN"):
        bad.where("retry_key is not null").write.format("outbox").mode("append").option("send", "true").save(str(tmp_path))
    assert outbox.outcomes(spark, str(tmp_path), False).count() == 0 and _staged(tmp_path) == []


def test_a_crash_between_messages_goes_on_behind_the_last_record(spark, tmp_path):
    receiver = Receiver(dies_at=2)
    w = _writer(tmp_path, receiver)
    staged = [w.write(iter([_row("a"), _row("b"), _row("c", "日本語")])), w.write(iter([_row("d")]))]
    with pytest.raises(RuntimeError):
        w.commit(staged)
    w.abort(staged)  # as Spark does; what is written down stays due
    assert receiver.got == ["a", "b"]
    receiver.dies_at = None
    assert outbox.send_due(str(tmp_path), receiver) == 2 and receiver.got == ["a", "b", "c", "d"]
    assert outbox.send_due(str(tmp_path), receiver) == 0 and _staged(tmp_path) == []
    rows = {r.retry_key: (r.id, r.message, r.ok, r.attempts) for r in outbox.outcomes(spark, str(tmp_path), False).collect()}
    assert rows["c"] == ("dc", "日本語", True, 1) and len(rows) == 4
    # a dry run neither sends what is due nor counts as sent
    assert outbox.outcomes(spark, str(tmp_path), True).count() == 0


def test_what_did_not_arrive_is_tried_by_the_next_write(spark, tmp_path):
    receiver = Receiver()
    receiver.down = {"b"}
    for _ in range(2):
        w = _writer(tmp_path, receiver)
        w.commit([w.write(iter([_row("a"), _row("b")]))])
    receiver.down = set()
    w = _writer(tmp_path, receiver)
    w.commit([w.write(iter([_row("b")]))])
    assert receiver.got == ["a", "b", "b", "b"]
    assert {(r.retry_key, r.ok, r.error, r.attempts) for r in outbox.outcomes(spark, str(tmp_path), False).collect()} == {("a", True, None, 1), ("b", True, None, 3)}


def test_deliveries_whose_end_was_not_recorded_are_not_sent_again(spark, tmp_path):
    store, box = SnapshotStore(spark, str(tmp_path / "store")), str(tmp_path / "box")
    store.upsert("digests", spark.createDataFrame([("m_2026-09-12", "m", "generated", "the digest", 1.0), ("n_2026-09-12", "n", "skipped", "", 1.0)], "id string, channel_id string, status string, message string, version double"))

    class Dying(outbox.OutboxSender):
        def send(self, rows):
            super().send(rows)
            raise RuntimeError("the driver died")

    channels, day = [Channel("m"), Channel("n")], date(2026, 9, 12)
    with pytest.raises(RuntimeError):
        jobs.deliver(store, channels, day, Dying(spark, box), datetime(2026, 9, 12, 23))
    assert store.read("deliveries").first().delivery_status == "failed"
    out = jobs.deliver(store, channels, day, outbox.OutboxSender(spark, box), datetime(2026, 9, 12, 23, 5))
    assert out == {"m_2026-09-12": "send", "n_2026-09-12": "skipped"}
    assert store.read("deliveries").first().delivery_status == "sent" and store.read("digests").where("channel_id = 'm'").first().status == "delivered"
    assert [(r.id, r.message, r.attempts) for r in outbox.outcomes(spark, box, True).collect()] == [("m_2026-09-12", "the digest", 1)]
    assert jobs.deliver(store, channels, day, outbox.OutboxSender(spark, box), datetime(2026, 9, 12, 23, 9))["m_2026-09-12"] == "delivered"


def test_a_stream_that_starts_anew_sends_only_what_is_new(spark, tmp_path):
    spark.dataSource.register(outbox.Outbox)
    (tmp_path / "in").mkdir()
    schema = "id string, message string, retry_key string"

    def run(checkpoint):
        rows = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        rows.writeStream.format("outbox").option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start(str(tmp_path / "box")).awaitTermination()
        return {(r.retry_key, r.attempts) for r in outbox.outcomes(spark, str(tmp_path / "box"), True).collect()}

    (tmp_path / "in" / "1.json").write_text('{"id": "x", "message": "m", "retry_key": "1"}\n')
    assert run("c1") == {("1", 1)}
    (tmp_path / "in" / "2.json").write_text('{"id": "x", "message": "m", "retry_key": "2"}\n{"id": "x", "message": "m", "retry_key": "1"}\n')
    assert run("c1") == {("1", 1), ("2", 1)}
    # a lost checkpoint brings all rows again
    assert run("c2") == {("1", 1), ("2", 1)} and _staged(tmp_path / "box") == []


def test_the_command_line_sends_through_an_outbox(spark, tmp_path):
    from tidemark.cli import main

    (tmp_path / "config").mkdir()
    (tmp_path / "config" / "c.json").write_text('[{"kind": "channel", "id": "m"}]')
    said = []
    assert main(["test-broadcast", "--config", str(tmp_path / "config"), "--outbox", str(tmp_path / "box")], spark, said.append) == 0
    assert said == ['{"test_m": true}'] and outbox.outcomes(spark, str(tmp_path / "box"), True).first().id == "test_m"
