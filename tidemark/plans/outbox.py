"""A sink for messages: tasks stage rows of (id, message, retry_key), and what they staged is sent once their write commits.

An attempt that fails, is killed or repeated leaves a file that no commit names, so nothing of it is sent. A commit first writes down
which files are due and then sends them from the driver, a message at a time, with a record for each; after a crash the next commit, or `send_due`,
goes on behind the last record. Rows of one retry key are one message, whichever comes first: it is sent until it has arrived and
never again. A message sent just before a crash, without its record, goes out again with its key, by which receivers tell repeats.
"""

from __future__ import annotations

import hashlib
import json
import os
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from ..sources.settings import Settings
from . import jobs

ROW = pa.schema([("id", pa.string()), ("message", pa.string()), ("retry_key", pa.string())])
OUTCOME = "id string, message string, retry_key string, ok boolean, error string, attempts int"
BATCH = 1000


@dataclass
class Staged(WriterCommitMessage):
    """The file of a task's successful attempt; none if it had no rows."""

    file: str | None


class _Folder:
    """The outbox's folder, which driver and executors share. Dry runs have a part of their own, so they never count as sent."""

    def __init__(self, path: str, dry: bool):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(path)
        self.part = f"{self.root}/{'dry' if dry else 'real'}"

    def exists(self, path: str) -> bool:
        return self.fs.get_file_info(path).type != pyarrow.fs.FileType.NotFound

    def load(self, path: str) -> dict | None:
        if not self.exists(path):
            return None
        with self.fs.open_input_stream(path) as f:
            return json.loads(f.read())

    def store(self, path: str, value: dict) -> None:
        """Whole or not at all, under a name that readers don't list until it is there."""
        folder, name = path.rsplit("/", 1)
        self.fs.create_dir(folder, recursive=True)
        half = f"{folder}/.{name}.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(half) as f:
            f.write(json.dumps(value, ensure_ascii=False).encode())
        if self.exists(path):
            self.fs.delete_file(path)
        self.fs.move(half, path)

    def record(self, key: str) -> str:
        return f"{self.part}/sent/{hashlib.sha256(key.encode()).hexdigest()}.json"

    def due(self) -> list[str]:
        if not self.exists(f"{self.part}/due"):
            return []
        found = self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.part}/due"))
        return sorted(f.path for f in found if not f.base_name.startswith("."))

    def rows(self, file: str) -> Iterator[dict]:
        with self.fs.open_input_file(f"{self.root}/{file}") as f:
            for batch in pq.ParquetFile(f).iter_batches(BATCH):
                yield from batch.to_pylist()


@dataclass
class _Message:
    id: str
    message: str
    retry_key: str


def send_due(path: str, sender) -> int:
    """Send what committed writes left due; the number of messages sent or tried. One driver at a time."""
    dry = isinstance(sender, jobs.DryRunSender)
    folder, n = _Folder(path, dry), 0
    for due in folder.due():
        listed = folder.load(due)
        for file in listed["files"]:
            for row in folder.rows(file):
                at = folder.record(row["retry_key"])
                old = folder.load(at) or {"ok": False, "attempts": 0, "run": None}
                if old["ok"] or old["run"] == listed["run"]:
                    continue
                ((_, ok, error),) = [(row["id"], True, None)] if dry else sender.send([_Message(**row)])
                folder.store(at, row | {"ok": ok, "error": error, "attempts": old["attempts"] + 1, "run": listed["run"]})
                n += 1
        folder.fs.delete_file(due)
        for file in listed["files"]:
            folder.fs.delete_file(f"{folder.root}/{file}")
    return n


class _Writing:
    """What the writers of tables and of streams share."""

    def __init__(self, options):
        if "path" not in options:
            raise ValueError("outbox needs a path: a folder that the driver and the executors share")
        self.path, self.real, self.run = options["path"], options.get("send", "false") == "true", uuid.uuid4().hex

    def sender(self):
        """The sender of the driver's settings. Secrets come from its environment, as options are shown with plans."""
        if not self.real:
            return jobs.DryRunSender([])
        sender = jobs.sender_of(Settings.from_env(os.environ))
        if isinstance(sender, jobs.DryRunSender):
            raise ValueError("to send, the driver's environment needs DRY_RUN off and an endpoint with its token")
        return sender

    def write(self, iterator: Iterator) -> Staged:
        folder, rows = _Folder(self.path, not self.real), iter(iterator)
        file, out = f"staged/{self.run}/{uuid.uuid4().hex}.parquet", None
        try:
            while some := list(islice(rows, BATCH)):
                if any(not r["retry_key"] for r in some):
                    raise ValueError("a message without a retry key")
                if out is None:
                    folder.fs.create_dir(f"{folder.root}/staged/{self.run}", recursive=True)
                    out = pq.ParquetWriter(f"{folder.root}/{file}", ROW, filesystem=folder.fs)
                out.write_table(pa.Table.from_pylist([{c: r[c] or "" for c in ROW.names} for r in some], schema=ROW))
        finally:
            if out is not None:
                out.close()
        return Staged(None if out is None else file)

    def finish(self, messages: Iterable[Staged | None], run: str) -> None:
        sender, folder = self.sender(), _Folder(self.path, not self.real)
        files = [m.file for m in messages if m is not None and m.file]
        if files:
            folder.store(f"{folder.part}/due/{run}.json", {"run": run, "files": files})
        send_due(self.path, sender)
        self._clear(folder)

    def undo(self, run: str) -> None:
        """Nothing is sent of a write that fails before its commit; what a commit has written down stays due."""
        folder = _Folder(self.path, not self.real)
        if not folder.exists(f"{folder.part}/due/{run}.json"):
            self._clear(folder)

    def _clear(self, folder: _Folder) -> None:
        """Files of attempts that no commit named."""
        if folder.exists(f"{folder.root}/staged/{self.run}"):
            folder.fs.delete_dir(f"{folder.root}/staged/{self.run}")


class OutboxWriter(_Writing, DataSourceWriter):
    def commit(self, messages) -> None:
        self.finish(messages, self.run)

    def abort(self, messages) -> None:
        self.undo(self.run)


class OutboxStreamWriter(_Writing, DataSourceStreamWriter):
    """A batch that a restart runs again brings its keys again, and what has arrived of them is not sent."""

    def commit(self, messages, batchId: int) -> None:  # noqa: N803  Spark's name
        self.finish(messages, f"{self.run}-{batchId:09d}")

    def abort(self, messages, batchId: int) -> None:  # noqa: N803
        self.undo(f"{self.run}-{batchId:09d}")


class Outbox(DataSource):
    """df.write.format("outbox").mode("append").save(folder) after spark.dataSource.register(Outbox), or writeStream likewise.

    Rows have (id, message, retry_key); null ids and messages count as empty, a row without a key fails the write, and nothing of it is
    sent. Option send: "true" sends by the driver's settings; else the run is dry. `outcomes` tells what became of the messages.
    """

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> str:
        return "id string, message string, retry_key string"

    def writer(self, schema, overwrite: bool) -> OutboxWriter:
        if overwrite:
            raise ValueError("an outbox is only added to: what is sent stays sent")
        return OutboxWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> OutboxStreamWriter:  # noqa: N802
        return OutboxStreamWriter(self.options)


def outcomes(spark: SparkSession, path: str, dry: bool) -> DataFrame:
    """A row for each message that was sent or tried, with the number of its attempts; the last error where it has not arrived."""
    folder = _Folder(path, dry)
    if not folder.exists(f"{folder.part}/sent"):
        return spark.createDataFrame([], OUTCOME)
    return spark.read.schema(OUTCOME).json(f"{path}/{'dry' if dry else 'real'}/sent")


@dataclass
class OutboxSender:
    """A sender for `jobs.deliver`: messages go through an outbox, so that a delivery whose end was not recorded is not sent again."""

    spark: SparkSession
    path: str
    real: bool = False
    source: type[Outbox] = Outbox

    def send(self, rows: Iterable) -> list[tuple[str, bool, str | None]]:
        rows = [(r.id, r.message, r.retry_key) for r in rows]  # a digest for each channel
        if not rows:
            return []
        self.spark.dataSource.register(self.source)
        frame = self.spark.createDataFrame(rows, "id string, message string, retry_key string")
        frame.write.format(self.source.name()).mode("append").option("send", str(self.real).lower()).save(self.path)
        mine = outcomes(self.spark, self.path, not self.real).join(frame.select("retry_key"), "retry_key", "left_semi")
        return [(r.id, r.ok, r.error) for r in mine.select("id", "ok", "error").collect()]


def sender_of(spark: SparkSession, path: str, settings: Settings) -> OutboxSender:
    """As `jobs.sender_of`, through an outbox."""
    return OutboxSender(spark, path, not isinstance(jobs.sender_of(settings), jobs.DryRunSender))
