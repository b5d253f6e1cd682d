"""A streaming source of pages: each micro-batch asks for all of them with the validators of the last, and has those that changed."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources import fetch

_ROW = pa.schema([("source_id", pa.string()), ("url", pa.string()), ("final_url", pa.string()), ("status", pa.int32()), ("content_type", pa.string()), ("body", pa.binary()), ("etag", pa.string()), ("last_modified", pa.string()), ("error", pa.string())])


class ChangedPagesReader(SimpleDataSourceStreamReader):
    """Offsets hold the number of polls and each URL's validators, so a restart sends them. What a poll brings is written to
    `spool` before its offset is known to Spark, and read from there whenever its offsets come again: equal offsets give equal rows.

    Polls are for the listing pages of configured sources, a few for each, and run on the driver.
    """

    opener = staticmethod(fetch.open_url)

    def __init__(self, options):
        self.sources = json.loads(options.get("sources", "[]"))  # [[source_id, url], ...]
        self.pause = float(options.get("pause_s", fetch.DELAY_S))
        self.allowed = options.get("allow_network", "false") == "true"
        if "spool" not in options:
            raise ValueError("changed_pages needs the option spool: a folder that restarts can read")
        self.fs, self.spool = pyarrow.fs.FileSystem.from_uri(options["spool"])

    def initialOffset(self) -> dict:  # noqa: N802  Spark's name
        return {"polls": 0, "known": {}}

    def _path(self, polls: int) -> str:
        return f"{self.spool}/poll-{polls:09d}.parquet"

    def _kept(self, polls: int) -> tuple[list[tuple], dict] | None:
        if self.fs.get_file_info(self._path(polls)).type != pyarrow.fs.FileType.File:
            return None
        table = pq.read_table(self._path(polls), filesystem=self.fs)
        return [tuple(r.values()) for r in table.to_pylist()], json.loads(table.schema.metadata[b"end"])

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        polls = start["polls"] + 1
        kept = self._kept(polls)
        if kept is None:
            polite, known, rows = fetch.Polite(self.opener, self.pause), dict(start["known"]), []
            for source, url in self.sources if self.allowed else ():
                final, status, kind, body, etag, modified, error = polite.get(url, known.get(url))
                if status == 304:
                    continue
                rows.append((source, url, final, status, kind, body, etag, modified, error))
                if status is not None and 200 <= status < 300:
                    known[url] = {"etag": etag, "last_modified": modified}
            if not rows:
                return iter(()), start
            end = {"polls": polls, "known": known}
            table = pa.Table.from_pylist([dict(zip(_ROW.names, r, strict=True)) for r in rows], schema=_ROW.with_metadata({"end": json.dumps(end)}))
            self.fs.create_dir(self.spool, recursive=True)
            half = f"{self.spool}/.{uuid.uuid4().hex}"
            pq.write_table(table, half, filesystem=self.fs)
            self.fs.move(half, self._path(polls))
            kept = rows, end
        return iter(kept[0]), kept[1]

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        for polls in range(start["polls"] + 1, end["polls"] + 1):
            kept = self._kept(polls)
            if kept is None:
                raise FileNotFoundError(f"the spool has lost poll {polls}")
            yield from kept[0]

    def commit(self, end: dict) -> None:
        """Polls before the last finished one are not asked for again."""
        old = self._path(end["polls"] - 1)
        if self.fs.get_file_info(old).type == pyarrow.fs.FileType.File:
            self.fs.delete_file(old)


class ChangedPages(DataSource):
    """spark.readStream.format("changed_pages") after spark.dataSource.register(ChangedPages). Off unless allow_network is true.

    Options: sources, a JSON list of [source_id, url]; spool, a folder; pause_s. A page that has not changed (304) has no row; one that
    can't be read has a row with its status or error in each poll. Rows have the schema of PoliteSource.
    """

    @classmethod
    def name(cls) -> str:
        return "changed_pages"

    def schema(self) -> str:
        return "source_id string, url string, final_url string, status int, content_type string, body binary, etag string, last_modified string, error string"

    def simpleStreamReader(self, schema) -> ChangedPagesReader:  # noqa: N802
        return ChangedPagesReader(self.options)
