"""Fetching: character sets, retries, robots rules, and a data source with one partition for each host."""

from __future__ import annotations

import codecs
import json
import re
import time
import urllib.error
import urllib.request
from collections.abc import Iterator
from urllib.parse import urlsplit
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.urls import host_of, internal_host

RETRIES, DELAY_S, TIMEOUT_S = 3, 2.0, 20
#: Seconds that a run may take to read pages.
BUDGET_S = 1200.0
#: Hosts that are asked at the same time, and answers to HEAD after which GET is tried.
HOSTS_AT_ONCE, HEAD_REFUSED = 4, (403, 405, 501)
AGENT = "tidemark"
ROBOTS = "refused by robots rules"
_META = re.compile(rb"""<meta[^>]+charset\s*=\s*["']?\s*([\w-]+)""", re.I)
_XML = re.compile(rb"""<\?xml[^>]+encoding\s*=\s*["']([\w-]+)""", re.I)
_BINARY = re.compile(r"^(image|audio|video|font)/|application/(octet-stream|zip|pdf|msword|vnd)", re.I)
#: Names of character sets that stand for wider ones.
_ALIASES = {"shift_jis": "cp932", "sjis": "cp932", "x-sjis": "cp932", "windows-31j": "cp932", "iso-8859-1": "cp1252"}


#: Pages in an Arrow batch to a Python task, at most; their bodies may be long.
BATCH_PAGES = 500


def short_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_PAGES rows, if they are longer, so that a task's Python holds few pages at a time."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(conf)) <= BATCH_PAGES:
        spark.conf.set(conf, str(BATCH_PAGES))


def charset(body: bytes, content_type: str) -> str:
    """The character set by header, else by a meta tag in the first 2 KB, else by the XML declaration, else UTF-8."""
    header = re.search(r"charset\s*=\s*[\"']?([\w-]+)", content_type or "", re.I)
    names = [header[1] if header else None] + [m[1].decode("ascii", "ignore") if (m := p.search(body[:2048])) else None for p in (_META, _XML)]
    for name in filter(None, names):
        name = _ALIASES.get(name.lower(), name)
        try:
            codecs.lookup(name)
            return name
        except LookupError:
            continue
    return "utf-8"


def decode(body: bytes, content_type: str) -> str:
    """The text of a body; empty for binary types."""
    if _BINARY.search(content_type or ""):
        return ""
    return body.decode(charset(body, content_type), "replace").removeprefix("﻿")


def retryable(status: int | None) -> bool:
    """Network errors, 429 and 5xx are worth another try."""
    return status is None or status == 429 or status >= 500


def backoff(attempt: int, base: float = DELAY_S) -> float:
    return base * 2 ** (attempt - 1)


def by_host(urls: list[str]) -> dict[str, list[str]]:
    out: dict[str, list[str]] = {}
    for url in urls:
        out.setdefault(urlsplit(url).netloc.lower(), []).append(url)
    return out


class _Hosts(InputPartition):
    def __init__(self, hosts: list[list[tuple[str, str]]]):
        self.hosts = hosts


class Refused(OSError):
    """An address that is not fetched."""


class _Redirects(urllib.request.HTTPRedirectHandler):
    """A page may not send the reader to an internal address."""

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if internal_host(newurl):
            raise Refused(f"redirect to an internal address: {newurl}")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def open_url(url: str, headers: dict[str, str], method: str = "GET", timeout: float = TIMEOUT_S, data: bytes | None = None):
    if internal_host(url):
        raise Refused(f"internal address: {url}")
    return urllib.request.build_opener(_Redirects).open(urllib.request.Request(url, data=data, headers=headers, method=method), timeout=timeout)


def probe(url: str, opener=open_url) -> tuple[int | None, str | None]:
    """(status, error) of a URL by HEAD, and by GET where a server refuses HEAD as such."""
    for method in ("HEAD", "GET"):
        try:
            with opener(url, {"User-Agent": AGENT}, method) as r:
                return r.status, None
        except urllib.error.HTTPError as e:
            if method == "GET" or e.code not in HEAD_REFUSED:
                return e.code, str(e)
        except OSError as e:
            return None, str(e)
    return None, None


class Polite:
    """Requests of one task: no internal address, robots rules kept for each site, a pause between requests to one host."""

    def __init__(self, opener=open_url, pause_s: float = DELAY_S, sleep=time.sleep):
        self.open, self.pause, self.sleep = opener, pause_s, sleep
        self._robots: dict[str, RobotFileParser] = {}
        self._asked: set[str] = set()

    def _ask(self, url: str, headers: dict[str, str], method: str = "GET"):
        host = urlsplit(url).netloc.lower()
        if host in self._asked:
            self.sleep(self.pause)
        self._asked.add(host)
        return self.open(url, headers, method)

    def robots(self, url: str) -> RobotFileParser:
        """The rules of a URL's site; whatever keeps them from being read, an internal address too, allows everything."""
        root = f"{urlsplit(url).scheme}://{urlsplit(url).netloc}"
        if root not in self._robots:
            rules = self._robots[root] = RobotFileParser(root + "/robots.txt")
            try:
                with self._ask(root + "/robots.txt", {"User-Agent": AGENT}) as r:
                    rules.parse(r.read().decode("utf-8", "replace").splitlines())
            except OSError:
                rules.allow_all = True
        return self._robots[root]

    def get(self, url: str, known: dict[str, str] | None = None, probe_only: bool = False) -> tuple:
        """(final URL, status, content type, body, ETag, Last-Modified, error) of a URL; known: the validators of what is there."""
        if internal_host(url):
            return (url, None, None, None, None, None, "internal address")
        if not self.robots(url).can_fetch(AGENT, url):
            return (url, None, None, None, None, None, ROBOTS)
        if probe_only:
            status, error = probe(url, self._ask)
            return (url, status, None, None, None, None, error)
        known = known or {}
        headers = {"User-Agent": AGENT} | ({"If-None-Match": known["etag"]} if known.get("etag") else {}) | ({"If-Modified-Since": known["last_modified"]} if known.get("last_modified") else {})
        status, error = None, None
        for attempt in range(1, RETRIES + 1):
            try:
                with self._ask(url, headers) as r:
                    return (r.url, r.status, r.headers.get("Content-Type"), r.read(), r.headers.get("ETag"), r.headers.get("Last-Modified"), None)
            except urllib.error.HTTPError as e:
                status, error = e.code, str(e)
                if status == 304:
                    return (url, 304, None, None, known.get("etag"), known.get("last_modified"), None)
            except Refused as e:
                return (url, None, None, None, None, None, str(e))
            except OSError as e:
                status, error = None, str(e)
            if not retryable(status) or attempt == RETRIES:
                break
            self.sleep(backoff(attempt))
        return (url, status, None, None, None, None, error)


#: What pages are read as, and the error of one that a run had no time for.
FETCHED = "id string, url string, final_url string, status int, content_type string, body binary, etag string, last_modified string, error string"
LATE = "no time left in this run"


def read_pages(asked: DataFrame, opener=open_url, budget_s: float = BUDGET_S, hosts_at_once: int = HOSTS_AT_ONCE, pause_s: float = DELAY_S, clock=time.monotonic) -> DataFrame:
    """Pages (id, canonical_url and, where known, etag and last_modified), each asked for once, in the schema FETCHED.

    A host's pages are read one after another in one task, and at most hosts_at_once tasks read. A task stops asking once budget_s
    seconds have passed since it began; pages that are left get a row that says so, and wait for the next run. No failure of
    a page is an error of the job.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        began, polite = clock(), Polite(opener, pause_s)
        for part in batches:
            rows = []
            for r in part.itertuples(index=False):
                known = {"etag": r.etag, "last_modified": r.last_modified}
                got = (r.canonical_url, None, None, None, None, None, LATE) if clock() - began >= budget_s else polite.get(r.canonical_url, known)
                rows.append((r.id, r.canonical_url, *got))
            out = pd.DataFrame(rows, columns=[c.split(" ")[0] for c in FETCHED.split(", ")])
            yield out.astype({"status": "Int32"})

    given = [F.col(c) if c in asked.columns else F.lit(None).cast("string").alias(c) for c in ("etag", "last_modified")]
    hosts = asked.select("id", "canonical_url", *given, host_of(F.col("canonical_url")).alias("host")).repartition(hosts_at_once, "host").sortWithinPartitions("host", "id")
    return hosts.drop("host").mapInPandas(run, FETCHED)


class PoliteReader(DataSourceReader):
    """Requests to one host come one after another, with a pause between them; at most `hosts_at_once` partitions, so as
    many hosts are asked at the same time. With probe=true, pages are only tested for being there."""

    def __init__(self, options):
        self.sources = json.loads(options.get("sources", "[]"))  # [[source_id, url], ...]
        self.validators = json.loads(options.get("validators", "{}"))  # url: {etag, last_modified}
        self.pause = float(options.get("pause_s", DELAY_S))
        self.allowed = options.get("allow_network", "false") == "true"
        self.probe = options.get("probe", "false") == "true"
        self.at_once = int(options.get("hosts_at_once", HOSTS_AT_ONCE))

    def partitions(self):
        groups = by_host([url for _, url in self.sources])
        ids = {url: source for source, url in self.sources}
        hosts = [[(ids[u], u) for u in urls] for _, urls in sorted(groups.items(), key=lambda g: (-len(g[1]), g[0]))]
        return [_Hosts(hosts[k :: self.at_once]) for k in range(min(self.at_once, len(hosts)))]

    def read(self, partition: _Hosts) -> Iterator[tuple]:
        polite = Polite(pause_s=self.pause)
        for urls in partition.hosts:
            for source, url in urls:
                if self.allowed:
                    yield (source, url, *polite.get(url, self.validators.get(url), self.probe))
                else:
                    yield (source, url, url, None, None, None, None, None, "network access is off")


class PoliteSource(DataSource):
    """spark.read.format("polite_http") after spark.dataSource.register(PoliteSource). Off unless allow_network is true."""

    @classmethod
    def name(cls) -> str:
        return "polite_http"

    def schema(self) -> str:
        return "source_id string, url string, final_url string, status int, content_type string, body binary, etag string, last_modified string, error string"

    def reader(self, schema) -> DataSourceReader:
        return PoliteReader(self.options)


def reached(probed: DataFrame) -> DataFrame:
    """Rows of a probe as the gate takes them: source_url, ok, status, robots_disallowed."""
    return probed.select(
        F.col("url").alias("source_url"), F.coalesce(F.col("status").between(200, 399), F.lit(False)).alias("ok"), "status",
        F.coalesce(F.col("error") == ROBOTS, F.lit(False)).alias("robots_disallowed"),
    )
