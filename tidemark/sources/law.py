"""Law revisions from an API whose payload, JSON or XML, has no fixed shape.

A payload is flattened to its nodes and its scalar values, each with the nodes that enclose it. What a node holds of a field
is the first value of a fitting key below it, and of dates the one of the best key; both are minima by node. Records are the
innermost objects that hold enough.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import UTC, date, datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fetch

LAW_URL = "https://laws.e-gov.go.jp/law/"
MAX_DEPTH, MAX_RECORDS = 12, 500
#: Keys, folded to letters and digits, that carry a record's fields; dates by priority.
ID_KEYS, NUMBER_KEYS = ("lawid",), ("lawnum", "lawno", "lawnumber")
NAME_KEYS, WEAK_NAME_KEYS = ("lawname", "lawtitle", "lawfullname"), ("title", "name")
DATE_KEYS = ("promulgationdate", "amendmentdate", "updated", "date")
#: The text of an XML element that has attributes or children too.
TEXT = "#text"

NODE = pa.struct([("node", pa.int32()), ("parent", pa.int32()), ("object", pa.bool_())])
VALUE = pa.struct([("at", pa.int32()), ("nodes", pa.list_(pa.int32())), ("key", pa.string()), ("value", pa.string()), ("day", pa.timestamp("us"))])


def _plain(element: ET.Element):
    """An element as text, or as a mapping where it has attributes or children; tags that repeat become lists."""
    text = (element.text or "").strip()
    if not len(element) and not element.attrib:
        return text
    out: dict = dict(element.attrib) | ({TEXT: text} if text else {})
    for child in element:
        out.setdefault(child.tag.rsplit("}", 1)[-1], []).append(_plain(child))
    return {k: v[0] if isinstance(v, list) and len(v) == 1 else v for k, v in out.items()}


def parse_payload(raw: str):
    """The payload as JSON, or else as XML; null where it is neither."""
    raw = raw.strip()
    try:
        return json.loads(raw)
    except (ValueError, RecursionError):
        pass
    try:
        root = ET.fromstring(re.sub(r"^<\?xml[^>]*\?>", "", raw).strip().encode())
        return {root.tag.rsplit("}", 1)[-1]: _plain(root)}
    except (ET.ParseError, ValueError, RecursionError):
        return None


def law_date(raw: str) -> datetime | None:
    """A day, which begins at midnight nine hours ahead of UTC, or an instant; in UTC without a zone."""
    m = re.fullmatch(r"(\d{4})([-/]?)(\d{1,2})\2(\d{1,2})", raw) if re.fullmatch(r"\d{8}|\d{4}[-/]\d{1,2}[-/]\d{1,2}", raw) else None
    try:
        if re.fullmatch(r"\d{8}", raw):
            day = date(int(raw[:4]), int(raw[4:6]), int(raw[6:]))
        elif m:
            day = date(int(m[1]), int(m[3]), int(m[4]))
        else:
            t = datetime.fromisoformat(raw.replace("Z", "+00:00"))
            return (t if t.tzinfo else t.replace(tzinfo=UTC)).astimezone(UTC).replace(tzinfo=None)
        return datetime(day.year, day.month, day.day, tzinfo=timezone(timedelta(hours=9))).astimezone(UTC).replace(tzinfo=None)
    except (ValueError, OverflowError):
        return None


def flatten(payload) -> tuple[list[tuple], list[tuple]]:
    """(nodes, values): (node, parent, object) of all lists and mappings down to MAX_DEPTH, in reading order, and (at, nodes,
    folded key, text, day) of all scalars of mappings, a mapping's own before what is below it."""
    nodes: list[tuple] = []
    values: list[tuple] = []
    stack: list[tuple] = [(payload, -1, ())]
    while stack:
        here, parent, above = stack.pop()
        inside = (*above, len(nodes))
        nodes.append((len(nodes), parent, isinstance(here, dict)))
        if isinstance(here, dict):
            for key, value in here.items():
                if isinstance(value, dict):
                    value = value.get(TEXT)
                if isinstance(value, (str, int, float)) and not isinstance(value, bool) and (text := str(value).strip()):
                    folded = re.sub("[^a-z0-9]", "", key.lower())
                    values.append((len(values), list(inside), folded, text, law_date(text) if "date" in folded else None))
        below = [x for x in (here.values() if isinstance(here, dict) else here) if isinstance(x, (dict, list))]
        if len(inside) <= MAX_DEPTH:
            stack += [(x, inside[-1], inside) for x in reversed(below)]
    return nodes, values


def _rank(key: Column) -> Column:
    known = [F.when(key == k, r) for r, k in enumerate(DATE_KEYS)]
    return F.coalesce(*known, F.when(key.contains("date"), len(DATE_KEYS)))


def records(payloads: DataFrame, now: datetime) -> DataFrame:
    """(source_id, ord, url, title, published_at) of payloads (source_id, body, content_type, lookback_days): revisions of the
    last days; undated ones stay; of one URL the first. Records have an id and a name; where a payload has none of these, a
    name; where it has none of those either, an id. Payloads that can't be read have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = []
            for body, kind in zip(batch.column("body").to_pylist(), batch.column("content_type").to_pylist(), strict=True):
                payload = parse_payload(fetch.decode(body or b"", kind or "") or (body or b"").decode("utf-8", "replace"))
                flat.append(flatten(payload) if isinstance(payload, (dict, list)) else ([], []))
            struct = lambda rows, kind: [dict(zip((f.name for f in kind), r, strict=True)) for r in rows]
            yield pa.RecordBatch.from_arrays(
                [batch.column("source_id"), batch.column("lookback_days"), pa.array([struct(n, NODE) for n, _ in flat], pa.list_(NODE)), pa.array([struct(v, VALUE) for _, v in flat], pa.list_(VALUE))],
                ["source_id", "lookback_days", "nodes", "values"],
            )

    schema = "source_id string, lookback_days int, nodes array<struct<node: int, parent: int, object: boolean>>, `values` array<struct<at: int, nodes: array<int>, key: string, value: string, day: timestamp_ntz>>"
    flat = payloads.select("source_id", "lookback_days", "body", "content_type").mapInArrow(run, schema)
    values = flat.select("source_id", F.explode("values").alias("v")).select("source_id", F.explode("v.nodes").alias("node"), "v.at", "v.key", "v.value", "v.day")
    key = F.col("key")
    first = lambda keys: F.min(F.when(key.isin(*keys), F.struct("at", "value")))["value"]
    best = F.min(F.when(_rank(key).isNotNull(), F.struct(_rank(key).alias("rank"), "at", "value", "day")))
    fields = values.groupBy("source_id", "node").agg(first(ID_KEYS).alias("law_id"), first(NUMBER_KEYS).alias("number"), first(NAME_KEYS).alias("name"), first(WEAK_NAME_KEYS).alias("weak_name"), best["day"].alias("published_at"))
    nodes = flat.select("source_id", "lookback_days", F.explode("nodes").alias("n")).select("source_id", "lookback_days", "n.*").join(fields, ["source_id", "node"])
    law, name = F.col("law_id").isNotNull(), F.col("name").isNotNull()
    enough = {"both": law & (name | F.col("weak_name").isNotNull()), "named": name, "numbered": law}
    nodes = nodes.withColumns(enough)
    inner = nodes.groupBy("source_id", F.col("parent").alias("node")).agg(*(F.max(k).alias(f"{k}_below") for k in enough))
    nodes = nodes.join(inner, ["source_id", "node"], "left")
    nodes = nodes.withColumns({k: F.col("object") & F.col(k) & ~F.coalesce(F.col(f"{k}_below"), F.lit(False)) for k in enough})
    by_source = W.partitionBy("source_id")
    has = [F.max(k).over(by_source) for k in enough]
    both, named, numbered = (F.col(k) for k in enough)
    found = nodes.where(F.col("both") | F.col("named") | F.col("numbered")).withColumn("taken", F.when(has[0], both).when(has[1], named).otherwise(numbered)).where("taken")
    found = found.withColumn("turn", F.row_number().over(by_source.orderBy("node"))).where((F.col("turn") <= MAX_RECORDS) & law)
    since = F.lit(str(now.astimezone(UTC).replace(tzinfo=None) if now.tzinfo else now)).cast("timestamp_ntz") - F.make_dt_interval(F.col("lookback_days"))
    found = found.where(F.col("published_at").isNull() | (F.col("published_at") >= since)).withColumn("url", F.concat(F.lit(LAW_URL), "law_id"))
    found = found.withColumn("again", F.row_number().over(W.partitionBy("source_id", "url").orderBy("node"))).where("again = 1")
    place = (F.row_number().over(by_source.orderBy("node")) - 1).cast("int")
    return found.select("source_id", place.alias("ord"), "url", F.coalesce("name", "weak_name", "number", "law_id").alias("title"), "published_at")
