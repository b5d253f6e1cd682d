"""Feeds: RSS 2.0, Atom, RDF and what resembles them."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from datetime import UTC, datetime, timedelta, timezone
from email.utils import parsedate_to_datetime
from urllib.parse import unquote, urljoin, urlsplit

from ..functions.text import decode_entities
from .html import collapse

LOCAL = timezone(timedelta(hours=9))
MAX_DEPTH = 6
#: Date elements, the best first.
DATE_NAMES = ("pubdate", "date", "published", "updated", "issued", "modified")
_RDF = "{http://www.w3.org/1999/02/22-rdf-syntax-ns#}"


def _local(tag) -> str:
    return tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""


def _text(node: ET.Element | None) -> str:
    return "" if node is None else collapse(decode_entities("".join(node.itertext())))


def _named(node: ET.Element, *names: str) -> list[ET.Element]:
    return [c for name in names for c in node if _local(c.tag) == name]


def _entries(root: ET.Element) -> list[ET.Element]:
    """Entry elements: by the format's own place, or else the first group of items found on the way down."""
    kind = _local(root.tag)
    if kind == "rss":
        found = [i for ch in _named(root, "channel") for i in _named(ch, "item")] + _named(root, "item")
    elif kind == "feed":
        found = _named(root, "entry")
    elif kind == "rdf":
        found = _named(root, "item") + [i for ch in _named(root, "channel") for i in _named(ch, "item")]
    else:
        found = []
    level = [root]
    for _ in range(MAX_DEPTH + 1):
        if found:
            return found
        for node in level:
            if found := _named(node, "item") or _named(node, "entry"):
                return found
        level = [c for node in level for c in node]
    return found


def _link(entry: ET.Element) -> str:
    links = _named(entry, "link")
    hrefs = [(x.get("rel", "").lower(), x.get("href", "").strip()) for x in links if x.get("href", "").strip()]
    for rel, href in hrefs:
        if rel in ("", "alternate"):
            return decode_entities(href)
    if hrefs:
        return decode_entities(hrefs[0][1])
    for x in [*links, *_named(entry, "url")]:
        if t := _text(x):
            return t
    about = entry.get(f"{_RDF}about") or entry.get("about") or ""
    if about.strip():
        return about.strip()
    for x in _named(entry, "guid"):
        if x.get("isPermaLink", "").lower() != "false" and re.match(r"https?://", _text(x), re.I):
            return _text(x)
    return next((t for x in _named(entry, "id") if re.match(r"https?://", t := _text(x), re.I)), "")


def parse_date(raw: str) -> datetime | None:
    """An instant of RFC 822, ISO 8601, or a wall clock without a zone, which is nine hours ahead of UTC."""
    raw = raw.strip()
    m = re.fullmatch(r"(\d{4})-(\d{2})-(\d{2})(?:[ T](\d{2}):(\d{2}))?", raw)
    try:
        if m:
            y, mo, d, h, mi = (int(x or 0) for x in m.groups())
            return datetime(y, mo, d, h, mi, tzinfo=LOCAL).astimezone(UTC)
        if re.match(r"\d{4}-\d{2}-\d{2}", raw):
            t = datetime.fromisoformat(raw.replace("Z", "+00:00"))
        else:
            t = parsedate_to_datetime(raw)
        return (t if t.tzinfo else t.replace(tzinfo=UTC)).astimezone(UTC)
    except (ValueError, TypeError, IndexError):
        return None


def title_from_url(url: str) -> str:
    parts = [p for p in urlsplit(url).path.split("/") if p]
    return unquote(parts[-1]) if parts else urlsplit(url).netloc.lower()


def read(xml: str, base: str) -> list[dict]:
    """Rows (ord, url, title, published_at) of a feed, the first of each URL; none for what is no feed."""
    try:
        root = ET.fromstring(xml.strip().encode() if "encoding=" not in xml[:200] else re.sub(r"<\?xml[^>]*\?>", "", xml, count=1).strip().encode())
    except (ET.ParseError, ValueError):
        return []
    out, seen = [], set()
    for entry in _entries(root):
        try:
            url = urljoin(base, _link(entry))
        except ValueError:
            continue
        if not _link(entry) or not re.match(r"https?://[^/\s]", url, re.I) or url in seen:
            continue
        seen.add(url)
        title = next((t for x in _named(entry, "title") if (t := _text(x))), "") or title_from_url(url)
        dates = (parse_date(t) for name in DATE_NAMES for x in _named(entry, name) if (t := _text(x)))
        out.append({"ord": len(out), "url": url, "title": title, "published_at": next((d for d in dates if d), None)})
    return out
