"""Canonical URLs and item identities."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, quote_plus, unquote, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Parameters that do not change what a URL names, and the ports that go without saying.
TRACKING_PREFIX = "utm_"
TRACKING = ("fbclid", "gclid", "yclid", "_ga", "mc_cid", "mc_eid")
DEFAULT_PORTS = ("80", "443")
ID_LENGTH = 40

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """The canonical form of an absolute ASCII http(s) URL without escapes or dot segments, inside code generation.

    http becomes https, the host is lowered and loses a trailing dot and a default port, tracking parameters go, the
    rest are sorted by key (equal keys in their order), and fragment, trailing and doubled slashes go. Other schemes
    only lose the fragment; what is no URL is null. `canonical_url_general` takes all URLs.
    """
    part = lambda k: F.regexp_extract(url, _PARTS, k)
    web = F.lower(part(1)).isin("http", "https")
    user = F.regexp_extract(part(2), r"^(.*@)", 1)
    host = F.lower(F.regexp_replace(part(2), r"^.*@", ""))
    host = F.regexp_replace(host, rf":({'|'.join(DEFAULT_PORTS)})?$", "")
    host = F.regexp_replace(host, r"\.(:|$)", "$1")
    key = lambda p: F.substring_index(p, "=", 1)
    kept = F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~F.lower(key(p)).startswith(TRACKING_PREFIX) & ~F.lower(key(p)).isin(*TRACKING))
    pair = lambda p: F.when(p.contains("="), p).otherwise(F.concat(p, F.lit("=")))
    ordered = F.array_sort(F.transform(kept, lambda p, k: F.struct(key(p).alias("key"), k.alias("at"), pair(p).alias("pair"))))
    query = F.array_join(F.transform(ordered, lambda s: s["pair"]), "&")
    path = F.when(part(3) == "/", "/").otherwise(F.regexp_replace(part(3), r"/+$", ""))
    path = F.regexp_replace(path, r"/{2,}", "/")
    path = F.when(path == "", "/").otherwise(path)
    whole = F.concat(F.lit("https://"), user, host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(web & (host != ""), whole).when(~web & url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.regexp_replace(url, r"#.*$", ""))


_SAFE_PATH = "/:@!$&'()*+,;=~%-._|^[]"


def _is_tracking(key: str) -> bool:
    return key.lower().startswith(TRACKING_PREFIX) or key.lower() in TRACKING


def canonicalise(raw: str | None, base: str | None = None) -> str | None:
    """The canonical form of any URL, against a base if it is relative; null if it can't be read as one."""
    if raw is None:
        return None
    raw = re.sub(r"[\t\n\r]", "", raw.strip())
    try:
        whole = urljoin(base, raw) if base else raw
        u = urlsplit(whole)
        port = u.port
    except ValueError:
        return None
    scheme = u.scheme.lower()
    if not scheme:
        return None
    if scheme not in ("http", "https"):
        return whole.split("#", 1)[0]
    try:
        host = (u.hostname or "").rstrip(".") if (u.hostname or "").endswith(".") and not (u.hostname or "").endswith("..") else (u.hostname or "")
        host = unquote(host).lower()
        host = host if host.isascii() else host.encode("idna").decode()
    except UnicodeError:
        return None
    if not host or re.search(r"[\s<>\\^|%#?/@]", host):
        return None
    if ":" in host:
        host = f"[{host}]"
    pairs = sorted(((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if not _is_tracking(k)), key=lambda p: p[0])
    query = "&".join(f"{quote_plus(k, safe='*-._')}={quote_plus(v, safe='*-._')}" for k, v in pairs).replace("~", "%7E")
    path = quote(_without_dots(u.path.replace("\\", "/")), safe=_SAFE_PATH) or "/"
    if path != "/":
        path = path.rstrip("/")
    path = re.sub(r"/{2,}", "/", path) or "/"
    user = f"{u.username}{':' + u.password if u.password else ''}@" if u.username else ""
    where = f"{host}:{port}" if port is not None and str(port) not in DEFAULT_PORTS else host
    return f"https://{user}{where}{path}{'?' + query if query else ''}"


def _without_dots(path: str) -> str:
    out: list[str] = []
    parts = path.split("/")
    for k, p in enumerate(parts):
        last = k == len(parts) - 1
        if p.lower() in (".", "%2e"):
            if last:
                out.append("")
        elif p.lower() in ("..", ".%2e", "%2e.", "%2e%2e"):
            if len(out) > 1:
                out.pop()
            if last:
                out.append("")
        else:
            out.append(p)
    return "/".join(out)


@F.pandas_udf(StringType())
def canonical_url_general(url: pd.Series, base: pd.Series) -> pd.Series:
    """`canonicalise` in Arrow batches, for URLs with escapes, dot segments, international names or a base."""
    return pd.Series([canonicalise(u, b) for u, b in zip(url, base, strict=True)], dtype="object")


def item_id(canonical: Column) -> Column:
    """The key of an item: the first 40 hex digits of its canonical URL's SHA-256."""
    return F.left(F.sha2(canonical.cast("binary"), 256), F.lit(ID_LENGTH))


def host_of(url: Column) -> Column:
    """The lower-case host, an IPv6 address in its brackets; empty where the string is no URL."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1))


def is_http(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^(?i)https?://[^/?#\s]+"), F.lit(False))


def allowed(url: Column, include: Column, exclude: Column) -> Column:
    """Whether a URL holds any include substring (if the list has entries) and no exclude substring. Empty patterns
    never match, so an include list of empty strings alone refuses all."""
    hit = lambda patterns: F.exists(F.filter(patterns, lambda x: x != ""), lambda x: F.contains(url, x))
    return ((F.size(include) == 0) | hit(include)) & ~hit(exclude)


#: Names and address ranges that are not fetched.
INTERNAL = r"^(localhost|.*\.localhost|.*\.local|.*\.internal|0\.[0-9.]+|10\.[0-9.]+|127\.[0-9.]+|169\.254\.[0-9.]+|192\.168\.[0-9.]+|172\.(1[6-9]|2[0-9]|3[01])\.[0-9.]+|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])\.[0-9.]+|\[::1?\]|\[(fc|fd|fe80)[0-9a-f:%.a-z]*\]|\[::ffff:.*\])$"


def is_internal(url: Column) -> Column:
    """Whether a URL names a loopback, link-local, shared or private host; names are not looked up."""
    return host_of(url).rlike(INTERNAL)


def internal_host(url: str) -> bool:
    """`is_internal` for one URL, on the worker that is about to fetch it."""
    try:
        host = (urlsplit(url).hostname or "").rstrip(".").lower()
    except ValueError:
        return True
    return re.match(INTERNAL, f"[{host}]" if ":" in host else host) is not None


def title_from_url(url: Column) -> Column:
    """The last path segment, decoded (a plus sign stays), or else the host."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    last = F.element_at(F.filter(F.split(path, "/"), lambda p: p != ""), -1)
    decoded = F.try_url_decode(F.regexp_replace(last, r"\+", "%2B"))
    return F.coalesce(F.when(decoded != "", decoded), last, host_of(url))
