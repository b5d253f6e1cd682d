"""Payloads that the readers take, one for each document, page or order, built by rules that SQL can follow."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import urls
from ..operators import delivery, message, model
from ..sources import listing
from . import standins as si
from .registry import query

NOW = datetime(2026, 9, 13)

_TITLE = "trim(regexp_replace(left(text, 40), '[^A-Za-z]+', ' ', 'g'))"
_DAY = "(DATE '2026-01-01' + CAST(doc_id % 300 AS INTEGER))"


def _documents(spark, sf_dir: str) -> DataFrame:
    """Documents with k (the id as text), title (letters of the text's first 40 characters) and day."""
    title = F.trim(F.regexp_replace(F.left("text", F.lit(40)), "[^A-Za-z]+", " "))
    day = F.date_add(F.lit("2026-01-01").cast("date"), (F.col("doc_id") % 300).cast("int"))
    return si.table(spark, sf_dir, "documents").select("doc_id", "text", F.col("doc_id").cast("string").alias("k"), title.alias("title"), day.alias("day"))


def _fill(pattern: str, **values: Column) -> Column:
    """A pattern with {name} replaced by columns."""
    parts, rest = [], pattern
    while rest:
        before, _, rest = rest.partition("{")
        parts.append(F.lit(before))
        if rest:
            name, _, rest = rest.partition("}")
            parts.append(values[name])
    return F.concat(*parts)


def _chosen(key: Column, options: list[Column]) -> Column:
    """The option of a key's remainder."""
    out = None
    for n, option in enumerate(options):
        hit = F.pmod(key, F.lit(len(options))) == n
        out = F.when(hit, option) if out is None else out.when(hit, option)
    return out


def _snapshots(rows: DataFrame, kind: str, body: Column, selector: str | None = None, date: str | None = None, exclude: list[str] = ()) -> DataFrame:
    s = lambda x: F.lit(x).cast("string")
    return rows.select(
        F.col("k").alias("source_id"), s(kind).alias("kind"), s("https://s.example/list/").alias("url"), s(None).alias("final_url"), F.lit(200).alias("status"), s("text/html; charset=utf-8").alias("content_type"), F.encode(body, "UTF-8").alias("body"),
        s(selector).alias("item_selector"), s(date).alias("date_selector"), s(None).alias("title_from"), F.array().cast("array<string>").alias("include"), F.array(*map(F.lit, exclude)).cast("array<string>").alias("exclude"), F.lit(30).alias("lookback_days"),
    )


def _shown(found: DataFrame) -> DataFrame:
    return found.select("source_id", "ord", "url", "title", F.date_format("published_at", "yyyy-MM-dd HH:mm").alias("published_at"))


_RSS = """<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><item><title><![CDATA[{title} &amp; more]]></title><link>/news/{k}</link><pubDate>{rfc} 18:30:00 +0900</pubDate></item>
<item><title></title><guid isPermaLink="false">none</guid><link>https://s.example/a%20{k}</link><pubDate>soon</pubDate></item><item><title>again</title><link>/news/{k}</link></item><item><title>mail</title><link>mailto:x@y.z</link></item></channel></rss>"""
_ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>first {title}</title><link rel="edit" href="/edit"/><link rel="alternate" href="/one/{k}"/><updated>2026-09-12T00:00:00Z</updated><published>{day}T12:00:00+09:00</published></entry>
<entry><title>second</title><link href="two/{k}"/><updated>{day}</updated></entry></feed>"""
_RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><item rdf:about="https://s.example/r/{k}"><title>r &amp;lt; {title}</title><dc:date>{day} 08:15</dc:date></item></rdf:RDF>"""
_UPPER = """<LIST><ITEM area="x"><TITLE>upper {title}</TITLE><URL>https://s.example/u/{k}</URL><DATE>{day} 10:30</DATE></ITEM></LIST>"""


@query(f"""WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, {_TITLE} AS t, {_DAY} AS day FROM documents),
    r AS (SELECT k, 0 AS ord, '/news/' || k AS path, trim(t || ' & more') AS title, strftime(day, '%Y-%m-%d 09:30') AS day_at FROM d WHERE doc_id % 5 = 0 UNION ALL SELECT k, 1, '/a%20' || k, 'a ' || k, NULL FROM d WHERE doc_id % 5 = 0
    UNION ALL SELECT k, 0, '/one/' || k, trim('first ' || t), strftime(day, '%Y-%m-%d 03:00') FROM d WHERE doc_id % 5 = 1 UNION ALL SELECT k, 1, '/list/two/' || k, 'second', strftime(day - 1, '%Y-%m-%d 15:00') FROM d WHERE doc_id % 5 = 1
    UNION ALL SELECT k, 0, '/r/' || k, trim('r < ' || t), strftime(day - 1, '%Y-%m-%d 23:15') FROM d WHERE doc_id % 5 = 2 UNION ALL SELECT k, 0, '/u/' || k, trim('upper ' || t), strftime(day, '%Y-%m-%d 01:30') FROM d WHERE doc_id % 5 = 3)
    SELECT k AS source_id, CAST(ord AS INTEGER) AS ord, 'https://s.example' || path AS url, title, day_at AS published_at FROM r""")
def feed_entries(spark, sf_dir):
    """Feeds of four formats, and one cut short, each of a document's letters."""
    d = _documents(spark, sf_dir)
    values = {"k": F.col("k"), "title": F.col("title"), "day": F.col("day").cast("string"), "rfc": F.date_format("day", "EEE, dd MMM yyyy")}
    bodies = [_fill(p, **values) for p in (_RSS, _ATOM, _RDF, _UPPER)]
    body = _chosen(F.col("doc_id"), [*bodies, F.left(bodies[0], F.lit(200))])
    return _shown(listing.candidates(_snapshots(d, "feed", body), NOW))


_LIST = """<html><head><base href="/n/"></head><body><nav><a href="/x">x</a></nav><div id="top"><ul class="news list"><li><span class="date">{first}</span><a href="{k}.html" title="T1">One {title} <b>two</b></a>
<li><span class="date">2026/4/2</span><a href="javascript:void(0)">bad</a><li><a href="{k}.html">again</a><li><div><span class="date">{second}</span></div><div><a href="https://other.example/{k}"><img alt="Picture {k}"></a></div><li><a href="skip.html">skip</a></ul></div></body></html>"""


@query(f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS k, {_TITLE} AS t, {_DAY} AS day FROM documents)
    SELECT k AS source_id, CAST(0 AS INTEGER) AS ord, 'https://s.example/n/' || k || '.html' AS url, CASE WHEN t = '' THEN 'One two' ELSE 'One ' || t || ' two' END AS title, strftime(day - 1, '%Y-%m-%d 15:00') AS published_at FROM d
    UNION ALL SELECT k, 1, 'https://other.example/' || k, 'Picture ' || k, strftime(day, '%Y-%m-%d 15:00') FROM d""")
def listing_entries(spark, sf_dir):
    """Listing pages, one of each document: nested titles, dates in three forms, a base, repeated, refused and excluded links."""
    d = _documents(spark, sf_dir)
    era = F.concat(F.lit("令和8年"), F.month("day").cast("string"), F.lit("月"), F.day("day").cast("string"), F.lit("日"))
    first = _chosen(F.col("doc_id"), [F.date_format("day", "yyyy'年'M'月'd'日'"), F.date_format("day", "yyyy/M/d"), era])
    body = _fill(_LIST, k=F.col("k"), title=F.col("title"), first=first, second=F.date_format(F.date_add("day", 1), "yyyy'年'M'月'd'日'"))
    return _shown(listing.candidates(_snapshots(d, "html", body, "#top ul.news li", ".date", ["skip"]), NOW))


_LAW = "https://laws.e-gov.go.jp/law/"
_LAWS = (
    """{"total": 2, "laws": [{"law_info": {"law_id": "A{k}", "law_num": "No. 1"}, "revision_info": {"law_title": "Act {title}", "amendment_date": "{new}"}}, {"lawId": "M{k}", "lawName": "Old", "promulgationDate": "{old}"}, {"LawId": "N{k}", "title": "Third", "updated": "{plain}"}, {"lawId": "N{k}", "title": "again"}]}""",
    """<r><law><LawId type="x">B{k}</LawId><LawName lang="ja">Act {title}</LawName><Date>{plain}</Date></law><law><LawId>C{k}</LawId><LawName>Three</LawName></law><law><LawId>O{k}</LawId><LawName>Old</LawName><Date>{old}</Date></law></r>""",
    """[{"law_id": "D{k}", "law_no": "No. {k}"}]""",
    """{"laws": [{"law_id": "{k}\"""",
)


@query(f"""WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, trim('Act ' || {_TITLE}) AS t, DATE '2026-09-01' + CAST(doc_id % 10 AS INTEGER) - 1 AS day FROM documents),
    r AS (SELECT k, 0 AS ord, 'A' || k AS id, t AS title, day FROM d WHERE doc_id % 4 = 0 UNION ALL SELECT k, 1, 'N' || k, 'Third', day FROM d WHERE doc_id % 4 = 0
    UNION ALL SELECT k, 0, 'B' || k, t, day FROM d WHERE doc_id % 4 = 1 UNION ALL SELECT k, 1, 'C' || k, 'Three', NULL FROM d WHERE doc_id % 4 = 1 UNION ALL SELECT k, 0, 'D' || k, 'No. ' || k, NULL FROM d WHERE doc_id % 4 = 2)
    SELECT k AS source_id, CAST(ord AS INTEGER) AS ord, '{_LAW}' || id AS url, title, strftime(day, '%Y-%m-%d 15:00') AS published_at FROM r""")
def law_revisions(spark, sf_dir):
    """Payloads of law APIs in JSON and XML, of other names and shapes, with records too old and repeated ones, and one cut short."""
    d = _documents(spark, sf_dir)
    new = F.date_add(F.lit("2026-09-01").cast("date"), (F.col("doc_id") % 10).cast("int"))
    values = {"k": F.col("k"), "title": F.col("title"), "new": new.cast("string"), "plain": F.date_format(new, "yyyyMMdd"), "old": F.date_format(F.date_sub(new, 400), "yyyy-MM-dd")}

    def filled(pattern: str) -> Column:
        parts = [F.lit(pattern)]
        for name, value in values.items():
            parts = [F.replace(parts[0], F.lit("{" + name + "}"), value)]
        return parts[0]

    return _shown(listing.candidates(_snapshots(d, "law", _chosen(F.col("doc_id"), [filled(p) for p in _LAWS])), NOW))


_LATIN = "regexp_replace(text, '[^ -~\\x{A1}-\\x{FF}]', '?', 'g')"


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS url, CASE doc_id % 5 WHEN 0 THEN {_LATIN} WHEN 1 THEN '<meta charset="iso-8859-1">' || {_LATIN} WHEN 2 THEN '<?xml version="1.0" encoding="ISO-8859-1"?>' || {_LATIN} WHEN 3 THEN text ELSE '' END AS text FROM documents""")
def charsets_decoded(spark, sf_dir):
    """Texts in Latin-1, as header, meta tag or XML declaration say, in UTF-8 without a word, and as an image."""
    latin = F.regexp_replace("text", "[^ -~¡-ÿ]", "?")
    one = lambda before: F.encode(F.concat(F.lit(before), latin), "ISO-8859-1")
    body = _chosen(F.col("doc_id"), [one(""), one('<meta charset="iso-8859-1">'), one('<?xml version="1.0" encoding="ISO-8859-1"?>'), F.encode("text", "UTF-8"), F.encode("text", "UTF-8")])
    kind = _chosen(F.col("doc_id"), [F.lit(x) for x in ("text/plain; charset=iso-8859-1", "text/html", "text/xml", "", "image/png")])
    return listing.decoded(_documents(spark, sf_dir).select(F.col("k").alias("url"), kind.alias("content_type"), body.alias("body")))


_SPACES = "[\\t\\n\\x0B\\f\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"
_ONE_LINE = f"trim(regexp_replace(text, '{_SPACES}', ' ', 'g'))"
_ARTICLE = """<html><head><title>Title {k}</title></head><body><nav>menu <a href="/x">x</a></nav><div class="sidebar"><a href="/y">{k}</a></div><article class="story"><p>{text}</p><script>x()</script></article><footer>{k}</footer></body></html>"""


@query(f"""SELECT CAST(doc_id AS VARCHAR) AS url, CASE doc_id % 4 WHEN 2 THEN 'pdf' WHEN 3 THEN 'text' ELSE 'html' END AS kind, CASE WHEN doc_id % 4 < 2 THEN 'Title ' || CAST(doc_id AS VARCHAR) ELSE '' END AS title,
    CASE WHEN doc_id % 4 = 2 THEN '' WHEN doc_id % 4 = 3 OR length(regexp_replace(text, '\\s', '', 'g')) >= 25 AND length({_ONE_LINE}) >= 40 THEN {_ONE_LINE} ELSE trim(CAST(doc_id AS VARCHAR) || {_ONE_LINE}) END AS text FROM documents""")
def main_text_extracted(spark, sf_dir):
    """Documents as articles among navigation, side bars and scripts, as PDF and as plain text. A text too short to be told
    from its surroundings comes with the side bar's."""
    safe = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.encode(_fill(_ARTICLE, k=F.col("k"), text=safe), "UTF-8")
    body = _chosen(F.col("doc_id"), [page, page, F.encode(F.concat(F.lit("%PDF-1.7 "), "text"), "UTF-8"), F.encode("text", "UTF-8")])
    kind = _chosen(F.col("doc_id"), [F.lit(x) for x in ("text/html; charset=utf-8", "", "text/html", "text/plain; charset=utf-8")])
    return listing.extracted(_documents(spark, sf_dir).select(F.col("k").alias("url"), kind.alias("content_type"), body.alias("body"))).select("url", "kind", "title", "text")


_SITE = "regexp_extract(url, '^[A-Za-z]+://[^/?#]*')"


@query(f"""SELECT page_id, CAST(0 AS INTEGER) AS ord, {_SITE} || '/feed/' || CAST(page_id AS VARCHAR) || '.xml' AS url FROM pages WHERE page_id % 3 < 2
    UNION ALL SELECT page_id, 1, 'https://other.example/atom' FROM pages WHERE page_id % 3 = 1""")
def advertised_feeds(spark, sf_dir):
    """The feeds that pages name in links put before their markup: one of a path, one of another site, a style sheet that is none."""
    k = F.col("page_id").cast("string")
    link = lambda kind, href: F.concat(F.lit(f'<link rel="alternate" type="{kind}" href="'), href, F.lit('">'))
    own, other = link("application/rss+xml", F.concat(F.lit("/feed/"), k, F.lit(".xml"))), link("application/atom+xml", F.lit("https://other.example/atom"))
    head = _chosen(F.col("page_id"), [F.concat(own, own), F.concat(own, other), link("text/css", F.lit("/style.css"))])
    p = si.table(spark, sf_dir, "pages")
    return listing.feeds_of(p.select("page_id", "url", F.concat(head, "html").alias("html")))


@query("""WITH n AS (SELECT doc_id AS page_id, CAST(doc_id % 5 AS INTEGER) AS n FROM documents)
    SELECT page_id, CAST(0 AS INTEGER) AS position, '#m a' AS selector, n + 1 AS links, CAST(1 AS INTEGER) AS depth FROM n WHERE n >= 2 UNION ALL SELECT page_id, 1, 'ul.l a', n, 3 FROM n WHERE n >= 3""")
def best_selectors(spark, sf_dir):
    """Containers of up to five links inside each other, for each document: fullest first, of equally full ones the deepest."""
    d = _documents(spark, sf_dir)
    items = F.array_join(F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 5 + 1).cast("int")), lambda x: F.when(x > 1, F.concat(F.lit('<li><a href="/'), x.cast("string"), F.lit('">x</a></li>'))).otherwise("")), "")
    page = F.concat(F.lit('<main id="m"><section class="s"><ul class="l">'), items, F.lit("</ul></section><a href="), F.col("k"), F.lit("/z>z</a><a href="), F.col("k"), F.lit("/z>again</a></main>"))
    return listing.selectors(d.select(F.col("doc_id").alias("page_id"), F.lit("https://s.example/").alias("url"), page.alias("html")))


@query("""WITH d AS (SELECT doc_id, doc_id % 6 AS kind, CAST(doc_id % 256 AS VARCHAR) AS b, CAST(doc_id % 40 AS VARCHAR) AS s, CAST(doc_id AS VARCHAR) AS k FROM documents)
    SELECT doc_id, CASE kind WHEN 0 THEN '100.' || b || '.3.4' WHEN 1 THEN '172.' || s || '.0.1' WHEN 2 THEN 'h' || k || '.example' WHEN 3 THEN '[fd00::' || s || ']' WHEN 4 THEN '169.254.' || b || '.1' ELSE '10.' || k || '.example.org' END AS host,
        CASE kind WHEN 0 THEN doc_id % 256 BETWEEN 64 AND 127 WHEN 1 THEN doc_id % 40 BETWEEN 16 AND 31 WHEN 3 THEN true WHEN 4 THEN true ELSE false END AS internal FROM d""")
def hosts_and_internal(spark, sf_dir):
    """URLs of shared, private, link-local and named hosts, with users, ports and paths."""
    k = F.col("doc_id")
    values = {"b": (k % 256).cast("string"), "s": (k % 40).cast("string"), "k": F.col("k")}
    u = _chosen(k, [_fill(p, **values) for p in ("https://100.{b}.3.4/", "http://172.{s}.0.1:8080/a", "https://u:p@H{k}.Example:81/x?y", "http://[fd00::{s}]:8080/a", "http://169.254.{b}.1/latest", "http://10.{k}.example.org/")])
    return _documents(spark, sf_dir).withColumn("url", u).select("doc_id", urls.host_of(F.col("url")).alias("host"), urls.is_internal(F.col("url")).alias("internal"))


@query("""WITH d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k FROM documents)
    SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'https://User@ex' || k || '.com/b/c/d?a=1&b=' || k WHEN 1 THEN 'https://ex.com/%e3%81%82/' || k || '?q=%E3%81%82' WHEN 2 THEN 'mailto:a' || k || '@b.c' WHEN 3 THEN 'https://ex.com:8443/' || k WHEN 4 THEN 'https://ex.com/' || k || '?a=&b=' END AS canonical_url FROM d""")
def url_canonical_general(spark, sf_dir):
    """URLs with users, ports, dot segments, escapes, tracking and empty parameters, of another scheme, and none at all."""
    patterns = ("HTTP://User@Ex{k}.COM:80/a/../b/./c//d/?utm_x=1&b={k}&a=1#f", "https://ex.com/%e3%81%82/{k}?q=%e3%81%82", "mailto:a{k}@b.c#x", "https://ex.com:8443/{k}", "https://ex.com/{k}?b&a=", "no scheme {k}")
    u = _chosen(F.col("doc_id"), [_fill(p, k=F.col("k")) for p in patterns])
    return _documents(spark, sf_dir).withColumn("url", u).select("doc_id", urls.canonical_url_general(F.col("url"), F.lit(None).cast("string")).alias("canonical_url"))


@query("SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN 'é' WHEN 1 THEN '&nope; &' ELSE '&lt;&#0;' END AS text FROM documents")
def entities_decoded(spark, sf_dir):
    """Whole texts with some letters and signs as named, decimal and hexadecimal references; unknown ones, and those of
    another reference's text, stay."""
    k = F.col("doc_id")
    raw = F.replace(F.replace("text", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    raw = F.replace(raw, F.lit("e"), _chosen(k, [F.lit("&#101;"), F.lit("&#x65;")]))
    raw = F.concat(raw, _chosen(k, [F.lit("&eacute;"), F.lit("&nope; &"), F.lit("&amp;lt;&#0;")]))
    return _documents(spark, sf_dir).select("doc_id", tx.unescape(raw).alias("text"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 IN (0, 1, 2) THEN 'retry' WHEN o_orderkey % 3 = 0 THEN 'billing' ELSE 'refused' END AS kind FROM orders""")
def model_error_kinds(spark, sf_dir):
    k = F.col("o_orderkey")
    status = _chosen(k, [F.lit(x).cast("int") for x in (None, 429, 503, 400, 401, 404, 422)])
    detail = _chosen(k, [F.concat(F.lit("Your credit balance is too low for "), "o_orderpriority"), F.col("o_orderpriority"), F.lit(None).cast("string")])
    return si.table(spark, sf_dir, "orders").select("o_orderkey", model.error_kind(status, detail).alias("kind"))


@query("""WITH o AS (SELECT o_orderkey, o_orderkey % 5 = 4 AS there, o_orderkey % 3 AS mode, o_orderkey // 3 % 3 AS n, o_orderkey // 9 % 2 AS waiting, o_orderkey // 18 % 2 AS passed, o_orderkey // 36 % 2 = 0 AS send_empty FROM orders)
    SELECT o_orderkey, CASE WHEN there THEN 'kept' WHEN n = 0 THEN CASE WHEN mode = 2 THEN 'skipped' WHEN waiting > 0 THEN 'failed' WHEN send_empty THEN 'generated' ELSE 'skipped' END WHEN passed = 0 THEN 'failed' ELSE 'generated' END AS outcome FROM o""")
def digest_outcomes(spark, sf_dir):
    """Every combination of mode, candidates, waiting items, entries that pass and what to do on a quiet day."""
    k = F.col("o_orderkey")
    digit = lambda n, size: F.floor(k / n) % size
    mode = _chosen(k, [F.lit(x) for x in ("daily", "weekly", "urgent")])
    return si.table(spark, sf_dir, "orders").select("o_orderkey", delivery.digest_outcome(k % 5 == 4, mode, digit(3, 3), digit(9, 2), digit(18, 2), digit(36, 2) == 0).alias("outcome"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'slack' WHEN 1 THEN 'discord' WHEN 2 THEN 'discord' ELSE 'plain' END AS kind FROM documents")
def webhook_kinds(spark, sf_dir):
    patterns = ("https://hooks.slack.com/services/T/{k}", "https://discord.com/api/webhooks/{k}/x", "https://discordapp.com/api/webhooks/1/{k}", "https://e.example/hook/{k}", "https://hooks.slack.com.e.example/{k}")
    u = _chosen(F.col("doc_id"), [_fill(p, k=F.col("k")) for p in patterns])
    return _documents(spark, sf_dir).select("doc_id", message.webhook_kind(u).alias("kind"))


@query()
def article_scores(spark, sf_dir):
    """The scores of all containers of all pages; tests hold them against a walk of each container."""
    from ..sources import nodes

    p = si.table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("key"), F.lit("text/html; charset=utf-8").alias("content_type"), F.encode("html", "UTF-8").alias("body"))
    rows = nodes.container_scores(nodes.nodes_of(nodes.dealt(p), texts=False)).where("score is not null")
    return rows.select(F.col("key").cast("long").alias("page_id"), "pre", "tag", "chars", F.round("density", 9).alias("density"), F.round("score", 6).alias("score"))
