"""Queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions import time as tm
from ..functions import urls
from ..operators import collect, config, delivery, gate, health, message, model, runs, select, store
from ..streaming import health as streams
from . import standins as si
from .registry import ORACLE_SQL, QUERIES, query

__all__ = ["ORACLE_SQL", "QUERIES"]

#: Latin stand-ins for the banned expressions, as the driver's texts have no other script.
LATIN_BANNED = ("thation", "(when|that) an", "ouelle", "keit der", "mente el")
NOW = "2024-01-31 00:00:00"
START, END = tm.window_of(si.DAY)
WEEK_START = END - timedelta(days=7)
CARRY, UPDATES = START - timedelta(days=3), START - timedelta(days=14)


def _ts(x) -> Column:
    return F.lit(str(x)).cast("timestamp_ntz")


def _show(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def _sql(c: str) -> str:
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"


# URLs and listings

_PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
CANONICAL = rf"""parts AS (
    SELECT page_id, url, html, regexp_extract(url, '{_PARTS}', 2) AS h, regexp_extract(url, '{_PARTS}', 3) AS p,
        list_filter(str_split(regexp_extract(url, '{_PARTS}', 4), '&'), lambda x: x <> '' AND NOT starts_with(lower(split_part(x, '=', 1)), 'utm_')
            AND lower(split_part(x, '=', 1)) NOT IN ('fbclid', 'gclid', 'yclid', '_ga', 'mc_cid', 'mc_eid')) AS q FROM pages),
canonical AS (
    SELECT page_id, url, html, 'https://' || regexp_replace(lower(h), ':(80|443)?$', '')
        || coalesce(nullif(regexp_replace(CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/+$', '') END, '/{{2,}}', '/', 'g'), ''), '/')
        || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_transform(list_sort(list_transform(q, lambda x, i: {{'k': split_part(x, '=', 1), 'i': i,
            'p': CASE WHEN contains(x, '=') THEN x ELSE x || '=' END}})), lambda s: s.p), '&') ELSE '' END AS canonical_url FROM parts)"""
LINKS = CANONICAL + r""", links AS (
    SELECT page_id, canonical_url AS page, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)"', 1), 1) AS ord FROM canonical)"""


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return si.table(spark, sf_dir, "pages").withColumn("canonical_url", urls.canonical_url(F.col("url")))


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r'<a href="([^"]*)"'), F.lit(1))
    return _canonical(spark, sf_dir).select("page_id", F.col("canonical_url").alias("page"), F.posexplode(found).alias("at", "href")).withColumn("ord", F.col("at") + 1).drop("at")


@query(f"WITH {CANONICAL} SELECT page_id, canonical_url FROM canonical")
def url_canonical(spark, sf_dir):
    return _canonical(spark, sf_dir).select("page_id", "canonical_url")


@query(f"WITH {CANONICAL} SELECT page_id, left(sha256(canonical_url), 40) AS id FROM canonical")
def url_item_id(spark, sf_dir):
    return _canonical(spark, sf_dir).select("page_id", urls.item_id(F.col("canonical_url")).alias("id"))


@query(f"WITH {CANONICAL} SELECT canonical_url, min(page_id) AS page_id, count(*) AS n FROM canonical GROUP BY canonical_url")
def url_dedupe_first(spark, sf_dir):
    return collect.counted_first(_canonical(spark, sf_dir), ["canonical_url"], "page_id")


@query(f"WITH {LINKS} SELECT page_id, href, min(ord) AS ord FROM links WHERE href <> '' GROUP BY ALL")
def link_candidates(spark, sf_dir):
    return collect.first_per_key(_links(spark, sf_dir).where("href <> ''"), ["page_id", "href"], ["ord"]).select("page_id", "href", F.col("ord").cast("long"))


@query(f"WITH {LINKS} SELECT page_id, ord, href FROM links WHERE (contains(href, 'the') OR contains(href, 'an')) AND NOT contains(href, 'in')")
def link_include_exclude(spark, sf_dir):
    keep = urls.allowed(F.col("href"), F.array(F.lit("the"), F.lit(""), F.lit("an")), F.array(F.lit("in"), F.lit("")))
    return _links(spark, sf_dir).where(keep).select("page_id", F.col("ord").cast("long"), "href")


_NOISE = tx.NOISE


@query(
    "WITH t0 AS (SELECT page_id, html AS h FROM pages), "
    + ", ".join(f"t{k + 1} AS (SELECT page_id, regexp_replace(h, '(?s)<{tag}\\b[^>]*>.*?</{tag}>', ' ', 'g') AS h FROM t{k})" for k, tag in enumerate(_NOISE))
    + f" SELECT page_id, length(trim(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS n_chars, sha256(trim(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\n\\r]+', ' ', 'g'))) AS text_sha256 FROM t{len(_NOISE)}"
)
def page_text_noise_stripped(spark, sf_dir):
    rows = si.table(spark, sf_dir, "pages").select("page_id", tx.without_noise(F.col("html")).alias("t"))
    return rows.select("page_id", F.char_length("t").cast("long").alias("n_chars"), F.sha2(F.col("t").cast("binary"), 256).alias("text_sha256"))


# Collection


@query("SELECT doc_id, sha256(CASE WHEN doc_id % 10 = 0 THEN left(text, 60) ELSE text END) AS content_hash, doc_id % 4 = 0 AND upper(text) <> text AS content_changed FROM documents")
def content_hash_changed(spark, sf_dir):
    d = si.table(spark, sf_dir, "documents")
    old = tx.content_hash(F.col("text"), F.left("text", F.lit(60)))
    new = tx.content_hash(F.when(F.col("doc_id") % 4 == 0, F.upper("text")).otherwise(F.col("text")), F.left("text", F.lit(60)))
    shown = tx.content_hash(F.when(F.col("doc_id") % 10 != 0, F.col("text")), F.left("text", F.lit(60)))
    return d.select("doc_id", shown.alias("content_hash"), (old != new).alias("content_changed"))


@query("SELECT d.doc_id, source FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL")
def new_items_anti(spark, sf_dir):
    c = si.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    known = si.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return collect.new_candidates(c, known).select(F.col("id").alias("doc_id"), "source")


@query("""WITH n AS (SELECT d.doc_id, source, row_number() OVER (PARTITION BY source ORDER BY d.doc_id) AS rank, count(*) OVER (PARTITION BY source) AS c
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.doc_id IS NULL)
    SELECT doc_id, source, rank, greatest(c - 10, 0) AS overflow FROM n WHERE rank <= 10""")
def new_items_capped(spark, sf_dir):
    c = si.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.col("doc_id").alias("ord"))
    new = collect.new_candidates(c, si.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")))
    return collect.capped_new(new, 10).select(F.col("id").alias("doc_id"), F.col("source_id").alias("source"), F.col("rank").cast("long"), F.col("overflow").cast("long"))


@query(f"""WITH {si.ITEMS}, k AS (SELECT id, source_id, row_number() OVER (PARTITION BY source_id ORDER BY updated_at, ord) AS rank FROM items)
    SELECT * FROM k WHERE rank <= 5 AND CAST(id AS BIGINT) % 4 <> 0""")
def recheck_oldest_k(spark, sf_dir):
    known = si.items(spark, sf_dir).select("id", "source_id", "updated_at", "ord")
    return collect.rechecks(known, known.where("ord % 4 = 0")).select("id", "source_id", F.col("rank").cast("long"))


@query("""WITH k AS (SELECT doc_id, source, CAST(doc_id % 3 = 0 AS INT) AS changed FROM documents),
    b AS (SELECT *, coalesce(sum(changed) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
    SELECT doc_id, source, changed, CAST(before AS BIGINT) AS before FROM b WHERE before < 50""")
def update_quota_running(spark, sf_dir):
    known = si.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("source_id"), F.col("doc_id").alias("ord"))
    return collect.update_quota(known, F.col("doc_id") % 3 == 0).select("doc_id", F.col("source_id").alias("source"), "changed", "before")


@query(f"""WITH {si.ITEMS}, p AS (SELECT *, ord % 7 <> 0 AS same, ord % 4 = 0 AS changed FROM items)
    SELECT id, CASE WHEN same AND ord % 5 <> 0 THEN title || '!' ELSE title END AS title, CASE WHEN same THEN 'zz' ELSE region END AS region,
        '{NOW}' AS updated_at, CASE WHEN NOT changed THEN strftime(classified_at, '%Y-%m-%d %H:%M:%S') END AS classified_at, changed AS content_changed FROM p""")
def item_update_projection(spark, sf_dir):
    old = si.items(spark, sf_dir).withColumn("content_hash", F.lit("h")).withColumn("published_at", F.col("detected_at"))
    fresh = old.select(
        "id",
        F.when(F.col("ord") % 7 == 0, F.lit("other")).otherwise(F.col("source_id")).alias("source_id"),
        F.when(F.col("ord") % 5 != 0, F.concat("title", F.lit("!"))).otherwise("").alias("title"),
        "published_at",
        "content_text",
        F.when(F.col("ord") % 4 == 0, F.lit("g")).otherwise("h").alias("content_hash"),
        F.lit("zz").alias("region"),
    )
    out = collect.apply_updates(collect.known_candidates(fresh, old), _ts(NOW))
    return out.select("id", "title", "region", _show("updated_at"), _show("classified_at"), "content_changed")


@query("""WITH s AS (SELECT DISTINCT source, 'Source ' || source AS name FROM documents WHERE source NOT IN ('src3', 'src7'))
    SELECT d.doc_id, coalesce(s.name, d.source) AS source_name FROM documents d LEFT JOIN s ON d.source = s.source""")
def source_name_left_join(spark, sf_dir):
    d = si.table(spark, sf_dir, "documents").withColumnRenamed("source", "source_id")
    configured = d.where(~F.col("source_id").isin("src3", "src7")).select(F.col("source_id").alias("id")).distinct().withColumn("name", F.concat(F.lit("Source "), F.col("id")))
    return collect.source_names(d, configured).select("doc_id", "source_name")


@query(f"""WITH {si.ITEMS}, q AS (SELECT id, updated_at FROM items WHERE classified_at IS NULL AND updated_at >= TIMESTAMP '2024-01-10' ORDER BY updated_at, id LIMIT 200)
    SELECT id, {_sql('updated_at')}, CAST((row_number() OVER (ORDER BY q.updated_at, id) - 1) // 20 AS INTEGER) AS batch_id FROM q""")
def unclassified_queue(spark, sf_dir):
    return collect.unclassified_queue(si.items(spark, sf_dir), _ts("2024-01-10 00:00:00"), 200).select("id", _show("updated_at"), "batch_id")


# Time windows


@query(f"SELECT event_id, user_id FROM events WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'")
def window_fresh(spark, sf_dir):
    e = si.table(spark, sf_dir, "events").withColumnRenamed("event_id", "id")
    return store.in_window(e, _ts(START), _ts(END), "ts").select(F.col("id").alias("event_id"), "user_id")


@query("SELECT CAST(CAST(ts + INTERVAL 2 HOUR AS DATE) + 1 AS VARCHAR) AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def business_day_counts(spark, sf_dir):
    return streams.business_days(si.table(spark, sf_dir, "events"), ["event_type"])


@query(f"SELECT user_id, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts >= TIMESTAMP '{WEEK_START}' AND ts < TIMESTAMP '{END}' GROUP BY ALL")
def weekly_window_counts(spark, sf_dir):
    return streams.sliding_totals(si.table(spark, sf_dir, "events"), _ts(WEEK_START), _ts(END))


# Selection


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN '2024-02-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0')
    ELSE '2024-01-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END END AS last FROM documents""")
def last_digested_date(spark, sf_dir):
    day = F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")
    marks = F.array(
        F.concat(F.lit("main_2024-01-"), day),
        F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("main_2024-02-"), day)).otherwise(F.lit("main_two_2024-03-01")),
        F.lit("main_2024-02-30"),
    )
    marks = F.when(F.col("doc_id") % 6 == 0, marks).otherwise(F.array(F.lit("main_two_2024-01-09")))
    return si.table(spark, sf_dir, "documents").select("doc_id", select.last_digested(marks, "main").cast("string").alias("last"))


_REASON = f"""{si.ITEMS}, lasts AS (SELECT *, CAST(list_max(list_transform(digested_in, lambda x: substr(x, 6))) AS DATE) AS last FROM items),
reasons AS (SELECT *, CASE
    WHEN detected_at >= TIMESTAMP '{START}' AND detected_at < TIMESTAMP '{END}' AND last IS NULL THEN 'fresh'
    WHEN updated_at >= TIMESTAMP '{UPDATES}' AND updated_at < TIMESTAMP '{END}' AND detected_at < TIMESTAMP '{START}' AND classified_at >= updated_at
        AND CASE WHEN last IS NULL THEN updated_at >= TIMESTAMP '{START}' ELSE updated_at > CAST(last AS TIMESTAMP) + INTERVAL 15 HOUR AND DATE '{si.DAY}' >= last + 7 END THEN 'updated'
    WHEN detected_at >= TIMESTAMP '{CARRY}' AND detected_at < TIMESTAMP '{START}' AND last IS NULL THEN 'carried' END AS reason FROM lasts),
pool AS (SELECT * FROM reasons WHERE reason IS NOT NULL)"""
_CANDIDATES = (
    _REASON
    + f""", facts AS (SELECT coalesce(bool_or(region IS NULL), false) AS has_national, count(*) FILTER (classified_at IS NULL) AS unclassified FROM pool),
candidates AS (SELECT pool.*, facts.* FROM pool, facts WHERE classified_at IS NOT NULL AND list_contains(channels, 'main') AND relevance >= {si.CHANNEL.relevance_threshold}
    AND NOT list_contains(digested_in, 'main_{si.DAY}') AND NOT (is_duplicate_of_national AND region IS NOT NULL AND has_national))"""
)


def _pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.pool(si.items(spark, sf_dir), si.CHANNEL.id, si.DAY)


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.candidates(_pool(spark, sf_dir), si.CHANNEL, f"main_{si.DAY}")


@query(f"WITH {_REASON} SELECT id, reason FROM pool")
def select_union_reasons(spark, sf_dir):
    return _pool(spark, sf_dir).select("id", "reason")


@query(f"WITH {_REASON} SELECT id, {_sql('updated_at')} FROM pool WHERE reason = 'updated'")
def redeliverable_updates(spark, sf_dir):
    return _pool(spark, sf_dir).where("reason = 'updated'").select("id", _show("updated_at"))


@query(f"WITH {_REASON} SELECT id, {_sql('detected_at')} FROM pool WHERE reason = 'carried'")
def carry_over(spark, sf_dir):
    return _pool(spark, sf_dir).where("reason = 'carried'").select("id", _show("detected_at"))


@query(f"WITH {_CANDIDATES} SELECT id, region, is_duplicate_of_national, unclassified FROM candidates")
def national_duplicate_suppressed(spark, sf_dir):
    return _candidates(spark, sf_dir).select("id", "region", "is_duplicate_of_national", "unclassified")


@query(f"""WITH {_CANDIDATES} SELECT id, reason, importance_rank, relevance, rank FROM
    (SELECT *, CAST(row_number() OVER (ORDER BY importance_rank DESC, relevance DESC, detected_at DESC, id) AS INTEGER) AS rank FROM candidates) WHERE rank <= 20""")
def digest_rank_topk(spark, sf_dir):
    return select.ranked(_candidates(spark, sf_dir)).select("id", "reason", "importance_rank", "relevance", "rank")


@query(f"""WITH {si.ITEMS}, inside AS (SELECT *, bool_or(region IS NULL) OVER () AS has_national FROM items
        WHERE detected_at >= TIMESTAMP '{END - timedelta(days=3)}' AND detected_at < TIMESTAMP '{END}')
    SELECT id, CAST(deadline AS VARCHAR) AS deadline, relevance, CAST(row_number() OVER (ORDER BY inside.deadline, relevance DESC, id) AS INTEGER) AS rank FROM inside
    WHERE classified_at IS NOT NULL AND list_contains(channels, 'main') AND relevance >= {si.CHANNEL.relevance_threshold} AND importance_rank = 3
        AND inside.deadline BETWEEN DATE '{si.DAY}' AND DATE '{si.DAY}' + 3 AND len(digested_in) = 0
        AND NOT (is_duplicate_of_national AND region IS NOT NULL AND has_national)
    ORDER BY inside.deadline, relevance DESC, id LIMIT 5""")
def urgent_topk(spark, sf_dir):
    return select.urgent(si.items(spark, sf_dir), si.CHANNEL, si.DAY).select("id", F.col("deadline").cast("string").alias("deadline"), "relevance", "rank")


# Gate

_ANY = "|".join(f"(?:{p})" for p in LATIN_BANNED)
_BANNED = f"regexp_matches(headline, '{_ANY}') OR regexp_matches(summary, '{_ANY}') OR regexp_matches(affected, '{_ANY}')"
_BLANK = lambda c: f"regexp_replace(coalesce({c}, ''), '[ \\t\\n\\r\\x{{3000}}]', '', 'g') = ''"
_GATE = si.ENTRIES + f""", joined AS (SELECT e.*, u.canonical_url IS NOT NULL AS url_known, i.canonical_url AS item_url FROM entries e
    LEFT JOIN (SELECT DISTINCT canonical_url FROM gate_items) u ON u.canonical_url = e.source_url LEFT JOIN gate_items i ON i.id = e.item_id),
first AS (SELECT *, CASE WHEN NOT url_known THEN 'Q1' WHEN item_url IS NULL OR item_url <> source_url THEN 'Q3'
    WHEN {_BLANK('headline')} OR {_BLANK('summary')} THEN 'Q4' WHEN {_BANNED} THEN 'Q5' END AS f FROM joined),
checked AS (SELECT *, CASE WHEN f IS NULL AND row_number() OVER (PARTITION BY digest_id, source_url, f IS NULL ORDER BY idx) > 1 THEN 'Q8' ELSE f END AS failed FROM first)"""


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.static_check(si.gate_items(spark, sf_dir), si.entries(spark, sf_dir), LATIN_BANNED)


@query(f"WITH {_GATE} SELECT digest_id, idx, failed FROM checked")
def gate_first_failed_check(spark, sf_dir):
    return _checked(spark, sf_dir).select("digest_id", "idx", "failed")


@query(f"WITH {_GATE} SELECT failed, count(*) AS n FROM checked WHERE failed IS NOT NULL GROUP BY failed")
def gate_breakdown(spark, sf_dir):
    return gate.breakdown(_checked(spark, sf_dir))


@query(f"WITH {_GATE} SELECT digest_id, idx, source_url FROM checked WHERE failed = 'Q8'")
def gate_dedupe_url(spark, sf_dir):
    return _checked(spark, sf_dir).where("failed = 'Q8'").select("digest_id", "idx", "source_url")


_FIRST = lambda c: "coalesce(" + ", ".join(f"nullif(regexp_extract({c}, '({p})', 1), '')" for p in LATIN_BANNED) + ")"


@query(f"""WITH {si.ENTRIES}, m AS (SELECT idx, {_FIRST('headline')} AS h, {_FIRST('summary')} AS s FROM entries)
    SELECT idx, CASE WHEN h IS NOT NULL THEN 'headline' ELSE 'summary' END AS field, coalesce(h, s) AS matched FROM m WHERE h IS NOT NULL OR s IS NOT NULL""")
def banned_expression_match(spark, sf_dir):
    found = tx.first_banned([("headline", F.col("headline")), ("summary", F.col("summary"))], LATIN_BANNED)
    return si.entries(spark, sf_dir).select("idx", found.alias("b")).where("b is not null").select("idx", "b.field", "b.matched")


@query(f"""WITH {si.ENTRIES}, r AS (SELECT *, trim(regexp_extract(region, '^([^(（]*)', 1)) AS pref FROM entries)
    SELECT idx, CASE WHEN region IS NULL OR pref = '' OR contains(headline, pref) OR contains(summary, pref) OR contains(affected, pref) THEN affected
        ELSE left(CASE WHEN affected = '' THEN pref ELSE pref || '・' || affected END, 40) END AS affected FROM r""")
def region_annotated(spark, sf_dir):
    e = si.entries(spark, sf_dir)
    return e.select("idx", tx.annotate_region(F.col("headline"), F.col("summary"), F.col("affected"), F.col("region")).alias("affected"))


@query(f"""WITH {si.ENTRIES}, k AS (SELECT digest_id, idx, row_number() OVER (PARTITION BY digest_id ORDER BY importance_rank DESC, idx) AS r FROM entries)
    SELECT digest_id, idx, CAST(row_number() OVER (PARTITION BY digest_id ORDER BY idx) AS INTEGER) AS number FROM k WHERE r <= 5""")
def item_cap_stable(spark, sf_dir):
    return select.item_cap(si.entries(spark, sf_dir), 5, ["digest_id"]).select("digest_id", "idx", "number")


# Messages

_T = message.Template()
_LINE = lambda c: f"trim(regexp_replace({c}, '[ \\t\\n\\r\\x{{3000}}]+', ' ', 'g'))"
_BLOCK = f"""'{_T.bullet}' || CAST(number AS VARCHAR) || '. ' || CASE WHEN importance_rank = 3 THEN '{_T.mark}' ELSE '' END || {_LINE('headline')} || chr(10) || '{_T.indent}' || {_LINE('summary')}
    || CASE WHEN {_LINE('affected')} <> '' THEN chr(10) || '{_T.indent}{_T.affected}' || {_LINE('affected')} ELSE '' END
    || CASE WHEN date_note IS NOT NULL THEN chr(10) || '{_T.indent}' || date_note ELSE '' END || chr(10) || '{_T.indent}{_T.source}' || {_LINE('source_url')}"""
_MESSAGE = lambda n: f"""array_to_string(list_concat(list_concat(['{_T.header}' || CAST(digest_id AS VARCHAR)], list(block ORDER BY number)),
    CASE WHEN {n} > 0 THEN ['{_T.omitted_before}' || CAST({n} AS VARCHAR) || '{_T.omitted_after}', '{_T.closing}'] ELSE ['{_T.closing}'] END), chr(10) || chr(10))"""  # noqa: E731


def _header() -> Column:
    return F.concat(F.lit(_T.header), F.col("digest_id").cast("string"))


def _fitted(limit: int, omitted: str) -> str:
    """The rest of a query over `ranked` entries: the longest prefix whose message fits, or the first entry alone with its summary
    cut. Gives `fitted` with digest_id, k, size and message."""
    text = _MESSAGE(omitted)
    cut = f"length({_LINE('summary')}) - (length(message) - {limit}) - 1"
    return f"""prefixes AS (SELECT a.*, b.r AS k FROM ranked a JOIN (SELECT digest_id, r FROM ranked) b ON a.digest_id = b.digest_id AND a.r <= b.r),
numbered AS (SELECT *, row_number() OVER (PARTITION BY digest_id, k ORDER BY idx) AS number FROM prefixes),
texts AS MATERIALIZED (SELECT digest_id, k, any_value(size) AS size, {text} AS message FROM (SELECT *, {_BLOCK} AS block FROM numbered) GROUP BY digest_id, k),
fits AS (SELECT digest_id, max(k) AS k FROM texts WHERE length(message) <= {limit} GROUP BY digest_id),
alone AS (SELECT n.* REPLACE (CASE WHEN {cut} > 0 THEN left({_LINE('summary')}, {cut}) || '{message.ELLIPSIS}' ELSE '' END AS summary) FROM numbered n JOIN texts t ON t.digest_id = n.digest_id AND t.k = n.k WHERE n.k = 1 AND n.digest_id NOT IN (SELECT digest_id FROM fits)),
fitted AS (SELECT t.* FROM texts t JOIN fits USING (digest_id, k) UNION ALL SELECT digest_id, k, any_value(size), {text} FROM (SELECT *, {_BLOCK} AS block FROM alone) GROUP BY digest_id, k)"""


@query(f"""WITH {si.ENTRIES}, ranked AS (SELECT *, row_number() OVER (PARTITION BY digest_id ORDER BY importance_rank DESC, idx) AS r, count(*) OVER (PARTITION BY digest_id) AS size FROM entries),
{_fitted(3000, '(any_value(size) - k)')}
SELECT digest_id, CAST(k AS INTEGER) AS n_kept, CAST(size - k AS INTEGER) AS dropped, sha256(message) AS message_sha256 FROM fitted""")
def fit_to_limit(spark, sf_dir):
    out = message.fit(si.entries(spark, sf_dir), _T, _header(), F.lit(0), 3000)
    return out.select("digest_id", "n_kept", "dropped", F.sha2(F.col("message").cast("binary"), 256).alias("message_sha256"))


@query(f"""WITH {_GATE}, base AS (SELECT *, count(*) FILTER (failed IS NOT NULL) OVER (PARTITION BY digest_id) AS by_gate FROM checked),
ranked AS (SELECT *, row_number() OVER (PARTITION BY digest_id ORDER BY importance_rank DESC, idx) AS r, count(*) OVER (PARTITION BY digest_id) AS size FROM base WHERE failed IS NULL),
{_fitted(message.LIMIT, '(any_value(by_gate) + any_value(size) - k)')}
SELECT digest_id, message FROM fitted""")
def digest_message(spark, sf_dir):
    checked = _checked(spark, sf_dir).withColumn("by_gate", F.count_if(F.col("failed").isNotNull()).over(W.partitionBy("digest_id")))
    return message.fit(checked.where("failed is null"), _T, _header(), F.col("by_gate")).select("digest_id", "message")


# Health


@query(f"WITH {si.HEALTH} SELECT source_id, seq, failures, empties FROM health")
def failure_streaks(spark, sf_dir):
    return health.streaks(si.fetches(spark, sf_dir)).select("source_id", "seq", "failures", "empties")


@query(f"WITH {si.HEALTH} SELECT source_id, seq, failures FROM health WHERE failed AND failures IN (2, 4, 8, 16, 32, 64)")
def alert_doubling(spark, sf_dir):
    return health.streaks(si.fetches(spark, sf_dir)).where(F.col("failed") & health.alerts_at(F.col("failures"), 2)).select("source_id", "seq", "failures")


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.latest_state(health.streaks(si.fetches(spark, sf_dir)))


@query(f"WITH {si.STATES} SELECT source_id, {_sql('last_fetched_at')}, {_sql('last_success_at')}, consecutive_failures, consecutive_empty FROM states")
def source_state_latest(spark, sf_dir):
    return _states(spark, sf_dir).select("source_id", _show("last_fetched_at"), _show("last_success_at"), "consecutive_failures", "consecutive_empty")


@query(f"""WITH {si.STATES} SELECT source_id, consecutive_failures, CAST(row_number() OVER (ORDER BY consecutive_failures DESC, source_id) AS INTEGER) AS position
    FROM states WHERE consecutive_failures > 0""")
def health_report(spark, sf_dir):
    return health.report(_states(spark, sf_dir)).select("source_id", "consecutive_failures", "position")


@query(f"WITH {si.STATES} SELECT source_id, consecutive_empty FROM states WHERE consecutive_failures = 0 AND consecutive_empty >= 1")
def silent_sources(spark, sf_dir):
    return health.silent(_states(spark, sf_dir), 1).select("source_id", "consecutive_empty")


@query(f"""WITH {si.RUNS}, d AS (SELECT day, max(succeeded) AS best, arg_max(total, (started_at, id)) AS total, max(started_at) AS last_run_at FROM runs GROUP BY day)
    SELECT CAST(day AS VARCHAR) AS day, total, greatest(least(best, total) - 1, 0) AS succeeded, {_sql('last_run_at')} FROM d""")
def coverage_summary(spark, sf_dir):
    out = health.coverage(si.runs(spark, sf_dir), F.lit(1))
    return out.select(F.col("day").cast("string").alias("day"), "total", "succeeded", _show("last_run_at"))


@query("""WITH s AS (SELECT CAST(ts + INTERVAL 9 HOUR AS DATE) AS day, user_id, max(ts) AS last FROM events WHERE event_type <> 'error' GROUP BY ALL)
    SELECT CAST(day AS VARCHAR) AS day, count(*) AS succeeded, strftime(max(last), '%Y-%m-%d %H:%M:%S') AS last_success_at FROM s GROUP BY day""")
def coverage_fallback(spark, sf_dir):
    out = health.from_states(si.fetches(spark, sf_dir), tm.local_date(F.col("ts")))
    return out.select(F.col("day").cast("string").alias("day"), "succeeded", _show("last_success_at"))


@query(f"""WITH {si.RUNS} SELECT CAST(day AS VARCHAR) AS day, id,
    CASE WHEN failed = total THEN 'failed' WHEN failed > 0 OR errors > 0 THEN 'partial' ELSE 'succeeded' END AS collect,
    CASE WHEN total > 0 AND failed = total THEN 'failed' WHEN failed > 0 OR errors > 0 THEN 'partial' ELSE 'succeeded' END AS summarize,
    CASE WHEN errors = 0 THEN 'succeeded' WHEN sent > 0 THEN 'partial' ELSE 'failed' END AS deliver FROM runs""")
def run_status(spark, sf_dir):
    status = {job: health.run_status(job, *(F.col(c) for c in ("total", "failed", "sent", "errors"))) for job in ("collect", "summarize", "deliver")}
    return si.runs(spark, sf_dir).select(F.col("day").cast("string").alias("day"), "id", *(s.alias(job) for job, s in status.items()))


@query("""WITH t AS (SELECT CAST(min(ts) AS DATE) AS a, CAST(max(ts) AS DATE) AS b FROM events), days AS (SELECT CAST(unnest(generate_series(a, b, INTERVAL 1 DAY)) AS DATE) AS day FROM t),
    s AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE event_type = 'purchase' AND value > 200 GROUP BY ALL)
    SELECT CAST(days.day AS VARCHAR) AS day, coalesce(n, 0) AS sent FROM days LEFT JOIN s ON s.day = days.day WHERE coalesce(n, 0) < 3""")
def delivery_missing_days(spark, sf_dir):
    out = runs.missing_days(si.table(spark, sf_dir, "events"), F.expr("event_type = 'purchase' and value > 200"), 3)
    return out.select(F.col("day").cast("string").alias("day"), "sent")


# Delivery, store, configuration


@query("""SELECT doc_id, CASE WHEN doc_id % 6 = 0 THEN 'missing' WHEN doc_id % 6 = 1 THEN 'delivered' WHEN doc_id % 6 = 2 THEN 'skipped' WHEN doc_id % 6 = 3 THEN 'failed'
    WHEN doc_id % 5 = 0 AND doc_id % 6 <> 5 THEN 'awaiting_approval' WHEN doc_id % 7 = 0 THEN 'already_sent' ELSE 'send' END AS decision FROM documents""")
def delivery_decision(spark, sf_dir):
    k = F.col("doc_id")
    d = si.table(spark, sf_dir, "documents").select(k.alias("id"), F.element_at(F.array(F.lit(None).cast("string"), *map(F.lit, ("delivered", "skipped", "failed", "generated", "approved"))), (k % 6 + 1).cast("int")).alias("status"))
    sent = si.table(spark, sf_dir, "documents").where("doc_id % 7 = 0").select(k.alias("id"), F.lit("sent").alias("delivery_status"))
    return delivery.decision(d, sent, F.col("id") % 5 == 0).select(F.col("id").alias("doc_id"), "decision")


@query(f"""WITH {si.ITEMS} SELECT id, array_to_string(list_sort(CASE WHEN ord % 4 = 0 THEN list_filter(digested_in, lambda x: x <> 'main_2024-01-15')
    WHEN ord % 4 = 1 AND NOT list_contains(digested_in, 'main_2024-01-15') THEN list_append(digested_in, 'main_2024-01-15') ELSE digested_in END), ',') AS marks FROM items""")
def mark_unmark(spark, sf_dir):
    d, k, m = F.lit("main_2024-01-15"), F.col("ord"), F.col("digested_in")
    marks = F.when(k % 4 == 0, store.unmark(m, d)).when(k % 4 == 1, store.mark(m, d)).otherwise(m)
    return si.items(spark, sf_dir).select("id", F.array_join(F.array_sort(marks), ",").alias("marks"))


@query(f"WITH {si.ITEMS} SELECT id FROM items WHERE ord % 9 = 0 OR detected_at + INTERVAL 14 DAY > TIMESTAMP '{NOW}'")
def ttl_live_items(spark, sf_dir):
    expires = F.when(F.col("ord") % 9 != 0, F.col("detected_at") + F.expr("INTERVAL 14 DAYS"))
    return store.live(si.items(spark, sf_dir).withColumn("expires_at", expires), _ts(NOW)).select("id")


@query("SELECT n_regionkey AS id, count(*) AS n FROM nation GROUP BY ALL HAVING count(*) > 1")
def config_duplicates(spark, sf_dir):
    return config.duplicates(si.table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("id")), "id")


@query("""WITH s AS (SELECT c_custkey AS id, [CAST(c_nationkey AS VARCHAR), CAST(c_nationkey * 2 AS VARCHAR)] AS channels FROM customer),
    p AS (SELECT DISTINCT id, unnest(channels) AS ch FROM s), n AS (SELECT CAST(n_nationkey AS VARCHAR) AS ch FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT 'spare')
    SELECT CAST(id AS VARCHAR) AS source_id, p.ch AS channel_id, 'undefined' AS problem FROM p LEFT JOIN n ON n.ch = p.ch WHERE n.ch IS NULL
    UNION ALL SELECT NULL, n.ch, 'unreferenced' FROM n WHERE ch NOT IN (SELECT ch FROM p)""")
def config_unreferenced(spark, sf_dir):
    refs = F.array(F.col("c_nationkey").cast("string"), (F.col("c_nationkey") * 2).cast("string"))
    s = si.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), refs.alias("channels"))
    n = si.table(spark, sf_dir, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").cast("string").alias("id"))
    n = n.unionAll(spark.createDataFrame([("spare",)], "id string"))  # a channel that no source feeds
    undefined = config.undefined_references(s, n).select(F.col("source_id").cast("string").alias("source_id"), "channel_id", F.lit("undefined").alias("problem"))
    idle = config.unreferenced_channels(s, n).select(F.lit(None).cast("string").alias("source_id"), F.col("id").alias("channel_id"), F.lit("unreferenced").alias("problem"))
    return undefined.unionAll(idle)


@query("""SELECT role, count(*) AS calls, CAST(sum(length(text)) FILTER (turn % 2 = 1) AS BIGINT) AS input_tokens, CAST(sum(length(text)) FILTER (turn > 100000) AS BIGINT) AS output_tokens FROM conversations GROUP BY role""")
def token_usage_rollup(spark, sf_dir):
    n, turn = F.char_length("text"), F.col("turn")
    c = si.table(spark, sf_dir, "conversations").select("role", F.when(turn % 2 == 1, n).alias("input_tokens"), F.when(turn > 100_000, n).alias("output_tokens"))
    return model.usage(c, ["role"])


# Model results, runs, calendar


@query("""WITH a AS (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 20 AS batch_id FROM documents)
    SELECT CAST(batch_id AS BIGINT) AS batch_id, count(*) AS asked, count(*) FILTER (l.doc_id IS NULL) AS missing FROM a LEFT JOIN labels l ON a.doc_id = l.doc_id GROUP BY batch_id""")
def model_results_missing(spark, sf_dir):
    asked = model.batched(si.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))
    got = asked.join(si.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")), "id", "left_semi").withColumn("relevance", F.lit(1.0))
    return model.missing(model.join_results(asked, got))


@query("""SELECT doc_id, array_to_string(list_filter(['main', 'child'], lambda x: list_contains([lang, 'main', 'other', CASE WHEN doc_id % 2 = 0 THEN 'child' ELSE 'main' END], x)), ',') AS channels,
    least(greatest(CAST(n_chars AS DOUBLE) / CAST(1000 AS DOUBLE) - CAST(1 AS DOUBLE), CAST(0 AS DOUBLE)), CAST(1 AS DOUBLE)) AS relevance, CAST(doc_id % 3 + 1 AS INTEGER) AS importance_rank,
    CASE WHEN doc_id % 28 + 1 < 29 AND doc_id % 5 <> 0 THEN '2024-02-' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') END AS deadline FROM documents""")
def model_output_validated(spark, sf_dir):
    k = F.col("doc_id")
    word = F.element_at(F.array(*map(F.lit, model.IMPORTANCE)), (k % 3 + 1).cast("int"))
    day = F.when(k % 5 == 0, F.lit("2024-02-30")).otherwise(F.concat(F.lit("2024-02-"), F.lpad((k % 28 + 1).cast("string"), 2, "0")))
    one = F.struct(k.cast("string").alias("id"), F.array(F.lit("main"), F.when(k % 2 == 0, "child").otherwise("main"), F.col("lang"), F.lit("other")).alias("channels"), (F.col("n_chars") / 1000 - 1).alias("relevance"), word.alias("importance"), day.alias("deadline"))
    repeated = F.struct(k.cast("string").alias("id"), F.array(F.lit("x")).alias("channels"), F.lit(9.0).alias("relevance"), F.lit("low").alias("importance"), F.lit("never").alias("deadline"))
    bodies = si.table(spark, sf_dir, "documents").select(k.alias("batch_id"), F.to_json(F.array(one, repeated)).alias("body"))
    out = model.parse(bodies, ["main", "child"])
    return out.select(F.col("batch_id").alias("doc_id"), F.array_join("channels", ",").alias("channels"), "relevance", "importance_rank", F.col("deadline").cast("string").alias("deadline"))


@query("SELECT conv_id, sha256(string_agg(text, chr(10) || '---' || chr(10) ORDER BY turn, text)) AS merged_sha256 FROM conversations GROUP BY conv_id")
def merged_audit_text(spark, sf_dir):
    out = model.merged_text(si.table(spark, sf_dir, "conversations"), "conv_id", "turn", "text")
    return out.select("conv_id", F.sha2(F.col("merged").cast("binary"), 256).alias("merged_sha256"))


@query(f"""WITH {_GATE}, g AS (SELECT digest_id, count(*) FILTER (failed IS NOT NULL) AS by_gate, count(*) FILTER (failed IS NULL) AS passed FROM checked GROUP BY digest_id)
    SELECT digest_id, by_gate + greatest(passed - 5, 0) + 2 AS omitted FROM g""")
def omitted_count(spark, sf_dir):
    g = _checked(spark, sf_dir).groupBy("digest_id").agg(F.count_if(F.col("failed").isNotNull()).alias("by_gate"), F.count_if(F.col("failed").isNull()).alias("passed"))
    return g.select("digest_id", model.omitted(F.lit(2), F.col("by_gate"), F.lit(0), F.greatest(F.col("passed") - 5, F.lit(0)), F.lit(0)).alias("omitted"))


@query("""SELECT CAST(CAST(ts + INTERVAL 9 HOUR AS DATE) AS VARCHAR) AS day, CAST(count(*) FILTER (event_type = 'view') AS INTEGER) AS fetched, CAST(count(*) FILTER (event_type = 'signup') AS INTEGER) AS new_items,
    CAST(count(*) FILTER (event_type = 'error') AS INTEGER) AS sources_failed, CAST(count(*) FILTER (event_type = 'purchase') AS INTEGER) AS sent FROM events GROUP BY ALL""")
def run_counters(spark, sf_dir):
    kinds = F.create_map(*(F.lit(x) for pair in (("view", "fetched"), ("signup", "new_items"), ("error", "sources_failed"), ("purchase", "sent"), ("click", "skipped")) for x in pair))
    rows = si.table(spark, sf_dir, "events").select(tm.local_date(F.col("ts")).cast("string").alias("day"), kinds[F.col("event_type")].alias("kind"))
    return runs.counters(rows, ["day"]).select("day", "fetched", "new_items", "sources_failed", "sent")


@query("SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), '%Y-%m-%d %H:%M:%S') AS window_start, user_id AS source_id, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY ALL HAVING count(*) >= 2")
def error_alert_windows(spark, sf_dir):
    return runs.error_windows(si.fetches(spark, sf_dir), "1 hour", ["source_id"], 2).select(_show("window_start"), "source_id", "errors")


@query("""SELECT o_orderkey, CAST(month(d) AS VARCHAR) || '/' || CAST(day(d) AS VARCHAR) || '(' || ['日', '月', '火', '水', '木', '金', '土'][dayofweek(d) + 1] || ')' AS header, CAST(dayofweek(d) AS INTEGER) AS weekday,
    strftime(o_orderdate + INTERVAL 90 MINUTE, '%Y-%m-%dT%H:%M:%S.000Z') AS iso, strftime(o_orderdate + INTERVAL 630 MINUTE, '%H:%M') AS local_time
    FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def calendar_labels(spark, sf_dir):
    o = si.table(spark, sf_dir, "orders").withColumns({"d": F.col("o_orderdate").cast("date"), "t": F.col("o_orderdate") + F.expr("INTERVAL 90 MINUTES")})
    return o.select("o_orderkey", tm.header_date(F.col("d")).alias("header"), tm.weekday(F.col("d")).cast("int").alias("weekday"), tm.iso(F.col("t")).alias("iso"), tm.local_time(F.col("t")).alias("local_time"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS page, CASE WHEN o_orderkey % 4 = 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS api FROM orders""")
def dates_parsed(spark, sf_dir):
    d, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "yyyy/M/d")).when(k == 1, F.concat(F.lit("updated "), F.date_format(d, "yyyy年M月d日"))).when(k == 2, F.date_format(d, "(yyyy. M. d)")).otherwise(F.date_format(d, "2024-02-30 yyyy"))
    o = si.table(spark, sf_dir, "orders").select("o_orderkey", text.alias("t"))
    return o.select("o_orderkey", tm.page_date(F.col("t")).cast("string").alias("page"), tm.compact_date(F.col("t")).cast("string").alias("api"))


@query("""WITH v AS (SELECT doc_id, 1 AS version, source AS value FROM documents UNION ALL SELECT doc_id, quality * 2, 'q' || CAST(quality AS VARCHAR) FROM labels)
    SELECT doc_id, arg_max(value, version) AS value, max(version) AS version FROM v GROUP BY doc_id""")
def upsert_latest(spark, sf_dir):
    base = si.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit(1).alias("version"), F.col("source").alias("value"))
    changes = si.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") * 2).alias("version"), F.concat(F.lit("q"), F.col("quality").cast("string")).alias("value"))
    return store.upsert(base, changes).select(F.col("id").alias("doc_id"), "value", "version")


@query("""WITH q AS (SELECT unnest(['0000000007', '0000000003', '0000000007', 'none', '0000000011']) AS id, generate_subscripts(['0000000007', '0000000003', '0000000007', 'none', '0000000011'], 1) AS pos),
    f AS (SELECT id, min(pos) AS pos FROM q GROUP BY id), d AS (SELECT lpad(CAST(doc_id AS VARCHAR), 10, '0') AS id, source FROM documents)
    SELECT d.id, source, CAST(row_number() OVER (ORDER BY pos) AS INTEGER) AS position FROM d JOIN f ON d.id = f.id""")
def multi_get_order(spark, sf_dir):
    d = si.table(spark, sf_dir, "documents").select(F.lpad(F.col("doc_id").cast("string"), 10, "0").alias("id"), "source")
    got = store.multi_get(d.withColumn("n", F.lit(1)), ["0000000007", "0000000003", "0000000007", "none", "0000000011"])
    wanted = F.array_position(F.array(*map(F.lit, ("0000000007", "0000000003", "0000000011"))), F.col("id"))
    return got.select("id", "source", wanted.cast("int").alias("position"))


@query(f"""WITH {si.RUNS} SELECT id, {_sql('started_at')}, CAST(row_number() OVER (ORDER BY runs.started_at DESC, id DESC) AS INTEGER) AS position FROM runs WHERE day = DATE '2024-01-15'""")
def runs_newest_first(spark, sf_dir):
    return store.list_runs(si.runs(spark, sf_dir), "2024-01-15").select("id", _show("started_at"), "position")


@query("SELECT CAST(id AS VARCHAR) AS id FROM (SELECT c_custkey AS id FROM customer UNION ALL SELECT c_custkey + 10000000 FROM customer) WHERE id NOT IN (SELECT o_custkey FROM orders)")
def requested_unknown(spark, sf_dir):
    customers = si.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"))
    asked = customers.unionAll(customers.select(F.col("id") + 10_000_000))
    known = si.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"))
    return config.unknown_requested(known, asked).select(F.col("id").cast("string").alias("id"))


@query("""SELECT c_mktsegment AS type, count(*) AS sources, count(*) FILTER (c_acctbal > 0) AS enabled, count(*) FILTER (c_custkey % 3 = 0) AS not_ok,
    round(count(*) FILTER (c_custkey % 3 = 0) / count(*), 4) AS share FROM customer GROUP BY ALL""")
def config_summary(spark, sf_dir):
    c = si.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("type"), (F.col("c_acctbal") > 0).alias("enabled"))
    return config.summary(c, c.select("id", F.when(F.col("id") % 3 == 0, "unreachable").otherwise("ok").alias("verdict")))


@query()
def selector_candidates(spark, sf_dir):
    from ..sources.listing import selectors

    return selectors(si.table(spark, sf_dir, "pages").select("page_id", "url", "html"))
