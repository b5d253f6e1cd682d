from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text, time, urls

URLS = [
    ("HTTP://Example.COM/a/", "https://example.com/a"), ("http://example.com:80/", "https://example.com/"), ("https://example.com:443/x?b=2&a=1", "https://example.com/x?a=1&b=2"),
    ("https://example.com/x?utm_source=q&a1=1&a=2", "https://example.com/x?a=2&a1=1"), ("https://example.com./p//q///", "https://example.com/p/q"), ("https://example.com/#top", "https://example.com/"),
    ("https://u:p@example.com/x?FBCLID=1", "https://u:p@example.com/x"), ("https://example.com/x?k&a=", "https://example.com/x?a=&k="), ("https://example.com:8080/x", "https://example.com:8080/x"),
    ("mailto:a@b.c#x", "mailto:a@b.c"), ("no url", None), (None, None), ("https://example.com/x?b=2&a=1&b=1", "https://example.com/x?a=1&b=2&b=1"),
]


def test_canonical_url_forms_agree(spark):
    df = spark.createDataFrame([(u,) for u, _ in URLS], "u string")
    got = [r.c for r in df.select(urls.canonical_url(F.col("u")).alias("c")).collect()]
    assert got == [w for _, w in URLS]
    assert [urls.canonicalise(u) for u, _ in URLS] == [w for _, w in URLS]
    df = df.withColumn("b", F.lit(None).cast("string"))
    assert [r.c for r in df.select(urls.canonical_url_general("u", "b").alias("c")).collect()] == [w for _, w in URLS]


@pytest.mark.parametrize(("raw", "base", "want"), [
    ("../x/./y", "https://e.com/a/b/c", "https://e.com/a/x/y"), ("/ä b", "https://e.com", "https://e.com/%C3%A4%20b"), ("//other.org/z/", "https://e.com", "https://other.org/z"),
    ("https://bücher.example/", None, "https://xn--bcher-kva.example/"), ("https://e.com/a?q=x+y&p=%7E", None, "https://e.com/a?p=%7E&q=x+y"), ("http://[::1", None, None), ("https://e.com:99999/", None, None),
])
def test_canonicalise(raw, base, want):
    assert urls.canonicalise(raw, base) == want


def test_url_filters(spark):
    one = spark.range(1)
    arr = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<string>")
    u = F.lit("https://e.com/news/1.html")
    got = one.select(urls.allowed(u, arr("news"), arr()), urls.allowed(u, arr(""), arr()), urls.allowed(u, arr(), arr("1")), urls.allowed(u, arr(), arr("")), urls.is_http(F.lit("javascript:x"))).first()
    assert tuple(got) == (True, False, False, True, False)
    hosts = [("http://localhost/x", True), ("http://10.1.2.3/", True), ("https://172.20.0.1/", True), ("https://172.40.0.1/", False), ("https://example.com", False)]
    assert [r[0] for r in spark.createDataFrame(hosts, "u string, w boolean").select(urls.is_internal(F.col("u"))).collect()] == [w for _, w in hosts]
    assert one.select(urls.title_from_url(F.lit("https://e.com/a/b%20c+d/"))).first()[0] == "b c+d"


def test_dates(spark):
    rows = [("令和8年4月1日", date(2026, 4, 1)), ("R元年5月1日 x", date(2019, 5, 1)), ("2026年2月30日", None), ("on 2026.4.1", date(2026, 4, 1)), ("x 2026/04/09 2020/01/01", date(2026, 4, 9)), ("none", None), (None, None)]
    got = spark.createDataFrame(rows, "t string, w date").select(time.page_date(F.col("t"))).collect()
    assert [r[0] for r in got] == [w for _, w in rows]
    rows = [("2026-02-29", None), ("2024-02-29", date(2024, 2, 29)), ("0050-01-01", None), ("2026-1-1", None)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string, w date").select(time.valid_date(F.col("t"))).collect()] == [w for _, w in rows]
    rows = [("20260401", date(2026, 4, 1)), ("2026/4/1", date(2026, 4, 1)), ("20261301", None)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string, w date").select(time.compact_date(F.col("t"))).collect()] == [w for _, w in rows]


@pytest.mark.parametrize(("ts", "day"), [("2026-09-12 21:59:59.999", date(2026, 9, 13)), ("2026-09-12 22:00:00", date(2026, 9, 14)), ("2026-09-13 21:59:59.999", date(2026, 9, 14))])
def test_business_day_edges(spark, ts, day):
    t = F.lit(ts).cast("timestamp_ntz")
    assert spark.range(1).select(time.business_day(t)).first()[0] == day
    start, end = time.window_of(day)
    assert start <= datetime.fromisoformat(ts) < end


def test_header_date_and_iso(spark):
    got = spark.range(1).select(time.header_date(F.lit("2026-09-13").cast("date")), time.weekday(F.lit("2026-09-13").cast("date")), time.iso(F.lit("2026-09-12 22:30:00").cast("timestamp_ntz"))).first()
    assert tuple(got) == ("9/13(日)", 0, "2026-09-12T22:30:00.000Z")


def test_text(spark):
    one = spark.range(1)
    assert one.select(text.one_line(F.lit(" a　 b\n\nc "))).first()[0] == "a b c"
    assert one.select(text.is_blank(F.lit("　 \t")), text.is_blank(F.lit(None).cast("string")), text.is_blank(F.lit("\x85"))).first() == (True, True, False)
    found = one.select(text.first_banned([("h", F.lit("ok")), ("s", F.lit("早めの準備が望ましいです。必要です"))])).first()[0]
    assert tuple(found) == ("s", "望ましい")
    assert one.select(text.first_banned([("h", F.lit("ok"))])).first()[0] is None
    assert one.select(text.annotate_region(F.lit("h"), F.lit("s"), F.lit("x"), F.lit("大阪府(大阪市)"))).first()[0] == "大阪府・x"
    assert text.decode_entities("&amp;lt; &#x41;&#0; &nope; &AMP;") == "&lt; A&#0; &nope; &"
    got = one.select(text.redact_map(F.create_map(F.lit("api_key"), F.lit("v"), F.lit("m"), F.lit("use Bearer abc.def now")))).first()[0]
    assert got == {"api_key": "***", "m": "use *** now"}
