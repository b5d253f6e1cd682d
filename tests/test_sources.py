from datetime import UTC, datetime

import pytest

from tidemark.sources import feed, fetch, html, law, listing, settings

PAGE = """<html><head><base href="/n/"><link rel=alternate type="application/rss+xml" href="/f.xml"></head><body><nav><a href=/x>x</a></nav>
<div id=contents><ul class="list news"><li><span class=date>令和8年4月1日</span><a href="1.html" title="T1">One <b>two</b></a>
<li><span class=date>2026/4/2</span><a href="javascript:void(0)">bad</a><li><a href="1.html">again</a><li><span class=date>none</span><a href="https://other.org/2.pdf"><img alt="Pic"></a></ul></div></body></html>"""


def test_listing():
    got = html.listing(PAGE, "https://e.com/a/index.html", "#contents ul.list a", ".date")
    assert [(r["url"], r["title"], r["date_text"]) for r in got] == [("https://e.com/n/1.html", "One two", "令和8年4月1日"), ("https://other.org/2.pdf", "Pic", "none")]
    assert [r["url"] for r in html.listing(PAGE, "https://e.com/", "ul.news li", include=["1.html", ""])] == ["https://e.com/n/1.html"]
    assert html.listing(PAGE, "https://e.com/", "ul.news li", include=[""]) == []
    with pytest.raises(ValueError):
        html.selector("a > b")


def test_page_analysis():
    assert html.advertised_feeds(PAGE, "https://e.com/") == ["https://e.com/f.xml"]


def test_selectors_match_a_walk_of_every_container(spark):
    """Against a count of each container's own links, one container after the other."""
    nested = "<div class=a>" * 40 + "".join(f"<a href=/{k}>x</a>" for k in range(9)) + "</div>" * 40
    pages = [PAGE, nested, "<ul id=u>" + "".join(f"<li class=c{k % 2}><a href=/{k}>" for k in range(12)), "<p>none", "<main><a href=/1><a href=/2><a href=/3><section><a href=/1><a href=/4><a href=/5></section></main>"]
    want = []
    for page, text in enumerate(pages):
        best, by_count = {}, {}
        for node in html.parse(text).walk():
            path, links = html._path(node), len({n.attrs["href"] for n in node.walk() if n.tag == "a" and n.attrs.get("href")})
            if path and links >= 3:
                best[path] = max(best.get(path, (0, 0)), (links, sum(1 for _ in node.ancestors())))
        for path, (links, depth) in best.items():
            if links not in by_count or depth > by_count[links][1]:
                by_count[links] = (path, depth)
        want += [(page, k, f"{path} a", links, depth) for k, (links, (path, depth)) in enumerate(sorted(by_count.items(), reverse=True)[:6])]
    df = spark.createDataFrame([(k, "https://e.com/", t) for k, t in enumerate(pages)], "page_id long, url string, html string")
    assert sorted(tuple(r) for r in listing.selectors(df).collect()) == want and len(want) >= 5


def test_nested_pages_are_quick(spark):
    import time

    began = time.time()
    links = "".join(f"<div class=c><a href=/{k}>" for k in range(1200))
    df = spark.createDataFrame([(1, "https://e.com/", links)], "page_id long, url string, html string")
    assert listing.selectors(df).first().links == 1200
    assert time.time() - began < 30


RSS = """<?xml version="1.0" encoding="UTF-8"?><rss><channel><item><title><![CDATA[A &amp; B]]></title><link>/1</link><pubDate>Sat, 12 Sep 2026 09:00:00 +0900</pubDate></item>
<item><title/><guid isPermaLink="false">zz</guid><link>https://e.com/2%20x</link><pubDate>令和</pubDate></item><item><title>dup</title><link>/1</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>t</title><link rel="edit" href="/e"/><link rel="alternate" href="/a"/><updated>2026-09-12T00:00:00Z</updated><published>2026-09-11T00:00:00Z</published></entry></feed>"""
RDF = """<rdf:RDF xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#" xmlns="http://purl.org/rss/1.0/" xmlns:dc="http://purl.org/dc/elements/1.1/"><item rdf:about="https://e.com/r"><title>r</title><dc:date>2026-09-12</dc:date></item></rdf:RDF>"""
ODD = """<RSS_LIST><ITEM area="1"><TITLE>o</TITLE><URL>https://e.com/o</URL><DATE>2026-09-12 10:30</DATE></ITEM></RSS_LIST>"""


def test_feeds():
    base = "https://e.com/feed"
    got = feed.read(RSS, base)
    assert [(r["url"], r["title"]) for r in got] == [("https://e.com/1", "A & B"), ("https://e.com/2%20x", "2 x")]
    assert got[0]["published_at"] == datetime(2026, 9, 12, tzinfo=UTC) and got[1]["published_at"] is None
    (a,) = feed.read(ATOM, base)
    assert a["url"] == "https://e.com/a" and a["published_at"] == datetime(2026, 9, 11, tzinfo=UTC)
    assert feed.read(RDF, base)[0]["url"] == "https://e.com/r"
    (o,) = feed.read(ODD, base)
    assert (o["url"], o["published_at"]) == ("https://e.com/o", datetime(2026, 9, 12, 1, 30, tzinfo=UTC))
    assert feed.read("<broken", base) == [] and feed.read("", base) == []


NOW = datetime(2026, 9, 13, tzinfo=UTC)


def laws(spark, *raws):
    """(payload's number, url, title, published) of all records."""
    df = spark.createDataFrame([(str(k), bytearray(r.encode()), "application/json", 30) for k, r in enumerate(raws)], "source_id string, body binary, content_type string, lookback_days int")
    return sorted((int(r.source_id), r.ord, r.url.removeprefix(law.LAW_URL), r.title, r.published_at) for r in law.records(df, NOW).collect())


def test_law_records(spark):
    got = laws(
        spark,
        '{"law_revisions":[{"law_id":"L1","law_name":"N1","amendment_date":"2026-09-10"},{"law_id":"L2","law_name":"N2","amendment_date":"2020-01-01"},{"lawId":"L3","law_info":{"law_title":"N3"}}]}',
        "<r><law><LawId type='x'>L1</LawId><LawName>N1</LawName><Date>20260910</Date></law><law><LawId>L2</LawId><LawName>N2</LawName><Date>20200101</Date></law><law><LawId>L3</LawId><LawName lang='ja'>N3</LawName></law></r>",
        '{"a":{"law_id":"A","name":"own","deep":{"law_name":"below","date":"x"}},"b":[{"law_num":"n"},{"law_id":"B"}]}',
        '[{"law_id":"I1"},{"law_id":"I1"},{"law_id":2}]',
        '{"date":"2026-09-01","promulgationdate":"2026-09-12","law_id":"D","name":"d"}',
    )
    day = datetime(2026, 9, 9, 15)
    assert got[:4] == [(0, 0, "L1", "N1", day), (0, 1, "L3", "N3", None), (1, 0, "L1", "N1", day), (1, 1, "L3", "N3", None)]
    assert got[4:] == [(2, 0, "A", "below", None), (3, 0, "I1", "I1", None), (3, 1, "2", "2", None), (4, 0, "D", "d", datetime(2026, 9, 11, 15))]


def test_law_malformed(spark):
    raws = ["", "1", "null", '"x"', "[]", "{}", '{"a":', "<", "[[[[[[[[[[[[[[{}]]]]]]]]]]]]]]", '[1,{"a":[null]}]', "[" * 2000 + "]" * 2000]
    assert laws(spark, *raws) == []


def test_charset():
    body = '<meta charset="Shift_JIS">表示'.encode("cp932")
    assert fetch.decode(body, "text/html").endswith("表示") and fetch.decode("é".encode("latin-1"), "text/plain; charset=iso-8859-1") == "é"
    assert fetch.decode(b"\x00", "image/png") == "" and fetch.charset(b"", "text/html; charset=nope") == "utf-8"
    assert [fetch.retryable(s) for s in (None, 429, 503, 404)] == [True, True, True, False] and fetch.backoff(3) == 8


def test_candidates_from_snapshots(spark):
    row = lambda s, k, b, **x: (s, k, "https://e.com/a/", None, x.get("status", 200), "text/html", b.encode(), x.get("sel"), x.get("date"), None, None, None, 30)
    snaps = spark.createDataFrame([row("h", "html", PAGE, sel="#contents a", date=".date"), row("f", "feed", RSS), row("n", "feed", RSS, status=304), row("l", "law", '{"law_id":"L1","law_name":"N"}')], listing.SNAPSHOT)
    got = listing.candidates(snaps, NOW)
    assert sorted((r.source_id, r.ord) for r in got.collect()) == [("f", 0), ("f", 1), ("h", 0), ("h", 1), ("l", 0)]
    assert got.where("source_id = 'h' and ord = 0").first().published_at == datetime(2026, 3, 31, 15)
    status = {r.source_id: (r.ok, r.not_modified, r.n_candidates) for r in listing.fetch_status(snaps, got).collect()}
    assert status == {"h": (True, False, 2), "f": (True, False, 2), "n": (True, True, 0), "l": (True, False, 1)}


def test_internal_addresses_are_not_fetched(monkeypatch):
    for url in ("http://127.0.0.1/", "http://[::1]/x", "http://100.64.0.9/", "http://169.254.169.254/latest/meta-data"):
        assert fetch.Polite().get(url)[-1] == "internal address"
        with pytest.raises(fetch.Refused):
            fetch.open_url(url, {})
    with pytest.raises(fetch.Refused):
        fetch._Redirects().redirect_request(None, None, 302, "", {}, "http://10.0.0.1/")


class Answers:
    """An opener that answers by URL: a body, a status, or an error; it keeps what it was asked."""

    def __init__(self, pages):
        self.pages, self.asked = pages, []

    def __call__(self, url, headers, method="GET"):
        import io
        import urllib.error

        self.asked.append(url)
        got = self.pages.get(url, 404)
        if isinstance(got, Exception):
            raise got
        if isinstance(got, int):
            raise urllib.error.HTTPError(url, got, "x", {}, io.BytesIO())
        r = io.BytesIO(got.encode())
        r.status, r.url, r.headers = 200, url, {"Content-Type": "text/html"}
        return r


def test_robots_rules_are_read_through_the_guarded_opener(monkeypatch):
    rules = "User-agent: *\nDisallow: /private"
    for robots, allowed in ((rules, [True, False]), (404, [True, True]), (503, [True, True]), (fetch.Refused("redirect to an internal address"), [True, True]), (OSError("timed out"), [True, True])):
        answers, waits = Answers({"https://e.com/robots.txt": robots, "https://e.com/a": "a", "https://e.com/private/b": "b"}), []
        polite = fetch.Polite(answers, 2.0, waits.append)
        got = [polite.get(f"https://e.com/{p}") for p in ("a", "private/b")]
        assert [g[1] == 200 for g in got] == allowed and (allowed[1] or got[1][-1] == fetch.ROBOTS)
        assert answers.asked.count("https://e.com/robots.txt") == 1 and waits == [2.0] * (len(answers.asked) - 1)
    # what a site's rules redirect to is checked like any other address
    opened = []
    monkeypatch.setattr(fetch.urllib.request, "build_opener", lambda handler: opened.append(handler) or (_ for _ in ()).throw(OSError("off")))
    fetch.Polite(pause_s=0).robots("https://e.com/x")
    assert opened == [fetch._Redirects]


def test_pages_are_read_by_host_within_the_time(spark):
    asked = spark.createDataFrame([(str(k), f"https://h{k % 3}.example/{k}") for k in range(12)], "id string, canonical_url string")
    pages = {f"https://h{k % 3}.example/{k}": f"<title>{k}</title>" for k in range(12) if k != 4}

    def opener(url, headers, method="GET"):
        import io
        import urllib.error

        if url not in pages:
            raise urllib.error.HTTPError(url, 404, "x", {}, io.BytesIO())
        r = io.BytesIO(pages[url].encode())
        r.status, r.url, r.headers = 200, url, {"Content-Type": "text/html"}
        return r

    got = {r.id: r for r in fetch.read_pages(asked, opener, pause_s=0).collect()}
    assert len(got) == 12 and got["3"].body == b"<title>3</title>" and (got["4"].status, got["4"].body) == (404, None)
    assert fetch.read_pages(asked, opener, pause_s=0).rdd.getNumPartitions() <= fetch.HOSTS_AT_ONCE
    # time runs out after a task's second page
    tick = lambda t=[0]: t.__setitem__(0, t[0] + 1) or t[0]  # noqa: E731, B006
    late = fetch.read_pages(asked.where("id in ('0', '3', '6', '9')"), opener, budget_s=3, pause_s=0, clock=tick).collect()
    assert sorted(r.error is None for r in late) == [False, False, True, True] and {r.error for r in late} == {None, fetch.LATE}


def test_probe_asks_again_where_head_is_refused():
    import io
    import urllib.error

    def opener(answers):
        asked = []

        def call(url, headers, method):
            asked.append(method)
            status = answers[method]
            if status is None:
                raise OSError("no route")
            if status >= 400:
                raise urllib.error.HTTPError(url, status, "x", {}, io.BytesIO())
            r = io.BytesIO()
            r.status = status
            return r

        return call, asked

    for answers, status, methods in (({"HEAD": 200}, 200, ["HEAD"]), ({"HEAD": 405, "GET": 200}, 200, ["HEAD", "GET"]), ({"HEAD": 404}, 404, ["HEAD"]), ({"HEAD": 403, "GET": 403}, 403, ["HEAD", "GET"]), ({"HEAD": None}, None, ["HEAD"])):
        call, asked = opener(answers)
        assert fetch.probe("https://e.com/", call)[0] == status and asked == methods


def test_no_more_hosts_at_once_than_allowed():
    urls = [[str(k), f"https://h{k % 7}.example/{k}"] for k in range(20)]
    import json

    parts = fetch.PoliteReader({"sources": json.dumps(urls)}).partitions()
    assert len(parts) == fetch.HOSTS_AT_ONCE and sorted(x for p in parts for h in p.hosts for x in h) == sorted(map(tuple, urls))
    assert all(len({u.split("/")[2] for _, u in h}) == 1 for p in parts for h in p.hosts)


def test_polite_source_is_off_by_default(spark):
    spark.dataSource.register(fetch.PoliteSource)
    df = spark.read.format("polite_http").option("sources", '[["a","https://x.example/1"],["b","https://y.example/"],["c","https://x.example/2"]]').load()
    assert df.rdd.getNumPartitions() == 2 and {r.error for r in df.collect()} == {"network access is off"}


def test_settings(tmp_path):
    (tmp_path / "b.json").write_text('[{"id": "${NAME}"}]')
    (tmp_path / "a.json").write_text('{"id": "x"}')
    assert settings.load_folder(str(tmp_path), {"NAME": "y"}) == [{"id": "x"}, {"id": "y"}]
    with pytest.raises(settings.ConfigError, match="NAME is not set"):
        settings.load_folder(str(tmp_path), {})
    assert settings.Settings.from_env({"RETENTION_DAYS": "30"}).retention_days == 30
    with pytest.raises(settings.ConfigError):
        settings.Settings.from_env({"RETENTION_DAYS": "0", "DRY_RUN": "maybe"})


def test_configuration_rows_tell_every_fault(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"kind": "source", "id": "${NAME}"}, 7]')
    (tmp_path / "b.json").write_text('{"id": "x", "token": "${SECRET_VALUE}" oops}')
    (tmp_path / "c.json").write_text('{"id": "${MISSING} ${MISSING} ${OTHER}"}')
    (tmp_path / "d.yaml").write_text("a: [1, 2\nb: }")
    (tmp_path / "e.txt").write_text("not read")
    rows = [tuple(r) for r in settings.config_rows(spark, str(tmp_path), {"NAME": "y", "SECRET_VALUE": "very-secret-thing"}).orderBy("file", "ord", "error").collect()]
    assert rows[1] == ("a.json", 0, '{"kind": "source", "id": "y"}', None) or rows[0] == ("a.json", 0, '{"kind": "source", "id": "y"}', None)
    assert [r[3] for r in rows if r[0] == "a.json"] == [None, "not a record"] and [r[3] for r in rows if r[0] == "c.json"] == ["MISSING is not set", "OTHER is not set"]
    assert [r[0] for r in rows if r[3]] == ["a.json", "b.json", "c.json", "c.json", "d.yaml"] and not any("very-secret" in (r[3] or "") for r in rows)
    with pytest.raises(settings.ConfigError):
        settings.load_folder(str(tmp_path), {"NAME": "y"})
    with pytest.raises(settings.ConfigError, match="https URL"):
        settings.Settings.from_env({"BROADCAST_URL": "http://x"})
