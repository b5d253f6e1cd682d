import os
import re

import pytest
from pyspark.sql import functions as F

from tidemark.sources import html, listing, nodes

SF_PAGES = "/root/testdata/sf0.001/pages.parquet"
PAGE = """<html><head><base href="/n/"><title> A  title</title><title>second</title></head><body><nav><a href=/x>x</a></nav>
<div id=contents><ul class="list news"><li><span class=date>令和8年4月1日</span><a href="1.html" title="T1">One <b>two</b></a>
<li><span class=date>2026/4/2</span><a href="javascript:void(0)">bad</a><li><a href="1.html">again</a><li><span class=date> </span><a href="https://other.org/2.pdf"><img alt="Pic"></a>
<li class=date>own <a href="own.html" aria-label="Label"></a><li><div><div><a href="deep.html">deep</a></div></div><li><a>none</a><li><a href=" ">blank</a></ul></div></body></html>"""
ARTICLE = """<body class="page"><div class="sidebar"><p>Short, links <a href=/a>one</a>, <a href=/b>two</a> and some more words in it, so it counts</p></div>
<div class="story"><h1>Head</h1><p>First paragraph, with a comma, and then quite a lot of words that go on and on until there are enough of them.</p><p>Second one, also long enough to be counted as a paragraph of the text.</p><script>x()</script></div>
<div class="story"><p>Another part of the story, of the same class, which belongs to it as well, and goes on.</p></div><p>A long paragraph beside the containers that holds no links at all and so belongs to the article too, by its length.</p>
<p><a href=/c>A long paragraph that is one link and so does not belong to the article, however long it may become.</a></p></body>"""


def _pages(spark, *bodies, **options):
    rows = [(str(k), "https://e.com/a/index.html", "text/html", bytearray(b.encode()), options.get("item"), options.get("date"), options.get("title_from", "text"), options.get("include"), options.get("exclude")) for k, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "key string, url string, content_type string, body binary, item_selector string, date_selector string, title_from string, include array<string>, exclude array<string>")


DEEP = "<div class=c>" * 60 + '<p class="date">2026/1/1</p><a href=/d>deep</a>' + "</div>" * 60


@pytest.mark.parametrize(("item", "date", "options"), [("#contents ul.list a", ".date", {}), ("a", ".date", {}), ("li", "span.date", {"title_from": "attr"}), ("ul.news li", "ul .date", {"include": ["1.html", ""]}), ("li", None, {"exclude": ["1.html"]}), ("div div div a", "div .date", {}), ("nav ul a", None, {}), ("a", None, {"include": [""]})])
def test_listings_from_node_rows_are_those_of_a_walk(spark, item, date, options):
    bodies = [PAGE, DEEP, "", "<p>none", "<ul><li><a href=/1>1</a><li><b>x</b></ul><base href=/late/>"]
    got = nodes.listed(_pages(spark, *bodies, item=item, date=date, **options)).collect()
    want = [(str(k), r["ord"], r["url"], r["title"], r["date_text"]) for k, b in enumerate(bodies) for r in html.listing(b, "https://e.com/a/index.html", item, date, options.get("title_from", "text"), options.get("include") or [], options.get("exclude") or [])]
    assert sorted(map(tuple, got)) == sorted(want)


def plain_scores(text):
    """By walking every container's own subtree."""
    root = html.parse(text)
    number = {id(n): k for k, n in enumerate(x for x in _all(root))}
    solid = lambda s: len(re.sub(r"\s", "", s))
    skip = (*html.NOISE, "title", "head")
    real = [n for n in root.walk() if n.tag not in skip and not any(u.tag in skip for u in n.ancestors())]
    passed = {}
    for n in real:
        own = n.text(skip)
        if n.tag in nodes._PARAGRAPH and solid(own) >= nodes.LEAST_CHARS:
            points = 1 + len(re.findall("[,、,,]", own)) + min(solid(own) // 100, 3)
            for level, up in enumerate(list(n.ancestors())[: nodes.NEAR]):
                passed[id(up)] = passed.get(id(up), 0) + points * (1 if level == 0 else 0.5 if level == 1 else 1 / (3 * level))
    out = {}
    for n in real:
        if id(n) in passed:
            names = " ".join([*n.attrs.get("class", "").split(), n.attrs.get("id", "")]).lower()
            start = nodes._TAG_SCORE.get(n.tag, 0) + (25 if re.search(nodes._FOR, names) else 0) - (25 if re.search(nodes._AGAINST, names) else 0)
            chars = solid(n.text(skip))
            links = sum(solid(a.text(skip)) for a in n.walk() if a in real and a.tag == "a" and a.attrs.get("href") and not any(u.tag == "a" and u.attrs.get("href") and u in list(n.walk()) for u in a.ancestors()))
            out[number[id(n)]] = (start + passed[id(n)]) * (1 - (links / chars if chars else 0))
    return out


def _all(root):
    stack = [root]
    while stack:
        n = stack.pop()
        yield n
        if isinstance(n, html.Node):
            stack += reversed(n.children)


def test_scores_are_those_of_a_walk(spark):
    bodies = [PAGE, ARTICLE, DEEP, "", "<table><tr><td>" + "cell, " * 30 + "</td></tr></table>", "<section><h2>" + "heading " * 9 + "</h2><p>" + "x" * 30 + "</p></section>"]
    if os.path.isfile(SF_PAGES):
        bodies += [r.html for r in spark.read.parquet(SF_PAGES).where("page_id % 10 = 3").collect()]
    got = nodes.container_scores(nodes.nodes_of(_pages(spark, *bodies))).where("score is not null").collect()
    want = {(str(k), pre): score for k, b in enumerate(bodies) for pre, score in plain_scores(b).items()}
    assert {(r.key, r.pre) for r in got} == set(want) and len(want) > 8
    assert all(abs(r.score - want[r.key, r.pre]) < 1e-9 for r in got)


def test_articles(spark):
    plain = "<title>T</title><body><nav>menu</nav><article><p>" + "word " * 30 + "</p><script>x()</script></article><footer>f</footer>"
    bodies = [ARTICLE, plain, "<body>short<footer>f</footer></body>", "<p>unclosed <b>x", "", "<div>" * 2000 + "text " * 50 + "</div>" * 2000, PAGE]
    got = {r.key: (r.text, r.title) for r in nodes.articles(_pages(spark, *bodies)).collect()}
    text = got["0"][0]
    assert text.startswith("HeadFirst paragraph") and "Another part" in text and "beside the containers" in text and "sidebar" not in text and "one link" not in text and "Short, links" not in text and "x()" not in text
    assert got["1"] == (("word " * 30).strip(), "T") and got["2"] == ("short", "") and got["3"] == ("unclosed x", "") and got["4"] == ("", "")
    assert got["5"][0].startswith("text text") and got["6"][1] == "A title"
    assert all(len(r.text) <= 50 for r in nodes.articles(_pages(spark, *bodies), limit=50).collect())


def test_extraction_never_fails(spark):
    rows = [("a", "text/html", ARTICLE.encode()), ("b", "application/pdf", b"%PDF-1.7"), ("c", "text/plain", b" a \n b "), ("d", None, None), ("e", "image/png", b"\x89PNG"), ("f.PDF", "text/html", b"%PDF-1.4 x")]
    df = spark.createDataFrame([(u, c, bytearray(b) if b is not None else None) for u, c, b in rows], "url string, content_type string, body binary")
    got = {r.url: (r.kind, r.text[:4], r.title) for r in listing.extracted(df).collect()}
    assert got == {"a": ("html", "Head", ""), "b": ("pdf", "", ""), "c": ("text", "a b", ""), "d": ("html", "", ""), "e": ("html", "", ""), "f.PDF": ("pdf", "", "")}


def test_texts_are_whole(spark, tmp_path):
    """Also past the 6,000 characters that a collection stores of a page."""
    import duckdb

    from tidemark.plans import readers

    long = " many  words, \U00020BB7 and\u3000more\n" * 900 + "the end "
    spark.createDataFrame([(k, long if k < 8 else "\x1c short") for k in range(12)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = readers.QUERIES["main_text_extracted"](spark, str(tmp_path)).collect()
    whole = "many words, \U00020BB7 and more " * 900 + "the end"
    assert {r.url: r.text for r in got if int(r.url) < 8} == {str(k): "" if k % 4 == 2 else whole for k in range(8)} and len(whole) > 20_000
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.execute(readers.ORACLE_SQL["main_text_extracted"]).fetchall())
    # without a container, and what a collection stores
    loose = _pages(spark, "<body>" + "word " * 3000).select(F.col("key").alias("id"), F.lit(200).alias("status"), "content_type", "body", F.lit(None).cast("string").alias("error"))
    loose = loose.unionAll(loose.withColumns({"id": F.lit("plain"), "content_type": F.lit("text/plain")}))
    assert {len(r.text) for r in listing.extracted(loose.withColumnRenamed("id", "url")).collect()} == {14_999, 14_999 + len("<body>")}
    assert [len(r.content_text) for r in listing.page_texts(loose).collect()] == [6000, 6000]


def _plan(df):
    return df._jdf.queryExecution().toString()


def _reads(df):
    """How often a plan reads pages' markup."""
    return len(re.findall("MapIn(?:Arrow|Pandas)", df._jdf.queryExecution().executedPlan().toString()))


def test_articles_read_each_page_once(spark):
    assert _reads(nodes.articles(_pages(spark, ARTICLE))) == 1


def test_scores_read_each_page_once(spark):
    assert _reads(nodes.container_scores(nodes.nodes_of(_pages(spark, ARTICLE)))) == 1


@pytest.mark.parametrize("date", [".date", None])
def test_listings_read_each_page_once_and_go_through_it_once(spark, date):
    found = nodes.listed(_pages(spark, PAGE, item="li", date=date))
    # a frame that shrinks from row to row takes the square of a page's nodes
    assert _reads(found) == 1 and "RowFrame, 1, unboundedfollowing" not in _plan(found)


def test_many_nodes(spark):
    many = "<ul>" + "".join(f'<li><a href="/{k}">n {k}</a><span class=date>2026/1/{k % 28 + 1}</span>' for k in range(3000)) + "</ul>"
    got = nodes.listed(_pages(spark, many, item="li", date=".date")).orderBy("ord").collect()
    assert [(r.ord, r.url, r.title, r.date_text) for r in got] == [(k, f"https://e.com/{k}", f"n {k}", f"2026/1/{k % 28 + 1}") for k in range(3000)]


def test_titles_of_pages_that_share_a_url(spark, tmp_path):
    import duckdb

    from tidemark.plans import readers

    rows = [(1, "https://e.com/a", "<title>One &amp; two</title>"), (2, "https://e.com/a", "<title>Other</title>"), (3, "https://e.com/b", "<title>cut &amp;&amp</title>x"), (4, None, "<title>&lt; a  b </title>")]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = readers.QUERIES["page_titles_extracted"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.execute(readers.ORACLE_SQL["page_titles_extracted"]).fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and len(want) == 4


def test_decoded_texts_come_in_batches_of_bounded_size():
    import pyarrow as pa

    bodies = [b"x" * 1000] * 100 + [None, b""]
    part = pa.record_batch([pa.array([str(k) for k in range(102)]), pa.array(["text/html"] * 102), pa.array(bodies, pa.binary())], ["url", "content_type", "body"])
    got = list(listing.decoded_batches(iter([part]), 10_000))
    assert [b.num_rows for b in got] == [10] * 10 + [2] and pa.Table.from_batches(got)["text"].to_pylist() == ["x" * 1000] * 100 + ["", ""]


def test_decoding_reads_few_pages_at_a_time(spark):
    from tidemark.sources import fetch

    listing.decoded(_pages(spark, "a"))
    assert 0 < int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= fetch.BATCH_PAGES


def test_selectors_deal_links_once(spark):
    pages = spark.createDataFrame([(1, "https://e.com/", '<ul class="l">' + "".join(f'<li><a href="/{k}">x</a>' for k in range(4)) + "</ul>"), (2, None, None)], "page_id long, url string, html string")
    found = listing.selectors(pages)
    assert found.collect() == [(1, 0, "ul.l a", 4, 1)]
    assert len(re.findall(r"[+:]- Exchange", found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0])) == 1


def test_pages_of_one_file_are_read_by_several_tasks(spark, tmp_path):
    from tidemark.plans import readers

    spark.range(40).selectExpr("id AS page_id", "'u' AS url", "concat('<div><p>', repeat('word, ', 10), id, '</p></div>') AS html").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    got = readers.QUERIES["article_scores"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(key" in plan.split("MapInArrow")[-1] and got.count() == 80
    one = _pages(spark, *([ARTICLE] * 20)).coalesce(1)
    assert nodes.nodes_of(nodes.dealt(one)).select(F.spark_partition_id()).distinct().count() > 1


def test_rows_without_texts_are_the_others(spark):
    for body in (ARTICLE, PAGE, "", "<p>a, b<br>c <a href=/x>d</a>", "x"):
        root = html.parse(body)
        assert nodes.node_rows("k", root, False) == [r for r in nodes.node_rows("k", root) if r[4] != "#text"]


def test_listings_keep_their_tasks(spark):
    pages = _pages(spark, *[PAGE] * 20, item="a")
    found = nodes.listed(nodes.dealt(pages), 1)
    got = found.groupBy("key").count().collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    # the adaptive planner joins no tasks of a shuffle by number
    assert len(got) == 20 and "REPARTITION_BY_NUM" in plan.split("MapInArrow")[0] and "REPARTITION_BY_NUM" in plan.split("MapInArrow")[-1]
