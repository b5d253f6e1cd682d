"""Pages as rows of nodes. Python reads the markup; what a page lists and which of its text is the article is decided in Spark.

A node has its place in the page (pre) and that of its last descendant (last), so that "inside" is an interval, and as
intervals nest, one running maximum over a page tells whether a row lies inside any of a set of nodes. Its
text is a range of the page's whole text, which only the row of the root holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import NOISE, one_line
from ..functions.urls import allowed, is_http
from . import fetch, html

NODE = "key string, pre int, last int, parent int, tag string, ident string, classes array<string>, href string, title string, label string, alt string, up array<int>, within int, begins int, ends int, chars int, commas int, linked int, text string"
#: What a node is or lies in, as bits of `within`.
NOISY, HEADED, LINKED, BODIED, TITLED = 1, 2, 4, 8, 16
#: A batch of node rows ends with the page that reaches so many rows or characters.
BATCH_ROWS, BATCH_CHARS = 10_000, 1 << 21
#: Ancestors that a node knows.
NEAR = 5
_STOP = ("body", "html", "#root")

#: What tags add to a container's score, and names that speak for and against one.
_TAG_SCORE = {"div": 5, "pre": 3, "td": 3, "blockquote": 3, "address": -3, "ol": -3, "ul": -3, "dl": -3, "dd": -3, "dt": -3, "li": -3, "form": -3, "h1": -5, "h2": -5, "h3": -5, "h4": -5, "h5": -5, "h6": -5, "th": -5}
_FOR = "article|body|content|entry|main|page|post|text|blog|story"
_AGAINST = "hidden|banner|comment|footer|masthead|media|meta|promo|related|scroll|share|sidebar|sponsor|shopping|tags|widget"
#: Paragraphs, and the characters that one needs to count.
_PARAGRAPH, LEAST_CHARS = ("p", "td", "pre", "section", "h2", "h3", "h4", "h5", "h6"), 25


def _bits(node: html.Node) -> int:
    tag = node.tag
    return NOISY * (tag in NOISE) | HEADED * (tag in ("title", "head")) | LINKED * (tag == "a" and node.attrs.get("href", "") != "") | BODIED * (tag == "body") | TITLED * (tag == "title")


def node_rows(key: str | None, root: html.Node, texts: bool = True) -> list[list]:
    """Rows of NODE for a parsed page, in the page's order; pieces of text are rows of the tag #text, left out without `texts` (their places
    stay free). chars (without spaces), commas and linked (characters in links) are those of a node's text outside noise, title and head."""
    rows: list[list] = []
    parts: list[str] = []
    n = at = solid = commas = linked = 0
    stack: list[tuple] = [(root, -1, (), 0)]
    while stack:
        node, parent, up, within = stack.pop()
        if node is None:  # the end of the node whose row is `parent`
            row = parent
            row[2], row[14] = n - 1, at
            row[15], row[16], row[17] = solid - row[15], commas - row[16], linked - row[17]
            continue
        pre = n
        n += 1
        if isinstance(node, str):
            mine = [0, 0, 0]
            if not within & (NOISY | HEADED):
                mine[0], mine[1] = len(node) - sum(map(node.count, " \t\n\x0b\f\r")), sum(map(node.count, ",、"))
                solid, commas = solid + mine[0], commas + mine[1]
                if within & LINKED:
                    mine[2] = mine[0]
                    linked += mine[2]
            if texts:
                rows.append([key, pre, pre, parent, "#text", None, [], None, None, None, None, up, within, at, at + len(node), *mine, node])
            parts.append(node)
            at += len(node)
            continue
        attrs, within = node.attrs, within | _bits(node)
        if attrs:
            row = [key, pre, pre, parent, node.tag, attrs.get("id"), attrs.get("class", "").split(), attrs.get("href"), attrs.get("title"), attrs.get("aria-label"), attrs.get("alt"), up, within, at, at, solid, commas, linked, None]
        else:
            row = [key, pre, pre, parent, node.tag, None, [], None, None, None, None, up, within, at, at, solid, commas, linked, None]
        rows.append(row)
        if node.children:
            stack.append((None, row, (), 0))
            below = (pre, *up)[:NEAR]
            stack += [(c, pre, below, within) for c in reversed(node.children)]
        else:
            row[15] = row[16] = row[17] = 0
    rows[0][18] = "".join(parts)
    return rows


def dealt(rows: DataFrame) -> DataFrame:
    """Pages, or rows of them, by key over as many tasks as a shuffle has: what is made of each costs more than moving it, files may be few
    or large, and tasks that adaptive execution has joined by their bytes are often one more than there are cores, which takes twice as long."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")


def nodes_of(pages: DataFrame, texts: bool = True) -> DataFrame:
    """Node rows of pages (key, content_type, body), without pieces of text unless `texts`. Each page is read once; what follows should need it once."""
    text, number = pa.string(), pa.int32()
    kinds = {"string": text, "int": number, "array<string>": pa.list_(text), "array<int>": pa.list_(number)}
    schema = pa.schema([(c.split(" ")[0], kinds[c.split(" ")[1]]) for c in NODE.split(", ")])

    def batch(rows: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, chars = [], 0
        for part in batches:
            for key, kind, body in zip(*part.columns, strict=True):  # a page's bytes at a time
                text = fetch.decode(body.as_py(), kind.as_py() or "") if body.is_valid else ""
                rows += node_rows(key.as_py(), html.parse(text), texts)
                chars += len(text)
                if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                    yield batch(rows)
                    rows, chars = [], 0
        if rows:
            yield batch(rows)

    fetch.short_batches(pages.sparkSession)
    return pages.select("key", "content_type", "body").mapInArrow(run, NODE)


def _rows(start: int, end: int):
    """A page's rows in its order, from one place to another around each."""
    return W.partitionBy("key").orderBy("pre").rowsBetween(start, end)


def _inside(which: Column, itself: bool = False) -> Column:
    """Whether a row lies below one of the nodes, or, with `itself`, is or lies below one."""
    return F.coalesce(F.max(F.when(which, F.col("last"))).over(_rows(W.unboundedPreceding, 0 if itself else -1)) >= F.col("pre"), F.lit(False))


def _next(which: Column, value: Column) -> Column:
    """value of the next of the nodes in the page's order: the last one on the way back from the page's end, as a frame that shrinks
    would be gone through anew for every row."""
    back = W.partitionBy("key").orderBy(F.desc("pre")).rowsBetween(W.unboundedPreceding, -1)
    return F.last(F.when(which, value), ignorenulls=True).over(back)


def _fits(step: Column) -> Column:
    """Whether a step (tag, ids, classes) of a selector matches a node by itself; null where there is none."""
    return (step["tag"].isNull() | (step["tag"] == F.col("tag"))) & F.forall(step["ids"], lambda i: i == F.coalesce("ident", F.lit(""))) & (F.size(F.array_except(step["classes"], "classes")) == 0)


def _marked(nodes: DataFrame, most: int, **marks: str) -> DataFrame:
    """nodes with a column for each of marks: whether the selector in the column that it names, an array of steps at most as long as `most`,
    matches them. A step of all selectors takes one pass over a page."""
    for name in marks:
        nodes = nodes.withColumns({f"__in_{name}": F.lit(True), name: F.lit(False)})
    for k in range(most):
        done = {}
        for name, steps in marks.items():
            fits = F.coalesce(F.col(f"__in_{name}") & _fits(F.get(steps, F.lit(k))), F.lit(False))
            # of a shorter selector the last step stays the one that decides
            done[name] = F.when(F.lit(k) >= F.coalesce(F.size(steps), F.lit(0)), F.col(name)).otherwise(fits)
        nodes = nodes.withColumns(done)
        nodes = nodes.withColumns({f"__in_{name}": _inside(F.col(name)) for name in marks})
    return nodes.drop(*(f"__in_{name}" for name in marks))


_NAMES = T.ArrayType(T.StringType())
_STEPS = T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("ids", _NAMES), T.StructField("classes", _NAMES)]))


@F.pandas_udf(_STEPS)
def selector_steps(css: pd.Series) -> pd.Series:
    """A selector's steps; an unreadable one is an error."""
    known = {c: [{"tag": s.tag, "ids": list(s.ids), "classes": list(s.classes)} for s in html.selector(c)] for c in css.dropna().unique() if c}
    return css.map(lambda c: known.get(c))


def steps_of(pages: DataFrame) -> int:
    """The steps of the longest item or date selector of pages."""
    one = pages.select(F.explode(F.array("item_selector", "date_selector")).alias("css")).distinct()
    return max(1, one.agg(F.coalesce(F.max(F.size(selector_steps("css"))), F.lit(0))).first()[0])


@F.pandas_udf(T.StringType())
def _resolved(url: pd.Series, base: pd.Series, href: pd.Series) -> pd.Series:
    """href against the page's base, against its URL; null if it can't be read."""

    def one(u, b, h):
        try:
            return html.urljoin(html.urljoin(u, b or ""), h.strip())
        except ValueError:
            return None

    return pd.Series([one(*x) for x in zip(url, base, href, strict=True)])


def listed(pages: DataFrame, most_steps: int | None = None) -> DataFrame:
    """Candidates (key, ord, url, title, date_text) of listing pages: key, url, content_type, body, item_selector, date_selector, title_from,
    include, exclude; a key names one page.

    Selected elements' links, against the page's base, http(s) only, filtered by substrings, the first of each URL. A date is the text of the
    nearest date element: the element itself, below it, or below the nearest of its NEAR ancestors that has one.
    """
    none = F.array().cast("array<string>")
    # a short name for a page, as keys may be long, begin alike and are sorted by often
    pages = pages.withColumns({"page_key": F.col("key"), "key": F.base64(F.unhex(F.sha2("key", 256)))})
    own = pages.select("key", "page_key", "url", "title_from", F.coalesce("include", none).alias("include"), F.coalesce("exclude", none).alias("exclude"), selector_steps("item_selector").alias("items"), selector_steps("date_selector").alias("dates"))
    if most_steps is None:
        most_steps = steps_of(pages)
    nodes = dealt(nodes_of(pages, texts=False)).join(own.select("key", "items", "dates"), "key")
    nodes = _marked(nodes, most_steps, item="items", date="dates").drop("items")
    linked = F.coalesce((F.col("tag") == "a") & (F.col("href") != ""), F.lit(False))
    based, pictured = (F.col("tag") == "base") & F.col("href").isNotNull(), F.coalesce((F.col("tag") == "img") & (F.col("alt") != ""), F.lit(False))
    # of a page without a date selector no ancestors are asked, so what else is in it plays no part
    nodes = nodes.where((F.coalesce(F.size("dates"), F.lit(0)) > 0) | F.col("item") | linked | based | pictured | (F.col("pre") == 0))
    attrs = F.struct("href", "title", "label").alias("attrs")
    self_date = F.col("item") & (F.size("dates") > 0) & _fits(F.get("dates", F.size("dates") - 1))
    whole = F.first(F.when(F.col("pre") == 0, F.col("text")), ignorenulls=True).over(W.partitionBy("key"))
    # a page's whole text goes along with its elements only until their own part of it is cut out
    nodes = nodes.withColumn("own_text", F.when(F.col("item") | F.col("date") | linked, one_line(F.substring(whole, F.col("begins") + 1, F.col("ends") - F.col("begins")))))
    nodes = nodes.withColumn("own_date", F.coalesce(self_date, F.lit(False)) & (F.col("own_text") != "")).withColumn("date", F.col("date") & (F.col("own_text") != ""))
    nodes = nodes.withColumn("base", F.min(F.when(based, F.struct("pre", "href"))).over(W.partitionBy("key"))["href"])
    nodes = nodes.withColumns({
        "next_date": _next(F.col("date"), F.struct("pre", "own_text")), "next_link": _next(linked, F.struct("pre", attrs, "own_text")),
        "next_alt": _next(pictured, F.struct("pre", "alt")),
    })
    nodes = nodes.withColumn("own_alt", F.when(F.col("next_alt.pre") <= F.col("last"), F.col("next_alt.alt")))
    nodes = nodes.withColumn("link_alt", _next(linked, F.struct("pre", F.col("own_alt").alias("alt"))))
    link = F.when(F.col("tag") == "a", F.struct(attrs, F.col("own_text").alias("text"), F.col("own_alt").alias("alt"))).when(
        F.col("next_link.pre") <= F.col("last"), F.struct(F.col("next_link.attrs").alias("attrs"), F.col("next_link.own_text").alias("text"), F.col("link_alt.alt").alias("alt"))
    )
    nodes = nodes.select("key", "pre", "up", "item", F.size("dates").alias("n_dates"), F.struct("base", link.alias("link"), F.when(F.col("own_date"), F.col("own_text")).alias("self_text")).alias("found"),
        F.when(F.col("next_date.pre") <= F.col("last"), F.struct(F.col("next_date.own_text").alias("text"), F.col("tag").isin(*_STOP).alias("stop"))).alias("dated"))
    # an element without a date in or below it asks its near ancestors for the first date below them; the nearest that has one decides.
    # Questions and answers meet in the ancestor's place, so that no page is read twice
    kinds = nodes.select("found", "dated").schema
    none_of = lambda c: F.lit(None).cast(kinds[c].dataType).alias(c)
    null = F.lit(None).cast("int")
    said = F.struct(F.col("pre").alias("at"), "dated", null.alias("level"), null.alias("pre"), none_of("found"))
    own_row = F.struct(F.col("pre").alias("at"), none_of("dated"), F.lit(0).alias("level"), "pre", "found")
    upward = F.transform("up", lambda u, level: F.struct(u.alias("at"), none_of("dated"), (level + 1).cast("int").alias("level"), F.col("pre").alias("pre"), none_of("found")))
    empty = F.array().cast(nodes.select(F.array(said).alias("x")).schema["x"].dataType)
    asks = F.col("item") & F.coalesce(F.trim("found.link.attrs.href") != "", F.lit(False))
    open_ = asks & (F.col("n_dates") > 0) & F.col("dated").isNull() & F.col("found.self_text").isNull()
    parts = [F.when(which, rows).otherwise(empty) for which, rows in ((F.col("dated").isNotNull(), F.array(said)), (asks, F.array(own_row)), (open_, upward))]
    rows = nodes.select("key", F.explode(F.concat(*parts)).alias("r")).select("key", "r.*")
    rows = rows.withColumn("answer", F.max("dated").over(W.partitionBy("key", "at"))).where("level is not null")
    told = F.when(F.col("answer").isNotNull() & ((F.col("level") == 0) | ~F.col("answer.stop")), F.col("level"))
    found = rows.groupBy("key", "pre").agg(F.first("found", ignorenulls=True).alias("found"), F.min_by("answer.text", told).alias("near_text")).select("key", "pre", "found.*", "near_text")
    rows = found.join(own.select("key", "page_key", "url", "title_from", "include", "exclude"), "key")
    rows = rows.withColumn("target", _resolved("url", "base", F.col("link.attrs.href"))).where(is_http(F.col("target"))).where(allowed(F.col("target"), F.col("include"), F.col("exclude")))
    attr = one_line(F.coalesce(F.when(F.col("link.attrs.title") != "", F.col("link.attrs.title")), F.col("link.attrs.label"), F.lit("")))
    text, alt = F.coalesce("link.text", F.lit("")), one_line(F.coalesce("link.alt", F.lit("")))
    filled = lambda *c: F.coalesce(*(F.when(x != "", x) for x in c), F.lit(""))
    rows = rows.withColumn("title", F.when(F.col("title_from") == "attr", filled(attr, text, alt)).otherwise(filled(text, attr, alt)))
    first = rows.withColumn("turn", F.row_number().over(W.partitionBy("key", "target").orderBy("pre"))).where("turn = 1")
    order = F.row_number().over(W.partitionBy("key").orderBy("pre")) - 1
    return first.select(F.col("page_key").alias("key"), order.cast("int").alias("ord"), F.col("target").alias("url"), "title", F.coalesce("self_text", "near_text").alias("date_text"))


def _scored(nodes: DataFrame) -> DataFrame:
    """nodes with names, density, passed and score (null where a node is no container) instead of what these are made of."""
    names = F.lower(F.concat_ws(" ", F.concat_ws(" ", "classes"), F.coalesce("ident", F.lit(""))))
    real = (F.col("within").bitwiseAND(NOISY | HEADED) == 0) & (F.col("tag") != "#text")
    points = F.when(real & F.col("tag").isin(*_PARAGRAPH) & (F.col("chars") >= LEAST_CHARS), 1 + F.col("commas") + F.least(F.floor(F.col("chars") / 100), F.lit(3)))
    # in parts of 36, which all shares are whole numbers of: sums don't depend on the order of rows
    share = lambda level: F.when(level == 0, 36).when(level == 1, 18).otherwise(F.floor(F.lit(12) / level))
    me = F.struct("last", "parent", "tag", "classes", names.alias("names"), real.alias("real"), "within", "chars", "linked", F.when(F.col("tag") == "#text", F.col("text")).alias("text"))
    # a row for the node itself and one for each that it gives points to; both meet by a grouping, so no page is read twice
    own = F.array(F.struct("pre", F.lit(None).cast("long").alias("parts"), me.alias("me")))
    gives = F.transform(F.when(points.isNotNull(), F.col("up")).otherwise(F.array().cast("array<int>")), lambda u, level: F.struct(u.alias("pre"), (points * share(level)).cast("long").alias("parts"), F.lit(None).cast(nodes.select(me.alias("me")).schema["me"].dataType).alias("me")))
    rows = nodes.select("key", F.explode(F.concat(own, gives)).alias("r")).select("key", "r.*")
    rows = rows.groupBy("key", "pre").agg(F.sum("parts").alias("parts"), F.first("me", ignorenulls=True).alias("me")).select("key", "pre", "me.*", (F.col("parts") / 36.0).alias("passed"))
    start = F.coalesce(*(F.when(F.col("tag") == t, F.lit(v)) for t, v in _TAG_SCORE.items()), F.lit(0))
    start = start + F.when(F.col("names").rlike(_FOR), 25).otherwise(0) - F.when(F.col("names").rlike(_AGAINST), 25).otherwise(0)
    density = F.when(F.col("chars") > 0, F.col("linked") / F.col("chars")).otherwise(0.0)
    rows = rows.withColumn("density", density)
    return rows.withColumn("score", F.when(F.col("real") & F.col("passed").isNotNull(), (start + F.col("passed")) * (1 - F.col("density")))).drop("names", "linked")


def container_scores(nodes: DataFrame) -> DataFrame:
    """Containers of pages' paragraphs: key, pre, last, parent, tag, classes, chars, density, passed, score.

    A paragraph outside noise of LEAST_CHARS characters (spaces not counted) has a point, one for each comma and one for each 100 characters up to 3. Its parent gets all
    of them, the grandparent half, further ancestors up to NEAR a third of their level's share. A container starts with its tag's points
    and 25 for or against its names; the sum is cut by the share of its text that is links.
    """
    real = (F.col("within").bitwiseAND(NOISY | HEADED) == 0) & (F.col("tag") != "#text")
    out = _scored(nodes.where(real)).where(F.col("passed").isNotNull() | (F.col("tag") == "p"))
    return out.select("key", "pre", "last", "parent", "tag", "classes", "chars", "density", "passed", "score")


def articles(pages: DataFrame, limit: int | None = None) -> DataFrame:
    """(key, text, title) of HTML pages (key, content_type, body), a row for each: the text of the container of the highest
    score (of equal ones the first), and of those beside it that belong to it: of a fifth of its score, those of its class counting that
    much more, or long paragraphs with few links. Where that is under html.MIN_MAIN_CHARS characters, the body without noise. Texts are whole, or of
    at most `limit` characters.

    Node rows are dealt by page once; groupings and windows below are all within pages, so they need no further shuffle."""
    lies = lambda bits: F.col("within").bitwiseAND(bits) != 0
    text, titled = F.col("tag") == "#text", lies(TITLED)
    wanted = F.when(text, ~lies(NOISY) | titled).otherwise(~lies(NOISY | HEADED) | F.col("tag").isin("body", "title"))
    rows = _scored(nodes_of(pages).where(wanted).repartition("key"))
    best = F.when((F.col("score") > 0), F.struct("score", (-F.col("pre")).alias("p"), "pre", "parent", "classes"))
    rows = rows.withColumn("top", F.max(best).over(W.partitionBy("key")))
    container = F.col("real") & (F.col("passed").isNotNull() | (F.col("tag") == "p"))
    beside = (F.col("pre") == F.col("top.pre")) | (F.col("parent") == F.col("top.parent"))
    fifth = 0.2 * F.col("top.score")
    bonus = F.when((F.size("top.classes") > 0) & (F.col("classes") == F.col("top.classes")), fifth).otherwise(0.0)
    belongs = (F.col("pre") == F.col("top.pre")) | (F.col("score") + bonus >= F.greatest(F.lit(10.0), fifth)) | ((F.col("tag") == "p") & (F.col("chars") > 80) & (F.col("density") < 0.25))
    rows = rows.withColumn("chosen", F.coalesce(container & beside & belongs, F.lit(False))).select("key", "pre", "last", "tag", "within", "chosen", "text")
    rows = rows.withColumn("mine", _inside(F.col("chosen"), True))
    has_body = F.max((F.col("tag") == "body").cast("int"))
    first_title = F.min(F.when(F.col("tag") == "title", F.struct("pre", "last")))
    pieces = F.sort_array(F.collect_list(F.when(text, F.struct("pre", "text", "within", "mine"))))
    out = rows.groupBy("key").agg(pieces.alias("pieces"), has_body.alias("has_body"), first_title.alias("t"))
    joined = lambda keep: F.array_join(F.transform(F.filter("pieces", keep), lambda x: x["text"]), "")
    has = lambda x, bits: x["within"].bitwiseAND(bits) != 0
    title = joined(lambda x: has(x, TITLED) & (x["pre"] <= F.col("t.last")))
    main = joined(lambda x: ~has(x, NOISY) & x["mine"])
    rest = joined(lambda x: ~has(x, NOISY | HEADED) & (has(x, BODIED) | (F.col("has_body") == 0)))
    out = out.select("key", one_line(main).alias("main"), rest.alias("rest"), F.coalesce(one_line(title), F.lit("")).alias("title"))
    text = F.when(F.char_length("main") >= html.MIN_MAIN_CHARS, F.col("main")).otherwise(one_line(F.col("rest")))
    return out.select("key", (text if limit is None else F.left(text, F.lit(limit))).alias("text"), "title")
