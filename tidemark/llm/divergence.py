"""Operator 11: how far the sources of a language diverge, by a baseline-correction inverted index.

Each pair of sources starts at V times the value that a term has which neither holds. Postings (language, term, source,
count) then add only what differs from that: a posting by itself corrects its source against one that lacks the term,
which depends on its count alone, so postings are counted by count first; two postings of one term correct each other
once more, where the index brings them together. No cell of a term that neither source holds is ever made.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import few, short_batches, slices, store, text_of

#: p is in units of one in so many.
SCALE = 1_000_000_000
#: Different terms that a task holds before it passes their counts on.
HELD_TERMS = 400_000
#: Groups (language, source) sent to every task at most; more are joined by a shuffle.
FEW_GROUPS = 50_000

#: Bytes of terms: letters in lower case and all that is not ASCII; the others become spaces.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def term_counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of batches of (lang, source, text), summed up as far as HELD_TERMS goes. A group that
    occurs has a row with the empty term, whatever its texts hold."""
    n: dict[tuple, Counter] = defaultdict(Counter)
    docs: dict[tuple, Counter] = defaultdict(Counter)

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in n.items():
            some = list(terms)
            if not some:
                continue
            for at in range(0, len(some), 1 << 16):
                part = some[at : at + (1 << 16)]
                flat = pa.array([lang] * len(part), pa.string()), pa.array([source] * len(part), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*flat, pa.array(part, pa.binary()).cast(pa.string()), pa.array([terms[t] for t in part], pa.int64()), pa.array([docs[lang, source][t] for t in part], pa.int64())],
                    ["lang", "source", "term", "n", "docs"],
                )
        n.clear()
        docs.clear()

    for batch in batches:
        for part in slices([batch], "text"):
            for lang, source, text in zip(*(part.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                terms = text.encode().translate(_TERM).split()
                n[lang, source].update(terms)
                docs[lang, source].update(set(terms))
                docs[lang, source][b""] = n[lang, source][b""] = 0
            if sum(map(len, n.values())) > HELD_TERMS:
                yield from rows()
    yield from rows()


def _share(count: str, total: str, terms: str) -> Column:
    """p of a count, exactly: numbers of 38 digits, as counts times SCALE may pass 64 bits."""
    return F.expr(f"1 + cast(cast({count} + 2 as decimal(20, 0)) * {SCALE} div cast({total} + 2 * {terms} as decimal(20, 0)) as bigint)")


def _value(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q}) div ({p} + {q}))"


def index(docs: DataFrame, min_docs: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> tuple[DataFrame, DataFrame]:
    """The groups that occur, with (lang, source, total, lang_total, terms, p0), and the postings of kept terms, with (lang,
    term, source, n, p, p0, q); both stored."""
    short_batches(docs.sparkSession)
    plain = docs.select(text_of(lang).alias("lang"), text_of(source).alias("source"), text_of(text).alias("text"))
    found = plain.mapInArrow(term_counts, "lang string, source string, term string, n long, docs long")
    summed = found.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = W.partitionBy("lang", "term")  # at most a row for each source
    rows = summed.withColumns({"in_docs": F.sum("docs").over(term), "in_lang": F.sum("n").over(term)})
    rows = store(rows.where((F.col("term") == "") | (F.col("in_docs") >= min_docs)).select("lang", "term", "source", "n", "in_lang"), "postings")
    kept = F.col("term") != ""
    groups = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    terms = rows.where(kept).select("lang", "term").distinct().groupBy("lang").agg(F.count("*").alias("terms"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total")).join(terms, "lang", "left")
    groups = groups.join(langs, "lang").withColumn("terms", F.coalesce("terms", F.lit(0).cast("long")))
    groups = store(groups.withColumns({"zero": F.lit(0).cast("long")}).withColumn("p0", F.when(F.col("terms") > 0, _share("zero", "total", "terms"))).drop("zero"), "groups")
    rows = rows.where(kept).join(few(groups, FEW_GROUPS), ["lang", "source"])
    rows = rows.withColumns({"p": _share("n", "total", "terms"), "q": _share("in_lang", "lang_total", "terms")})
    return groups, store(rows.select("lang", "term", "source", "n", "p", "p0", "q"), "shares")


def pair_values(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, a, b, value) for the pairs a < b of each language's sources: V times the baseline, and the corrections of it."""
    one = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("p"), "terms")
    other = few(groups, FEW_GROUPS).select("lang", F.col("source").alias("b"), F.col("p0").alias("q"))
    baseline = one.join(other, "lang").where("a < b").select("lang", "a", "b", F.expr(f"coalesce(terms * {_value('p', 'q')}, 0)").alias("value"))
    # against a source without the term a posting's correction depends on its count alone
    counted = postings.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("k"))
    alone = counted.join(other, "lang").where("source <> b")
    alone = alone.select("lang", F.least("source", "b").alias("a"), F.greatest("source", "b").alias("b"), F.expr(f"k * ({_value('p', 'q')} - {_value('p0', 'q')})").alias("value"))
    # where both have it, the two corrections give way to the true value
    left = postings.select("lang", "term", F.col("source").alias("a"), "p", "p0")
    right = postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = left.join(right, ["lang", "term"]).where("a < b")
    both = both.select("lang", "a", "b", F.expr(f"{_value('p', 'q')} - {_value('p', 'q0')} - {_value('p0', 'q')} + {_value('p0', 'q0')}").alias("value"))
    parts = [x.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in (alone, both)]
    return reduce(DataFrame.unionByName, [baseline, *parts]).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Rows (lang, source, part, item, value, rank) for each group (lang, source) that occurs in docs.

    Part `pair`: each other source of the language and its divergence from this one over the language's kept terms, ranked
    from the greatest. Part `term`: the `top` terms that the source holds more of than its language does. Terms are runs of
    letters and of characters outside ASCII, A-Z in lower case; a language keeps those in at least min_docs of its documents.
    Null in text, lang or source counts as empty; an empty source is a source like others. Each row is a document, repeated ones too.
    Ties rank by the item's UTF-8. A language without kept terms has pairs of value 0 and no terms; one with
    a single source has no pairs. An empty table gives an empty result. Other columns play no part.
    """
    groups, postings = index(docs, min_docs, text, lang, source)
    pairs = store(pair_values(groups, postings), "pairs")
    both = pairs.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(pairs.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value"))
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = both.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    terms = postings.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(_value("p", "q")).alias("value"))
    # the limit on ranks is applied in every task before rows are sent, however many terms a source holds
    terms = terms.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.unionByName(terms)
