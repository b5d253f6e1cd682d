"""Operator 3: soft-membership mixing, in DataFrame operations only.

A Bayes classifier, trained on a labelled table, gives each document a posterior over domains: distinct words by length, and
the weight of its marker words, both given its symbols, by probabilities that come from documents whose labels the markers
were not chosen by. A projected gradient method then finds a nonnegative rate for each document such
that the domains' expected token totals come as near as possible, in least squares, to their targets; `mixing_report`
tells how near. Documents of equal features have equal rates, so all rounds run over one array of at most 600 cells, and
nothing is joined or shuffled by document.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, packed_rows, store, text_of

#: Domains that the labels (quality, toxic) tell apart.
DOMAINS = ("clean", "noisy", "toxic")
#: What the query and the pipeline ask for.
TARGETS = {"clean": 0.94, "noisy": 0.05, "toxic": 0.01}
#: Labelled documents that the classifier is trained on: those with the smallest hash of their id.
TRAIN_DOCUMENTS = 20_000
#: Words and word beginnings, at most, that mark the toxic domain; the share of its documents that has to hold each, the
#: number of them, and how much more often than others.
MARKERS, MARKER_SHARE, MARKER_LEAST, MARKER_LIFT = 400, 0.02, 4, 8
#: Letters of word beginnings: inflected words of other languages are told by these.
STEMS = (4, 5, 6)
#: Parts of the labelled documents; what markers tell of one is learnt with those of the others.
FOLDS = 5
#: Documents that the product of single features counts for, in the probabilities of features taken together.
BACKING = 2.0
#: The solver stops once no domain's total is off by more than TOLERANCE of its own tokens, or no rate moves by more than
#: STILL (then what is left can't be reached); ROUNDS is far beyond what that takes, and a solution that comes there is logged.
ROUNDS, TOLERANCE, STILL = 100_000, 1e-6, 1e-5
#: A target that is missed by more than this part of it is logged.
MISSED = 0.01
#: Documents of at least this clean posterior keep a rate of 1 or more, so that each has a copy.
ANCHOR = 0.5
#: The highest rate, so that no document is repeated more often: targets out of reach would else go to a few documents.
MOST = 8.0

_SYMBOLS = (0.02, 0.1, 0.3, 0.6)
_DISTINCT = (0.1, 0.3, 0.5, 0.7)
_LENGTH = (20, 100, 1000)
_WEIGHT = (0.2, 0.5, 1.0, 2.0, 4.0)


CELL = ("__f0", "__f1", "__f2")


def domain() -> Column:
    """The domain of a labelled row; null where a label is missing."""
    return F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "noisy").when((F.col("quality") == 1) & (F.col("toxic") == 0), "clean")


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.lower(text_of(text)), f"{SPACE}+"), "")


def clues(words: str) -> Column:
    """Distinct words, and the beginnings of longer ones after a mark of their own; the words are distinct."""

    def begun(n: int) -> Column:
        return F.transform(F.filter(words, lambda w: F.char_length(w) > n), lambda w: F.concat(F.lit("\x1f"), F.left(w, F.lit(n))))

    return F.array_distinct(F.concat(F.col(words), *map(begun, STEMS)))


def _bucket(value: Column, limits: tuple) -> Column:
    return sum(((value >= x).cast("int") for x in limits[1:]), (value >= limits[0]).cast("int"))


@dataclass(frozen=True)
class Classifier:
    #: Markers with their weights: logs of how much more often toxic documents hold them.
    markers: tuple[tuple[str, float], ...]
    #: For each domain its log prior, the logs of the probabilities of symbols with distinct words, and of weights given symbols.
    prior: tuple[float, ...]
    tables: tuple[tuple[tuple[float, ...], ...], ...]


#: Buckets of each feature: symbols for each word, distinct words by length, weight of the marker words.
SIZES = (len(_SYMBOLS) + 1, (len(_DISTINCT) + 1) * (len(_LENGTH) + 1), len(_WEIGHT) + 1)


def features(docs: DataFrame, text: str, markers: tuple[tuple[str, float], ...]) -> DataFrame:
    """docs with __tokens and the bucket numbers __f0, __f1, __f2. The weight is the sum of the markers that a text holds,
    whatever their number there, by the logarithm of its length."""
    docs = docs.withColumn("__words", words_of(text))
    n = F.size("__words")
    docs = docs.withColumns({
        "__tokens": n.cast("long"),
        "__symbols": F.regexp_count(text_of(text), F.lit(r"[#*$%&|<>!]")) / F.greatest(n, F.lit(1)),
        "__distinct": F.array_distinct("__words"),
    })
    weight = F.lit(0.0)
    if markers:
        weigh = F.create_map(*(F.lit(x) for pair in markers for x in pair))
        held = F.array_sort(F.array_intersect(clues("__distinct"), F.array(*(F.lit(w) for w, _ in markers))))
        weight = F.aggregate(held, F.lit(0.0), lambda a, w: a + weigh[w]) / (1 + F.log1p(F.col("__tokens")))
    share = F.size("__distinct") / F.greatest(F.col("__tokens"), F.lit(1))
    docs = docs.withColumn("__weight", weight)
    docs = docs.withColumns({
        "__f0": _bucket(F.col("__symbols"), _SYMBOLS),
        "__f1": _bucket(share, _DISTINCT) * F.lit(len(_LENGTH) + 1) + _bucket(F.col("__tokens"), _LENGTH),
        "__f2": _bucket(F.col("__weight"), _WEIGHT),
    })
    return docs.drop("__words", "__symbols", "__distinct", "__weight")


def _fold(key: Column) -> Column:
    """The fold of the labelled documents, from 0, that a document is in."""
    return F.pmod(F.xxhash64(F.lit("fold"), key), F.lit(FOLDS)).cast("int")


def _markers(counts: DataFrame, toxic: str, other: str, n: tuple[int, int]) -> tuple[tuple[str, float], ...]:
    """The clues of counts (w, and of documents that hold it toxic and other ones) that mark the toxic domain, of n documents."""
    lift = F.log((F.col(toxic) + 0.5) / (n[0] + 1.0)) - F.log((F.col(other) + 0.5) / (n[1] + 1.0))
    best = counts.where(F.col(toxic) >= max(MARKER_LEAST, math.ceil(MARKER_SHARE * n[0]))).select("w", F.round(lift, 9).alias("lift")).where(F.col("lift") > math.log(MARKER_LIFT))
    return tuple(sorted((r.w, r.lift) for r in best.orderBy(F.desc("lift"), "w").limit(MARKERS).collect()))


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS, text: str = "text", doc_id: str = "doc_id") -> Classifier:
    """Naive Bayes over bucketed features on at most `limit` labelled documents. Without labels all domains are equal. Of labels
    that contradict each other the worst counts: toxic before noisy before clean. Of rows that repeat an id one counts,
    that of the least hash of its text."""
    rank = F.array_position(F.array(*map(F.lit, DOMAINS)), F.col("__domain"))
    known = labels.select(F.col("doc_id").alias("__id"), domain().alias("__domain")).dropna()
    chosen = known.groupBy("__id").agg(F.max_by("__domain", rank).alias("__domain"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(limit)
    sample = store(docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(chosen), "__id"), "labelled")
    again = store(sample.groupBy("__id").agg(F.count("*").alias("rows")).where("rows > 1").select("__id"), "repeated-labelled")
    if not again.isEmpty():
        one = sample.join(again, "__id").groupBy("__id", "__domain").agg(F.min_by("__text", F.xxhash64("__text")).alias("__text")).select(sample.columns)
        sample = store(sample.join(again, "__id", "left_anti").select(sample.columns).unionAll(one), "labelled")
    sample = sample.withColumn("__fold", _fold(F.col("__id")))
    toxic = F.col("__domain") == "toxic"
    found = {"t": F.count_if(toxic), "o": F.count_if(~toxic)}
    found |= {f"{k}{h}": F.count_if((toxic if k == "t" else ~toxic) & (F.col("__fold") != h)) for h in range(FOLDS) for k in "to"}
    n = sample.agg(*(c.alias(k) for k, c in found.items())).first()
    held = sample.withColumn("__words", F.array_distinct(words_of("__text"))).select("__domain", "__fold", F.explode(clues("__words")).alias("w"))
    counts = store(held.groupBy("w").agg(*(c.alias(k) for k, c in found.items())).where(F.col("t") >= MARKER_LEAST), "clues")
    marked = lambda h="": _markers(counts, f"t{h}", f"o{h}", (n[f"t{h}"], n[f"o{h}"]))
    markers = marked()
    # a document's weight for the probabilities is by markers of the other folds
    apart = reduce(DataFrame.unionByName, (features(sample.where(F.col("__fold") == h), "__text", marked(h)) for h in range(FOLDS)))
    cells: dict[str, dict[tuple, int]] = {d: {} for d in DOMAINS}
    for r in apart.groupBy("__domain", *CELL).count().collect():  # no more than there are cells
        cells[r["__domain"]][tuple(r[f] for f in CELL)] = r["count"]
    total = sum(sum(c.values()) for c in cells.values())
    prior = tuple(math.log((sum(cells[d].values()) + 1) / (total + len(DOMAINS))) for d in DOMAINS)
    return Classifier(markers, prior, tuple(tables_of(cells[d]) for d in DOMAINS))


def tables_of(cells: Mapping[tuple, int]) -> tuple[tuple[float, ...], ...]:
    """Logs of the probabilities of a domain's features, from its documents by cell: of the first two together, backed by the
    product of the single ones, and of the third given the first, backed by its own."""
    n = sum(cells.values())
    single = [[0.5] * size for size in SIZES]
    both, given = ([[0] * SIZES[f] for _ in range(SIZES[0])] for f in (1, 2))
    for cell, count in cells.items():
        both[cell[0]][cell[1]] += count
        given[cell[0]][cell[2]] += count
        for f, b in enumerate(cell):
            single[f][b] += count
    p = [[x / (n + 0.5 * size) for x in row] for row, size in zip(single, SIZES, strict=True)]
    joint = tuple(math.log((both[a][b] + BACKING * p[0][a] * p[1][b]) / (n + BACKING)) for a in range(SIZES[0]) for b in range(SIZES[1]))
    return joint, tuple(math.log((given[a][b] + BACKING * p[2][b]) / (sum(given[a]) + BACKING)) for a in range(SIZES[0]) for b in range(SIZES[2]))


def posteriors(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """docs with __tokens and the posteriors __p0, __p1, ... of DOMAINS."""
    docs = features(docs, text, model.markers)
    at = (F.col("__f0") * SIZES[1] + F.col("__f1") + 1, F.col("__f0") * SIZES[2] + F.col("__f2") + 1)
    logit = {
        f"__l{k}": reduce(Column.__add__, (F.element_at(F.array(*map(F.lit, table)), place) for table, place in zip(model.tables[k], at, strict=True)), F.lit(model.prior[k]))
        for k in range(len(DOMAINS))
    }
    docs = docs.withColumns(logit)
    top = F.greatest(*logit)
    docs = docs.withColumns({f"__e{k}": F.exp(F.col(f"__l{k}") - top) for k in range(len(DOMAINS))})
    total = reduce(Column.__add__, (F.col(f"__e{k}") for k in range(len(DOMAINS))))
    docs = docs.withColumns({f"__p{k}": F.col(f"__e{k}") / total for k in range(len(DOMAINS))})
    return docs.drop(*(f"__{x}{k}" for x in "le" for k in range(len(DOMAINS))))


def cells_of(known: DataFrame) -> DataFrame:
    """Documents of equal features have equal posteriors, so equal gradients and rates: their tokens are summed up
    beforehand. The number of cells is bounded by the product of SIZES, 600."""
    return known.groupBy(*CELL).agg(F.sum("__tokens").alias("__tokens"), *(F.first(f"__p{k}").alias(f"__p{k}") for k in range(len(DOMAINS))))


@dataclass(frozen=True)
class Solution:
    """Tokens by domain: natural (all rates 1), asked for, and expected at the rates found."""

    natural: tuple[float, ...]
    target: tuple[float, ...]
    reached: tuple[float, ...]
    rounds: int
    #: The rate of a row by its columns CELL.
    rate: Column

    @property
    def residual(self) -> tuple[float, ...]:
        return tuple(s - t for s, t in zip(self.reached, self.target, strict=True))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def solution(cells: DataFrame, targets: Mapping[str, float], anchor: float | None = None, most: float = math.inf) -> Solution:
    """The rates whose totals come nearest to the targets.

    Totals T are in the targets' proportions, as large as lets the first domain keep its own tokens; a domain that is
    scarcer than its weight gets rates above 1. A domain without any tokens is passed over. Minimised is
    sum_k (S_k - T_k)^2 over rates 0 <= r <= most, and r >= 1 where the first domain's posterior is at least `anchor`, with
    S_k = sum_d r_d tokens_d p_dk. The gradient of r_d, scaled by 1 / tokens_d, is sum_k p_dk (S_k - T_k); as no row of the
    scaled Hessian sums up to more than sum_k p_dk N_k, with N_k being S_k at r = 1, its inverse is the step length of r_d, and
    rates of scarce domains move as fast as those of large ones. Rounds start from
    rates of 1 and look ahead along the last move (Nesterov), afresh whenever that has led astray.
    """
    ks = range(len(DOMAINS))
    natural = [float(x) for x in cells.agg(*(F.coalesce(F.sum(F.col("__tokens") * F.col(f"__p{k}")), F.lit(0.0)) for k in ks)).first()]
    share = sum(targets.values())
    weight = [targets.get(d, 0.0) / share for d in DOMAINS]
    budget = natural[0] / weight[0] if weight[0] and natural[0] else sum(natural)
    target = [w * budget if n else 0.0 for w, n in zip(weight, natural, strict=True)]

    def off(reached: Column, by: list[float]) -> list[Column]:
        return [(reached[k] - target[k]) / by[k] if natural[k] else F.lit(0.0) for k in ks]

    def totals(rates: Column) -> Column:
        tokens = lambda k: F.zip_with("cells", rates, lambda c, r: c["__tokens"] * c[f"__p{k}"] * r)
        return F.array(*(F.aggregate(tokens(k), F.lit(0.0), lambda a, x: a + x) for k in ks))

    def moved(state: Column) -> Column:
        step = lambda by: F.zip_with("cells", state["ahead"], lambda c, r: F.least(F.lit(most), F.greatest(c["low"], r - c["step"] * reduce(Column.__add__, (c[f"__p{k}"] * by[k] for k in ks)))))
        rates = _let(F.array(*off(state["reached_ahead"], [1.0] * len(DOMAINS))), step)

        def ends(new: Column) -> Column:
            move = F.zip_with(new, state["rates"], lambda a, b: a - b)
            back = F.zip_with(state["ahead"], new, lambda a, b: a - b)
            astray = F.aggregate(F.zip_with(back, move, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x) > 0
            most = F.array_max(F.transform(move, F.abs))
            t = F.when(astray, 1.0).otherwise((1 + F.sqrt(1 + 4 * state["t"] * state["t"])) / 2)
            return _let(F.struct(F.when(astray, 0.0).otherwise((state["t"] - 1) / t).alias("by"), t.alias("t"), most.alias("most"), totals(new).alias("reached")), lambda x: F.struct(
                new.alias("rates"), F.zip_with(new, state["rates"], lambda a, b: a + x["by"] * (a - b)).alias("ahead"), x["reached"].alias("reached"),
                F.zip_with(x["reached"], state["reached"], lambda a, b: a + x["by"] * (a - b)).alias("reached_ahead"), x["t"].alias("t"), x["most"].alias("moved"), (state["rounds"] + 1).alias("rounds"),
            ))

        return _let(rates, ends)

    def advance(state: Column, _: Column) -> Column:
        done = (F.greatest(*map(F.abs, off(state["reached"], [n or 1.0 for n in natural]))) < TOLERANCE) | (state["moved"] <= STILL)
        return F.when(done, state).otherwise(moved(state))

    low = F.lit(0.0) if anchor is None else F.when(F.col("__p0") >= anchor, 1.0).otherwise(0.0)
    curve = reduce(Column.__add__, (F.col(f"__p{k}") * natural[k] for k in ks))
    row = F.struct(*CELL, "__tokens", *(F.col(f"__p{k}") for k in ks), low.alias("low"), F.coalesce(1 / F.nullif(curve, F.lit(0.0)), F.lit(0.0)).alias("step"))
    listed = cells.agg(F.sort_array(F.collect_list(row)).alias("cells"))  # no more than there are cells
    ones, reached = F.transform("cells", lambda _: F.lit(1.0)), F.array(*map(F.lit, natural))
    start = F.struct(ones.alias("rates"), ones.alias("ahead"), reached.alias("reached"), reached.alias("reached_ahead"), F.lit(1.0).alias("t"), F.lit(math.inf).alias("moved"), F.lit(0).alias("rounds"))
    found = listed.select("cells", F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, advance).alias("end")).first()
    table = [1.0] * math.prod(SIZES)
    for c, rate in zip(found["cells"], found["end"]["rates"], strict=True):
        table[(c[0] * SIZES[1] + c[1]) * SIZES[2] + c[2]] = rate
    rate = F.element_at(F.array(*map(F.lit, table)), (F.col(CELL[0]) * SIZES[1] + F.col(CELL[1])) * SIZES[2] + F.col(CELL[2]) + 1)
    out = Solution(tuple(natural), tuple(target), tuple(found["end"]["reached"]), found["end"]["rounds"], rate)
    if out.rounds >= ROUNDS:
        logging.getLogger(__name__).warning("mixing: the rates have not settled after %d rounds", out.rounds)
    for d, t, left in zip(DOMAINS, out.target, out.residual, strict=True):
        if abs(left) > MISSED * t:
            logging.getLogger(__name__).warning("mixing: %s has %.0f tokens more than its target of %.0f, after %d rounds", d, left, t, out.rounds)
    return out


def solve(cells: DataFrame, targets: Mapping[str, float]) -> Column:
    """The rate of each cell, as a look-up by the columns CELL."""
    return solution(cells, targets).rate


def copies(rate: Column, key: Column) -> Column:
    """A whole number of copies whose expectation is the rate: its whole part, and one more by a hash of the key."""
    u = F.pmod(F.xxhash64(F.lit("copies"), key), F.lit(1 << 52)).cast("double") / F.lit(float(1 << 52))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("int")).cast("int")


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, tokens, p_clean, p_noisy, p_toxic, rate, copies.

    Null, empty and blank texts have no tokens and still a posterior and a rate. Null labels, and labels of unknown
    documents, are passed over, and of contradicting ones the worst counts; without labels the posterior is the same for all. Repeated rows get the same rate
    each; null ids stay null. An empty table gives an empty result; other columns are not looked at.
    """
    model = fit(docs, labels, text=text, doc_id=doc_id)
    sheet = posteriors(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")), model, "__text").drop("__text")
    known = store(sheet, "posteriors")
    out = known.withColumn("rate", solution(store(cells_of(known), "cells"), targets, ANCHOR, MOST).rate)
    return out.select("doc_id", F.col("__tokens").alias("tokens"), *(F.col(f"__p{k}").alias(f"p_{d}") for k, d in enumerate(DOMAINS)), "rate", copies(F.col("rate"), F.col("doc_id")).alias("copies"))


def mix(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with each row as often as its rate tells; all columns stay as they are. Cases as in `mixing_rates`."""
    model = fit(docs, labels, text=text, doc_id=doc_id)
    rate = solution(store(cells_of(posteriors(docs.select(F.col(text).alias("__text")), model, "__text")), "cells"), targets, ANCHOR, MOST).rate
    out = features(packed_rows(docs, __text=text, __id=doc_id), "__text", model.markers).withColumn("__copies", copies(rate, F.col("__id")))
    # an outer explode, as filters on the number of copies would be pushed down and read the text again
    out = out.withColumn("__copy", F.explode_outer(F.array_repeat(F.lit(1), F.col("__copies")))).where("__copy is not null")
    return out.select("__row.*")


def mixing_report(docs: DataFrame, labels: DataFrame, targets: Mapping[str, float] = TARGETS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per domain: weight, share expected by rates and share of the copies made; natural, target, expected and
    copied tokens, and the expected ones' residual."""
    model = fit(docs, labels, text=text, doc_id=doc_id)
    known = store(posteriors(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("__text")), model, "__text").drop("__text"), "posteriors")
    found = solution(store(cells_of(known), "cells"), targets, ANCHOR, MOST)
    made = F.col("__tokens") * copies(found.rate, F.col("doc_id"))
    copied = [float(x) for x in known.agg(*(F.coalesce(F.sum(made * F.col(f"__p{k}")), F.lit(0.0)) for k in range(len(DOMAINS)))).first()]
    every, total, whole = sum(targets.values()), sum(found.reached) or 1.0, sum(copied) or 1.0
    rows = [
        (d, targets.get(d, 0.0) / every, found.reached[k] / total, copied[k] / whole, found.natural[k], found.target[k], found.reached[k], copied[k], found.residual[k], found.rounds)
        for k, d in enumerate(DOMAINS)
    ]
    kinds = "domain string, weight double, share double, copied_share double, natural double, target double, expected double, copied double, residual double, rounds int"
    return docs.sparkSession.createDataFrame(rows, kinds)
