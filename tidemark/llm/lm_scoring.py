"""Operator 5: scoring texts with a hidden Markov language model.

A word's probability in a state is that of its class in the state times that of the word in its class. Frequent words
are classes of their own, the rest share classes by their endings; words in classes follow Witten-Bell estimates of
counts over the whole training corpus. States start from the classes' counts, disturbed by a seed, and are trained by
Baum-Welch over all training documents until their likelihood settles: tasks sum up expected counts of their documents, each
followed over its whole length from the start states on, Spark adds them up, and the driver, which only ever sees states x
classes numbers, re-estimates. Texts are never shuffled: a table of bounded size tells tasks the counts of frequent words, and
what a text holds of rarer ones is joined with their counts.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SpanHash, lower, short_batches, slices, store, text_of, utf8, words
from .hidden_markov import FIXED, Counts, Model, expect, log_likelihoods, random_model, reestimate

STATES = 6
#: Words with a class of their own, and classes that the other words share.
OWN, SHARED = 2048, 1024
#: Training ends once STEADY rounds in a row each gain less than SETTLED in natural log likelihood a token; ROUNDS guards
#: against no end, and is logged when met.
SETTLED, STEADY, ROUNDS = 1e-3, 3, 200
#: Words, at most, whose counts every task is given (16 bytes each); the counts of others are joined.
FREQUENT = 1 << 18
#: Tokens that a task counts or scores together; it trains on four times as many, 2 bytes each.
HELD_TOKENS = 1 << 20
#: The end of a text, as a word; class 0.
END = np.uint64(0x45E4D00DFACE0FF1)


@dataclass
class Classes:
    """Which words have a class of their own; sorted hashes and their classes. Class 0 is the end."""

    own: np.ndarray
    own_class: np.ndarray

    def of(self, word: np.ndarray, ending: np.ndarray) -> np.ndarray:
        out = (1 + OWN + ending).astype(np.int16)
        if len(self.own):
            at = np.minimum(np.searchsorted(self.own, word), len(self.own) - 1)
            hit = self.own[at] == word
            out[hit] = self.own_class[at[hit]]
        out[word == END] = 0
        return out


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, an end after each text, the classes of their endings, and the n+1 offsets of texts."""
    data, off = utf8(column)
    data = lower(data)
    start, end, first = words(data, off)
    spans = SpanHash(data)
    n = len(off) - 1
    at = first + np.arange(n + 1)
    word, ending = np.full(at[-1], END, np.uint64), np.zeros(at[-1], np.int64)
    inside = np.ones(at[-1], bool)
    inside[at[1:] - 1] = False
    word[inside] = spans(start, end)
    ending[inside] = (spans(np.maximum(start, end - 3), end) % np.uint64(SHARED)).astype(np.int64)
    return word, ending, at


def _stream(batches, column: str):
    """(hashes, endings, offsets, batch) of all batches, a slice at a time."""
    for batch in slices(batches, column):
        yield *tokens(batch.column(column)), batch


def word_counts(train: DataFrame) -> DataFrame:
    """(word, ending, n): how often each word, by its hash, is in all texts; tasks sum up their own first."""

    def run(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            ending = np.concatenate([h[1] for h in held])
            word, at, n = np.unique(np.concatenate([h[0] for h in held]), return_index=True, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(ending[at].astype(np.int32)), pa.array(n)], ["word", "ending", "n"])

        for word, ending, _, _ in _stream(batches, "text"):
            held.append((word, ending))
            size += len(word)
            if size >= HELD_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    parts = train.select("text").mapInArrow(run, "word long, ending int, n long")
    return parts.groupBy("word").agg(F.max("ending").alias("ending"), F.sum("n").alias("n"))


@dataclass
class Frequent:
    """Counts of frequent words, by sorted hash."""

    word: np.ndarray
    n: np.ndarray

    def counts(self, word: np.ndarray) -> np.ndarray:
        """The counts of words, -1 for those that are not in the table."""
        if not len(self.word):
            return np.full(len(word), -1)
        at = np.minimum(np.searchsorted(self.word, word), len(self.word) - 1)
        return np.where(self.word[at] == word, self.n[at], -1)


def frequent_words(counts: DataFrame, top: list) -> Frequent:
    """The most frequent words, at most FREQUENT of them and `top`: all whose count reaches the least level that leaves so many."""
    level = F.floor(8 * F.log2("n")).cast("int")
    left, least = FREQUENT, None
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("words")).orderBy(F.col("level").desc()).collect():
        left -= r.words
        if left < 0:
            break
        least = r.level
    some = counts.where(level >= least).select("word", "n").toPandas() if least is not None else None
    word = np.array([r.word for r in top], np.int64), np.array([r.n for r in top], np.int64)
    word = [np.append(a, b) for a, b in zip(word, (some["word"].to_numpy(), some["n"].to_numpy()), strict=True)] if some is not None else list(word)
    found, head = np.unique(word[0].view(np.uint64), return_index=True)
    return Frequent(found, word[1][head])


def coded(train: DataFrame, classes: Classes) -> DataFrame:
    """(x): the classes of all tokens of train, 16 bits each, a slice of whole texts in a row; each text ends in class 0."""

    def run(batches):
        for word, ending, _, _ in _stream(batches, "text"):
            yield pa.RecordBatch.from_arrays([pa.array([classes.of(word, ending).tobytes()], pa.binary())], ["x"])

    return train.select("text").mapInArrow(run, "x binary")


def expected_counts(train: DataFrame, model: Model) -> Counts:
    """One Baum-Welch expectation over all texts of train, as `coded` gives them."""
    states, size = model.emit.shape

    def run(batches):
        out, held, n = Counts.zero(states, size), [], 0

        def add():
            x = np.concatenate(held)
            got = expect(model, x, np.append(0, np.flatnonzero(x == 0) + 1))
            out.start += got.start
            out.step += got.step
            out.emit += got.emit
            out.log_likelihood += got.log_likelihood

        for batch in batches:
            for x in batch.column("x"):
                held.append(np.frombuffer(x.as_buffer(), np.int16))
                n += len(held[-1])
                if n >= 4 * HELD_TOKENS:
                    add()
                    held, n = [], 0
        if held:
            add()
        whole = np.concatenate((out.start, out.emit.ravel(), [out.log_likelihood])).astype(np.int64)
        some = np.flatnonzero(whole)
        cell = np.concatenate((some, -1 - np.arange(states * states)))
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.append(whole[some], np.zeros(states * states, np.int64))), pa.array(np.append(np.zeros(len(some)), out.step.ravel()))], ["cell", "whole", "step"])

    # whole numbers add up to the same in any order
    rows = train.mapInArrow(run, "cell long, whole long, step double").groupBy("cell").agg(F.sum("whole").alias("whole"), F.sum("step").alias("step")).toPandas()
    cell, whole, step = (rows[c].to_numpy() for c in ("cell", "whole", "step"))
    flat, steps = np.zeros(states + states * size + 1), np.zeros(states * states)
    flat[cell[cell >= 0]] = whole[cell >= 0]
    steps[-1 - cell[cell < 0]] = step[cell < 0]
    return Counts(flat[:states], steps.reshape(states, states), flat[states:-1].reshape(states, size), float(flat[-1]))


def train_model(train: DataFrame, shares: np.ndarray, n: int, rounds: int = ROUNDS) -> tuple[Model, list[float]]:
    """The model of all texts of train, n tokens as `coded` gives them, and the log likelihood a token before each round."""
    model, seen, calm = random_model(STATES, shares), [], 0
    for _ in range(rounds):
        counts = expected_counts(train, model)
        model = reestimate(counts)
        seen.append(counts.log_likelihood / FIXED / max(1, n))
        calm = calm + 1 if len(seen) > 1 and seen[-1] - seen[-2] < SETTLED else 0
        if calm == STEADY:
            return model, seen
    logging.getLogger(__name__).warning("op5: the likelihood has not settled after %d rounds", rounds)
    return model, seen


def score_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rounds: int = ROUNDS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Documents whose id's checksum leaves 2 when divided by 7 are held out of all training. Null, empty and blank
    texts are a single end token. A null id counts as the empty string's checksum (0), so it trains, and stays
    null. Repeated rows count and are scored as often as they are there. Where nothing is left to train on, all
    words are unknown and the model's classes are even. An empty table gives an empty result; other columns are
    not looked at. Words are told apart by 64 bits of hash. Scores don't depend on how rows are partitioned.
    """
    short_batches(docs.sparkSession)
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    sheet = docs.select(F.col(doc_id).alias("doc_id"), (crc % 7 == 2).alias("held_out"), text_of(text).alias("text"))
    train = sheet.where("not held_out").select("doc_id", "text")
    counts = store(word_counts(train), "words")
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_all, v_all = int(total[0]), int(total[1])

    end = int(END.view(np.int64))
    top = counts.where(F.col("word") != end).orderBy(F.col("n").desc(), "word").limit(OWN).select("word", "n").collect()
    own = np.array([r.word for r in top], np.int64).view(np.uint64)
    order = np.argsort(own)
    classes = Classes(own[order], (1 + order).astype(np.int16))
    shared = counts.where(F.col("word") != end).join(F.broadcast(counts.sparkSession.createDataFrame([(r.word,) for r in top], "word long")), "word", "left_anti")
    mass = np.zeros((2, SHARED))
    for r in shared.groupBy("ending").agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
        mass[:, r.ending] = r.n, r.v

    often = np.zeros(1 + OWN + SHARED)
    often[1 : 1 + len(top)], often[1 + OWN :] = [r.n for r in top], mass[0]
    often[0] = n_all - often.sum()
    model, _ = train_model(store(coded(train, classes), "classes"), often / max(1, n_all), n_all, rounds)

    known = frequent_words(counts, top)
    # natural logs of what an unseen word of a class counts as, and of what all words of the class count as
    with np.errstate(divide="ignore"):
        unseen_log, class_log = (np.where(x > 0, np.log(x), 0.0) for x in (mass[1], mass[0] + mass[1]))

    def score(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            xs, ats = [h[0] for h in held], [h[1] for h in held]
            shift = np.concatenate(([0], np.cumsum([a[-1] for a in ats])))
            off = np.concatenate([np.zeros(1, np.int64), *(a[1:] + b for a, b in zip(ats, shift, strict=False))])
            parts = pa.concat_batches([h[2] for h in held])
            i = parts.schema.get_field_index("score")
            return parts.set_column(i, "score", pa.array(parts.column(i).to_numpy() + log_likelihoods(model, np.concatenate(xs), off)))

        for word, ending, at, batch in _stream(batches, "text"):
            found, head, which = np.unique(word, return_index=True, return_inverse=True)
            n = known.counts(found)
            x = classes.of(found, ending[head])
            inner = x > OWN
            cls = np.where(inner, x - 1 - OWN, 0)
            first, many = at[:-1], len(at) - 1
            total = lambda by_word: np.add.reduceat(by_word[which], first)  # noqa: E731, B023
            # of rarer words, unseen ones included, each text's list: the word, how often, and what it adds if unseen
            doc = np.repeat(np.arange(many), np.diff(at))
            rare = n[which] < 0
            pair, k = np.unique(doc[rare] * len(found) + which[rare], return_counts=True)
            w = pair % max(1, len(found))
            item = pa.StructArray.from_arrays([pa.array(found[w].view(np.int64)), pa.array(k), pa.array(np.where(inner[w], k * unseen_log[cls[w]], 0.0)), pa.array(inner[w])], ["word", "k", "unseen", "inner"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(pair, np.arange(many + 1) * len(found)), pa.int32()), item)
            have = np.maximum(n, 1)
            columns = [
                batch.column("doc_id"), batch.column("held_out"), pa.array(np.diff(at)), pa.array(total((n > 0).astype(np.int64))),
                pa.array(total(np.where(n > 0, np.log(have + 1), 0.0)) - np.diff(at) * math.log(n_all + v_all + 1)),
                pa.array(total(np.where(inner, np.where(n > 0, np.log(have), 0.0) - class_log[cls], 0.0))), lists,
            ]
            held.append((x[which], at, pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base", "score", "rare"])))
            size += len(word)
            if size >= HELD_TOKENS:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    kind = sheet.schema["doc_id"].dataType.simpleString()
    lists = "array<struct<word: long, k: long, unseen: double, inner: boolean>>"
    parts = sheet.mapInArrow(score, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, score double, rare {lists}")
    parts = store(parts.withColumn("row", F.monotonically_increasing_id()), "scores")
    rare = parts.select("row", F.explode("rare").alias("r")).select("row", "r.*").join(counts.select("word", "n"), "word", "left")
    seen, k = F.col("n").isNotNull(), F.col("k")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(seen, k).otherwise(0)).alias("more_known"),
        F.sum(F.when(seen, k * F.log(F.col("n") + 1)).otherwise(0.0)).alias("more_base"),
        F.sum(F.when(~seen, F.col("unseen")).when(F.col("inner"), k * F.log("n")).otherwise(0.0)).alias("more_score"),
    )
    out = parts.drop("rare").join(rare, "row", "left")
    plus = lambda c, more: F.col(c) + F.coalesce(F.col(more), F.lit(0))
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "more_known").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), (plus("base", "more_base") / math.log(10)).alias("base_score"), (plus("score", "more_score") / math.log(10)).alias("score"))
