"""Operator 9: quality rules by line sequence labelling.

A linear-chain conditional random field marks each line of a document as content or boilerplate. It is trained on
labelled documents and decoded with Viterbi; the share of words in content lines decides whether a document stays,
after two base rules on its length and its repeated words.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SpanHash, map_rows, mix, short_batches, slices, utf8, words

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Labelled documents that the field is trained on: those with the smallest hash of their id.
TRAIN_DOCUMENTS = 2_000
#: A document stays if at least this share of its words is in content lines.
CONTENT_SHARE = 0.5
BOILERPLATE, CONTENT = 0, 1

#: Features of a line. Each is 0 or 1.
FEATURES = (
    "bias", "no_words", "few_words", "many_words", "symbols_some", "symbols_many", "bangs_many", "upper_many", "digits_many",
    "repeats_line", "repeats_word", "ends_sentence", "no_letters",
)
#: Content's lead over boilerplate before training, for the features in order; it alone decides where no labels are given.
START = (1.0, 0.0, 0.0, 0.3, -1.0, -2.0, -2.0, -1.0, -0.3, -1.0, -2.0, 0.5, -1.0)


@dataclass
class Field:
    """Weights: content's lead for each feature, and for each pair of neighbouring labels."""

    lead: np.ndarray = field(default_factory=lambda: np.array(START))
    step: np.ndarray = field(default_factory=lambda: np.array([[0.3, -0.3], [-0.3, 0.3]]))


def _class_sums(data: np.ndarray, chars: bytes | np.ndarray) -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[np.frombuffer(chars, np.uint8) if isinstance(chars, bytes) else chars] = 1
    out = np.zeros(len(data) + 1, np.int32)
    np.cumsum(table[data], out=out[1:])
    return out


@dataclass
class Sheet:
    """The counts and line features of a number of texts."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    lines: np.ndarray  # n+1 offsets of texts in the lines
    line_words: np.ndarray
    features: np.ndarray  # lines x features, 0 or 1


def _tag(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(values + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def read(column: pa.Array) -> Sheet:
    data, off = utf8(column)
    n = len(off) - 1
    start, end, first = words(data, off)
    spans = SpanHash(data)
    word = spans(start, end)
    doc = np.repeat(np.arange(n), np.diff(first))

    # three-word windows that are found twice or more in their text, and the words that they cover
    covered = np.zeros(len(word), bool)
    if len(word) >= 3:
        window = mix(mix(word[:-2] + np.uint64(1)) * np.uint64(3) + mix(word[1:-1] + np.uint64(2)) * np.uint64(5) + word[2:])
        whole = doc[:-2] == doc[2:]
        at = np.flatnonzero(whole)
        tags = _tag(window[at], doc[at])
        order = np.argsort(tags, kind="stable")
        same = tags[order[1:]] == tags[order[:-1]]
        again = np.zeros(len(at), bool)
        again[order[1:][same]] = True
        again[order[:-1][same]] = True
        for k in range(3):
            covered[at[again] + k] = True
    per_doc = lambda x: np.add.reduceat(np.append(x, 0), first[:-1]) * (np.diff(first) > 0) if n else np.zeros(0, np.int64)

    solid = _class_sums(data, np.array([b for b in range(256) if b not in (9, 10, 11, 12, 13, 32) and not 0x80 <= b < 0xC0], np.uint8))
    symbols = _class_sums(data, b"#*$%&|<>")

    # lines: one begins at each text and after each line feed
    feed = np.flatnonzero(data == 10)
    owner = np.concatenate((np.arange(n), np.searchsorted(off, feed, "right") - 1))
    begin = np.concatenate((off[:-1], feed + 1))
    order = np.lexsort((begin, owner))
    owner, begin = owner[order], begin[order]
    last = np.append(owner[1:] != owner[:-1], True) if n else np.zeros(0, bool)
    stop = np.where(last, off[owner + 1], np.append(begin[1:], 0) - 1)
    w0, w1 = np.searchsorted(start, begin), np.searchsorted(start, stop)
    line_words = w1 - w0
    text_line = line_words > 0
    tags = _tag(spans(begin, stop), owner)
    dup = np.zeros(len(begin), bool)
    some = np.flatnonzero(text_line)
    if len(some):
        _, head, which = np.unique(tags[some], return_index=True, return_inverse=True)
        dup[some] = head[which] != np.arange(len(some))
    lines = np.searchsorted(owner, np.arange(n + 1))

    size = np.maximum(1, stop - begin)
    of = lambda sums: sums[stop] - sums[begin]
    upper, digits = _class_sums(data, bytes(range(65, 91))), _class_sums(data, bytes(range(48, 58)))
    letters = _class_sums(data, np.array([*range(65, 91), *range(97, 123), *range(0xC3, 256)], np.uint8))
    bangs = _class_sums(data, b"!")
    twin = np.zeros(len(word) + 1, np.int32)
    if len(word) > 1:
        twin[2:] = np.cumsum((word[1:] == word[:-1]) & (doc[1:] == doc[:-1]))
    many = np.maximum(1, line_words)
    tail = data[np.maximum(end[np.maximum(w1 - 1, 0)] - 1, 0)] if len(end) else np.zeros(len(begin), np.uint8)
    f = np.stack([
        np.ones(len(begin), bool), ~text_line, (line_words > 0) & (line_words < 3), line_words >= 8,
        (of(symbols) > 0) & (of(symbols) * 20 < size), of(symbols) * 20 >= size, of(bangs) * 2 >= many, of(upper) * 2 >= np.maximum(1, of(letters)),
        of(digits) * 4 >= size, dup, (twin[w1] - twin[np.minimum(w0 + 1, w1)]) * 3 >= many, text_line & np.isin(tail, np.frombuffer(b".?\"')", np.uint8)),
        text_line & (of(letters) == 0),
    ], 1).astype(np.uint8)
    lines_sum = lambda x: np.add.reduceat(x, lines[:-1]) if n else np.zeros(0, np.int64)
    return Sheet(np.diff(first), solid[off[1:]] - solid[off[:-1]], symbols[off[1:]] - symbols[off[:-1]], lines_sum(dup.astype(np.int64)), per_doc(covered.astype(np.int64)), lines, line_words, f)


def _by_step(lines: np.ndarray):
    """The texts by falling number of lines, and for each step the rows of the texts that have so many lines."""
    size = np.diff(lines)
    order = np.argsort(-size, kind="stable")
    live = np.searchsorted(-size[order], -np.arange(1, size.max(initial=0) + 1), "right")
    return order, [lines[order[:k]] + t for t, k in enumerate(live)]


def viterbi(crf: Field, features: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """The most probable labels of all lines, for all texts at once; of equal paths the one with more content."""
    lead = features @ crf.lead
    gain = np.stack((np.zeros(len(lead)), lead), 1)
    back = np.zeros((len(lead), 2), np.int8)
    _, steps = _by_step(lines)
    best = np.zeros((0, 2))
    ends = []
    for t, rows in enumerate(steps):
        if t == 0:
            best = gain[rows]
        else:
            ends.append(best[len(rows) :])
            paths = best[: len(rows), :, None] + crf.step[None]
            up = paths[:, CONTENT] >= paths[:, BOILERPLATE]
            back[rows] = up
            best = np.where(up, paths[:, CONTENT], paths[:, BOILERPLATE]) + gain[rows]
    ends.append(best)
    label = np.zeros(len(lead), np.int8)
    now = np.zeros(0, np.int8)
    for t in reversed(range(len(steps))):
        fresh = ends[t + 1] if len(ends) == len(steps) + 1 else ends[t]
        new = (fresh[:, CONTENT] >= fresh[:, BOILERPLATE]).astype(np.int8)
        now = np.concatenate((now, new))
        label[steps[t]] = now
        now = back[steps[t], now]
    return label


def train(features: np.ndarray, lines: np.ndarray, quality: np.ndarray, rounds: int = 80, rate: float = 0.3, ridge: float = 1e-3) -> Field:
    """Fit the field to maximum conditional likelihood; a text's quality labels all of its lines."""
    crf = Field()
    size = np.diff(lines)
    if not len(quality) or quality.min() == quality.max():
        return crf
    # each class counts half
    weight = np.where(quality == 1, 0.5 / max(1, size[quality == 1].sum()), 0.5 / max(1, size[quality == 0].sum()))
    row_weight, gold = np.repeat(weight, size), np.repeat(quality, size)
    _, steps = _by_step(lines)
    f = features.astype(np.float64)
    theta = np.concatenate((crf.lead, crf.step.ravel()))
    seen = np.zeros(len(theta))
    for _ in range(rounds):
        lead, step = theta[: f.shape[1]], theta[f.shape[1] :].reshape(2, 2)
        gain = np.stack((np.zeros(len(f)), f @ lead), 1)
        fwd, bwd = np.zeros_like(gain), np.zeros_like(gain)
        for t, rows in enumerate(steps):
            before = np.logaddexp.reduce(fwd[steps[t - 1][: len(rows)]][:, :, None] + step[None], 1) if t else 0.0
            fwd[rows] = before + gain[rows]
        pairs = np.zeros((2, 2))
        for t in reversed(range(1, len(steps))):
            rows, prev = steps[t], steps[t - 1][: len(steps[t])]
            bwd[prev] = np.logaddexp.reduce(step[None] + (gain[rows] + bwd[rows])[:, None, :], 2)
        norm = np.logaddexp.reduce(fwd + bwd, 1)
        p = np.exp(fwd[:, 1] + bwd[:, 1] - norm)
        for t in range(1, len(steps)):
            rows, prev = steps[t], steps[t - 1][: len(steps[t])]
            joint = np.exp(fwd[prev][:, :, None] + step[None] + (gain[rows] + bwd[rows])[:, None, :] - norm[rows][:, None, None])
            pairs -= (joint * row_weight[rows][:, None, None]).sum(0)
            for y in (0, 1):
                pairs[y, y] += row_weight[rows][gold[rows] == y].sum()
        slope = np.concatenate((f.T @ (row_weight * (gold - p)), pairs.ravel())) - ridge * theta
        seen += slope**2
        theta += rate * slope / (np.sqrt(seen) + 1e-9)
    return Field(theta[: f.shape[1]], theta[f.shape[1] :].reshape(2, 2))


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCUMENTS, text: str = "text", doc_id: str = "doc_id") -> Field:
    """Train on at most `limit` labelled documents (labels: doc_id, quality), those with the smallest hash of their id.

    Executors read the texts; only line features, a byte each, come to the driver. Labels without a document,
    text or id are passed over; of labels that contradict each other the worse counts, of rows that repeat an id one, that
    of the least features.
    """
    short_batches(docs.sparkSession)
    chosen = labels.select(F.col("doc_id").alias("__id"), F.col("quality").alias("__quality")).dropna().groupBy("__id").agg(F.min("__quality").alias("__quality"))
    chosen = chosen.orderBy(F.xxhash64("__id"), "__id").limit(limit)
    # at most `limit` ids are broadcast, so the texts are not shuffled
    sample = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).where("length(__text) > 0").join(F.broadcast(chosen), "__id")

    def run(batches):
        for batch in slices(batches, "__text"):
            s = read(batch.column("__text"))
            rows = [s.features[a:b].tobytes() for a, b in zip(s.lines[:-1], s.lines[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("__id").cast(pa.int64()), batch.column("__quality").cast(pa.int64()), pa.array(rows, pa.binary())], ["id", "quality", "features"])

    # a row for each id, whatever repeats it: tasks find the least of theirs first
    rows = sample.mapInArrow(run, "id long, quality long, features binary").groupBy("id").agg(F.first("quality").alias("quality"), F.min("features").alias("features"))
    found = sorted(rows.collect(), key=lambda r: r.id)
    each = [np.frombuffer(r.features, np.uint8).reshape(-1, len(FEATURES)) for r in found]
    if not each:
        return Field()
    return train(np.concatenate(each), np.concatenate(([0], np.cumsum([len(x) for x in each]))), np.array([min(1, r.quality) for r in found]))


def judge(docs: DataFrame, crf: Field, share: float = CONTENT_SHARE, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content_share,
    base_failed, kept.

    Null, empty and blank texts have no words and fail the base rules. Repeated rows are judged alike; null ids
    stay null. An empty table gives an empty result; other columns are not looked at.
    """
    short_batches(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches):
        for batch in slices(batches, "__text"):
            s = read(batch.column("__text"))
            label = viterbi(crf, s.features, s.lines)
            good = np.add.reduceat(s.line_words * label, s.lines[:-1])
            part = good / np.maximum(1, s.n_words)
            failed = (s.n_words < MIN_WORDS) | (100 * s.n_repeat_words > MAX_REPEAT_PERCENT * s.n_words)
            counts = [pa.array(x.astype(np.int64)) for x in (s.n_words, s.word_chars, s.n_symbols, s.n_dup_lines, s.n_repeat_words)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, pa.array(part), pa.array(failed), pa.array(~failed & (part >= share))], ["doc_id", *names, "content_share", "base_failed", "kept"])

    sheet = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kind = sheet.schema["doc_id"].dataType.simpleString()
    return sheet.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names) + ", content_share double, base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, crf: Field, share: float = CONTENT_SHARE, text: str = "text") -> DataFrame:
    """The rows of docs that are kept, with all columns as they are; judged where they stand, without a join."""

    def run(batches, name):
        for batch in slices(batches, name):
            s = read(batch.column(name))
            good = np.add.reduceat(s.line_words * viterbi(crf, s.features, s.lines), s.lines[:-1])
            failed = (s.n_words < MIN_WORDS) | (100 * s.n_repeat_words > MAX_REPEAT_PERCENT * s.n_words)
            yield batch.filter(pa.array(~failed & (good >= share * np.maximum(1, s.n_words))))

    short_batches(docs.sparkSession)
    return map_rows(docs, text, run)
