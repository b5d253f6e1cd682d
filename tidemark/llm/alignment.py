"""Operator 12: alignment of two tokenizers over whole texts.

For each text the byte ranges of B's tokens form a static interval index: sorted starts and sorted ends. Each token of A
stabs it with two bisections, which list all of B's tokens that overlap it. A place between two tokens that no range of
either side spans ends a group. One pass over the texts gives groups and each document's distinct linked id pairs; how many
documents hold a pair is then counted by Spark, and brought back to the documents that hold it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import short_batches, slices, store
from .packing import FileTokenizer

#: Pairs sent to every task at most, the most frequent ones; rarer ones are joined by a shuffle.
FREQUENT_PAIRS = 1 << 19
#: Fixed value: the character that stands for a space in B's pieces.
SPACE_PIECE = "▁"


class Side:
    """A tokenizer of one side: `encode` maps texts to lists of ids, `pieces` holds the bytes of each id."""

    def __init__(self, encode: Callable[[list[str]], list], pieces: list[bytes]):
        self.encode, self.pieces = encode, pieces
        self.size = np.array([len(p) for p in pieces], np.int64)


class PlainTokenizer(FileTokenizer):
    """`FileTokenizer` for which the strings of added tokens are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self._added = []

    def _slow(self, text: str) -> np.ndarray:
        if self._whole is None:
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._path)
            self._whole.encode_special_tokens = True
        return super()._slow(text)


def byte_level_side(path: str) -> Side:
    """A byte-level BPE file, for a space and the text; its vocabulary's characters stand for bytes."""
    tokenizer = PlainTokenizer(path)
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in kept)}
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    pieces = [b""] * (max(vocab.values()) + 1)
    for token, k in vocab.items():
        pieces[k] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    return Side(lambda texts: [tokenizer.encode(" " + t) for t in texts], pieces)


def piece_side(path: str) -> Side:
    """A piece model, for the text; it adds the space itself."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    piece = model.id_to_piece
    pieces = [bytes([int(piece(k)[3:5], 16)]) if model.is_byte(k) else piece(k).replace(SPACE_PIECE, " ").encode() for k in range(model.vocab_size())]
    return Side(lambda texts: model.encode(texts, num_threads=1), pieces)


class IntervalIndex:
    """Byte ranges that follow each other without gaps or overlaps, for stabbing queries by bisection."""

    def __init__(self, ends: np.ndarray):
        self.ends = ends
        self.starts = np.append(0, ends[:-1])

    def overlapping(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query range the first of the ranges that overlaps it, and the one after the last."""
        return np.searchsorted(self.ends, starts, "right"), np.searchsorted(self.starts, ends, "left")

    def spans(self, places: np.ndarray) -> np.ndarray:
        """Whether a range holds the bytes on both sides of a place."""
        at = np.minimum(np.searchsorted(self.ends, places, "left"), len(self.ends) - 1)
        return (self.starts[at] < places) & (places < self.ends[at])


@dataclass
class Aligned:
    """Texts laid end to end: their tokens, the offsets of their tokens by text, groups and links."""

    a: np.ndarray
    b: np.ndarray
    a_off: np.ndarray
    b_off: np.ndarray
    a_group: np.ndarray
    b_group: np.ndarray
    groups: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray
    links: np.ndarray


def align(a: list[np.ndarray], b: list[np.ndarray], a_size: np.ndarray, b_size: np.ndarray) -> Aligned:
    """Groups and links of texts of which both sides' tokens add up to the same bytes, none of them of no bytes.

    a_group, b_group: each token's group, numbered over all texts; groups and links: how many each text has;
    link_a, link_b: the places of linked tokens, in order of A.
    """
    off = lambda x: np.append(0, np.cumsum([len(t) for t in x], dtype=np.int64))
    flat = lambda x: np.concatenate([np.asarray(t, np.int64) for t in x]) if x else np.zeros(0, np.int64)
    out = Aligned(flat(a), flat(b), off(a), off(b), *[np.zeros(0, np.int64)] * 6)
    out.groups = out.links = np.zeros(len(a), np.int64)
    if not len(out.a):
        return out
    ends = np.cumsum(a_size[out.a])
    starts = np.append(0, ends[:-1])
    index = IntervalIndex(np.cumsum(b_size[out.b]))
    first, past = index.overlapping(starts, ends)
    width = past - first
    out.link_a = np.repeat(np.arange(len(out.a)), width)
    out.link_b = np.arange(len(out.link_a)) + np.repeat(first - np.append(0, np.cumsum(width)[:-1]), width)
    out.links = np.diff(np.append(0, np.cumsum(width))[out.a_off])
    # a token of A never spans its own end, so a gap is open where no token of B spans it
    open_ = ~index.spans(ends)
    out.a_group = np.cumsum(open_) - open_
    out.b_group = np.searchsorted(ends[open_], index.ends, "left")
    out.groups = np.diff(np.append(0, np.cumsum(open_))[out.a_off])
    return out


def _digests(x: Aligned, marks: list[bytes], n_a: int) -> list[str]:
    """SHA-256 of each text's groups: `marks` holds the decimal ids with what may follow: A's with a comma, A's with a
    bar, B's with a comma, B's with a semicolon."""
    n_b = len(marks) // 2 - n_a
    code = np.empty(len(x.a) + len(x.b), np.int64)
    last_a = np.append(x.a_group[1:] != x.a_group[:-1], True)
    last_b = np.append(x.b_group[1:] != x.b_group[:-1], True)
    # a group's tokens of A come after all earlier groups' tokens of B, those of B after its own tokens of A
    code[np.arange(len(x.a)) + np.searchsorted(x.b_group, x.a_group, "left")] = x.a + n_a * last_a
    code[np.arange(len(x.b)) + np.searchsorted(x.a_group, x.b_group, "right")] = 2 * n_a + x.b + n_b * last_b
    off = x.a_off + x.b_off
    return [hashlib.sha256(b"".join(map(marks.__getitem__, code[s:e].tolist()))[:-1]).hexdigest() if e > s else "" for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]


def _aligner(make_a: Callable[[], Side], make_b: Callable[[], Side], kind: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of (doc_id, text) to the rows of `aligned`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a_side, b_side = make_a(), make_b()
        decimal = lambda n, end: [b"%d" % k + end for k in range(n)]
        n_a, n_b = len(a_side.pieces), len(b_side.pieces)
        marks = decimal(n_a, b",") + decimal(n_a, b"|") + decimal(n_b, b",") + decimal(n_b, b";")
        joined = lambda side, ids: b"".join(map(side.pieces.__getitem__, ids))
        for part in slices(batches, "text"):
            texts = [t or "" for t in part.column("text").to_pylist()]
            a, b = [list(x) for x in a_side.encode(texts)], b_side.encode(texts)
            for k, t in enumerate(texts):
                whole = b" " + t.encode()
                if not t or joined(a_side, a[k]) != whole or joined(b_side, b[k]) != whole:
                    a[k] = b[k] = []
            x = align(a, b, a_side.size, b_side.size)
            doc = np.repeat(np.arange(len(texts)), x.links)
            cell, times = np.unique((doc * n_a + x.a[x.link_a]) * n_b + x.b[x.link_b], return_counts=True)
            pair = pa.StructArray.from_arrays([pa.array(cell % (n_a * n_b)).cast(kind), pa.array(times)], ["pair", "times"])
            held = pa.ListArray.from_arrays(pa.array(np.searchsorted(cell, np.arange(len(texts) + 1) * (n_a * n_b)), pa.int32()), pair)
            counts = [pa.array(v, pa.int64()) for v in (np.diff(x.a_off), np.diff(x.b_off), x.groups, x.links)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *counts, pa.array(_digests(x, marks, n_a), pa.string()), held], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return run


def pair_counts(documents: DataFrame, n_b: int) -> DataFrame:
    """(pair, n, best): how many documents hold each linked id pair, and whether no pair of its A id is in more; stored."""
    counts = store(documents.select(F.explode("pairs.pair").alias("pair")).groupBy("pair").agg(F.count("*").alias("n")), "pair-counts")
    id_a = F.floor(F.col("pair") / F.lit(n_b)).cast("int")
    most = counts.groupBy(id_a.alias("id_a")).agg(F.max("n").alias("most"))
    return store(counts.withColumn("id_a", id_a).join(most, "id_a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def least_frequent_level(counts: DataFrame, limit: int) -> int:
    """The least level, a power of two, such that at most `limit` pairs are in that many documents or more."""
    level = F.length(F.bin("n")) - 1
    least = 64
    for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("pairs")).orderBy(F.col("level").desc()).collect():  # 64 rows at most
        limit -= r.pairs
        if limit < 0:
            break
        least = r.level
    return least


def align_tokens(docs: DataFrame, byte_level: str, pieces: str, text: str = "text", doc_id: str = "doc_id", frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A is the byte-level BPE file, which encodes a space and the text, B the piece model, which adds the space itself. Links are all
    pairs of an A and a B token whose bytes overlap; a pair's count is the number of documents that hold it. n_best: links whose
    count is the highest of their A id, ties included; count_sum: counts summed over links. Texts that are null
    or empty, or that a side doesn't give back byte for byte, have no tokens: zeros and an empty string. Special
    tokens' strings are plain text. Repeated rows count as documents and get a row each; null ids stay null.
    An empty table gives an empty result. Other columns play no part.
    """
    short_batches(docs.sparkSession)
    n_a, n_b = len(byte_level_side(byte_level).pieces), len(piece_side(pieces).pieces)
    kind = "int" if n_a * n_b < 1 << 31 else "long"
    run = _aligner(lambda: byte_level_side(byte_level), lambda: piece_side(pieces), f"int{32 if kind == 'int' else 64}")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    aligned = rows.mapInArrow(run, f"doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<struct<pair: {kind}, times: long>>")
    aligned = store(aligned.withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = pair_counts(aligned, n_b)
    level = least_frequent_level(counts, frequent)
    often = F.col("n") >= F.lit(2.0**level)
    links = aligned.select("row", F.inline("pairs"))
    parts = [links.join(F.broadcast(counts.where(often)), "pair")]  # `frequent` rows at most
    rare = counts.where(~often)
    if not rare.isEmpty():
        parts.append(links.join(F.broadcast(counts.where(often).select("pair")), "pair", "left_anti").join(rare, "pair"))
    summed = lambda x: x.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    sums = summed(parts[0])
    if len(parts) > 1:
        sums = sums.unionByName(summed(parts[1])).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    none = F.lit(0).cast("long")
    return aligned.drop("pairs").join(sums, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256")
