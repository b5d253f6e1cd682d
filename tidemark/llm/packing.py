"""Operator 10: hierarchical multi-length packing.

Documents are tokenised and routed by what is left of them after full windows to tiers of power-of-two window
sizes. Each tier's windows are packed, longest tier first; the gap that a document leaves in its window is filled
from shorter tiers, whole documents first and then the head of one. What no longer fills a window is laid out in
windows of the powers of two that add up to it, so nothing is padded. Windows are dealt to step groups of equal
token counts, as nearly as they allow. Every task packs its own documents, a bounded number at a time, so no row is shuffled.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import heapreplace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import gathered, short_batches

END = 1
#: Text bytes packed together; what is left over at the end of each is less than one window.
GROUP_BYTES = 8 << 20
#: Fixed value: the pattern by which the vocabulary's pre-tokeniser splits a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class FileTokenizer:
    """The ids of `tokenizers` for a byte-level BPE file, whole texts at a time.

    A byte-level vocabulary in merge order is also a table of ranks, so tiktoken gives the same ids several times
    faster; it is built from the same file. A text that it refuses, or that holds one of the file's added tokens, is left to
    `tokenizers`.
    """

    def __init__(self, path: str):
        import tiktoken

        self._path, self._whole = path, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self._added = [t["content"] for t in file["added_tokens"]]
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in kept)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in file["model"]["vocab"].items() if all(c in byte_of for c in token) and token not in self._added}
        self._fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def _slow(self, text: str) -> np.ndarray:
        if self._whole is None:  # few texts need it, and it takes as much memory as the other
            from tokenizers import Tokenizer

            self._whole = Tokenizer.from_file(self._path)
        return np.array(self._whole.encode(text, add_special_tokens=False).ids, "<u4")

    def encode(self, text: str) -> np.ndarray:
        """The ids as little-endian 32-bit numbers, with nothing put before or after the text."""
        if any(t in text for t in self._added):
            return self._slow(text)
        try:
            return self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
        except BaseException as e:  # the library panics, not as an Exception, where its pattern runs too deep
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return self._slow(text)


@dataclass(frozen=True)
class Piece:
    doc: int
    start: int
    length: int
    window: int
    offset: int


def _tier(n: int, least: int) -> int:
    return max(least, 1 << (n - 1).bit_length())


def pack(lengths: list[int], size: int = 2048, least_tier: int = 256) -> tuple[list[Piece], list[int]]:
    """Pieces of documents of these lengths, and the size of each window. Every window is full.

    size and least_tier are powers of two. A document of length 0 has no piece.
    """
    pieces: list[Piece] = []
    windows: list[int] = []
    # what is left of each document after its full windows: (length, document, start), in order of length
    pool: list[tuple[int, int, int]] = []
    for doc, n in enumerate(lengths):
        for start in range(0, n - n % size, size):
            pieces.append(Piece(doc, start, size, len(windows), 0))
            windows.append(size)
        if n % size:
            pool.append((n % size, doc, n - n % size))
    pool.sort()

    def fill(gap: int, offset: int) -> None:
        """Fill the last window's gap from the pool, which holds enough."""
        while gap:
            k = bisect_right(pool, (gap, len(lengths), 0)) - 1
            n, doc, start = pool.pop(k if k >= 0 else 0)
            take = min(n, gap)
            pieces.append(Piece(doc, start, take, len(windows) - 1, offset))
            if take < n:
                insort(pool, (n - take, doc, start + take))
            gap, offset = gap - take, offset + take

    left = sum(x[0] for x in pool)
    tier = size
    while tier >= least_tier:
        floor = tier // 2 if tier > least_tier else 0
        while pool and pool[-1][0] > floor and left >= tier:
            n, doc, start = pool.pop()  # the longest of its tier: gaps are left to shorter tiers
            take = min(n, tier)
            windows.append(tier)
            pieces.append(Piece(doc, start, take, len(windows) - 1, 0))
            if take < n:
                insort(pool, (n - take, doc, start + take))
            fill(tier - take, take)
            left -= tier
        tier //= 2
    for bit in reversed(range(left.bit_length())):
        if left >> bit & 1:
            windows.append(1 << bit)
            fill(1 << bit, 0)
    return pieces, windows


def step_groups(windows: list[int], capacity: int) -> list[int]:
    """A step group for each window: no more groups than the tokens fill, and each window, longest first, in the group that
    holds least. As sizes are powers of two and capacity is a multiple of the largest, no group exceeds it, and groups
    differ by no more than the shortest windows that are there to level them."""
    groups = max(1, -(-sum(windows) // capacity))
    held = [(0, g) for g in range(groups)]
    out = [0] * len(windows)
    for k in sorted(range(len(windows)), key=lambda k: -windows[k]):
        n, g = held[0]
        out[k] = g
        heapreplace(held, (n + windows[k], g))
    return out


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, least_tier: int = 256, windows_per_step: int = 8, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Pieces of all rows of docs: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, step_group.

    Numbers of sequences and step groups begin with the task's, so they follow the input's partitions. Null and empty texts
    are a single end token. Rows that repeat an id are packed as documents of their own; null
    ids stay null. An empty table gives an empty result. tokenizer: path of a vocabulary file on every worker.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group"]

    def run(batches) -> Iterator[pa.RecordBatch]:
        words = FileTokenizer(tokenizer)
        end = np.array([END], "<u4")
        task = TaskContext.get().partitionId() << 32
        used = groups = 0
        for batch in gathered(batches, "__text", GROUP_BYTES):
            ids = [np.append(words.encode(t), end) for t in batch.column("__text").to_pylist()]
            lengths = [len(x) for x in ids]
            pieces, windows = pack(lengths, size, least_tier)
            steps = step_groups(windows, size * windows_per_step)
            rows = [(p.doc, p.start, p.length, zlib.crc32(ids[p.doc][p.start : p.start + p.length]), lengths[p.doc], task + used + p.window, p.offset, windows[p.window], task + groups + steps[p.window]) for p in pieces]
            columns = list(zip(*rows, strict=True))
            ids_of = batch.column("doc_id").take(pa.array(columns[0], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_of, *(pa.array(c, pa.int64()) for c in columns[1:])], names)
            used, groups = used + len(windows), groups + max(steps) + 1

    short_batches(docs.sparkSession)
    sheet = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kind = sheet.schema["doc_id"].dataType.simpleString()
    return sheet.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names[1:]))


def unpack_check(lengths: list[int], pieces: list[Piece], windows: list[int]) -> bool:
    """Whether the pieces cover each document once and each window without a gap."""
    docs: dict[int, int] = {}
    for p in sorted(pieces, key=lambda p: (p.doc, p.start)):
        if docs.get(p.doc, 0) != p.start:
            return False
        docs[p.doc] = p.start + p.length
    at: dict[int, int] = {}
    for p in sorted(pieces, key=lambda p: (p.window, p.offset)):
        if at.get(p.window, 0) != p.offset:
            return False
        at[p.window] = p.offset + p.length
    return all(docs.get(k, 0) == n for k, n in enumerate(lengths)) and all(at[k] == n for k, n in enumerate(windows))
