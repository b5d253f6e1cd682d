"""Operator 8: licence scans.

Overlapping windows of each text, in sizes that follow the templates', are sketched with MinHash; a window that agrees
with a template in any band retrieves it, and the template's word shingles are then sought in the text around the
window. A template is found where enough of them are there.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SpanHash, mix, short_batches, slices, utf8, words
from .license_templates import TEMPLATES

SHINGLE, PERCENT = 5, 80
#: The first window sizes in words; each further one is the sum of the two before, as far as templates need. A template is
#: sought with the least size that holds it. A window begins every quarter of its size.
FIRST_SIZES = (5, 8)
#: Bands of one row each. A window that covers 7/8 of a template of which 80 % is there has a similarity of at least
#: 0.7 / (13/8 + 1 - 0.7) = 0.36 and so agrees in one of 32 bands with a probability above 0.9999993.
BANDS = 32
_TABLE_BITS = 16

_SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64)) | np.uint64(1)
_PLAIN = np.full(256, 32, np.uint8)
for _range in (range(48, 58), range(97, 123), range(128, 256)):
    _PLAIN[list(_range)] = list(_range)
_PLAIN[65:91] = range(97, 123)
_PLAIN[10] = 32


def plain_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of words after A-Z is lowered and other ASCII than letters and digits is blanked; texts' offsets in them."""
    data = _PLAIN[data]
    start, end, first = words(data, off)
    return SpanHash(data)(start, end), first


def _shingles(word: np.ndarray) -> np.ndarray:
    n = len(word) - SHINGLE + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(n, SHINGLE, np.uint64)
    for k in range(SHINGLE):
        h = h * np.uint64(0x9FB21C651E98DF25) + word[k : n + k]
    return mix(h)


def _rows(shingle: np.ndarray) -> np.ndarray:
    """BANDS x shingles: 32 bits of each band's hash."""
    return ((shingle[None, :] * _SEEDS[:, None]) >> np.uint64(32)).astype(np.uint32)


@dataclass
class Template:
    licence: str
    number: int
    words: int
    shingles: np.ndarray


class Index:
    """Templates by window size, with the bands' values."""

    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.by_size: dict[int, list[Template]] = {}
        self.sizes = list(FIRST_SIZES)
        for number, (licence, notice) in enumerate(templates):
            raw = np.frombuffer(notice.encode(), np.uint8)
            word, _ = plain_words(raw, np.array([0, len(raw)]))
            if len(word) < SHINGLE:
                raise ValueError(f"template {number} has {len(word)} words; {SHINGLE} are the least that can be sought")
            while self.sizes[-1] < len(word):
                self.sizes.append(self.sizes[-1] + self.sizes[-2])
            self.by_size.setdefault(next(s for s in self.sizes if s >= len(word)), []).append(Template(licence, number, len(word), np.unique(_shingles(word))))
        self.bands: dict[int, np.ndarray] = {s: np.stack([_rows(t.shingles).min(1) for t in ts], 1) for s, ts in self.by_size.items()}
        self.tables: dict[int, np.ndarray] = {}
        for s, bands in self.bands.items():
            self.tables[s] = np.zeros((BANDS, 1 << _TABLE_BITS), bool)
            for k in range(BANDS):
                self.tables[s][k, bands[k] >> np.uint32(32 - _TABLE_BITS)] = True

    def retrieve(self, shingle: np.ndarray) -> list[tuple[int, Template]]:
        """(first word, template) of all windows that agree with a template in a band. Windows run on over all words."""
        if not len(shingle):
            return []
        out = []
        reach, least = 1, _rows(shingle)
        for size in self.sizes:
            m = min(size - SHINGLE + 1, len(shingle))
            if size not in self.by_size:
                continue
            while reach * 2 <= m:
                least = np.minimum(least[:, :-reach], least[:, reach:])
                reach *= 2
            gap, stride = max(0, m - reach), max(1, size // 4)
            at = np.unique(np.append(np.arange(0, len(shingle) - m + 1, stride), len(shingle) - m))
            window = np.minimum(least[:, at], least[:, at + gap])
            bands = self.bands[size]
            hits = set()
            for k in range(BANDS if m > 1 else 1):
                for w in np.flatnonzero(self.tables[size][k, window[k] >> np.uint32(32 - _TABLE_BITS)]):
                    hits.update((int(at[w]), int(t)) for t in np.flatnonzero(bands[k] == window[k, w]))
            out += [(w, self.by_size[size][t]) for w, t in sorted(hits)]
        return out


def scan_slice(index: Index, column: pa.Array, percent: int) -> list[tuple[int, str, int, int, int, int]]:
    """(text's number, licence, template, first word, shingles found, shingles of the template) of each text's best."""
    word, first = plain_words(*utf8(column))
    shingle = _shingles(word)
    best: dict[tuple[int, int], tuple[int, int, Template]] = {}
    for at, t in index.retrieve(shingle):
        # a window can reach over texts; each text in reach is looked at on its own
        lo, hi = at - t.words, at + 2 * t.words + SHINGLE
        a, b = np.searchsorted(first, max(lo, 0), "right") - 1, np.searchsorted(first, min(hi, len(word)), "left")
        for d in range(a, b):
            s, e = max(lo, first[d]), min(hi, first[d + 1]) - SHINGLE + 1
            if e <= s:
                continue
            there = np.flatnonzero(np.isin(shingle[s:e], t.shingles))
            # no more than half as long again as the template, wherever in reach that holds the most
            span = max(1, t.words * 3 // 2 - SHINGLE + 1)
            for k in there:
                inside = there[(there >= k) & (there < k + span)]
                found = len(np.unique(shingle[s + inside]))
                if 100 * found >= percent * len(t.shingles):
                    key, value = (d, t.number), (found, -int(s + k - first[d]), t)
                    if key not in best or value[:2] > best[key][:2]:
                        best[key] = value
    return [(d, t.licence, number, -at, found, len(t.shingles)) for (d, number), (found, at, t) in sorted(best.items(), key=lambda x: x[0])]


@lru_cache(maxsize=1)
def index_of(templates: tuple[tuple[str, str], ...]) -> Index:
    """The index of templates, built once in each worker."""
    return Index(templates)


def templates_from(folder: str) -> tuple[tuple[str, str], ...]:
    """(name, text) of all files of a folder of licence texts, by name; for whole licences that are not among TEMPLATES."""
    return tuple((p.stem, p.read_text(encoding="utf-8", errors="replace")) for p in sorted(Path(folder).iterdir()) if p.is_file())


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """A row for each template found in a row of docs: doc_id, license, template, first_word, n_found, n_template, containment.

    A template is found if at least `percent` of its distinct five-word shingles are in a stretch of the text half as
    long again as the template; the fullest stretch is reported, the first of equal ones. Null, empty and blank texts
    hold none. Of templates that a stretch holds alike, each is reported. Repeated rows are each reported; null ids stay null. An empty table gives an empty result; other
    columns are not looked at.
    """
    Index(templates)  # a template that can't be sought is told here, not in a task
    names = ["doc_id", "license", "template", "first_word", "n_found", "n_template", "containment"]

    def run(batches):
        index = index_of(templates)
        for batch in slices(batches, "__text"):
            rows = scan_slice(index, batch.column("__text"), percent)
            doc, licence, number, at, found, size = zip(*rows, strict=True) if rows else ((),) * 6
            share = [f / s for f, s in zip(found, size, strict=True)]
            counts = [pa.array(x, pa.int64()) for x in (number, at, found, size)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(licence, pa.string()), *counts, pa.array(share, pa.float64())], names)

    short_batches(docs.sparkSession)
    sheet = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    kind = sheet.schema["doc_id"].dataType.simpleString()
    return sheet.mapInArrow(run, f"doc_id {kind}, license string, template long, first_word long, n_found long, n_template long, containment double")
