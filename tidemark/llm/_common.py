"""Helpers shared by the corpus operators: stored intermediates, null-safe text, packed arrays."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the contracts: space and the controls from tab to carriage return.
SPACE = "[\\x20\\x09-\\x0D]"
#: Text bytes handled at once inside a Python task; one longer document is handled alone.
SLICE_BYTES = 1 << 19
#: Rows in an Arrow batch to a Python task, at most; texts may be long.
BATCH_ROWS = 1_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; a folder of our own only where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        local = spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local"
        found = tempfile.mkdtemp(prefix="tidemark-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_work"
        spark.sparkContext.setCheckpointDir(found)
    return found


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there."""
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone at exit
        pass


def short_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows, if they are longer: they are cut by rows, not by bytes."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(conf)) <= BATCH_ROWS:
        spark.conf.set(conf, str(BATCH_ROWS))


def store(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: the lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored = path
    return out


def discard(*stored: DataFrame) -> None:
    """Delete tables of `store` that nothing will read any more."""
    for df in stored:
        remove(df.sparkSession, df._stored)


def packed_rows(docs: DataFrame, **columns: str) -> DataFrame:
    """docs with each whole row as the struct __row, and the named columns under their new names; so no name of docs
    can clash with an operator's own. select("__row.*") gives the rows back."""
    row = F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("__row")
    return docs.select(row, *(docs[f"`{old}`"].alias(new) for new, old in columns.items()))


def map_rows(docs: DataFrame, text: str, run) -> DataFrame:
    """docs through run(batches, name of the text column), with docs' columns, whatever their names are."""
    plain = docs.toDF(*(f"c{k}" for k in range(len(docs.columns))))
    name = f"c{docs.columns.index(text)}"
    return plain.mapInArrow(lambda batches: run(batches, name), plain.schema).toDF(*docs.columns)


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, a stored table, marked for broadcast if it has at most so many rows; else a join shuffles it."""
    return F.broadcast(df) if df.count() <= rows else df


def text_of(column: str = "text"):
    """The text, with null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about `limit` bytes of `column`; a longer text stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends, at = np.cumsum(size), 0
        while at < len(size):
            base = ends[at] - size[at]
            to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def gathered(batches: Iterable[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """Put record batches together until they hold `limit` bytes of `column`, in the order in which they come."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in slices(batches, column, limit):
        held.append(batch)
        size += pc.sum(pc.binary_length(batch.column(column))).as_py() or 0
        if size >= limit:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes end to end (uint8) and the n+1 offsets between them; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string()), b"" if pa.types.is_binary(column.type) else "")
    if column.offset or not len(column):
        column = pa.concat_arrays([column])
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)[column.offset :] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


_RANDOM = np.random.default_rng(20240229)
#: A random odd-ended 64-bit number for each byte value, and the base of the running sums.
BYTE_VALUES = _RANDOM.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def of(base: int) -> np.ndarray:
        p = np.full(n, base, np.uint64)
        p[0] = 1
        return np.cumprod(p, dtype=np.uint64)

    return of(_BASE), of(_BASE_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class SpanHash:
    """Hashes of any byte spans of `data`, from one pass of running sums modulo 2**64."""

    def __init__(self, data: np.ndarray):
        power, self._inverse = _powers(1 << max(20, int(len(data) + 1).bit_length()))
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * power[: len(data)], out=self._sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self._sums[end] - self._sums[start]) * self._inverse[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case; other bytes stay."""
    return _LOWER[data]


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text (n+1 offsets) where its words begin in them."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~_IS_SPACE[data]
    start = solid[1:] & ~solid[:-1]
    end = solid[:-1] & ~solid[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    both = inner[solid[inner] & solid[inner + 1]]  # a word never runs on into the next text
    start[both] = True
    end[both] = True
    starts, ends = np.flatnonzero(start[: len(data)]), np.flatnonzero(end)
    return starts, ends, np.searchsorted(starts, off)


def shingle_hashes(word: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word shingles, unsorted, and n+1 offsets by text. A shorter text gives one, of all its words."""
    factor = np.uint64(0x9FB21C651E98DF25)
    count = np.diff(first)
    full = np.zeros(max(0, len(word)), np.uint64)
    if len(word) >= n:
        h = np.full(len(word) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * factor + word[k : len(word) - n + 1 + k]
        full[: len(h)] = mix(h)
    have = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    out_off = np.concatenate(([0], np.cumsum(have)))
    pick = np.repeat(first[:-1] - out_off[:-1], have) + np.arange(out_off[-1])
    out = full[pick]
    for d in np.flatnonzero((count > 0) & (count < n)):
        h = int(count[d])
        for w in word[first[d] : first[d + 1]]:
            h = (h * int(factor) + int(w)) & 0xFFFFFFFFFFFFFFFF
        out[out_off[d]] = mix(np.array([h], np.uint64))[0]
    return out, out_off


def list_column(flat: np.ndarray, off: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat, kind))
