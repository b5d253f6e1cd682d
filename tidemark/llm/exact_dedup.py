"""Operator 1: exact deduplication with counting quotient filters.

Each input partition builds counting quotient filters of its texts' 64-bit fingerprints, one for each range of
quotients; filters of one range merge losslessly by their sorted remainders. Fingerprints counted more than
once are routed to byte verification; all other texts are unique without a second look.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SPACE, few, packed_rows, store, text_of
from .quotient_filter import CountingQuotientFilter

#: Fingerprints that one range of quotients holds on the mean; the number of ranges follows the number of rows.
RANGE_ROWS = 200_000
#: Up to so many repeated fingerprints (16 bytes each) are broadcast to pick the texts to verify; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: The same for groups of equal texts (some 120 bytes each), which pick the rows that stay.
GROUP_ROWS = 200_000


def normalised(column: str = "text"):
    return F.regexp_replace(text_of(column), f"{SPACE}+", " ")


def _range_bits(rows: int) -> int:
    return max(0, int(np.ceil(np.log2(max(1, rows) / RANGE_ROWS))))


def repeated_fingerprints(prints: DataFrame, rows: int) -> DataFrame:
    """Of a column fp: the fingerprints (long) that occur more than once, with their count."""
    bits = _range_bits(rows)

    def build(batches):
        held = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        if not held:
            return
        fp = np.sort(np.concatenate(held))
        part = (fp >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(fp), np.int64)
        for x in np.split(fp, np.flatnonzero(np.diff(part)) + 1):
            if len(x):
                key = int(x[0] >> np.uint64(64 - bits)) if bits else 0
                # within its range a filter's quotients start after the range's own bits
                out = CountingQuotientFilter.build(x << np.uint64(bits))
                yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([out.to_bytes()], pa.binary())], ["part", "filter"])

    def merge(key, group):
        if not group.num_rows:
            return group.select([]).append_column("fp", pa.array([], pa.int64())).append_column("n", pa.array([], pa.int64()))
        level = [CountingQuotientFilter.from_bytes(x.as_py()) for x in group.column("filter")]
        while len(level) > 1:
            level = [level[k].merge(level[k + 1]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
        found, count = level[0].entries()
        part = np.uint64(key[0].as_py() << (64 - bits)) if bits else np.uint64(0)
        many = count > 1
        fp = (found[many] >> np.uint64(bits)) | part
        return pa.table({"fp": pa.array(fp.view(np.int64), pa.int64()), "n": pa.array(count[many].astype(np.int64), pa.int64())})

    filters = prints.select("fp").mapInArrow(build, "part long, filter binary")
    return filters.groupBy("part").applyInArrow(merge, "fp long, n long")


def duplicate_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """(rows, groups): rows has __id, __fp, __sha of every row of docs; groups has a row for each text that
    occurs more than once: __fp, __sha, keep_id, group_size, n_keep (rows that carry keep_id)."""
    sheet = docs.select(F.col(doc_id).alias("__id"), normalised(text).alias("__norm"))
    sheet = sheet.withColumns({"__fp": F.xxhash64("__norm"), "__sha": F.sha2(F.col("__norm").cast("binary"), 256)})
    rows = store(sheet.drop("__norm"), "exact-rows")
    total = rows.count()
    repeated = store(repeated_fingerprints(rows.select(F.col("__fp").alias("fp")), total), "exact-repeated")
    routed = few(repeated.select(F.col("fp").alias("__fp")), BROADCAST_ROWS)
    # byte verification: Spark groups by the bytes themselves, and partial sums in each task shrink large groups first
    texts = sheet.join(routed, "__fp", "left_semi").groupBy("__fp", "__norm").agg(F.first("__sha").alias("__sha"), F.count("*").alias("__copies"))
    named = texts.groupBy("__fp", "__sha").agg(F.sum("__copies").alias("__copies"), F.count("*").alias("__texts"))
    verified = named.where((F.col("__copies") > 1) & F.expr("assert_true(__texts = 1, 'two texts share a SHA-256') IS NULL"))
    by_id = rows.join(routed, "__fp", "left_semi").groupBy("__fp", "__sha", "__id").agg(F.count("*").alias("__n"))
    first = by_id.groupBy("__fp", "__sha").agg(F.min("__id").alias("keep_id"), F.sum("__n").alias("group_size"), F.min_by("__n", F.struct(F.col("__id").isNull(), F.col("__id"))).alias("n_keep"))
    return rows, first.join(verified.select("__fp", "__sha"), ["__fp", "__sha"])


def exact_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after each run of white space is replaced by one space; of equal texts the
    row with the smallest doc_id stays. Null text counts as empty; null ids come after all others, and a group
    of null ids only has a null keep_id. Rows that repeat a doc_id and its text tie: `kept` is true for each of
    them (`dedup` keeps one). An empty table gives an empty result; other columns of docs are not looked at.
    """
    rows, groups = duplicate_groups(docs, text, doc_id)
    out = rows.join(store(groups, "exact-groups"), ["__fp", "__sha"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("__id").alias("doc_id"),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("__id").eqNullSafe(keep).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each group of equal texts, that of the smallest doc_id; all columns stay as they are.

    Nulls, ties and empty tables as in `exact_dedup`; of rows that repeat the kept doc_id and text, one stays.
    """
    _, groups = duplicate_groups(docs, text, doc_id)
    groups = few(store(groups, "exact-groups").withColumnRenamed("keep_id", "__keep"), GROUP_ROWS)
    norm = normalised("__text")
    marked = packed_rows(docs, __text=text, __id=doc_id).select("__row", "__id", F.xxhash64(norm).alias("__fp"), F.sha2(norm.cast("binary"), 256).alias("__sha"))
    # texts are shuffled only where the groups are too many to be broadcast
    joined = marked.join(groups, ["__fp", "__sha"], "left")
    kept = joined.where(F.col("__keep").isNull() & F.col("group_size").isNull() | F.col("__id").eqNullSafe(F.col("__keep")))
    tied = F.coalesce("n_keep", F.lit(1)) > 1
    one = kept.where(~tied).unionByName(kept.where(tied).dropDuplicates(["__fp", "__sha"]))
    return one.select("__row.*")
