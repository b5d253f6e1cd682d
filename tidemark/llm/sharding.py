"""Operator 7: placement by a hierarchical weighted hash tree (region, rack, shard).

At every level a row draws one number for each child from a hash of its key and the child's name, divides its
negative logarithm by the child's weight, and descends to the smallest. Changing one child's weight changes
only draws against that child, so rows move only into or out of the subtree whose weight changes. A new shard
opens as a subtree of its own: it takes rows only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import store, text_of

#: Mean rows in one range of a shard's slots; the number of ranges follows the number of rows.
SLOT_ROWS = 50_000


@dataclass(frozen=True)
class Level:
    """One level of the tree: for each node of the level above, its children here as (index, weight).

    An index names a child in its draws, so it must stay as the tree grows.
    """

    name: str
    children: tuple[tuple[tuple[int, float], ...], ...]


def tree(shards: int, racks_per_region: int = 2, shards_per_rack: int = 5, opened: int = 0) -> list[Level]:
    """`shards` shards of weight 1 in regions of racks, and `opened` more, each in a region and rack of its own."""
    racks = [list(range(k, min(k + shards_per_rack, shards))) for k in range(0, shards, shards_per_rack)]
    regions = [list(range(k, min(k + racks_per_region, len(racks)))) for k in range(0, len(racks), racks_per_region)]
    for k in range(shards, shards + opened):
        regions.append([len(racks)])
        racks.append([k])
    rack_weight = [float(len(r)) for r in racks]
    region_weight = [sum(rack_weight[k] for k in r) for r in regions]
    return [
        Level("region", (tuple(enumerate(region_weight)),)),
        Level("rack", tuple(tuple((k, rack_weight[k]) for k in r) for r in regions)),
        Level("shard", tuple(tuple((k, 1.0) for k in r) for r in racks)),
    ]


def _descend(key: Column, node: Column | None, level: Level) -> Column:
    """The child that a key draws at this level: the least -ln(u) / weight, u from a hash of key and child."""
    draws = []
    for j in range(max(map(len, level.children))):
        child, weight = zip(*(c[j] if j < len(c) else (-1, 0.0) for c in level.children), strict=True)
        if node is None:
            child_, weight_ = F.lit(child[0]), F.lit(weight[0])
        else:
            child_ = F.element_at(F.array(*map(F.lit, child)), node + 1)
            weight_ = F.element_at(F.array(*map(F.lit, weight)), node + 1)
        bits = F.shiftrightunsigned(F.xxhash64(F.lit(level.name), child_, key, key.isNull()), 11)
        draw = -F.log((bits + F.lit(1)).cast("double") / F.lit(float(1 << 53) + 1)) / weight_
        draws.append(F.when(weight_ > 0, F.struct(draw.alias("draw"), child_.alias("child"))))
    return (F.least(*draws) if len(draws) > 1 else draws[0])["child"]


def place(rows: DataFrame, key: Column, levels: list[Level], out: str) -> DataFrame:
    """rows with the shard that a key descends to. A null key is a key of its own."""
    node = None
    for k, level in enumerate(levels):
        rows = rows.withColumn(f"__{out}_{k}", _descend(key, node, level))
        node = F.col(f"__{out}_{k}")
    return rows.withColumn(out, node.cast("int")).drop(*(f"__{out}_{k}" for k in range(len(levels))))


def shard_documents(docs: DataFrame, shards: int = 40, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Law `key`: doc_id and the shard count alone decide, so rows of one id share a shard. `slot` numbers a
    shard's rows from 0 without gaps, by ranges of a hash; repeated rows get a slot each. Null text has size 16
    and the checksum of no bytes; null ids share one shard. An empty table gives an empty result.
    """
    raw = text_of(text).cast("binary")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(raw) + F.lit(16)).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    key = F.col("doc_id").cast("long")
    rows = place(rows, key, tree(shards), "shard")
    rows = place(rows, key, tree(shards, opened=1), "grown_shard")
    return add_slots(rows, ["doc_id", "text_crc32", "size"], docs.count())


def add_slots(rows: DataFrame, order: list[str], total: int) -> DataFrame:
    """Add `slot`: 0, 1, ... within each shard. Each shard's rows are cut into hash ranges, which are counted, then
    numbered on their own; so no task holds a whole shard."""
    names, spread = rows.columns, max(1, total // SLOT_ROWS)
    # equal rows are told apart by a running number, so that copies of one row do not meet in one range
    ranged = store(rows.withColumns({"__tie": F.monotonically_increasing_id()}).withColumn("__range", F.pmod(F.xxhash64(*order, "__tie"), F.lit(spread))), "shard-rows")
    counts = ranged.groupBy("shard", "__range").agg(F.count("*").alias("__n"))
    # as many rows as shards times ranges: 50,000 times fewer than the input's
    before = F.coalesce(F.sum("__n").over(W.partitionBy("shard").orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "__range", before.alias("__start"))
    within = F.row_number().over(W.partitionBy("shard", "__range").orderBy(*order, "__tie")) - 1
    out = ranged.withColumn("__within", within).join(starts, ["shard", "__range"])
    return out.select(*names, (F.col("__start") + F.col("__within")).cast("long").alias("slot"))
