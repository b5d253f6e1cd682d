"""Operator 13: exact top-k search by dual-tree cover-tree search.

Queries and data are indexed together. The upper level of both is one net of centres, rows in farthest-point order, of which
queries use the first ones; each row goes to its nearest centre's cell, and each cell is cut into blocks that fit a task, with a
cover tree each. A block of queries first meets the block of data that promises most. The kth scores found there are floors;
cells that can't reach the worst floor of a query block are pruned by their radii, and in what is left the two trees are
descended together, under the same rule. Scores are exact, so the result is that of comparing everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import discard, store
from .cover_tree import LEAST, ROUNDING, CoverTree, Search, build, distances, products

#: Components of a data block, and of a query block, at most about.
DATA_CELLS, QUERY_CELLS = 1 << 17, 1 << 15
#: Rows from which centres are chosen at most, the centres at most, and the components of both.
SAMPLE_ROWS, CENTRES, SAMPLE_CELLS = 4_096, 1_024, 1 << 22

_BLOCK = "block long, keys binary, ids array<long>, x binary, nodes binary, radius binary, floors binary"
_FOUND = "query_key long, query_id long, vec_id long, score long"


def whole_vectors(vectors: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """(key, vec_id, x): the rows that take part, components as floor(256 * x), in doubles; key numbers the rows; stored."""
    v = F.col(vector).cast("array<double>")
    top = float(np.finfo(float).max) / 256
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("x")).where("x is not null").where(F.forall("x", lambda c: F.coalesce(F.abs(c) <= F.lit(top), F.lit(False))))

    def run(batches):
        for b in batches:
            lists = b.column("x")
            flat = np.floor(lists.flatten().to_numpy(zero_copy_only=False) * 256.0)
            off = np.append(0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))) * 8
            raw = flat.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array([raw[s:e] for s, e in zip(off[:-1], off[1:], strict=True)], pa.binary())], ["vec_id", "x"])

    return store(rows.mapInArrow(run, "vec_id long, x binary").withColumn("key", F.monotonically_increasing_id()), "vectors")


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows; short ones are filled up with zeros."""
    out = np.zeros((len(column), dim))
    for k, raw in enumerate(column.to_pylist()):
        out[k, : len(raw) // 8] = np.frombuffer(raw)
    return out


def centres_of(rows: DataFrame, n: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and vectors of up to n centres, in farthest-point order, from a bounded sample of rows by hash."""
    most = max(1, min(SAMPLE_ROWS, SAMPLE_CELLS // dim))
    sample = rows.select("key", "x").orderBy(F.xxhash64("key"), "key").limit(most).toArrow()
    x, keys = _matrix(sample.column("x").combine_chunks(), dim), sample.column("key").to_numpy()
    picked, far = [0], distances(x, x[0])
    while len(picked) < min(n, len(x)) and far.max() > 0:
        picked.append(int(far.argmax()))
        far = np.minimum(far, distances(x, x[picked[-1]]))
    return keys[picked], x[picked]


def assigned(rows: DataFrame, centres: np.ndarray, coarse: int, is_query: Column, dim: int) -> DataFrame:
    """rows with their nearest centre and their distance from it, and for queries the nearest of the first `coarse`; stored."""
    square = np.square(centres).sum(axis=1)

    def run(batches):
        for b in batches:
            for part in (b.slice(k, 1024) for k in range(0, b.num_rows, 1024)):
                x = _matrix(part.column("x"), dim)
                with np.errstate(over="ignore", invalid="ignore"):
                    near = np.nan_to_num(square - 2 * (x @ centres.T), nan=np.inf)  # any cell is right, its radius is measured
                cell = near.argmin(axis=1)
                far = np.concatenate([distances(x[k : k + 1], centres[c]) for k, c in enumerate(cell)]) if len(x) else np.zeros(0)
                cells = [pa.array(c.astype(np.int32)) for c in (cell, near[:, :coarse].argmin(axis=1))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("key", "vec_id", "x", "query")), *cells, pa.array(far)], ["key", "vec_id", "x", "query", "cell", "query_cell", "far"])

    flagged = rows.withColumn("query", F.coalesce(is_query, F.lit(False))).select("key", "vec_id", "x", "query")
    return store(flagged.mapInArrow(run, "key long, vec_id long, x binary, query boolean, cell int, query_cell int, far double"), "assigned")


def blocks_of(rows: DataFrame, cell: str, sizes: DataFrame, dim: int, k: int, anchors: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """A stored row for each block of a cell: its points in the order of their tree, and the tree. anchors, for queries: centres'
    keys and vectors, whose kth best score is a query's first floor."""

    def one(table: pa.Table) -> pa.Table:
        tree, order = build(_matrix(table.column("x").combine_chunks(), dim))
        keys = table.column("key").to_numpy()[order]
        floors = np.full(len(keys), LEAST)
        if anchors is not None:
            for n, (key, x) in enumerate(zip(keys, tree.x, strict=True)):
                got = np.sort(products(anchors[1][anchors[0] != key], x))
                floors[n] = got[-k] if len(got) >= k else LEAST
        row = [table.column("block")[0].as_py(), keys.tobytes(), table.column("vec_id").combine_chunks().take(pa.array(order)).to_pylist(), tree.x.tobytes(), np.array([tree.lo, tree.hi, tree.first, tree.count]).tobytes(), tree.radius.tobytes(), floors.tobytes()]
        schema = pa.schema([("block", pa.int64()), ("keys", pa.binary()), ("ids", pa.list_(pa.int64())), ("x", pa.binary()), ("nodes", pa.binary()), ("radius", pa.binary()), ("floors", pa.binary())])
        return pa.Table.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

    numbered = rows.join(F.broadcast(sizes.select(cell, "parts")), cell)  # a row for each of CENTRES cells at most
    numbered = numbered.withColumn("block", F.shiftleft(F.col(cell).cast("long"), 32) + F.pmod(F.xxhash64("key"), F.col("parts")))
    return store(numbered.select("block", "key", "vec_id", "x").groupBy("block").applyInArrow(one, _BLOCK), "blocks")


def _sizes(rows: DataFrame, cell: str, most: int) -> DataFrame:
    """(cell, parts, radius) of each cell: into how many blocks of about `most` rows it is cut; stored."""
    n = rows.groupBy(cell).agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    return store(n.select(cell, F.ceil(F.col("n") / F.lit(most)).alias("parts"), "radius"), "cells")


def _tree(row: dict, dim: int, prefix: str = "") -> CoverTree:
    radius = np.frombuffer(row[f"{prefix}radius"])
    return CoverTree(np.frombuffer(row[f"{prefix}x"]).reshape(-1, dim), *np.frombuffer(row[f"{prefix}nodes"], np.int64).reshape(4, -1), radius)


def promising(queries: DataFrame, centres: np.ndarray, cells: list, dim: int, home: bool) -> DataFrame:
    """(q_block, cell): for each query block the cells that can hold a row of as high a score as the worst of its floors; or,
    for `home`, the one whose centre promises most."""
    at = np.array([r.cell for r in cells], np.int64)
    far = np.array([r.radius for r in cells])
    norm = distances(centres[at], np.zeros(dim))

    def run(batches):
        for b in batches:
            for row in b.select(["block", "x", "nodes", "radius", "floors"]).to_pylist():
                tree, floors = _tree(row, dim), np.frombuffer(row["floors"], np.int64)
                with np.errstate(over="ignore", invalid="ignore"):
                    score, n, r = centres[at] @ tree.x[0], tree.norm[0], tree.radius[0]
                    top = np.nan_to_num(score + n * far + r * (norm + far) + ROUNDING * (n + r) * (norm + far), nan=np.inf, posinf=np.inf, neginf=-np.inf)
                worst = float(floors.min()) if floors.min() > LEAST else -np.inf
                some = np.nan_to_num(score, nan=-np.inf).argmax(keepdims=True) if home else np.flatnonzero(top >= np.nextafter(worst, -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row["block"])), pa.array(at[some].astype(np.int32))], ["q_block", "cell"])

    return queries.mapInArrow(run, "q_block long, cell int")


def searched(pairs: DataFrame, queries: DataFrame, data: DataFrame, dim: int, k: int) -> DataFrame:
    """The search of each pair (q_block, block): a row with the query block's raised floors and what was found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids = row["ids"]
                no_id = np.array([i is None for i in ids])
                plain = np.array([0 if i is None else i for i in ids], np.int64)
                q_keys = np.frombuffer(row["q_keys"], np.int64)
                s = Search(_tree(row, dim, "q_"), _tree(row, dim), np.frombuffer(row["q_floors"], np.int64), q_keys, np.frombuffer(row["keys"], np.int64), plain, no_id, k).run()
                found = [{"query_key": int(q_keys[n]), "query_id": row["q_ids"][n], "vec_id": ids[p], "score": int(v)} for n, best in enumerate(s.best) for p, v in zip(*best, strict=True)]
                item = pa.struct([("query_key", pa.int64()), ("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array([row["q_block"]], pa.int64()), pa.array([s.floors.tobytes()], pa.binary()), pa.array([found], pa.list_(item))], ["q_block", "raised", "found"])

    # queries travel to the data: they are fewer, and a block of data comes once
    named = queries.select(*(F.col(c).alias(f"q_{c}") for c in queries.columns))
    met = pairs.join(named, "q_block").join(data.drop("floors"), "block")
    return met.mapInArrow(run, f"q_block long, raised binary, found array<struct<{', '.join(f'{c.split()[0]}: {c.split()[1]}' for c in _FOUND.split(', '))}>>")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose id is divisible by `every` the k rows of highest inner product of
    floor(256 * x), its own row left out; ties go to the smaller id.

    Vectors that are null, or hold null or non-finite components (or ones whose 256-fold no double can hold), take no part.
    Short vectors count as filled up with zeros, empty ones as all zeros. Rows of a null id are no queries but can be found, after
    others of their score. Repeated rows are rows of their own: each is found, and each queries. Fewer other rows than k give
    so many. Scores beyond 64 bits count as the nearest 64-bit number. An empty table gives an empty result. Other columns play no part.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, vector, vec_id)
    is_query = F.col("vec_id") % F.lit(every) == 0
    n, n_queries, dim = rows.agg(F.count("*"), F.count_if(is_query), F.max(F.octet_length("x") / 8)).first()
    if not n_queries:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dim = max(1, int(dim))
    data_rows, query_rows = max(1, DATA_CELLS // dim), max(1, QUERY_CELLS // dim)
    limit = max(1, min(CENTRES, SAMPLE_CELLS // dim))
    keys, centres = centres_of(rows, min(limit, -(-n // data_rows)), dim)
    placed = assigned(rows, centres, min(len(centres), -(-n_queries // query_rows)), is_query, dim)
    discard(rows)
    asking = placed.where("query")
    sizes, query_sizes = _sizes(placed, "cell", data_rows), _sizes(asking, "query_cell", query_rows)
    data = blocks_of(placed, "cell", sizes, dim, k)
    queries = blocks_of(asking, "query_cell", query_sizes, dim, k, (keys, centres))
    cells = sizes.collect()  # CENTRES rows at most
    first = promising(queries, centres, cells, dim, home=True).withColumn("block", F.shiftleft(F.col("cell").cast("long"), 32))
    # a hot cell's first part may hold none of its rows, so the least of its blocks is taken
    least = data.groupBy(F.shiftright("block", 32).cast("int").alias("cell")).agg(F.min("block").alias("block"))
    first = first.drop("block").join(least, "cell").select("q_block", "block")
    home = store(searched(first, queries, data, dim, k), "home")
    raised = queries.join(home.select(F.col("q_block").alias("block"), "raised"), "block").withColumn("floors", F.col("raised")).drop("raised")
    raised = store(raised, "raised")
    there = data.select("block", F.shiftright("block", 32).cast("int").alias("cell"))
    pairs = promising(raised, centres, cells, dim, home=False).join(there, "cell").select("q_block", "block").join(first, ["q_block", "block"], "left_anti")
    found = home.select(F.inline("found")).unionByName(searched(pairs, raised, data, dim, k).select(F.inline("found")))
    order = W.partitionBy("query_key").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
