"""Operator 4: near-duplicates by one-permutation MinHash with optimal densification.

One hash of each shingle fills all bins: its high bits name the bin, the least value in a bin is kept, and an
empty bin copies from a full one that hashing of (bin, attempt) finds. Rows of bins form bands; documents that
agree on a band share a bucket. A bucket of m documents proposes m - 1 edges for each of its centres, not all
pairs; the centres are the documents whose buckets are the fullest over all bands, so that the text that
others were copied from is one of them. Every proposed edge is confirmed on the full shingle sets. A star loses a
link between two members that are both unlike its centres, so documents that their bucket's largest component does
not hold are then compared with all of the bucket, where their rarest shingles allow a link at all, in blocks and
without a row for each pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import SpanHash, discard, few, list_column, lower, mix, shingle_hashes, short_batches, slices, store, text_of, utf8, words
from .components import connected_components, merged_components

BINS, BANDS = 128, 32
#: Centres of each bucket. With rows of 4 bins, documents of similarity 0.8 miss all 32 buckets once in 20 million.
CENTRES = 3
#: Up to so many ids (8 bytes each) of documents to drop are broadcast; beyond, texts and ids are joined by a shuffle.
DROP_ROWS = 1_000_000
#: Documents and shingles on either side of a block of comparisons, and shingles that a task holds before it compares.
BLOCK, BLOCK_SHINGLES, HELD_SHINGLES = 256, 1 << 18, 1 << 18
#: Cells of the table that orders shingles by how common they are.
CELLS = 1 << 16
_ATTEMPTS = 8192


def _first_attempts() -> np.ndarray:
    """For each bin and donor the first attempt at which the bin's sequence of hashes names the donor."""
    donor = (mix(np.arange(BINS * _ATTEMPTS, dtype=np.uint64) + np.uint64(0xC0FFEE)) % np.uint64(BINS)).astype(np.int64).reshape(BINS, _ATTEMPTS)
    out = np.full((BINS, BINS), _ATTEMPTS, np.int16)
    for attempt in reversed(range(_ATTEMPTS)):
        out[np.arange(BINS), donor[:, attempt]] = attempt
    return out


_FIRST = _first_attempts()
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def signatures(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One-permutation signatures, densified: row d of sorted distinct hashes flat[off[d]:off[d+1]], none of them empty."""
    n = len(off) - 1
    sig = np.full((n, BINS), _NONE, np.uint64)
    doc = np.repeat(np.arange(n), np.diff(off))
    bin_ = (flat >> np.uint64(64 - BINS.bit_length() + 1)).astype(np.int64)
    cell = doc * BINS + bin_
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else cell
    sig.reshape(-1)[cell[first]] = flat[first]
    full = sig != _NONE
    row, col = np.nonzero(~full)
    for at in range(0, len(row), 1 << 14):
        r, c = row[at : at + (1 << 14)], col[at : at + (1 << 14)]
        donor = np.where(full[r], _FIRST[c], _ATTEMPTS).argmin(1)  # the full bin that the sequence of attempts meets first
        sig[r, c] = sig[r, donor]
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A key for each band: a hash of its rows and its number."""
    rows = sig.reshape(len(sig), BANDS, BINS // BANDS)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), rows.shape[:2]).copy()
    for k in range(rows.shape[2]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, :, k])
    return key


def sets_of(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, flat with offsets."""
    data, off = utf8(column)
    data = lower(data)
    start, end, first = words(data, off)
    shingle, at = shingle_hashes(SpanHash(data)(start, end), first, n)
    out, size = [], np.zeros(len(off) - 1, np.int64)
    for d in range(len(off) - 1):
        out.append(np.unique(shingle[at[d] : at[d + 1]]))
        size[d] = len(out[-1])
    return (np.concatenate(out) if out else shingle), np.concatenate(([0], np.cumsum(size)))


def sketch(docs: DataFrame, n: int) -> DataFrame:
    """Of (id, th, text): id, th, n_shingles, set_hi and set_lo (a 128-bit digest of the set), bands (empty for an empty set)."""

    def run(batches):
        for batch in slices(batches, "text"):
            flat, off = sets_of(batch.column("text"), n)
            size = np.diff(off)
            digest = [hashlib.md5(flat[a:b].tobytes(), usedforsecurity=False).digest() for a, b in zip(off[:-1], off[1:], strict=True)]
            both = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            some = np.flatnonzero(size)
            keys = band_keys(signatures(flat, np.append(0, np.cumsum(size[some]))))
            at = np.append(0, np.cumsum(np.where(size > 0, BANDS, 0)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("th"), pa.array(size, pa.int64()), pa.array(both[:, 0]), pa.array(both[:, 1]), list_column(keys.reshape(-1).view(np.int64), at, pa.int64())],
                ["id", "th", "n_shingles", "set_hi", "set_lo", "bands"],
            )

    kind = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(run, f"id {kind}, th long, n_shingles long, set_hi long, set_lo long, bands array<long>")


def shared_buckets(sketches: DataFrame) -> DataFrame:
    """(band, id, n) of buckets that n > 1 documents share; sketches: (id, bands), one row per id."""
    at = store(sketches.select("id", F.explode("bands").alias("band")), "bands")
    filled = at.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    out = store(at.join(filled, "band"), "buckets")
    discard(at)
    return out


def star_edges(shared: DataFrame, centres: int = CENTRES) -> DataFrame:
    """Distinct (a, b), a < b, from each bucket's centres to its other members."""
    score = shared.groupBy("id").agg(F.sum("n").alias("score"))
    # the best centres are minima of a rank, which every task finds for its own rows first
    rank = F.struct((-F.col("score")).alias("s"), F.col("id").alias("id"))
    found, taken = None, shared.join(score, "id").select("band", rank.alias("r"))
    for k in range(centres):
        top = taken.groupBy("band").agg(F.min("r").alias("top"))
        one = top.select("band", F.col("top.id").alias(f"c{k}"))
        found = one if found is None else found.join(one, "band", "left")
        if k + 1 < centres:
            taken = taken.join(top, "band").where("r > top").drop("top")
    edges = shared.select("band", "id").join(found, "band").select("id", F.explode(F.array_compact(F.array(*(f"c{k}" for k in range(centres))))).alias("c"))
    return edges.where("c <> id").select(F.least("c", "id").alias("a"), F.greatest("c", "id").alias("b")).distinct()


def mixed_buckets(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """(band, id, component, outsider) of buckets that hold more than one component; outsiders are the documents that are
    not in their bucket's largest component."""
    named = shared.join(groups.select(F.col("node").alias("id"), "component"), "id", "left").select("band", "id", F.coalesce("component", "id").alias("component"))
    return _marked(named)


def _marked(named: DataFrame) -> DataFrame:
    sizes = named.groupBy("band", "component").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("band").agg(F.max(F.struct("k", "component")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    return named.join(largest.select("band", F.col("top.component").alias("largest")), "band").select("band", "id", "component", (F.col("component") != F.col("largest")).alias("outsider"))


def frequencies(texts: DataFrame, n: int) -> np.ndarray:
    """For each of CELLS cells of shingle hashes a level, about twice the log of how many shingles of all texts fall into it. It
    only orders shingles, rare ones first, so it may be coarse; its size does not depend on the input."""
    shift = np.uint64(64 - CELLS.bit_length() + 1)

    def run(batches):
        count = np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in slices([batch], "text"):
                flat, _ = sets_of(part.column("text"), n)
                count += np.bincount((flat >> shift).astype(np.int64), minlength=CELLS)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], ["cell", "n"])

    rows = texts.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = rows.select("cell", F.round(2 * F.log2(F.col("n") + 1)).cast("tinyint").alias("level")).toPandas()
    out = np.zeros(CELLS, np.uint8)
    out[rows["cell"].to_numpy()] = rows["level"].to_numpy()
    return out


def prefixes(members: DataFrame, level: np.ndarray, n: int, percent: int) -> DataFrame:
    """Of (id, component, text): (shingle, id, component, short) of each set's rarest shingles.

    Two sets with 100 * intersection >= percent * union share one of the rarest shingles of the larger (all but
    percent / 100 of its own, and one) that is among a still shorter prefix, `short`, of the smaller (all but
    2 percent / (100 + percent), and one). This holds for any order that is the same for all sets.
    """
    shift = np.uint64(64 - CELLS.bit_length() + 1)

    def run(batches):
        for batch in batches:
            for part in slices([batch], "text"):
                flat, off = sets_of(part.column("text"), n)
                size = np.diff(off)
                doc = np.repeat(np.arange(len(size)), size)
                order = np.lexsort((flat, level[(flat >> shift).astype(np.int64)], doc))
                place = np.arange(len(flat)) - off[doc]
                long = size + (-percent * size // 100) + 1
                short = size + (-2 * percent * size // (100 + percent)) + 1
                keep = place < long[doc]
                d = doc[keep]
                cols = [part.column(c).take(pa.array(d)) for c in ("id", "component")]
                yield pa.RecordBatch.from_arrays([pa.array(flat[order][keep].view(np.int64)), *cols, pa.array(place[keep] < short[d])], ["shingle", "id", "component", "short"])

    return members.select("id", "component", "text").mapInArrow(run, "shingle long, id long, component long, short boolean")


def linkable(rows: DataFrame) -> DataFrame:
    """The ids of `prefixes` that share a prefix shingle with another component, so that they may be linked with it. Only
    sums by shingle are gathered."""
    short = lambda f: f(F.when(F.col("short"), F.col("component")))
    seen = rows.groupBy("shingle").agg(F.min("component").alias("a"), F.max("component").alias("b"), short(F.min).alias("c"), short(F.max).alias("d"))
    seen = seen.where("c is not null and a <> b")
    mine = F.col("component")
    other = (F.col("short") & ((F.col("a") != mine) | (F.col("b") != mine))) | (F.col("c") != mine) | (F.col("d") != mine)
    return rows.join(seen, "shingle").where(other).select("id").distinct()


def outsider_links(members: DataFrame, docs: DataFrame, n: int, percent: int, block: int = BLOCK) -> DataFrame:
    """Links (a, b) of outsiders with their bucket's members of other components: for each outsider one link with each
    component that it reaches. members: (band, id, component, outsider); docs: (id, n_shingles, bands, text).

    Outsiders and members of a bucket meet in blocks of about `block` by `block` documents, or fewer long ones, each a task's
    work of its own, in which set intersections are products of matrices. No row is made for a pair, and a pair is
    compared in the first bucket that it shares only.
    """
    w = F.col("n_shingles")
    sized = members.join(docs.select("id", "n_shingles"), "id")
    parts = lambda which: F.greatest(F.ceil(F.count_if(which) / block), F.ceil(F.sum(F.when(which, w).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    plan = sized.groupBy("band").agg(parts(F.col("outsider")).alias("ob"), parts(F.lit(True)).alias("mb"))
    rows = members.join(plan, "band").withColumn("slot", F.xxhash64("id"))
    whole = (F.col("ob") == 1) & (F.col("mb") == 1)
    pick = lambda c: F.pmod("slot", F.col(c)).cast("int").alias(c)
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1)).alias(c)
    m = rows.select("band", "id", "component", (whole & F.col("outsider")).alias("o"), F.lit(True).alias("m"), pick("mb"), spread("ob"))
    o = rows.where(~whole & F.col("outsider")).select("band", "id", "component", F.lit(True).alias("o"), F.lit(False).alias("m"), pick("ob"), spread("mb"))
    key = ["band", "ob", "mb"]
    placed = m.unionByName(o).join(docs.select("id", "bands", "text"), "id").select(*key, "id", "component", "o", "m", "bands", "text")

    def links(band, ids, component, is_o, is_m, bands, flat, off):
        o, m = np.flatnonzero(is_o), np.flatnonzero(is_m)
        size = np.diff(off)
        if len(o) * len(m) == 0 or len(np.unique(component)) < 2:
            return []
        good = component[o][:, None] != component[m][None, :]
        for k in range(int(np.flatnonzero(bands[0] == band)[0])):  # an earlier bucket compares the pair
            good &= bands[o, k][:, None] != bands[m, k][None, :]
        so, sm = size[o][:, None], size[m][None, :]
        good &= 100 * np.minimum(so, sm) >= percent * np.maximum(so, sm)
        o_, m_ = good.any(1), good.any(0)
        if not o_.any():
            return []
        o, m, good = o[o_], m[m_], good[o_][:, m_]
        used = np.zeros(len(ids), bool)
        used[o] = used[m] = True
        doc = np.repeat(np.arange(len(ids)), size)
        flat, doc = flat[used[doc]], doc[used[doc]]
        values, where, times = np.unique(flat, return_inverse=True, return_counts=True)
        held = times > 1  # a shingle of one document adds nothing
        column = np.cumsum(held) - 1
        both = np.zeros((len(o), len(m)), np.float32)
        keep = held[where]
        doc, where = doc[keep], column[where[keep]]
        order = np.argsort(where, kind="stable")
        doc, where = doc[order], where[order]
        for at in range(0, int(held.sum()), 2048):
            a, b = np.searchsorted(where, (at, at + 2048))
            table = np.zeros((len(ids), min(2048, int(held.sum()) - at)), np.float32)
            table[doc[a:b], where[a:b] - at] = 1
            both += table[o] @ table[m].T
        union = size[o][:, None] + size[m][None, :] - both
        good &= 100 * both >= percent * union
        out = []
        for k in np.flatnonzero(good.any(1)):
            hit = m[good[k]]
            _, one = np.unique(component[hit], return_index=True)
            out += [(ids[o[k]], ids[x]) for x in hit[one]]
        return out

    def run(batches):
        # sets of what has come: (keys, ids, components, flags, bands, hashes, sizes) of whole slices
        held: list[tuple] = []
        count = 0

        def flush(last: bool):
            nonlocal held, count
            k, ids, component, is_o, is_m, bands, flat, size = (np.concatenate(x) for x in zip(*held, strict=True))
            off = np.concatenate(([0], np.cumsum(size)))
            cuts = np.concatenate(([0], np.flatnonzero((k[1:] != k[:-1]).any(1)) + 1, [len(k)]))
            done = cuts if last else cuts[:-1]  # the last block may run on in the next batch
            out = []
            for a, b in zip(done[:-1], done[1:], strict=True):
                out += links(k[a, 0], ids[a:b], component[a:b], is_o[a:b], is_m[a:b], bands[a:b], flat[off[a] : off[b]], off[a : b + 1] - off[a])
            z = int(done[-1])
            held = [(k[z:], ids[z:], component[z:], is_o[z:], is_m[z:], bands[z:], flat[off[z] :], size[z:])] if z < len(k) else []
            count = int(off[-1] - off[z])
            a, b = zip(*out, strict=True) if out else ((), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in slices(batches, "text"):
            flat, off = sets_of(batch.column("text"), n)
            k = np.stack([batch.column(c).to_numpy() for c in key], 1)
            flags = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("o", "m")]
            bands = batch.column("bands").flatten().to_numpy().reshape(-1, BANDS)
            held.append((k, batch.column("id").to_numpy(), batch.column("component").to_numpy(), *flags, bands, flat, np.diff(off)))
            count += len(flat)
            if count >= HELD_SHINGLES and (held[0][0][0] != k[-1]).any():
                yield flush(False)
        if held:
            yield flush(True)

    dealt = placed.repartition(*key).sortWithinPartitions(*key)
    return dealt.mapInArrow(run, "a long, b long")


def confirm(edges: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The edges (a, b) whose texts' full shingle sets have 100 * intersection >= percent * union. docs: (id, text)."""
    text = docs.select("id", "text")
    pairs = edges.join(text.withColumnsRenamed({"id": "b", "text": "tb"}), "b").join(text.withColumnsRenamed({"id": "a", "text": "ta"}), "a").select("a", "b", "ta", "tb")

    def run(batches):
        known: dict[int, np.ndarray] = {}
        held = 0
        for whole in batches:
            for batch in slices([whole], "tb"):
                ids = batch.column("a").to_pylist()
                new = {x: k for k, x in enumerate(ids) if x not in known}
                if held > HELD_SHINGLES:
                    known, held = {}, 0
                    new = {x: k for k, x in enumerate(ids)}
                for part in slices([batch.take(pa.array(list(new.values()), pa.int64()))] if new else [], "ta"):
                    flat, off = sets_of(part.column("ta"), n)
                    for k, x in enumerate(part.column("a").to_pylist()):
                        known[x] = flat[off[k] : off[k + 1]].copy()
                        held += len(known[x])
                flat, off = sets_of(batch.column("tb"), n)
                keep = np.zeros(len(ids), bool)
                for k, x in enumerate(ids):
                    a, b = known[x], flat[off[k] : off[k + 1]]
                    if len(a) and len(b) and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)):
                        at = np.searchsorted(a, b)
                        both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
                        keep[k] = 100 * both >= percent * (len(a) + len(b) - both)
                yield batch.select(["a", "b"]).filter(pa.array(keep))

    kind = edges.schema["a"].dataType.simpleString()
    return pairs.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, kept.

    Words are split at white space after A-Z is lowered; a text of fewer than n words has one shingle of them all;
    null, empty and blank texts have none and are linked with nothing. component_id is the smallest doc_id that
    confirmed links reach, kept is true for that document. Equal sets are linked first and searched once. Rows
    that repeat a doc_id share its component; rows of a null id are linked with nothing, have a null component
    and are kept. An empty table gives an empty result; other columns are not looked at.
    """
    short_batches(docs.sparkSession)
    raw = text_of(text)
    sheet = docs.select(F.col(doc_id).cast("long").alias("id"), F.xxhash64(raw).alias("th"), raw.alias("text"))
    known = store(sketch(sheet, n), "sketches")
    key = ["set_hi", "set_lo"]
    named = known.where("id is not null and n_shingles > 0").withColumn("node", F.col("id"))
    texts = sheet.where("id is not null").select("id", "text")
    # rows that repeat a doc_id may differ: each of their sets is a node of its own, under a number that no other has
    again = store(named.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id"), "repeated-ids")
    several = not again.isEmpty()
    if several:
        number = F.lit(-(1 << 62)) - F.pmod(F.xxhash64("id", *key), F.lit(1 << 61))
        named = store(named.join(again.withColumn("again", F.lit(True)), "id", "left").withColumn("node", F.when(F.col("again"), number).otherwise(F.col("id"))).drop("again"), "named")
        twin = named.where("node <> id").select("id", "th", "node").distinct()
        texts = sheet.join(again, "id", "left_anti").select("id", "text").unionAll(sheet.join(twin, ["id", "th"]).dropDuplicates(["node"]).select("node", "text"))
    # one representative of every set: equal sets are linked already
    copies = store(named.groupBy(*key).agg(F.min("node").alias("rep")), "representatives")
    reps = named.join(copies, key).where("node = rep").select(F.col("node").alias("id"), "n_shingles", "bands")
    reps = store(reps.dropDuplicates(["id"]) if several else reps, "reps")
    shared = shared_buckets(reps)
    edges = store(star_edges(shared), "candidates")
    links = store(confirm(edges, texts, n, percent), "links")
    discard(edges)
    groups = store(connected_components(links), "components")
    discard(links)
    # what its buckets' largest components don't hold is compared with all of the buckets, where a link is possible at all
    mixed = store(mixed_buckets(shared, groups), "members")
    discard(shared)
    active = mixed.select("id", "component").distinct().join(reps, "id").join(texts, "id")
    active = store(active, "active")
    may = store(linkable(prefixes(active, frequencies(active, n), n, percent)), "linkable")
    members = store(_marked(mixed.drop("outsider").join(may, "id", "left_semi")), "members")
    found = outsider_links(members, active.join(may, "id", "left_semi"), n, percent)
    if several:
        sets = named.where("node <> id").select("id", *key).distinct().join(copies, key).select("id", "rep")
        found = found.unionAll(sets.join(sets.groupBy("id").agg(F.min("rep").alias("to")), "id").where("rep <> to").select(F.col("rep").alias("a"), F.col("to").alias("b")))
    links = store(found, "links")
    discard(mixed, members, active, may)
    groups = merged_components(groups, links)
    own = named.select("id", *key).join(copies, key).join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select("id", F.coalesce("component", "rep").alias("component"))
    if several:
        own = own.join(own.groupBy("component").agg(F.min("id").alias("least")), "component").select("id", F.col("least").alias("component"))
        own = own.distinct()
    out = known.select("id", "n_shingles").join(own, "id", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias("doc_id"), "n_shingles", component.alias("component_id"), (F.col("id").isNull() | (component == F.col("id"))).alias("kept"))


def near_dedup(docs: DataFrame, n: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs without the documents that `near_duplicates` does not keep; all columns stay as they are."""
    drop = store(near_duplicates(docs, n, percent, text, doc_id).where("not kept").select(F.col("doc_id").alias("__drop")).distinct(), "near-drop")
    return docs.join(few(drop, DROP_ROWS), docs[doc_id] == drop["__drop"], "left_anti")
