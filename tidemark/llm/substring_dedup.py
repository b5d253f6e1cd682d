"""Operator 2: removal of byte strings that occur more than once.

Strings are compared by merging Burrows-Wheeler transforms of shards (see bwt.py). To merge only what can match, and
to bring all of it together, every string of `width` bytes is assigned to its anchor: of its 32-byte grams the one
with the least hash, the leftmost of equal ones. Equal strings have equal anchors at equal places. Neighbouring
strings with one anchor form a segment, a few hundred bytes long. Equal segments enter the merge once, with their number: one
that occurs twice is an interval of its own; the segments of an anchor that differ are merged. Equal segments are found by
128 bits of hash; in the end the bytes of all of them are held against each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import SpanHash, short_batches, slices, store, text_of, utf8
from .bwt import repeated_windows

WIDTH, GRAM = 200, 32
#: Bytes of segments whose transforms are merged together.
MERGE_BYTES = 1 << 20
#: An anchor with more distinct segments than this is dealt out: its segments are cut into pieces of at most PIECE strings, and
#: pieces that hold the same core, the bytes that all of a piece's strings share, are merged together.
LARGE_ANCHOR, PIECE = 50_000, 8
#: Segments that a task holds to combine equal ones.
COMBINED = 1 << 20
#: Stands for a null id inside the operator.
_NO_ID = -(1 << 63)


def segments(data: np.ndarray, off: np.ndarray, width: int = WIDTH, gram: int = GRAM):
    """(text, start, strings, anchor, hash) of all segments: the text's number, the first string's start in it, how
    many strings, the anchor's hash and the hash of the segment's bytes."""
    size = np.diff(off)
    have = np.maximum(0, size - width + 1)
    none = np.zeros(0, np.int64)
    if not have.sum():
        return none, none, none, none, none
    spans = SpanHash(data)
    at = np.arange(len(data) - gram + 1)
    grams = spans(at, at + gram)
    least = (grams & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    reach, want = 1, width - gram + 1
    while reach * 2 <= want:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if want > reach:
        least = np.minimum(least[: len(least) - (want - reach)], least[want - reach :])
    text = np.repeat(np.arange(len(size)), have)
    start = np.arange(have.sum()) + np.repeat(off[:-1] - np.concatenate(([0], np.cumsum(have)))[:-1], have)
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    head = np.flatnonzero(np.append(True, (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])))
    strings = np.diff(np.append(head, len(anchor)))
    first = start[head]
    return text[head], first - off[text[head]], strings, grams[anchor[head]].view(np.int64), spans(first, first + strings + width - 1).view(np.int64)


def occurrences(sheet: DataFrame, width: int, gram: int) -> DataFrame:
    """Of (did, th, text): segments, with anchor, seg, strings, n, and where they are: did, th, start, and for segments
    that a task has met more than once the other places in `more`. So what is copied very often is a row for each
    task (or COMBINED rows of it), not for each copy."""
    names = ["anchor", "seg", "strings", "n", "did", "th", "start", "more"]

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush():
            anchor, seg, strings, did, th, start = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((start, th, did, seg, anchor))
            a, s = anchor[order], seg[order]
            head = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (s[1:] != s[:-1])))
            n = np.diff(np.append(head, len(order)))
            rest = np.ones(len(order), bool)
            rest[head] = False
            rest = order[rest]
            more = pa.StructArray.from_arrays([pa.array(did[rest]), pa.array(th[rest]), pa.array(start[rest], pa.int32())], ["did", "th", "start"])
            at = np.concatenate(([0], np.cumsum(n - 1)))
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), more, mask=pa.array(n == 1))
            first = order[head]
            flat = [anchor[first], seg[first], strings[first].astype(np.int32), n.astype(np.int32), did[first], th[first], start[first].astype(np.int32)]
            return pa.RecordBatch.from_arrays([*map(pa.array, flat), lists], names)

        for batch in slices(batches, "text"):
            data, off = utf8(batch.column("text"))
            text, start, strings, anchor, seg = segments(data, off, width, gram)
            if not len(text):
                continue
            ids = [batch.column(c).to_numpy()[text] for c in ("did", "th")]
            held.append((anchor, seg, strings, *ids, start))
            size += len(text)
            if size >= COMBINED:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return sheet.mapInArrow(run, "anchor long, seg long, strings int, n int, did long, th long, start int, more array<struct<did: long, th: long, start: int>>")


def merged(parts: DataFrame, width: int, merge_bytes: int) -> DataFrame:
    """Of segments with their bytes, sorted by (anchor, part, bytes) in every partition: the repeated strings (did, th, start,
    strings) of segments that occur once as a whole. part is 0 for segments; a piece of one has a hash of its core."""
    names = ["did", "th", "start", "strings"]

    def rows_of(found: list[tuple]) -> pa.RecordBatch:
        did, th, start, strings = zip(*found, strict=True) if found else ((),) * 4
        return pa.RecordBatch.from_arrays([pa.array(did, pa.int64()), pa.array(th, pa.int64()), pa.array(start, pa.int32()), pa.array(strings, pa.int32())], names)

    def run(batches):
        held: list[tuple] = []
        size = 0

        def flush(rows):
            flags = repeated_windows([np.frombuffer(r[6], np.uint8) for r in rows], width)
            found = []
            for r, flag in zip(rows, flags, strict=True):
                if r[5] == 1 and flag.any():
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], flag.view(np.int8), [0]))))
                    found += [(*r[2:4], r[4] + int(a), int(b - a)) for a, b in zip(edge[::2], edge[1::2], strict=True)]
            return rows_of(found)

        before = None
        for batch in batches:
            same = []  # pieces whose bytes come again: all of their strings are repeated
            for r in zip(*(batch.column(c).to_pylist() for c in ("anchor", "part", "did", "th", "start", "whole", "bytes")), strict=True):
                again = before is not None and r[1] != 0 and before[:2] == r[:2] and before[6] == r[6]
                if again:
                    same += [x for x in ((*r[:5], r[5], r[6]), held[-1]) if x[5] == 1]
                    held[-1] = (*held[-1][:5], 2, held[-1][6])
                    continue
                if size >= merge_bytes and held[-1][:2] != r[:2]:
                    yield flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
                before = r
            if same:
                yield rows_of([(*x[2:5], len(x[6]) - width + 1) for x in same])
        if held:
            yield flush(held)

    return parts.mapInArrow(run, "did long, th long, start int, strings int")


def pieces(data: np.ndarray, strings: int, anchor: int, width: int, gram: int) -> list[tuple[int, int, int]]:
    """(hash of the core, first string, end of strings) of a segment's pieces. Their borders lie at fixed distances from the
    anchor, so equal strings are in pieces of equal cores."""
    spans = SpanHash(data)
    at = np.arange(len(data) - gram + 1)
    place = int(np.flatnonzero(spans(at, at + gram).view(np.int64) == anchor)[0])
    step = max(1, min(PIECE, width - gram))
    out = []
    for far in range(place // step, (place - strings + 1) // step - 1, -1):
        # strings that begin far * step to far * step + step - 1 bytes before the anchor share the bytes between
        low, high = place - far * step - step + 1, place - far * step
        core = spans(np.array([high]), np.array([low + width])).view(np.int64)[0]
        first, end = max(0, low), min(strings, high + 1)
        if first < end:
            out.append((int(core) or 1, first, end))
    return out


def cut_out(joined: DataFrame, width: int) -> DataFrame:
    """Of (did, text, found array<struct<start, strings, anchor, seg>>): n_bytes, n_removed, n_spans, kept_sha256, and for
    each segment that was found by its hash, (anchor, seg, a digest of its bytes)."""

    def run(batches):
        for batch in slices(batches, "text"):
            data, off = utf8(batch.column("text"))
            edge = np.zeros(len(data) + 1, np.int32)
            found = batch.column("found")
            at = pc.list_parent_indices(found).to_numpy().astype(np.int64)
            flat = found.flatten()
            start = flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64) + off[at]
            np.add.at(edge, start, 1)
            np.add.at(edge, start + flat.field("strings").to_numpy(zero_copy_only=False) + width - 1, -1)
            gone = np.cumsum(edge[:-1]) > 0
            total = np.concatenate(([0], np.cumsum(gone)))
            run_head = gone & ~np.append(False, gone[:-1])
            run_head[off[:-1][off[:-1] < len(data)]] |= gone[off[:-1][off[:-1] < len(data)]]
            heads = np.concatenate(([0], np.cumsum(run_head)))
            sha = []
            for a, b in zip(off[:-1], off[1:], strict=True):
                mine = data[a:b]
                sha.append(hashlib.sha256((mine if total[a] == total[b] else mine[~gone[a:b]]).tobytes()).hexdigest())
            anchor, seg = flat.field("anchor"), flat.field("seg")
            known = np.flatnonzero(anchor.is_valid().to_numpy(zero_copy_only=False))
            stop = start[known] + flat.field("strings").to_numpy(zero_copy_only=False)[known] + width - 1
            whole = memoryview(np.ascontiguousarray(data))
            digest = [hashlib.blake2b(whole[a:b], digest_size=16).digest() for a, b in zip(start[known].tolist(), stop.tolist(), strict=True)]
            pick = pa.array(known)
            items = pa.StructArray.from_arrays([anchor.take(pick), seg.take(pick), pa.array(digest, pa.binary())], ["anchor", "seg", "digest"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(at[known], np.arange(len(off))), pa.int32()), items)
            yield pa.RecordBatch.from_arrays(
                [batch.column("did"), pa.array(np.diff(off)), pa.array(total[off[1:]] - total[off[:-1]]), pa.array(heads[off[1:]] - heads[off[:-1]]), pa.array(sha), lists],
                ["did", "n_bytes", "n_removed", "n_spans", "kept_sha256", "seen"],
            )

    return joined.select("did", "text", "found").mapInArrow(run, "did long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, seen array<struct<anchor: long, seg: long, digest: binary>>")


def repeated_strings(sheet: DataFrame, width: int = WIDTH, gram: int = GRAM, merge_bytes: int = MERGE_BYTES, large: int = LARGE_ANCHOR) -> DataFrame:
    """Of (did, th, text): runs of repeated strings (did, th, start, strings, anchor, seg), each at least once; anchor and seg
    are those of a segment that occurs more than once as a whole, else null."""
    by_anchor, by_seg = W.partitionBy("anchor"), W.partitionBy("anchor", "seg")
    # one exchange by anchor serves all windows; of what it brings together only repeated and differing segments stay
    rows = occurrences(sheet, width, gram).repartition("anchor").withColumns({
        "whole": F.sum("n").over(by_seg),
        "turn": F.row_number().over(by_seg.orderBy("did", "th", "start")),
        "differ": F.min("seg").over(by_anchor) != F.max("seg").over(by_anchor),
    })
    rows = rows.withColumn("kinds", F.count_if(F.col("turn") == 1).over(by_anchor)).where("whole > 1 or differ")
    rows = store(rows.drop("n"), "segments")
    here = F.array(F.struct("did", "th", "start"))
    every = rows.where("whole > 1").select("strings", "anchor", "seg", F.explode(F.when(F.col("more").isNull(), here).otherwise(F.concat(here, "more"))).alias("at"))
    full = every.select("at.did", "at.th", "at.start", "strings", "anchor", "seg")
    apart = rows.where("differ and turn = 1").select("did", "th", "anchor", "start", "strings", F.least("whole", F.lit(2)).cast("int").alias("whole"), (F.col("kinds") > large).alias("large"))
    found = apart.join(sheet, ["did", "th"])

    def cut(batches):
        for batch in slices(batches, "text"):
            out = {k: [] for k in ("anchor", "part", "did", "th", "start", "whole", "bytes")}
            columns = [batch.column(c).to_pylist() for c in ("anchor", "did", "th", "start", "strings", "whole", "large")]
            for k, (anchor, did, th, start, strings, whole, many) in enumerate(zip(*columns, strict=True)):
                text = batch.column("text")[k].as_buffer()
                piece = memoryview(text)[start : start + strings + width - 1]
                if not many:
                    rows = [(anchor, 0, did, th, start, whole, bytes(piece))]
                else:
                    rows = [(anchor, core, did, th, start + a, whole, bytes(piece[a : b + width - 1])) for core, a, b in pieces(np.frombuffer(piece, np.uint8), strings, anchor, width, gram)]
                for name, values in zip(out, zip(*rows, strict=True), strict=True):
                    out[name] += values
            yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in (("anchor", pa.int64()), ("part", pa.int64()), ("did", pa.int64()), ("th", pa.int64()), ("start", pa.int32()), ("whole", pa.int32()), ("bytes", pa.binary()))], list(out))

    parts = found.mapInArrow(cut, "anchor long, part long, did long, th long, start int, whole int, bytes binary")
    dealt = parts.repartition("anchor", "part").sortWithinPartitions("anchor", "part", "bytes")
    none = F.lit(None).cast("long")
    return full.unionAll(merged(dealt, width, merge_bytes).withColumns({"anchor": none, "seg": none}))


def substring_dedup(docs: DataFrame, width: int = WIDTH, text: str = "text", doc_id: str = "doc_id", gram: int = GRAM, merge_bytes: int = MERGE_BYTES, large: int = LARGE_ANCHOR) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Texts are UTF-8 bytes; each byte covered by a string of `width` bytes that also starts elsewhere, in any text, is
    removed, its first occurrence too. Null counts as empty; texts shorter than width keep all bytes. Rows that
    repeat a doc_id and its text are copies of each other. Null ids stay null. An empty table gives an empty result;
    other columns are not looked at. Segments are compared by 128 bits of hash, then by their bytes; if these ever told
    otherwise, the job would fail rather than give a wrong result.
    """
    short_batches(docs.sparkSession)
    raw = text_of(text)
    sheet = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("did"), F.xxhash64(raw).alias("th"), raw.alias("text"))
    found = repeated_strings(sheet, width, gram, merge_bytes, large)
    by_doc = found.groupBy("did", "th").agg(F.collect_set(F.struct("start", "strings", "anchor", "seg")).alias("found"))
    out = store(cut_out(sheet.join(by_doc, ["did", "th"], "left"), width), "substrings")
    seen = out.select(F.explode("seen").alias("s")).groupBy("s.anchor", "s.seg").agg((F.min("s.digest") != F.max("s.digest")).alias("differ"))
    if not seen.where("differ").isEmpty():
        raise RuntimeError("two segments share 128 bits of hash and differ in their bytes")
    return out.select(F.when(F.col("did") != _NO_ID, F.col("did")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
