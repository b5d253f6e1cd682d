import math
import struct
import zlib
from collections import Counter

import xxhash

from tidemark.llm import sharding as sh


def test_law_by_key(spark, docs):
    df = docs([f"t{k}" for k in range(3000)])
    rows = sh.shard_documents(df).collect()
    assert {r.law for r in rows} == {"key"} and {r.shard for r in rows} == set(range(40))
    moved = [r for r in rows if r.shard != r.grown_shard]
    assert moved and {r.grown_shard for r in moved} == {40}
    assert abs(len(moved) - 3000 / 41) < 40
    n = Counter(r.shard for r in rows)
    assert max(n.values()) < 2 * 3000 / 40
    again = {r.doc_id: r.shard for r in sh.shard_documents(docs(["other"] * 50)).collect()}
    assert again == {r.doc_id: r.shard for r in rows if r.doc_id < 50}


def draw(levels, key):
    """The descent by its definition: each child's hash, its negative logarithm over its weight, and the least of these."""
    node = 0
    for level in levels:
        best = None
        for child, weight in level.children[node]:
            h = xxhash.xxh64(level.name.encode(), 42).intdigest()
            h = xxhash.xxh64(struct.pack("<i", child), h).intdigest()
            h = h if key is None else xxhash.xxh64(struct.pack("<q", key), h).intdigest()
            h = xxhash.xxh64(struct.pack("<i", int(key is None)), h).intdigest()
            d = -math.log(((h >> 11) + 1) / (2.0**53 + 1)) / weight
            best = min(best or (d, child), (d, child))
        node = best[1]
    return node


def test_places_are_those_of_the_definition(docs):
    ids = [*range(-5, 120), 10**15, None]
    rows = sh.shard_documents(docs(["t"] * len(ids), ids)).collect()
    assert len(rows) == len(ids)
    for r in rows:
        assert (r.shard, r.grown_shard) == (draw(sh.tree(40), r.doc_id), draw(sh.tree(40, opened=1), r.doc_id))


def test_slots_are_gapless(docs, odd, none, monkeypatch):
    monkeypatch.setattr(sh, "SLOT_ROWS", 20)
    for df in (docs([f"t{k}" for k in range(500)]), odd):
        rows = sh.shard_documents(df).collect()
        assert len(rows) == df.count()
        for shard in {r.shard for r in rows}:
            mine = sorted(r.slot for r in rows if r.shard == shard)
            assert mine == list(range(len(mine)))
    assert sh.shard_documents(none).count() == 0
    by_id = {r.doc_id: r for r in rows}
    assert by_id[0].size == 16 and by_id[0].text_crc32 == 0
    t = "é 漢字 \U0001f600 ñ".encode()
    assert (by_id[8].size, by_id[8].text_crc32) == (len(t) + 16, zlib.crc32(t))


def test_weights_confine_moves(spark):
    """Doubling a shard's weight, with its rack's and region's, moves rows only out of others into its region."""
    keys = spark.range(4000)
    before = sh.tree(8, 2, 2)
    w = lambda node, k: (k, node[1] + 1.0)
    region, rack, shard = before
    after = [
        sh.Level("region", (tuple(w(c, 0) if c[0] == 0 else c for c in region.children[0]),)),
        sh.Level("rack", tuple(tuple(w(c, 0) if c[0] == 0 else c for c in r) for r in rack.children)),
        sh.Level("shard", tuple(tuple(w(c, 0) if c[0] == 0 else c for c in r) for r in shard.children)),
    ]
    rows = sh.place(sh.place(keys, keys.id, before, "a"), keys.id, after, "b").collect()
    moved = [r for r in rows if r.a != r.b]
    assert moved and all(r.b < 4 for r in moved)  # region 0 holds shards 0 to 3
    n = Counter(r.b for r in rows)
    assert n[0] > 1.5 * n[5]
