import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import substring_dedup as sd
from tidemark.llm.bwt import ShardTransform, repeated_intervals, repeated_windows


def brute(texts, width):
    raw = [(t or "").encode() for t in texts]
    n = Counter(b[i : i + width] for b in raw for i in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if n[b[i : i + width]] > 1:
                gone[i : i + width] = True
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b"").hexdigest()))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=60), min_size=1, max_size=8), st.integers(1, 20), st.sampled_from([5, 40, 1000]))
def test_merged_transforms_find_all_repeats(texts, width, shard):
    raw = [np.frombuffer(t.encode(), np.uint8) for t in texts]
    n = Counter(t[i : i + width] for t in texts for i in range(len(t) - width + 1))
    got = [f.tolist() for f in repeated_windows(raw, width, shard)]
    assert got == [[n[t[i : i + width]] > 1 for i in range(len(t) - width + 1)] for t in texts]


def test_shard_transform_is_a_burrows_wheeler_transform():
    data = np.frombuffer(b"mississippi\0", np.uint8)
    s = ShardTransform(data, 16)
    turns = sorted(bytes(np.roll(data, -k)) for k in range(len(data)))
    assert s.last.tobytes() == bytes(t[-1] for t in turns)
    row, out = 0, []
    for _ in range(len(data) - 1):
        out.append(s.last[row])
        row = s.step_back[row]
    assert bytes(out[::-1]) == b"mississippi"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", max_size=30), min_size=2, max_size=5))
def test_common_prefixes(texts):
    raw = [np.frombuffer((t + "\0").encode(), np.uint8) for t in texts]
    whole = b"".join(t.tobytes() for t in raw)
    ends = np.array([k for k in range(6, len(whole)) if 0 not in whole[k - 6 : k]], np.int64)
    _, _, common = repeated_intervals([ShardTransform(t, 6) for t in raw], ends, 6)
    for e, c in zip(ends, common, strict=True):
        others = [x for x in ends if x != e]
        assert c == max((d for d in range(7) if any(whole[x - d : x] == whole[e - d : e] for x in others)), default=0)


def test_pieces_of_equal_strings_have_equal_cores():
    rng = np.random.default_rng(9)
    common = rng.integers(97, 123, 30).astype(np.uint8)
    seen = {}
    for _ in range(60):
        data = np.concatenate((rng.integers(97, 99, rng.integers(1, 40)).astype(np.uint8), common, rng.integers(97, 99, rng.integers(1, 40)).astype(np.uint8)))
        off = np.array([0, len(data)])
        for _, start, strings, anchor, _ in zip(*sd.segments(data, off, 40, 8), strict=True):
            part = data[start : start + strings + 39]
            found = sd.pieces(part, int(strings), int(anchor), 40, 8)
            assert sorted(k for _, a, b in found for k in range(a, b)) == list(range(strings)) and all(b - a <= sd.PIECE for _, a, b in found)
            for core, a, b in found:
                for k in range(a, b):
                    assert seen.setdefault(part[k : k + 40].tobytes(), core) == core


def test_an_anchor_with_very_many_segments(docs):
    """More than LARGE_ANCHOR different segments around one short passage, and some that are equal in part."""
    rng = np.random.default_rng(1)
    pool = rng.integers(97, 123, 1 << 20).astype(np.uint8)
    at = np.arange(len(pool) - 31)
    k = int(np.argmin(sd.SpanHash(pool)(at, at + 32)))
    passage = pool[k - 8 : k + 40].tobytes().decode()
    n = sd.LARGE_ANCHOR + 200
    side = [x.tobytes().decode() for x in rng.integers(97, 123, (n, 44)).astype(np.uint8)]
    texts = [s[:22] + passage + s[22:] for s in side]
    texts[100] = texts[100][:8] + texts[200][8:80] + texts[100][80:]
    texts[300] = texts[400][:70] + texts[300][70:]
    got = sd.substring_dedup(docs(texts).repartition(8), 60).orderBy("doc_id").collect()
    want = brute(texts, 60)
    assert sum(w[1] > 0 for w in want) >= 4 and [tuple(r)[1:] for r in got] == want


def test_segments_cover_every_string_once():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    off = np.array([0, 10, 10, 900, 3000, 5000])
    text, start, strings, *_ = sd.segments(data, off, 60, 12)
    seen = Counter((t, s + k) for t, s, n in zip(text, start, strings, strict=True) for k in range(n))
    assert set(seen.values()) == {1} and len(seen) == sum(max(0, b - a - 59) for a, b in zip(off[:-1], off[1:], strict=True))


@pytest.mark.parametrize("large", [sd.LARGE_ANCHOR, 1])
def test_matches_brute_force(docs, corpus, large):
    rng = random.Random(2)
    texts = [*corpus, None, "", "x" * 30, *(corpus[rng.randrange(60)][rng.randrange(50) :] for _ in range(20))]
    got = sd.substring_dedup(docs(texts), 40, gram=8, merge_bytes=3000, large=large).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in got] == brute(texts, 40)


def test_odd_cases(odd, none):
    got = sorted((tuple(r) for r in sd.substring_dedup(odd).collect()), key=str)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    want = [(i, *w) for (i, _), w in zip(rows, brute([t for _, t in rows], 200), strict=True)]
    assert got == sorted(want, key=str)
    assert sd.substring_dedup(none).count() == 0
