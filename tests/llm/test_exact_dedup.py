import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import exact_dedup as ed
from tidemark.llm.quotient_filter import CountingQuotientFilter as CQF

PRINTS = st.lists(st.one_of(st.integers(0, 2**64 - 1), st.sampled_from([0, 1, 2**64 - 1, 2**63, 7 << 58])), max_size=300)


@settings(max_examples=60, deadline=None)
@given(PRINTS, PRINTS)
def test_filters_are_lossless_and_merge(a, b):
    from collections import Counter

    fa, fb = (CQF.build(np.array(x, np.uint64)) for x in (a, b))
    read = lambda f: dict(zip(*(x.tolist() for x in f.entries()), strict=True))
    assert read(fa) == Counter(a)
    assert read(CQF.from_bytes(fa.to_bytes())) == Counter(a)
    assert read(fa.merge(fb)) == Counter(a) + Counter(b)


def test_filter_holds_large_counts():
    f = CQF.build(np.array([5, 9], np.uint64), np.array([2**40 + 3, 1]))
    assert [x.tolist() for x in f.merge(f).entries()] == [[5, 9], [2**41 + 6, 2]]


def brute(rows):
    norm = lambda t: re.sub("[ \t-\r]+", " ", t or "")
    out = []
    for i, t in rows:
        ids = [j for j, u in rows if norm(u) == norm(t)]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_matches_brute_force(docs, corpus, odd):
    for df in (docs(corpus), odd):
        rows = [(r.doc_id, r.text) for r in df.collect()]
        got = [tuple(r) for r in ed.exact_dedup(df).collect()]
        assert sorted(got, key=str) == brute(rows)


def test_many_ranges(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(ed, "RANGE_ROWS", 10)
    monkeypatch.setattr(ed, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(ed, "GROUP_ROWS", 0)
    assert ed.dedup(docs(corpus)).count() == len({r[4] for r in brute(list(enumerate(corpus)))})
    rows = list(enumerate(corpus))
    assert sorted((tuple(r) for r in ed.exact_dedup(docs(corpus)).collect()), key=str) == brute(rows)


def test_dedup_keeps_one_of_each(docs, corpus, odd, none, untouched):
    for df in (docs(corpus), odd):
        out = ed.dedup(df)
        assert out.columns == df.columns and untouched(out.collect())
        got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
        rows = [(r.doc_id, r.text) for r in df.collect()]
        want = {(i, s): None for i, _, _, k, s in brute(rows) if k}
        assert len(got) == len(want)
    assert ed.dedup(none).count() == 0 and ed.exact_dedup(none).count() == 0
