import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np

from tidemark.llm import hidden_markov as hm
from tidemark.llm import lm_scoring as lm


def test_forward_is_the_sum_over_all_paths():
    m = hm.random_model(3, np.full(5, 0.2), 1)
    m.start = np.array([0.5, 0.3, 0.2])
    texts = [[0, 3, 1, 4], [2], [1, 1]]
    off = np.cumsum([0, *map(len, texts)])
    got = hm.log_likelihoods(m, np.concatenate(texts), off)
    for t, g in zip(texts, got, strict=True):
        p = sum(math.prod([m.start[s[0]] * m.emit[s[0], t[0]], *(m.step[a, b] * m.emit[b, x] for a, b, x in zip(s, s[1:], t[1:], strict=False))]) for s in itertools.product(range(3), repeat=len(t)))
        assert abs(g - math.log(p)) < 1e-9


def test_expected_counts_match_enumeration():
    m = hm.random_model(2, np.full(3, 1 / 3), 2)
    x = np.array([0, 2, 1, 1])
    c = hm.expect(m, x, np.array([0, 4]))
    total, start, step, emit = 0.0, np.zeros(2), np.zeros((2, 2)), np.zeros((2, 3))
    for s in itertools.product(range(2), repeat=4):
        p = math.prod([m.start[s[0]] * m.emit[s[0], 0], *(m.step[a, b] * m.emit[b, y] for a, b, y in zip(s, s[1:], x[1:], strict=False))])
        total += p
        start[s[0]] += p
        for a, b in zip(s, s[1:], strict=False):
            step[a, b] += p
        for a, y in zip(s, x, strict=True):
            emit[a, y] += p
    assert np.allclose(c.start / hm.FIXED, start / total, atol=1e-6) and np.allclose(c.step, step / total) and np.allclose(c.emit / hm.FIXED, emit / total, atol=1e-5)


def test_training_raises_the_likelihood():
    rng = np.random.default_rng(0)
    x = np.concatenate([np.append(rng.choice([1, 2, 3] if k % 2 else [4, 5, 6], 40), 0) for k in range(60)])
    off = np.append(0, np.flatnonzero(x == 0) + 1)
    m, seen = hm.random_model(2, np.bincount(x, minlength=7) / len(x)), []
    for _ in range(12):
        c = hm.expect(m, x, off)
        seen.append(c.log_likelihood / hm.FIXED)
        m = hm.reestimate(c)
    assert all(b > a - 1e-6 for a, b in zip(seen, seen[1:], strict=False)) and seen[-1] > seen[0] + 100


def brute(rows):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)})) + [None]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    n = Counter(w for i, t in rows if not held(i) for w in words(t))
    total, v = sum(n.values()), len(n)
    return [(i, held(i), len(words(t)), sum(n[w] > 0 for w in words(t)), total, sum(math.log10((n[w] + 1) / (total + v + 1)) for w in words(t))) for i, t in rows]


def check(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    got = sorted((tuple(r) for r in lm.score_documents(df).collect()), key=str)
    want = sorted(brute(rows), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(abs(g[5] - w[5]) < 1e-6 * max(1, abs(w[5])) and math.isfinite(g[6]) and g[6] <= 1e-9 for g, w in zip(got, want, strict=True))
    return got


def test_base_matches_brute_force_and_model_beats_it_on_held_out(docs, corpus, monkeypatch):
    monkeypatch.setattr(lm, "HELD_TOKENS", 2000)
    got = check(docs(corpus))
    held = [g for g in got if g[1]]
    assert held and sum(g[6] for g in held) > sum(g[5] for g in held)


def test_odd_cases(spark, docs, odd, none):
    check(odd)
    assert lm.score_documents(none).count() == 0
    held = next(k for k in range(100) if zlib.crc32(str(k).encode()) % 7 == 2)
    (row,) = lm.score_documents(docs(["some words here"], [held])).collect()
    assert row.held_out and row.train_tokens == 0 and row.n_known == 0 and math.isfinite(row.score)


def test_cut_texts_count_as_whole_ones():
    """Long texts are cut in parts and joined by transfer matrices: nothing changes."""
    rng = np.random.default_rng(4)
    m = hm.random_model(4, np.full(9, 1 / 9), 2)
    m.start = np.array([0.7, 0.1, 0.1, 0.1])
    off = np.cumsum([0, 1, 90, 33, 7, 250, 2])
    x = rng.integers(0, 9, off[-1])
    whole, cut = hm.expect(m, x, off, long=10**6), hm.expect(m, x, off, long=20, part=8)
    assert np.allclose(whole.start, cut.start, atol=2) and np.allclose(whole.step, cut.step) and np.allclose(whole.emit, cut.emit, atol=len(x))
    a, b = (hm.log_likelihoods(m, x, off, long=n, part=8) for n in (10**6, 20))
    assert np.allclose(a, b, rtol=1e-12) and abs(whole.log_likelihood / hm.FIXED - a.sum()) < 1e-4 and abs(cut.log_likelihood / hm.FIXED - a.sum()) < 1e-4
    # each text by itself gives the same
    alone = [hm.expect(m, x[i:j], np.array([0, j - i])) for i, j in zip(off[:-1], off[1:], strict=True)]
    assert (sum(c.emit for c in alone) == whole.emit).all() and np.allclose(sum(c.step for c in alone), whole.step)


def test_scores_do_not_depend_on_partitions_or_the_table_of_frequent_words(docs, corpus, monkeypatch):
    df = docs([*corpus, "long " * 40 + " ".join(corpus)])
    runs = []
    for k, (d, frequent) in enumerate(((df.coalesce(1), 1 << 18), (df.repartition(7, "doc_id"), 1 << 18), (df.repartition(3), 40), (df, 0))):
        monkeypatch.setattr(lm, "FREQUENT", frequent)
        monkeypatch.setattr(lm, "HELD_TOKENS", 3000 if k % 2 else 1 << 20)
        runs.append(sorted(map(tuple, lm.score_documents(d, rounds=6).collect())))
    for other in runs[1:]:
        assert [r[:5] for r in other] == [r[:5] for r in runs[0]]
        assert all(abs(a - b) < 1e-9 * max(1, abs(a)) for x, y in zip(runs[0], other, strict=True) for a, b in zip(x[5:], y[5:], strict=True))


def test_training_likelihood_is_the_sum_of_the_texts(docs, corpus):
    df = docs(corpus)
    none = lm.Classes(np.zeros(0, np.uint64), np.zeros(0, np.int16))
    coded = lm.coded(df, none)
    x = np.concatenate([np.frombuffer(r.x, np.int16) for r in coded.collect()])
    model = hm.random_model(lm.STATES, np.bincount(x, minlength=1 + lm.OWN + lm.SHARED) / len(x))
    got = lm.expected_counts(coded, model).log_likelihood / hm.FIXED
    assert abs(got - hm.log_likelihoods(model, x, np.append(0, np.flatnonzero(x == 0) + 1)).sum()) < 1e-6 * len(x)


def test_all_texts_train_until_the_likelihood_settles(docs, corpus):
    df = docs(corpus).repartition(3)
    none = lm.Classes(np.zeros(0, np.uint64), np.zeros(0, np.int16))
    coded = lm.coded(df, none)
    x = np.concatenate([np.frombuffer(r.x, np.int16) for r in coded.collect()])
    assert len(x) == sum(len(re.findall(r"[^\x20\x09-\x0D]+", t)) + 1 for t in corpus) and (x == 0).sum() == len(corpus)
    shares = np.bincount(x, minlength=1 + lm.OWN + lm.SHARED) / len(x)
    model, seen = lm.train_model(coded, shares, len(x))
    assert len(seen) > lm.STEADY and all(b - a < lm.SETTLED for a, b in itertools.pairwise(seen[-lm.STEADY - 1 :]))
    # the expectation is that of all tokens: the states' counts add up to them
    got = lm.expected_counts(coded, model)
    assert abs(got.emit.sum() / hm.FIXED - len(x)) < 1e-5 * len(x) and abs(got.start.sum() / hm.FIXED - len(corpus)) < 1e-5 * len(corpus)


def test_cut_texts_are_scaled_once_in_eight_tokens(monkeypatch):
    """The transfer matrices of parts, a large part of the work on long texts, are scaled as seldom as the tokens of whole ones."""
    rng = np.random.default_rng(5)
    m = hm.random_model(3, np.full(7, 1 / 7), 2)
    off = np.array([0, 150, 171])
    x = rng.integers(0, 7, off[-1])
    scaled, real = [], hm._scaled
    monkeypatch.setattr(hm, "_scaled", lambda t, last: scaled.append(real(t, last)) or scaled[-1])
    log = hm._bridge(m, x, hm._cut(off, 3, 20, 64))
    assert len(scaled) == 64 and sum(scaled) == 8
    monkeypatch.undo()
    assert np.allclose([log[:3].sum(), log[3:].sum()], hm.log_likelihoods(m, x, off, long=10**6), rtol=1e-12)


def test_texts_are_cut_only_where_few_others_are_at_hand(monkeypatch):
    """A cut text's tokens cost several times what others do: among many tokens, texts of some thousands are followed whole."""
    rng = np.random.default_rng(6)
    m = hm.random_model(3, np.full(7, 1 / 7), 2)
    size, n = 1500, 1400
    x, off = rng.integers(0, 7, size * n), np.arange(n + 1) * size
    bridged, real = [], hm._bridge
    monkeypatch.setattr(hm, "_bridge", lambda model, x, parts: bridged.append(parts.size.sum()) or real(model, x, parts))
    many = hm.expect(m, x, off)
    assert not bridged
    few = hm.expect(m, x[: 20 * size], off[:21])
    assert bridged == [20 * size]
    # nothing changes by that, nor by how many tokens are at hand
    rest = hm.expect(m, x[20 * size :], off[20:] - off[20])
    assert np.allclose(many.emit, few.emit + rest.emit, rtol=1e-9, atol=10) and np.allclose(many.step, few.step + rest.step) and np.allclose(many.start, few.start + rest.start, atol=10)
    assert abs(many.log_likelihood / hm.FIXED - hm.log_likelihoods(m, x, off).sum()) < 1e-3


def test_scores_are_scaled_once_in_eight_tokens_too(monkeypatch):
    rng = np.random.default_rng(7)
    m = hm.random_model(3, np.full(7, 1 / 7), 2)
    off = np.cumsum([0, 64, 5, 1, 8, 33])
    x = rng.integers(0, 7, off[-1])
    want = []
    for i, j in zip(off[:-1], off[1:], strict=True):
        a = m.start * m.emit[:, x[i]]
        for c in x[i + 1 : j]:
            a = (a @ m.step) * m.emit[:, c]
        want.append(np.log(a.sum()))
    scaled, real = [], hm._scaled
    monkeypatch.setattr(hm, "_scaled", lambda t, last: scaled.append(real(t, last)) or scaled[-1])
    assert np.allclose(hm.log_likelihoods(m, x, off), want, rtol=1e-12)
    assert len(scaled) == 64 and sum(scaled) == 8


def test_expectations_summed_in_blocks_are_the_same(monkeypatch):
    rng = np.random.default_rng(8)
    m = hm.random_model(4, np.full(9, 1 / 9), 2)
    off = np.cumsum([0, *rng.integers(1, 60, 50)])
    x = rng.integers(0, 9, off[-1])
    whole = hm.expect(m, x, off)
    for block, chunk in ((1, 1 << 20), (40, 200), (1 << 14, 1)):
        monkeypatch.setattr(hm, "BLOCK", block)
        monkeypatch.setattr(hm, "CHUNK", chunk)
        got = hm.expect(m, x, off)
        assert np.allclose(got.emit, whole.emit, atol=50, rtol=0) and np.allclose(got.step, whole.step) and np.allclose(got.start, whole.start, atol=50, rtol=0) and abs(got.log_likelihood - whole.log_likelihood) < 100
