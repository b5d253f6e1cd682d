import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import cover_tree as ct
from tidemark.llm import top_k as tk

SCHEMA = "vec_id long, embedding array<double>, key string, x string, block string, `a.b` string"


def plain(rows, k=5, every=50):
    whole = [(i, [math.floor(256 * c) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    out = []
    for n, (i, v) in enumerate(whole):
        if i is None or i % every:
            continue
        cut = lambda s: max(-(2**63), min(2**63 - 1, s))
        got = [(-cut(sum(a * b for a, b in zip(v, w))), j is None, j or 0) for m, (j, w) in enumerate(whole) if m != n]  # noqa: B905
        out += [(i, r, None if null else j, -s) for r, (s, null, j) in enumerate(sorted(got)[:k], 1)]
    return sorted(out, key=str)


def made(spark, rows, **options):
    got = tk.top_k(spark.createDataFrame([(*r, "k", "x", "b", "dot") for r in rows], SCHEMA), **options)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return sorted(map(tuple, got.collect()), key=str)


def clustered(n, dim, seed, spread):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(6, dim))
    return middle[rng.integers(0, 6, n)] + spread * rng.normal(size=(n, dim))


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_equals_comparing_everything(spark, monkeypatch, spread):
    monkeypatch.setattr(tk, "DATA_CELLS", 8 * 60)
    monkeypatch.setattr(tk, "QUERY_CELLS", 8 * 20)
    x = clustered(500, 8, 3, spread)
    rows = [(5 * k, v.tolist()) for k, v in enumerate(x)]
    # a hot vector, a third of all rows, is cut into blocks; ties go by id
    rows += [(1 + 5 * k, x[7].tolist()) for k in range(250)]
    assert made(spark, rows) == plain(rows)


def test_odd_vectors_ids_and_ties(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (50, None), (100, [1.0, None]), (150, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (250, []), (300, [0.5]), (-50, [-0.001, 3.0, 1.0])]
    rows += [(None, [1.0, 2.0]), (None, None), (7, [0.0039, -0.0039]), (8, [1.0, 2.0]), (350, [1e308, -1e308])]
    assert made(spark, rows) == plain([r for r in rows if r[0] != 350])
    assert made(spark, rows[:1]) == [] and made(spark, []) == [] and made(spark, [(1, [1.0])]) == []
    assert made(spark, rows[:2] + rows[8:9], k=1) == plain(rows[:2] + rows[8:9], 1)


def test_scores_past_doubles_and_64_bits(spark):
    rows = [(50 * k, [s * 2.0**e + f, 3.0]) for k, (s, e, f) in enumerate([(1, 40, 1), (1, 40, 2), (-1, 40, 0), (1, 60, 0), (-1, 90, 0), (1, 20, 0.5), (1, 300, 0), (-1, 300, 0)])]
    assert made(spark, rows) == plain(rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(-3, 3), min_size=3, max_size=3), min_size=1, max_size=60))
def test_trees_cover_and_separate(points):
    x = np.array(points, float)
    tree, order = ct.build(x)
    assert sorted(order.tolist()) == list(range(len(x))) and (tree.x == x[order]).all()
    for k in range(len(tree.lo)):
        lo, hi, own = tree.lo[k], tree.hi[k], tree.x[tree.lo[k]]
        away = np.linalg.norm(tree.x[lo:hi] - own, axis=1)
        assert away.max() == tree.radius[k]
        children = np.arange(tree.first[k], tree.first[k] + tree.count[k])
        assert (hi - lo == 1) == (not len(children))
        if len(children):
            assert tree.lo[children].tolist() == [lo, *tree.hi[children][:-1]] and tree.hi[children][-1] == hi
            centres = tree.x[tree.lo[children]]
            apart = np.linalg.norm(centres[:, None] - centres[None], axis=2)[~np.eye(len(children), dtype=bool)]
            assert tree.radius[k] == 0 or not len(apart) or apart.min() > tree.radius[k] / 2


def searched(x, q, k=5, **floors):
    data, order = ct.build(x)
    queries, q_order = ct.build(q)
    ids = np.arange(len(x))[order]
    s = ct.Search(queries, data, np.full(len(q), ct.LEAST), -1 - np.arange(len(q)), ids, ids, np.zeros(len(x), bool), k).run()
    return s, q_order, ids


def test_close_clusters_are_pruned():
    """Queries near clusters leave out most node pairs, and find what comparing everything finds."""
    x = np.floor(256 * clustered(2000, 6, 1, 0.02))
    q = np.floor(256 * clustered(200, 6, 1, 0.02))
    s, q_order, ids = searched(x, q)
    assert s.scored < len(x) * len(q) / 2
    for n, best in enumerate(s.best):
        score = (x @ q[q_order[n]]).astype(int)
        want = sorted(range(len(x)), key=lambda i: (-score[i], i))[:5]
        assert [ids[p] for p in best[0]] == want and best[1].tolist() == [score[i] for i in want]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(-2, 2), min_size=2, max_size=2), min_size=1, max_size=40), st.lists(st.lists(st.integers(-2, 2), min_size=2, max_size=2), min_size=1, max_size=40), st.integers(1, 6))
def test_searches_of_few_and_equal_points(points, asked, k):
    x, q = np.array(points, float), np.array(asked, float)
    s, q_order, ids = searched(x, q, k)
    for n, best in enumerate(s.best):
        score = (x @ q[q_order[n]]).astype(int)
        want = sorted(range(len(x)), key=lambda i: (-score[i], i))[:k]
        assert [ids[p] for p in best[0]] == want
