import itertools
import re
from collections import Counter

import numpy as np
import pytest

from tidemark.llm import quality as q


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    n = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(covered), len(w) < 50 or 100 * len(covered) > 50 * len(w)


def test_counts_match_brute_force(docs, corpus, odd, none):
    extra = ["a b c a b c", "x\n\nx\n x\nx", "#*$ %&| <> é漢\n" * 9, "\n", "a\n" * 3 + "a"]
    for df in (docs(corpus + extra), odd):
        got = sorted((tuple(r)[:6] + (r.base_failed,) for r in q.judge(df, q.Field()).collect()), key=str)
        assert got == sorted(((r.doc_id, *brute(r.text)) for r in df.collect()), key=str)
    assert q.judge(none, q.Field()).count() == 0


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(3)
    lines = np.array([0, 1, 6, 6, 10])
    f = rng.integers(0, 2, (10, len(q.FEATURES))).astype(np.uint8)
    crf = q.Field(rng.normal(size=len(q.FEATURES)), rng.normal(size=(2, 2)))
    got = q.viterbi(crf, f, lines)
    lead = f @ crf.lead
    for a, b in zip(lines[:-1], lines[1:], strict=True):
        def total(path, a=a):
            return sum(lead[a + k] * y for k, y in enumerate(path)) + sum(crf.step[x, y] for x, y in zip(path, path[1:], strict=False))

        if b > a:
            best = max(itertools.product((0, 1), repeat=b - a), key=total)
            assert abs(total(best) - total(tuple(got[a:b]))) < 1e-9


@pytest.fixture(scope="module")
def labelled(spark, docs):
    rng = np.random.default_rng(8)
    names = ["".join(rng.choice(list("abcdefg"), 5)) for _ in range(400)]
    good = ["\n".join("The " + " ".join(rng.choice(names, 11)) + "." for j in range(8)) for k in range(30)]
    bad = ["\n".join(f"| {k} | ### {j} | $$$ | *** | %%% | item{k * j} &&& |" for j in range(8)) for k in range(30)]
    labels = spark.createDataFrame([(k, int(k < 30)) for k in range(0, 60, 2)] + [(None, 1), (5, None), (999, 0)], "doc_id long, quality int")
    return docs(good + bad), labels


def test_training_separates_held_out_documents(labelled, untouched):
    d, labels = labelled
    crf = q.fit(d, labels)
    got = {r.doc_id: r.kept for r in q.judge(d, crf).collect()}
    assert all(got[k] == (k < 30) for k in range(60))
    kept = q.keep_good(d, crf)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == list(range(30)) and untouched(kept.collect())


def test_training_gradient_helps():
    rng = np.random.default_rng(1)
    lines = np.arange(0, 401, 10)
    y = np.arange(40) % 2
    f = (rng.random((400, len(q.FEATURES))) < 0.3).astype(np.uint8)
    f[:, 5] = np.repeat(1 - y, 10) & (rng.random(400) < 0.7)
    crf = q.train(f, lines, y)
    assert (q.viterbi(crf, f, lines) == np.repeat(y, 10)).mean() > 0.95


def test_without_labels_the_start_weights_decide(spark, docs, odd):
    crf = q.fit(odd, spark.createDataFrame([], "doc_id long, quality int"))
    assert np.allclose(crf.lead, q.START)
    assert q.keep_good(docs([None, ""]), crf).count() == 0


def test_contradicting_labels_and_repeated_ids(spark, labelled):
    d, labels = labelled
    twice = labels.unionAll(spark.createDataFrame([(0, 0), (2, 0)], labels.schema))
    many = d.unionAll(d).unionAll(d.where("doc_id < 10"))
    one, two = q.fit(d, twice), q.fit(many.repartition(5), twice.repartition(3))
    assert np.allclose(one.lead, two.lead) and np.allclose(one.step, two.step)
    worse = q.fit(d, labels.where("doc_id not in (0, 2)").unionAll(spark.createDataFrame([(0, 0), (2, 0)], labels.schema)))
    assert np.allclose(one.lead, worse.lead)
