import math
import random

import pytest

from tidemark.llm import mixing


@pytest.fixture(scope="module")
def labelled(spark, docs):
    good = [f"the {k} quiet river runs past old stone houses near town number {k * 7}" * 3 for k in range(40)]
    bad = [f"| {k} | ### $$$ | {k} | *** | %%% |" * 5 for k in range(20)]
    toxic = [f"the {k} river idiot runs past trash houses near the town {k}" * 3 for k in range(20)]
    d = docs(good + bad + toxic)
    labels = spark.createDataFrame([(k, 0 if 40 <= k < 60 else 1, 1 if k >= 60 else 0) for k in range(0, 80, 2)] + [(None, 1, 0), (3, None, None), (999, 1, 0)], "doc_id long, quality int, toxic int")
    return d, labels


def test_posteriors_and_targets(labelled):
    d, labels = labelled
    rows = {r.doc_id: r for r in mixing.mixing_rates(d, labels).collect()}
    assert len(rows) == 80
    assert all(abs(r.p_clean + r.p_noisy + r.p_toxic - 1) < 1e-9 and r.rate >= 0 for r in rows.values())
    for lo, hi, p in ((0, 40, "p_clean"), (40, 60, "p_noisy"), (60, 80, "p_toxic")):
        assert all(rows[k][p] > 0.5 for k in range(lo, hi))
    assert all(rows[k].copies >= 1 for k in range(40))
    total = sum(r.rate * r.tokens for r in rows.values())
    shares = [sum(r.rate * r.tokens * r[f"p_{x}"] for r in rows.values()) / total for x in mixing.DOMAINS]
    assert all(abs(s - mixing.TARGETS[x]) < 0.02 for s, x in zip(shares, mixing.DOMAINS, strict=True))


def plain(n, p, weights, anchor=None, rounds=200_000):
    """The totals and rates of a plain projected gradient over single documents, with short steps."""
    import numpy as np

    natural = n @ p
    target = np.array(weights) * natural[0] / weights[0]
    low = np.zeros(len(n)) if anchor is None else (p[:, 0] >= anchor).astype(float)
    r, length = np.ones(len(n)), 1 / natural.max()
    for _ in range(rounds):
        new = np.maximum(low, r - length * (p @ ((r * n) @ p - target)))
        if abs(new - r).max() < 1e-13:
            break
        r = new
    return (r * n) @ p, target


@pytest.mark.parametrize("weights", [(0.6, 0.3, 0.1), (0.94, 0.05, 0.01), (0.1, 0.1, 0.8)])
def test_rates_are_the_constrained_least_squares(spark, weights):
    """As near to the targets as a plain projected gradient over single documents comes."""
    import numpy as np

    rng = np.random.default_rng(4)
    p, n = rng.dirichlet([0.3, 0.3, 0.3], 30), rng.integers(5, 500, 30).astype(float)
    cells = [(k % 5, k // 5, 0, int(n[k]), *map(float, p[k])) for k in range(30)]
    df = spark.createDataFrame(cells, "__f0 int, __f1 int, __f2 int, __tokens long, __p0 double, __p1 double, __p2 double")
    for anchor in (None, 0.5):
        found = mixing.solution(df, dict(zip(mixing.DOMAINS, weights, strict=True)), anchor)
        rates = np.array([r[0] for r in df.select(found.rate).collect()])
        reached, target = plain(n, p, weights, anchor)
        assert np.allclose((rates * n) @ p, found.reached) and (rates >= (0 if anchor is None else p[:, 0] >= anchor)).all()
        cost = lambda s: ((s - target) ** 2).sum()  # noqa: E731, B023
        assert cost(np.array(found.reached)) <= cost(reached) + 1e-3 and found.rounds < mixing.ROUNDS


def test_a_short_domain_does_not_flood_another(spark):
    """Hardly any noisy text, and what there is looks toxic as well: toxic stays near what was asked for."""
    cells = [(0, 0, 0, 90_000, 0.97, 0.01, 0.02), (1, 0, 0, 3_000, 0.05, 0.02, 0.93), (2, 0, 0, 300, 0.2, 0.3, 0.5)]
    df = spark.createDataFrame(cells, "__f0 int, __f1 int, __f2 int, __tokens long, __p0 double, __p1 double, __p2 double")
    found = mixing.solution(df, mixing.TARGETS, mixing.ANCHOR)
    assert sum(found.reached) < 1.15 * 93_300 and found.reached[2] < 0.04 * sum(found.reached)
    assert found.residual[1] < 0 and found.rounds < mixing.ROUNDS


def test_contradicting_labels_and_repeated_ids(spark, docs):
    texts = [f"fine words number {k} in a row" for k in range(20)] + ["bad ### $$$ ***"] * 20
    d = docs([*texts, "another text"], [*range(40), 3])
    labels = [(k, int(k < 20), 0) for k in range(40)]
    one = mixing.fit(d, spark.createDataFrame([*labels, (3, 0, 1), (3, 0, 0)], "doc_id long, quality int, toxic int"))
    two = mixing.fit(d.repartition(5), spark.createDataFrame([(3, 0, 0), (3, 0, 1), *labels[::-1]], "doc_id long, quality int, toxic int"))
    assert one == two and abs(math.exp(one.prior[2]) * 43 - 2) < 1e-9  # the toxic label of 3 counts, once


def test_mix_repeats_and_drops_rows(labelled):
    d, labels = labelled
    copies = {r.doc_id: r.copies for r in mixing.mixing_rates(d, labels).collect()}
    out = mixing.mix(d, labels)
    assert out.columns == d.columns
    from collections import Counter

    assert Counter(r.doc_id for r in out.collect()) == Counter({k: c for k, c in copies.items() if c})


def test_odd_cases(spark, odd, none, untouched):
    no_labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = mixing.mixing_rates(odd, no_labels).collect()
    assert len(rows) == odd.count() and {round(r.p_clean, 6) for r in rows} == {round(1 / 3, 6)}
    assert {r.tokens for r in rows if r.doc_id in (0, 1, 2)} == {0}
    assert mixing.mixing_rates(none, no_labels).count() == 0 and mixing.mix(none, no_labels).count() == 0
    out = mixing.mix(odd, no_labels)
    assert out.columns == odd.columns and untouched(out.collect())


def test_plan_has_no_python(labelled):
    d, labels = labelled
    for df in (mixing.mixing_rates(d, labels), mixing.mix(d, labels)):
        plan = df._jdf.queryExecution().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_scarce_domains_are_raised_to_their_weight(spark):
    cells = [(0, 0, 0, 9000, 0.98, 0.01, 0.01), (1, 0, 0, 600, 0.1, 0.88, 0.02), (2, 0, 0, 400, 0.05, 0.05, 0.9)]
    df = spark.createDataFrame(cells, "__f0 int, __f1 int, __f2 int, __tokens long, __p0 double, __p1 double, __p2 double")
    found = mixing.solution(df, {"clean": 0.4, "noisy": 0.4, "toxic": 0.2})
    for got, want in zip(found.reached, (0.4, 0.4, 0.2), strict=True):
        assert abs(got / sum(found.reached) - want) < 1e-4
    assert [r[0] > 1 for r in df.orderBy("__f0").select(found.rate).collect()] == [False, True, True]


def test_report_names_what_is_missed(spark, labelled):
    cells = [(0, 0, 0, 9000, 0.9, 0.05, 0.05), (1, 0, 0, 1000, 0.1, 0.8, 0.1)]
    df = spark.createDataFrame(cells, "__f0 int, __f1 int, __f2 int, __tokens long, __p0 double, __p1 double, __p2 double")
    found = mixing.solution(df, {"clean": 0.94, "noisy": 0.05, "toxic": 0.01})
    assert found.residual[2] > 300 and found.rounds < mixing.ROUNDS  # no rates reach it: toxic goes with clean
    rows = {r.domain: r for r in mixing.mixing_report(*labelled, mixing.TARGETS).collect()}
    assert abs(sum(r.share for r in rows.values()) - 1) < 1e-9
    assert all(abs(r.expected - r.target - r.residual) < 1e-6 and r.weight == mixing.TARGETS[d] for d, r in rows.items())


def test_copies_are_the_rate_on_average(spark):
    from pyspark.sql import functions as F

    ids = spark.range(20_000)
    for rate in (0.0, 0.3, 0.76, 1.0, 1.8, 2.25):
        r = ids.select(mixing.copies(F.lit(rate), F.col("id")).alias("n")).agg(F.avg("n"), F.min("n"), F.max("n")).first()
        assert abs(r[0] - rate) < 0.02 and r[1] >= math.floor(rate) and r[2] <= math.ceil(rate)


def test_shares_of_rows_kept_are_the_targets(docs):
    rng = random.Random(3)
    some = lambda n, of: " ".join(rng.choice(of) for _ in range(n))
    good, bad = [f"w{k}" for k in range(400)], ["###", "$$$", "|", "***", "%%%"]
    texts = [some(60, good) for _ in range(1200)] + [some(60, bad) for _ in range(400)] + [some(50, good) + " idiot trash" * 5 for _ in range(400)]
    d = docs(texts)
    labels = d.sparkSession.createDataFrame([(k, int(not 1200 <= k < 1600), int(k >= 1600)) for k in range(2000)], "doc_id long, quality int, toxic int")
    rows = {r.domain: r for r in mixing.mixing_report(d, labels, mixing.TARGETS).collect()}
    assert all(abs(r.copied_share - r.weight) < 0.015 and abs(r.share - r.weight) < 0.005 for r in rows.values())
    kept = [r.doc_id for r in mixing.mix(d, labels, mixing.TARGETS).collect()]
    assert set(range(1200)) <= set(kept)  # each clean document has a copy
    words = [sum(len(texts[k].split()) for k in kept if lo <= k < hi) for lo, hi in ((0, 1200), (1200, 1600), (1600, 2000))]
    assert all(abs(w / sum(words) - t) < 0.015 for w, t in zip(words, mixing.TARGETS.values(), strict=True))


def test_posteriors_are_those_of_a_plain_recomputation(labelled):
    """Markers, their weights, buckets, probabilities and posteriors, from texts and labels, one document at a time."""
    import re

    from pyspark.sql import functions as F

    d, labels = labelled
    texts = {r.doc_id: r.text for r in d.collect()}
    domain = {k: 2 if k >= 60 else 1 if k >= 40 else 0 for k in range(0, 80, 2)}
    fold = {r.doc_id: r.fold for r in d.select("doc_id", mixing._fold(F.col("doc_id")).alias("fold")).collect()}
    words = {k: [w for w in re.split(r"[ \t-\r]+", t.lower()) if w] for k, t in texts.items()}
    clues = {k: set(ws) | {"\x1f" + w[:n] for w in ws for n in (4, 5, 6) if len(w) > n} for k, ws in words.items()}

    def markers(ids):
        toxic, other = [k for k in ids if domain[k] == 2], [k for k in ids if domain[k] != 2]
        out = {}
        for w in set().union(*(clues[k] for k in ids)):
            t, o = sum(w in clues[k] for k in toxic), sum(w in clues[k] for k in other)
            lift = (t + 0.5) / (len(toxic) + 1) / ((o + 0.5) / (len(other) + 1))
            if t >= max(4, math.ceil(0.02 * len(toxic))) and lift > 8:
                out[w] = math.log(lift)
        return out

    def buckets(k, marked):
        n = len(words[k])
        at = lambda v, limits: sum(v >= x for x in limits)
        symbols = len(re.findall(r"[#*$%&|<>!]", texts[k])) / max(n, 1)
        weight = sum(marked.get(w, 0) for w in clues[k]) / (1 + math.log(1 + n))
        return at(symbols, (0.02, 0.1, 0.3, 0.6)), at(len(set(words[k])) / max(n, 1), (0.1, 0.3, 0.5, 0.7)) * 4 + at(n, (20, 100, 1000)), at(weight, (0.2, 0.5, 1, 2, 4))

    model = mixing.fit(d, labels)
    marked = markers(list(domain))
    assert dict(model.markers) == pytest.approx(marked, abs=1e-8) and "idiot" in marked and "river" not in marked
    known = {k: buckets(k, markers([x for x in domain if fold[x] != fold[k]])) for k in domain}

    def likely(cell, k):
        mine = [c for x, c in known.items() if domain[x] == k]
        n = len(mine)
        single = [(sum(c[f] == cell[f] for c in mine) + 0.5) / (n + 0.5 * size) for f, size in enumerate((5, 20, 6))]
        both = (sum(c[:2] == cell[:2] for c in mine) + 2 * single[0] * single[1]) / (n + 2)
        given = (sum(c[0] == cell[0] and c[2] == cell[2] for c in mine) + 2 * single[2]) / (sum(c[0] == cell[0] for c in mine) + 2)
        return (n + 1) / (len(known) + 3) * both * given

    for r in mixing.mixing_rates(d, labels).collect():
        p = [likely(buckets(r.doc_id, marked), k) for k in range(3)]
        assert [r.p_clean, r.p_noisy, r.p_toxic] == pytest.approx([x / sum(p) for x in p], abs=1e-9) and r.rate <= mixing.MOST
