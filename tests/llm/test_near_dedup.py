import re

import numpy as np

from tidemark.llm import near_dedup as nd


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({k: k + 32 for k in range(65, 91)}))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute(rows, n, percent=80):
    sets = [(i, shingles(t, n)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, t in sets[:a]:
            both = len(s & t)
            if s and t and 100 * both >= percent * (len(s) + len(t) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets)


def test_matches_brute_force(docs, corpus):
    for n in (4, 5):
        rows = list(enumerate(corpus))
        got = sorted(tuple(r) for r in nd.near_duplicates(docs(corpus), n).collect())
        assert got == brute(rows, n)
        assert len({r[2] for r in got}) < len(got) - 10


def test_chain_of_copies(docs):
    words = [f"w{k}" for k in range(200)]
    texts = []
    for k in range(12):  # each shares enough with the next, the ends share little
        texts.append(" ".join(words[4 * k : 4 * k + 100]))
    got = sorted(tuple(r) for r in nd.near_duplicates(docs(texts), 4).collect())
    assert got == brute(list(enumerate(texts)), 4)


def test_densified_bins_of_short_texts():
    flat = np.sort(np.random.default_rng(1).integers(0, 2**64, 7, dtype=np.uint64))
    sig = nd.signatures(flat, np.array([0, 7]))
    assert set(sig[0].tolist()) <= set(flat.tolist()) and (sig == nd.signatures(flat, np.array([0, 7]))).all()
    assert (nd.signatures(flat[:1], np.array([0, 1])) == flat[0]).all()


def test_recall_at_the_threshold():
    """Pairs of similarity 0.8 share a band in all of 300 trials."""
    rng = np.random.default_rng(5)
    for _ in range(300):
        n = int(rng.integers(1, 40)) * 9
        pool = rng.integers(0, 2**64, n + n // 4, dtype=np.uint64)
        a, b = np.unique(pool[: n + n // 8]), np.unique(np.concatenate((pool[:n], pool[n + n // 8 :])))
        keys = [nd.band_keys(nd.signatures(x, np.array([0, len(x)])))[0] for x in (a, b)]
        assert (keys[0] == keys[1]).any()


def test_odd_cases(odd, none, untouched):
    got = sorted((tuple(r) for r in nd.near_duplicates(odd, 4).collect()), key=str)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert len(got) == len(rows)
    assert all(r[2] is None and r[3] for r in got if r[0] is None)
    assert {r[0]: r[2] for r in got if r[0] is not None} == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8, 9: 9, 11: 4, 14: 14}
    assert nd.near_duplicates(none).count() == 0 and nd.near_dedup(none).count() == 0
    kept = nd.near_dedup(odd)
    assert kept.columns == odd.columns and kept.count() == len(rows) - 2 and untouched(kept.collect())


def test_dense_group_near_the_threshold(docs, monkeypatch):
    """Variants of one text that are as often just under the threshold as over it; blocks smaller than the group."""
    import random

    monkeypatch.setattr(nd, "HELD_SHINGLES", 3_000)
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for _ in range(160):
        w = base.copy()
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(120)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    want = brute(list(enumerate(texts)), 4)
    assert len({r[2] for r in want}) > 3
    df = docs(texts)
    assert sorted(tuple(r) for r in nd.near_duplicates(df, 4).collect()) == want
    # without centres' links the blocks alone find all
    sheet = df.selectExpr("doc_id as id", "xxhash64(text) as th", "text")
    known = nd.sketch(sheet, 4)
    shared = nd.shared_buckets(known)
    lone = df.selectExpr("doc_id as node", "doc_id as component")
    links = nd.outsider_links(nd.mixed_buckets(shared, lone), known.drop("th").join(sheet, "id"), 4, 80, block=7)
    reach = nd.connected_components(links).collect()
    root = {r.node: r.component for r in reach}
    assert [(i, root.get(i, i)) for i in range(160)] == [(r[0], r[2]) for r in want]
    # a pair is compared in one bucket only, and no link is lost to the prefixes
    seen = [tuple(r) for r in links.collect()]
    assert len(seen) == len(set(seen))


def test_unlinked_documents_of_one_template_are_not_compared(docs):
    """Texts that share most of their words but no link share buckets; the prefixes leave nothing to compare."""
    import random

    rng = random.Random(8)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(120):
        w = base.copy()
        for at in rng.sample(range(0, 300, 5), 11):
            w[at] = f"own{k}x{at}"
        texts.append(" ".join(w))
    df = docs(texts)
    assert all(r[3] for r in brute(list(enumerate(texts)), 4))
    sheet = df.selectExpr("doc_id as id", "xxhash64(text) as th", "text")
    shared = nd.shared_buckets(nd.sketch(sheet, 4))
    assert shared.count() > 120
    active = sheet.selectExpr("id", "id as component", "text")
    assert nd.linkable(nd.prefixes(active, nd.frequencies(active, 4), 4, 80)).count() == 0
    assert all(r.kept for r in nd.near_duplicates(df, 4).collect())


def test_prefixes_lose_no_link(docs, corpus):
    """Every document with a link to another component has to be left to compare, whatever orders the shingles."""
    rows = [(i, t) for i, t in enumerate(corpus) if shingles(t, 4)]
    sets = {i: shingles(t, 4) for i, t in rows}
    linked = {i for i in sets for j in sets if i != j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])}
    assert linked
    active = docs([t for _, t in rows], [i for i, _ in rows]).selectExpr("doc_id as id", "doc_id as component", "text")
    for level in (nd.frequencies(active, 4), np.zeros(nd.CELLS, np.uint8), np.random.default_rng(1).integers(0, 9, nd.CELLS).astype(np.uint8)):
        assert linked <= {r.id for r in nd.linkable(nd.prefixes(active, level, 4, 80)).collect()}


def test_ids_with_several_texts(docs):
    """A doc_id with two texts is the smallest of both sets: near copies of either are linked with it."""
    one, two = ([f"{c}{k}" for k in range(60)] for c in "ab")
    near = lambda w: " ".join([*w[:-1], "other"])
    texts = [" ".join(one), " ".join(two), " ".join(two), near(one), near(two), "quite something else in here"]
    got = sorted(tuple(r) for r in nd.near_duplicates(docs(texts, [3, 3, 3, 7, 8, 9]), 4).collect())
    assert [(r[0], r[2], r[3]) for r in got] == [(3, 3, True)] * 3 + [(7, 3, False), (8, 3, False), (9, 9, True)]
