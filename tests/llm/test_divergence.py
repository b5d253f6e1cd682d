import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tidemark.llm.divergence import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}
SCHEMA = "doc_id long, text string, lang string, source string, term string, n string, value string, `a.b` string"


def plain(rows, min_docs, top):
    """Every cell of every pair, in Python's numbers."""
    groups, docs = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall((text or "").translate(LOWER))
        groups[lang, source].update(terms)
        docs[lang].update(set(terms))
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = []
    for lang in docs:
        kept = sorted(t for t, k in docs[lang].items() if k >= min_docs)
        own = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept)) for t in kept}
        p = {s: share(c) for s, c in own.items()}
        q = share({t: sum(c[t] for c in own.values()) for t in kept})
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, r) for r, (v, item) in enumerate(found[:most], 1)]
    return sorted(out)


def made(spark, rows, **options):
    docs = spark.createDataFrame([(k, *r, "t", "n", "v", "dot") for k, r in enumerate(rows)], SCHEMA)
    got = divergence(docs, **options)
    assert got.dtypes == [("lang", "string"), ("source", "string"), ("part", "string"), ("item", "string"), ("value", "bigint"), ("rank", "int")]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_every_cell_of_every_pair(spark, seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcé漢\U0001f600") for _ in range(rng.randint(1, 3))) for _ in range(150)]
    rows = []
    for _ in range(300):
        source = rng.choice(["hot"] * 5 + ["b", "c", None, "", "é"])
        some = words if source != "c" else words[:40]
        rows.append((" ".join(rng.choice(some) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "de", None]), source))
    assert made(spark, rows, min_docs=5) == plain(rows, 5, 10)


def test_odd_texts_groups_and_ties(spark):
    rows = [(None, "en", "a"), ("", "en", "b"), ("Word WORD-word\tw0rd é É\x00x", "en", "c"), ("one", None, None), ("one", None, None), ("two", "x", "alone"), ("word " * 30_000, "en", "long")]
    rows += [("tie one", "tied", s) for s in "abc"] * 2
    assert made(spark, rows, min_docs=2) == plain(rows, 2, 10)
    # none kept: pairs of value 0 by name, no terms
    got = made(spark, rows, min_docs=100)
    assert got == plain(rows, 100, 10) and {r[2] for r in got} == {"pair"} and {r[4] for r in got} == {0}


def test_counts_are_summed_over_flushes(spark, monkeypatch):
    from tidemark.llm import divergence as d

    monkeypatch.setattr(d, "HELD_TERMS", 3)
    rows = [(f"a b c w{k % 4}", "en", f"s{k % 3}") for k in range(60)]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 60, "source": [r[2] for r in rows], "text": [r[0] for r in rows]})
    out = Counter()
    for part in d.term_counts([batch.slice(k, 5) for k in range(0, 60, 5)]):
        for r in part.to_pylist():
            out[r["source"], r["term"], "n"] += r["n"]
            out[r["source"], r["term"], "docs"] += r["docs"]
    want = Counter()
    for t, _, s in rows:
        for w in TERM.findall(t):
            want[s, w, "n"] += 1
            want[s, w, "docs"] += 1
    assert +out == want
    assert made(spark, rows, min_docs=10) == plain(rows, 10, 10)


def test_no_rows(spark):
    assert made(spark, []) == []


def test_shares_past_64_bits(spark):
    from tidemark.llm.divergence import _share

    got = spark.sql("SELECT 50000000000000 AS c, 90000000000000 AS t, 7 AS v").select(_share("c", "t", "v")).first()[0]
    assert got == 1 + 10**9 * (50000000000000 + 2) // (90000000000000 + 14)
