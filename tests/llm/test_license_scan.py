import random
import re

import numpy as np
import pyarrow as pa

from tidemark.llm import license_scan as ls
from tidemark.llm.license_templates import TEMPLATES


def found(*texts):
    return {(d, licence, number) for d, licence, number, *_ in ls.scan_slice(ls.Index(TEMPLATES), pa.array(texts), ls.PERCENT)}


def test_every_template_is_found_in_prose():
    rng = random.Random(1)
    prose = lambda n: " ".join(rng.choice(["aa", "bb", "cc", "dd"]) for _ in range(n))
    for number, (licence, notice) in enumerate(TEMPLATES):
        for lead in (0, 1, 2, 3, 5, 17, 40):
            assert (0, licence, number) in found(f"{prose(lead)} {notice} {prose(30)}"), (number, lead)
        assert (1, licence, number) in found("x", notice.upper().replace(" ", "\n  ")), number


def test_edits_below_and_above_the_threshold():
    number, (licence, notice) = 11, TEMPLATES[11]
    w = notice.split(" ")
    one = w.copy()
    one[10] = "changed"
    assert (0, licence, number) not in found(" ".join(one))  # 5 of 17 shingles are gone
    cut = " ".join(w[:-2])
    assert (0, licence, number) in found(cut)
    assert found("no licence here at all, just words that say so") == set() and found("", "x") == set()


def test_minhash_retrieves_at_the_stated_similarity():
    rng = np.random.default_rng(0)
    misses = 0
    for _ in range(500):
        s = rng.integers(0, 2**64, 60, dtype=np.uint64)
        a, b = s[:40], np.concatenate((s[:23], s[40:]))  # similarity 23/60 = 0.38
        misses += not (ls._rows(a).min(1) == ls._rows(b).min(1)).any()
    assert misses == 0


def brute(texts, templates, percent=ls.PERCENT):
    """Every stretch of every text against every template, on the words themselves."""
    plain = lambda t: re.sub(r"[\x00-\x08\x0e-\x1f!-/:-@\[-`{-\x7f]", " ", t.lower()).split()
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    out = []
    for d, text in enumerate(texts):
        have = grams(plain(text))
        for number, (licence, notice) in enumerate(templates):
            words = plain(notice)
            want = set(grams(words))
            span = max(1, len(words) * 3 // 2 - 4)
            best = max(((len(want.intersection(have[k : k + span])), -k) for k in range(len(have)) if have[k] in want), default=(0, 0))
            if 100 * best[0] >= percent * len(want):
                out.append((d, licence, number, -best[1], best[0], len(want)))
    return out


def test_matches_an_exhaustive_search():
    rng = random.Random(6)
    long = ("long", " ".join(f"{rng.choice('abc')}{k}" for k in range(900)))
    templates = (*TEMPLATES, long, ("twin", TEMPLATES[3][1]))  # a tie: two templates of one text
    prose = lambda n: " ".join(rng.choice(["the", "of", "permission", "notice", "software", "zz"]) for _ in range(n))
    texts = ["", "one", prose(300), f"{long[1]} {prose(9)} {long[1]}"]
    for licence, notice in templates:
        w = notice.split(" ")
        for edits in (0, 1, 3):
            v = w.copy()
            for _ in range(edits * len(w) // 40):
                v[rng.randrange(len(v))] = "changed"
            texts.append(f"{prose(rng.randrange(60))} {' '.join(v)} {prose(rng.randrange(60))}")
        texts.append(" ".join(w[: len(w) * 9 // 10]) + " " + prose(5) + " " + notice)
    want = brute(texts, templates)
    assert ls.scan_slice(ls.Index(templates), pa.array(texts), ls.PERCENT) == want and len(want) > 100


def test_query_rows(docs, odd, none):
    rows = ls.scan_licenses(docs(["intro.\nReleased under the MIT License.", None, "Licensed under CC BY-NC 4.0."])).orderBy("doc_id").collect()
    assert [(r.doc_id, r.license, r.first_word, r.containment) for r in rows] == [(0, "MIT", 1, 1.0), (2, "CC-BY-NC-4.0", 0, 1.0)]
    assert ls.scan_licenses(odd).count() == 0 and ls.scan_licenses(none).count() == 0
