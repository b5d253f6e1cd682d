import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tidemark.llm import alignment as al

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "a", "a  b", " lead", "tail ", "\n\nhi\t x ", "▁under", "<s> </s> <unk>", "<0x41>", "<|endoftext|> x", "é漢字\U0001f600 ñandú", "\x00nul\x1c", "é é", "ﬁne Ⅳ", "word " * 3000, "x" * 3000, "same text here", "same text here", "\r\n 1234567890 --- it's  we'LL"]


@pytest.fixture(scope="module")
def sides():
    return al.byte_level_side(A), al.piece_side(B)


@pytest.fixture(scope="module")
def plain_ids():
    """Ids and bytes of tokens by the tokenizers' own libraries."""
    t, p = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    t.encode_special_tokens = True
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    back = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in own)}

    def ids(text):
        a, b = t.encode(" " + text, add_special_tokens=False).ids, p.encode(text)
        a = [(i, bytes(back[c] for c in t.id_to_token(i))) for i in a]
        b = [(i, bytes([int(p.id_to_piece(i)[3:5], 16)]) if p.is_byte(i) else p.id_to_piece(i).replace("▁", " ").encode()) for i in b]
        whole = b" " + text.encode()
        return (a, b) if text and all(b"".join(x[1] for x in s) == whole for s in (a, b)) else ([], [])

    return ids


def ranges(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def plain(texts, ids):
    """Every token of A against every token of B that is near."""
    docs, holds = [], Counter()
    for text in texts:
        a, b = map(ranges, ids(text or ""))
        both = sorted({x[2] for x in a} & {x[2] for x in b})
        shown, links, i, j = [], [], 0, 0
        for end in both:
            ga, gb = [], []
            while i < len(a) and a[i][2] <= end:
                ga.append(a[i])
                i += 1
            while j < len(b) and b[j][2] <= end:
                gb.append(b[j])
                j += 1
            links += [(x[0], y[0]) for x in ga for y in gb if x[1] < y[2] and y[1] < x[2]]
            shown.append(",".join(str(x[0]) for x in ga) + "|" + ",".join(str(x[0]) for x in gb))
        holds.update(set(links))
        docs.append((len(a), len(b), len(both), links, hashlib.sha256(";".join(shown).encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (a, _), n in holds.items():
        best[a] = max(best[a], n)
    return [(k, *d[:3], len(d[3]), sum(holds[x] == best[x[0]] for x in d[3]), sum(holds[x] for x in d[3]), d[4]) for k, d in enumerate(docs)]


@pytest.mark.parametrize("frequent", [1 << 19, 50, 0])
def test_equals_brute_force(docs, corpus, plain_ids, frequent):
    texts = TEXTS + (corpus if frequent == 50 else corpus[:40])
    got = al.align_tokens(docs(texts), A, B, frequent=frequent)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert {t for c, t in got.dtypes if c != "groups_sha256"} == {"bigint"}
    assert sorted(map(tuple, got.collect())) == plain(texts, plain_ids)


def test_odd_rows(odd, none):
    rows = al.align_tokens(odd, A, B).collect()
    assert len(rows) == 15 and sum(r.doc_id is None for r in rows) == 2
    twins = [r for r in rows if r.doc_id == 9]
    assert twins[0] == twins[1] and twins[0].count_sum >= 2 * twins[0].n_links > 0
    assert [tuple(r)[1:] for r in rows if r.doc_id in (0, 1)] == [(0, 0, 0, 0, 0, 0, "")] * 2
    assert al.align_tokens(none, A, B).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_ids_and_bytes_are_the_libraries_own(sides, plain_ids, texts):
    for t, a, b in zip(texts, sides[0].encode(texts), sides[1].encode(texts), strict=True):
        x, y = plain_ids(t)
        if x:
            assert [(int(i), sides[0].pieces[i]) for i in a] == x and [(i, sides[1].pieces[i]) for i in b] == y


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2**31), max_size=6))
def test_any_cuts_of_a_text(seeds):
    """Tokens are their own lengths: two random cuts of each of several texts."""
    size, a, b = np.arange(12), [], []
    for seed in seeds:
        rng = random.Random(seed)
        n = rng.randint(1, 60)
        for side in (a, b):
            left, cuts = n, []
            while left:
                cuts.append(min(left, rng.randint(1, 11)))
                left -= cuts[-1]
            side.append(cuts)
    x = al.align(a, b, size, size)
    base_a = base_b = link = group = 0
    for k, (p, q) in enumerate(zip(a, b, strict=True)):
        ra, rb = ranges([(i, b"x" * i) for i in p]), ranges([(i, b"x" * i) for i in q])
        want = [(i + base_a, j + base_b) for i, s in enumerate(ra) for j, t in enumerate(rb) if s[1] < t[2] and t[1] < s[2]]
        assert list(zip(x.link_a[link : link + x.links[k]].tolist(), x.link_b[link : link + x.links[k]].tolist(), strict=True)) == want
        both = sorted({s[2] for s in ra} & {s[2] for s in rb})
        assert x.groups[k] == len(both)
        assert x.a_group[base_a : base_a + len(p)].tolist() == [group + sum(e < s[2] for e in both) for s in ra]
        assert x.b_group[base_b : base_b + len(q)].tolist() == [group + sum(e < s[2] for e in both) for s in rb]
        base_a, base_b, link, group = base_a + len(p), base_b + len(q), link + len(want), group + len(both)


def test_the_level_leaves_no_more_than_the_limit(spark):
    counts = spark.createDataFrame([(k, n) for k, n in enumerate([1, 1, 1, 2, 3, 4, 9, 16])], "pair int, n long")
    assert [al.least_frequent_level(counts, k) for k in (0, 1, 2, 3, 4, 5, 7, 8)] == [64, 4, 3, 2, 2, 1, 1, 0]
    assert al.least_frequent_level(counts.where("false"), 5) == 64
