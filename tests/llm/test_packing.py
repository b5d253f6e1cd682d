import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing as pk

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def fast():
    return pk.FileTokenizer(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=80))
def test_ids_are_those_of_tokenizers(reference, fast, t):
    assert fast.encode(t).tolist() == reference(t)


@pytest.mark.parametrize("t", ["<|endoftext|>", "a <|endoftext|> b", "<|endoftext", "<| x |>", "a\n \n  b  ", "it's  we'LL\t\t x", " " * 50 + "y", "é漢字\U0001f600 1234567", "x" * 3000, "\x1c\x85 　z", "\r\n\r\n"])
def test_ids_of_odd_texts(reference, fast, t):
    assert fast.encode(t).tolist() == reference(t)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 9000), st.sampled_from([2048, 2047, 2049, 1024, 4096, 256, 1])), max_size=40))
def test_packing_is_a_partition_without_padding(lengths):
    pieces, windows = pk.pack(lengths)
    assert pk.unpack_check(lengths, pieces, windows)
    assert all(w <= 2048 and w & (w - 1) == 0 for w in windows) and all(p.length > 0 for p in pieces)
    groups = pk.step_groups(windows, 8 * 2048)
    total = defaultdict(int)
    for g, w in zip(groups, windows, strict=True):
        total[g] += w
    assert len(total) == max(1, -(-sum(windows) // (8 * 2048))) or not windows
    assert all(n <= 8 * 2048 for n in total.values())
    assert not windows or max(total.values()) - min(total.values()) <= 2048


def test_query_rows(docs, corpus, odd, none, reference):
    for df in (docs(corpus), odd):
        ids = [(r.doc_id, [*reference(r.text or ""), 1]) for r in df.collect()]
        rows = pk.pack_documents(df, PATH).collect()
        known = dict(ids)
        once = [i for i, _ in ids if [j for j, _ in ids].count(i) == 1]
        for i in once:
            at = 0
            for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(known[i])
                assert r.ids_crc32 == zlib.crc32(np.array(known[i][at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(known[i])
        sequences = defaultdict(list)
        for r in rows:
            sequences[r.sequence_id].append(r)
        for s in sequences.values():
            at = 0
            for r in sorted(s, key=lambda r: r.offset):
                assert r.offset == at
                at += r.length
            assert at == s[0].sequence_tokens
        assert sum(r.length for r in rows) == sum(len(x) for _, x in ids)
    assert pk.pack_documents(none, PATH).count() == 0
