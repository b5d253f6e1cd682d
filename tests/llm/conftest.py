import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __fp string, kept string, band string, __drop string, __row string, __words string, `a.b` string"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents of the given texts, numbered from 0, with columns whose names clash with the operators' own."""

    def make(texts, ids=None):
        ids = range(len(texts)) if ids is None else ids
        return spark.createDataFrame([(i, t, None, None, None, "x", "k", "y", "d", "r", "w", "dot") for i, t in zip(ids, texts, strict=True)], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    """Nulls, empty, blank and long texts, ties, repeated rows and null ids."""
    texts = [None, "", " \n\t", "a", "a  b", "a b", "x " * 30_000, "word", "é 漢字 \U0001f600 ñ", "dup line\n" * 40, "dup line\n" * 40, "a b", "null id", "null id", "q" * 5000]
    ids = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 9, 11, None, None, 14]
    return docs(texts, ids)


@pytest.fixture(scope="session")
def none(docs):
    return docs([])


@pytest.fixture(scope="session")
def corpus():
    """Random prose with exact copies, near copies, shared passages and repeated lines."""
    import random

    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, texts = prose(60), []
    for k in range(120):
        text = prose(rng.randint(0, 160))
        if k % 9 == 0:
            text = text + "\n" + passage + "\n" + prose(20)
        texts.append(text)
    for k in range(0, 60, 3):
        w = texts[k].split(" ")
        for _ in range(max(1, len(w) // 60)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    texts += [texts[5].replace(" ", "  "), texts[7], texts[7], texts[8] + " "]
    texts += ["spam line here\n" * 30, "same same " * 100, "p" * 700]
    return texts


EXTRA = (None, None, None, "x", "k", "y", "d", "r", "w", "dot")


@pytest.fixture(scope="session")
def untouched():
    """Whether all columns but id and text came through as they were."""
    return lambda rows: all(tuple(r)[2:] == EXTRA for r in rows)
