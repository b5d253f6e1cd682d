import os
import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
def test_stages_follow_one_another(spark):
    import corpus_pipeline as cp
    from tidemark.llm import exact_dedup, near_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, labels = docs.columns, {r.doc_id: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    out = {}
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        docs = spark.createDataFrame(docs.collect(), docs.schema)
        out[name] = [r.doc_id for r in docs.collect()]
        assert out[name]
    assert not [i for i in out["quality"] if i in labels and labels[i].quality == 0 and labels[i].toxic == 0]
    kept = spark.createDataFrame([(i,) for i in out["exact_dedup"]], "doc_id long").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    assert exact_dedup.exact_dedup(kept).where("not kept").count() == 0
    kept = spark.createDataFrame([(i,) for i in out["near_dedup"]], "doc_id long").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    assert near_dedup.near_duplicates(kept).where("not kept").count() == 0
    clean = {i for i in out["near_dedup"] if i in labels and labels[i].quality == 1 and labels[i].toxic == 0}
    assert len(clean - set(out["mixing"])) <= 0.02 * len(clean)
    assert cp.run(spark, SF).where("length > 0").count() > 0


def test_odd_tables(spark, tmp_path):
    """Nulls, empty texts, repeated rows, contradicting labels and an empty table run through all stages."""
    import corpus_pipeline as cp

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rng = random.Random(5)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(120)) + "."
    good, other = prose(), prose()
    near = good.replace(good.split(" ")[60], "changed")
    rows = [(0, None), (1, ""), (2, good), (2, good), (3, good), (4, near), (None, good), (5, "word " * 400), (6, other), (7, " \n ")]
    for name, docs in (("odd", rows), ("none", [])):
        folder = str(tmp_path / name)
        spark.createDataFrame([(i, t, None, "s", None) for i, t in docs], schema).write.parquet(f"{folder}/documents.parquet")
        labels = [(2, 1, 0), (2, 1, 1), (5, 0, 0), (6, 1, 0), (None, 1, 1), (99, 1, 0)] if docs else []
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        left = spark.read.parquet(f"{folder}/documents.parquet")
        for _, stage in cp.STAGES[:2]:
            left = spark.createDataFrame(stage(spark, left, folder).collect(), schema)
        # of equal texts the row of the smallest id stays, once; texts of too few or repeated words go
        assert sorted(r.doc_id for r in left.collect()) == ([2, 4, 6] if docs else [])
        out = cp.run(spark, folder).collect()
        assert {r.doc_id for r in out} <= ({2, 4, 6} if docs else set()) and bool(out) == bool(docs)


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    for n in range(1, 11):
        assert [q for q in names if q.startswith(f"op{n}_")]
    assert "pipeline" in names


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", ["op1_exact_dedup", "op2_substring_dedup", "op4_near_dedup"])
def test_query_matches_sql(spark, name):
    import duckdb

    from tidemark.llm.queries import ORACLE_SQL, QUERIES

    c = duckdb.connect()
    c.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
    df = QUERIES[name](spark, SF)
    want = sorted(c.sql(f"select {', '.join(df.columns)} from ({ORACLE_SQL[name]})").fetchall())
    assert sorted(tuple(r) for r in df.collect()) == want
