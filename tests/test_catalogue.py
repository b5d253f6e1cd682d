"""Each catalogue query gives the rows of its SQL on the smallest tables."""

import os

import pytest

from tidemark.plans import catalogue, readers

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def ordered(rows):
    return sorted([tuple(r) for r in rows], key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", list(readers.ORACLE_SQL))
def test_query_matches_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    sql = catalogue.ORACLE_SQL[name]
    assert columns == sorted(duck.sql(sql).columns)
    listed = ", ".join(f'"{c}"' for c in columns)
    assert ordered(df.select(*columns).collect()) == ordered(duck.sql(f"select {listed} from ({sql})").fetchall())


def test_entry_has_all_queries():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_selectors_of_pages(spark):
    rows = catalogue.QUERIES["selector_candidates"](spark, SF).collect()
    assert rows and all(r.links >= 3 for r in rows) and all(" a" in r.selector for r in rows)


def test_digest_views(spark):
    """Marks are those of the fitted message; a digest built again with less room takes marks back."""
    rows = catalogue.QUERIES["digest_marks_after_fit"](spark, SF).collect()
    assert rows and all(r.in_message for r in rows) and {r.n_entries for r in rows} == {len(rows)} and rows[0].omitted > 0
    both = catalogue.QUERIES["digest_forced_rebuild"](spark, SF).collect()
    assert sum(r.after for r in both) < sum(r.before for r in both) and all(r.before or r.after for r in both)
