import duckdb
import pytest

from vecloom.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = ("embeddings", "documents", "labels", "events")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, sql, name):
    got = QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr)
    if name not in ORACLES:
        assert rows
        return
    want = sql.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == columns
    assert rows == sorted((tuple(r[names.index(c)] for c in columns) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
