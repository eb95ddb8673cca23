"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from logfold.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr([None if v is None else round(float(v), 9) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_as_sql(spark, sf_dir, db, name):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    rows = df.select(*columns).collect()
    if name in ORACLES:
        cursor = db.execute(f"select {', '.join(chr(34) + c + chr(34) for c in columns)} from ({ORACLES[name]})")
        assert len(cursor.description) == len(columns)
        assert plain(rows) == plain(cursor.fetchall())


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries())
