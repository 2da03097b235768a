"""Every core query with a DuckDB statement gives the same rows on the smallest tables."""

import datetime
import decimal

import duckdb
import pytest

from lakeloom import catalog

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)):
        return str([plain(x) for x in v])
    if isinstance(v, (float, decimal.Decimal)):
        return repr(float(v) + 0.0)
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows(spark, db, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    ours = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    q = db.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in q.description]
    order = [names.index(c) for c in sorted(names)]
    theirs = sorted(tuple(plain(r[i]) for i in order) for r in q.fetchall())
    assert sorted(names) == cols
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, FOLDER).count() >= 0
