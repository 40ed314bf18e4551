"""Every registered query of the library against DuckDB on the smallest tables."""

import duckdb
import pytest

from arcloom.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(v):
    if v is None:
        return "null"
    return repr(v + 0.0) if isinstance(v, float) else str(int(v) if isinstance(v, bool) else v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows(name, spark, sf, con):
    df = catalog.QUERIES[name](spark, sf)
    r = con.execute(catalog.ORACLES[name])
    columns = [d[0] for d in r.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    ours = sorted(tuple(plain(x[c]) for c in order) for x in df.collect())
    theirs = sorted(tuple(plain(x[columns.index(c)]) for c in order) for x in r.fetchall())
    assert ours == theirs
