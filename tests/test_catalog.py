"""Every query against its SQL equivalent on the small tables."""

import math
import os

import duckdb
import pytest

from strandset.plans.catalog import ORACLE_SQL, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF_DIR}/{t}.parquet'")
    return c


def normal(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def close(a, b):
    return len(a) == len(b) and all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and math.isclose(x, y, rel_tol=1e-6, abs_tol=2e-5)) for x, y in zip(a, b))


KIND = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    got = df.collect()
    if name not in ORACLE_SQL:
        assert got
        return
    cur = con.execute(ORACLE_SQL[name])
    columns, kinds = [c[0] for c in cur.description], {c[0]: str(c[1]) for c in cur.description}
    assert sorted(columns) == sorted(df.columns)
    assert {c: KIND[k] for c, k in df.dtypes} == kinds
    a, b = rows_of(df.columns, got), rows_of(columns, cur.fetchall())
    assert len(a) == len(b), (len(a), len(b), a[:3], b[:3])
    bad = [(x, y) for x, y in zip(a, b) if not close(x, y)]
    assert not bad, bad[:5]
