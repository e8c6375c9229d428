"""Every registered query with SQL gives the SQL's rows on the small tables."""

import math

import duckdb
import pytest

from tessella.plans import collections as _collections, details as _details, ingest as _ingest, kinds as _kinds, mosaics as _mosaics, payloads as _payloads, profiles as _profiles, records as _records, slides as _slides, streams as _streams  # noqa: F401  register their queries
from tessella.plans.queries import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return con


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.7g}" if isinstance(v, float) else str(v)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return [*frame.columns], sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = QUERIES[name](spark, DIR).toPandas()
    if name in SQL:
        assert rows(found) == rows(duck.execute(SQL[name]).df())
    else:
        assert len(found)
