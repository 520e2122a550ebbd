"""Each query against its SQL; those without SQL against plain versions elsewhere, and here that they run."""

from collections import Counter
from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest

from loomframe.plans import QUERIES, SQL
from loomframe.plans.views import TABLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (float, Decimal)):
        return round(float(x), 6) + 0.0
    if isinstance(x, datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, date):
        return x.isoformat()
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else x


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, con, name):
    got = QUERIES[name](spark, SF)
    cursor = con.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    assert sorted(columns) == sorted(got.columns)
    rows = [tuple(map(plain, r)) for r in got.select([f"`{c}`" for c in columns]).collect()]
    assert Counter(rows) == Counter(tuple(map(plain, r)) for r in want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
