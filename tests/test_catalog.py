import math
from pathlib import Path

import duckdb
import pytest

from keystrata.plans import catalog

DIR = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not DIR.exists(), reason="driver tables are not here")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for p in DIR.glob("*.parquet"):
        c.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return c


def _plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    num = lambda v: round(v, 9) if isinstance(v, float) and math.isfinite(v) else v
    return sorted((tuple(num(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = catalog.queries()[name](spark, str(DIR))
    want = db.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert _plain([tuple(r) for r in got.collect()], got.columns) == _plain(want.fetchall(), want.columns)


def test_rows_only(spark):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, str(DIR)).count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
