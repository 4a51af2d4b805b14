"""Every registered query of the catalog against its SQL, on the smallest tables."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).parents[1] / "tools"))
from compare import TABLES, canon  # noqa: E402

from weftline.plans import catalog  # noqa: E402

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DIR}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, name):
    got = catalog.QUERIES[name](spark, DIR).toPandas()
    assert len(got)
    if name in catalog.ORACLES:
        want = con.sql(catalog.ORACLES[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)
    else:
        assert canon(got) == canon(catalog.QUERIES[name](spark, DIR).toPandas())


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert catalog.QUERIES.keys() <= entry.queries().keys()
