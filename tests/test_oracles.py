"""Every registered query against its SQL twin on the smallest tables."""

import duckdb
import pytest

from catalog.oracles import ORACLES
from catalog.queries import QUERIES
from tools.check_oracles import TABLES, compare


@pytest.fixture(scope="module")
def duck(tiny):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tiny}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, tiny, name):
    assert compare(spark, duck, name, tiny).startswith("ok" if name in ORACLES else "rows only")


def test_flagship(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark)
    assert got.count() > 0 and "pct_spread" in got.columns


def test_every_twin_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
