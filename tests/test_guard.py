import datetime as dt

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plotscope.operators.guard import LookaheadError, assert_no_lookahead, guarded

D = dt.date(2000, 1, 1)


def sales(spark, *dates):
    return spark.createDataFrame([(f"p{i}", d, D) for i, d in enumerate(dates)], "parcel_id string, sale_date date, as_of date")


def test_earlier_and_unknown_dates_pass(spark):
    df = sales(spark, dt.date(1999, 12, 1), None)
    assert_no_lookahead(df, D)
    assert guarded(df).count() == 2


def test_a_row_on_the_date_is_named(spark):
    with pytest.raises(LookaheadError, match=r"1 row.*p1"):
        assert_no_lookahead(sales(spark, dt.date(1999, 12, 1), D), D)
    with pytest.raises(PySparkException, match="look-ahead"):
        guarded(sales(spark, D)).collect()


def test_missing_column(spark):
    df = sales(spark, None).drop("sale_date")
    with pytest.raises(LookaheadError):
        assert_no_lookahead(df, D)
    with pytest.raises(LookaheadError):
        guarded(df)


def test_fires_on_leaky_pool(spark, tiny):
    """A pool that reaches a month past the date must not get through."""
    from catalog import adapters

    pool = adapters.history(spark, tiny).filter(F.col("sale_date") <= F.add_months(F.lit(D), 1))
    with pytest.raises(LookaheadError):
        assert_no_lookahead(pool, D)
