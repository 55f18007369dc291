import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from plotscope.functions.dates import month_start, months_apart
from plotscope.functions.scores import (
    clip, letter_grade, max_offer, min_max, round_half_even, tenure_years, two_proportion_z, two_sided_p, weighted_mean,
)
from plotscope.functions.text import (
    clean_text, is_absentee, is_out_of_state, normalize_address, recording_ref, to_number, zip5,
)


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")


def apply(spark, values, expression, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(expression).collect()]


def test_zip5(spark):
    got = apply(spark, [None, "", " 33101-1234", "123", "00000"], zip5(F.col("x")))
    assert got == ["00000", "00000", "33101", "00123", "00000"]


def test_address(spark):
    got = apply(spark, [" 12  Main St., #4 ", "# 5 A", None, "CALLÉ 8"], normalize_address(F.col("x")))
    assert got == ["12 MAIN ST 4", " 5 A", "", "CALLÉ 8"]


def test_numbers(spark):
    got = apply(spark, ["1.0d", "2f", "NaN", "1e5", "", " 12 ", None, "inf", "-.5"], to_number(F.col("x")))
    assert got == [None, None, None, 100000.0, None, 12.0, None, None, -0.5]


def test_clean_text(spark):
    assert apply(spark, [" a\t", "  ", "", None], clean_text(F.col("x"))) == ["a", None, None, None]


def test_absentee(spark):
    data = [
        (0, "1 A St", "1 a st.", "33101", "33101"), (1, "1 A St", "1 A St", "33102", "33101"),
        (2, "PO Box 1", "1 A St", "33101", "33101"), (3, "PO Box 1", "1 A St", "00000", "33101"),
    ]
    df = spark.createDataFrame(data, "i int, own string, situs string, mz string, sz string").orderBy("i")
    got = df.select(is_absentee(F.col("own"), F.col("situs"), F.col("mz"), F.col("sz"))).collect()
    assert [r[0] for r in got] == [False, True, True, False]


def test_out_of_state(spark):
    got = apply(spark, ["FL", " florida ", "NY", "", None], is_out_of_state(F.col("x"), ("FL", "FLORIDA")))
    assert got == [False, False, True, False, False]


def test_recording_ref(spark):
    data = [(0, "b", "p", "n"), (1, "b", None, "n"), (2, None, None, "n"), (3, None, None, None), (4, "", "p", "n")]
    df = spark.createDataFrame(data, "i int, b string, p string, c string").orderBy("i")
    got = [r[0] for r in df.select(recording_ref(F.col("b"), F.col("p"), F.col("c"))).collect()]
    assert got == ["b-p", "b-", "CLERK:n", None, "CLERK:n"]


def test_months(spark):
    null = apply(spark, [0, 13, None, 6], month_start(F.lit(2001), F.col("x")).cast("string"), "int")
    clipped = apply(spark, [0, 13, None, 6], month_start(F.lit(2001), F.col("x"), "clip").cast("string"), "int")
    assert null == [None, None, None, "2001-06-01"]
    assert clipped == ["2001-01-01", "2001-12-01", None, "2001-06-01"]
    with pytest.raises(ValueError):
        month_start(F.lit(2001), F.lit(1), "guess")


def test_months_apart(spark):
    got = spark.sql("select date'2001-03-01' a, date'1999-11-01' b").select(months_apart(F.col("a"), F.col("b")))
    assert got.first()[0] == 16


def test_grades(spark):
    got = apply(spark, [80.0, 79.99, 65.0, 50.0, 35.0, 34.99, None], letter_grade(F.col("x")), "double")
    assert got == ["A", "B", "B", "C", "D", "F", "N/A"]


def test_weighted_mean(spark):
    data = [(0, 100.0, 0.0), (1, 100.0, None), (2, None, None)]
    df = spark.createDataFrame(data, "i int, a double, b double").orderBy("i")
    assert [r[0] for r in df.select(weighted_mean({"a": 40, "b": 60})).collect()] == [40.0, 100.0, None]
    assert [r[0] for r in df.select(weighted_mean({"a": 0, "b": 0})).collect()] == [None, None, None]


def test_row_formulas(spark):
    assert apply(spark, [2.5, 3.5, -0.5], round_half_even(F.col("x")), "double") == [2.0, 4.0, 0.0]
    assert apply(spark, [30.04, 30.06], round_half_even(F.col("x"), 1), "double") == [30.0, 30.1]
    assert apply(spark, [None, -5.0, 5.0], clip(F.col("x"), F.lit(0.0), F.lit(1.0)), "double") == [None, 0.0, 1.0]
    assert apply(spark, [None, -3.0, 7.0, 120.0], tenure_years(F.col("x")), "double") == [100.0, 0.0, 7.0, 100.0]
    assert apply(spark, [5.0], min_max(F.col("x"), F.lit(5.0), F.lit(5.0)), "double") == [None]
    assert apply(spark, [100.0, 10.0, None], max_offer(F.col("x"), F.lit(20.0), 0.5), "double") == [30.0, 0.0, None]


def test_two_proportion(spark):
    data = [(0, 30, 100, 50, 400), (1, 0, 0, 5, 10), (2, 10, 10, 20, 20)]
    df = spark.createDataFrame(data, "i int, x1 long, n1 long, x2 long, n2 long")
    z = two_proportion_z(F.col("x1"), F.col("n1"), F.col("x2"), F.col("n2"))
    got = rows(df.select("i", z.alias("z")).withColumn("p", two_sided_p(F.col("z"))), "i")
    pooled = 80 / 500
    expected = (0.3 - 0.125) / math.sqrt(pooled * (1 - pooled) * (1 / 100 + 1 / 400))
    assert got[0][1] == pytest.approx(expected)
    assert got[0][2] == pytest.approx(math.erfc(expected / math.sqrt(2)))
    assert [r[1:] for r in got[1:]] == [(None, None), (None, None)]
