import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotscope.operators.order_stats import average_rank, cut_points, exact_quantiles, with_row_numbers

PROBS = {"p05": 0.05, "q1": 0.25, "t1": 33.3 / 100, "med": 0.5, "t2": 66.7 / 100, "q3": 0.75}
PATHS = [dict(few_groups=True), dict(few_groups=False)]


@pytest.fixture(scope="module")
def data(spark):
    """A hot group, a hot value inside it, negatives, tiny values, nulls, tiny groups."""
    rng = np.random.default_rng(7)
    hot = np.where(rng.random(6000) < 0.6, 100.0, rng.normal(0, 5e5, 6000).round(2))
    parts = [
        pd.DataFrame({"g": "hot", "v": hot}),
        pd.DataFrame({"g": "small", "v": rng.random(501) / 1e4}),
        pd.DataFrame({"g": "ints", "v": rng.integers(-3, 4, 200).astype(float)}),
        pd.DataFrame({"g": "one", "v": [3.5]}),
        pd.DataFrame({"g": "two", "v": [1.0, 2.0]}),
        pd.DataFrame({"g": "flat", "v": [7.0] * 9}),
        pd.DataFrame({"g": "null", "v": [np.nan] * 3}),
        pd.DataFrame({"g": "ints", "v": [np.nan] * 5}),
    ]
    pdf = pd.concat(parts, ignore_index=True)
    pdf["id"] = np.arange(len(pdf))
    df = spark.createDataFrame(pdf).withColumn("v", F.nanvl("v", F.lit(None).cast("double"))).repartition(7)
    return pdf, df.cache()


@pytest.mark.parametrize("path", PATHS)
def test_quantiles_match_numpy(data, path):
    pdf, df = data
    got = exact_quantiles(df, ["g"], "v", PROBS, **path).toPandas().set_index("g")
    assert "null" not in got.index
    for g, part in pdf.dropna(subset=["v"]).groupby("g"):
        assert got.loc[g, "n"] == len(part)
        for name, p in PROBS.items():
            expected = np.median(part["v"]) if p == 0.5 else np.percentile(part["v"], p * 100)
            if p in (0.05, 0.25, 0.75, 0.5):
                assert got.loc[g, name] == expected, (g, name)
            else:
                assert got.loc[g, name] == pytest.approx(expected, rel=1e-12, abs=1e-12)


def test_average_rank_matches_pandas(data):
    pdf, df = data
    got = average_rank(df, ["g"], "v", "r", "n").toPandas().set_index("id").sort_index()
    expected = pdf.groupby("g")["v"].rank(method="average")
    pd.testing.assert_series_equal(got["r"], expected, check_names=False, check_index_type=False)


def test_percent_rank_of_ties(spark):
    from plotscope.operators.order_stats import percent_rank_average

    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", None)], "g string, v double")
    got = percent_rank_average(df, ["g"], "v", "pr").select("v", "pr").collect()
    assert sorted(r.pr for r in got if r.v is not None) == [50.0, 50.0, 100.0]
    assert [r.pr for r in got if r.v is None] == [None]


def test_cut_points_match_a_full_sort(data, spark):
    pdf, df = data
    ties = df.withColumn("t", F.xxhash64("id")).cache()
    positions = {"top": "n div 10 - 1", "bottom": "n - n div 2"}
    cuts = {r.g: r for r in cut_points(ties, ["g"], "v", "t", positions).collect()}
    local = ties.dropna().toPandas()
    for g, part in local.groupby("g"):
        n = len(part)
        part = part.sort_values(["v", "t"], ascending=[False, True]).reset_index(drop=True)
        if n // 10 >= 1:
            edge = part.loc[n // 10 - 1]
            assert (cuts[g].top_value, cuts[g].top_tie) == (edge.v, edge.t)
            assert cuts[g].top_weight == (part.v == edge.v).sum()
        if n >= 2:
            edge = part.loc[n - n // 2]
            assert (cuts[g].bottom_value, cuts[g].bottom_tie) == (edge.v, edge.t)


def test_no_whole_group_window(data):
    """Ordered windows are only over bins of a group, or over values inside one bin."""
    _, df = data
    plan = exact_quantiles(df, ["g"], "v", PROBS)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_row_numbers_over_ranges(spark):
    rng = np.random.default_rng(3)
    rows = [(float(v), i) for i, v in enumerate(rng.integers(0, 20, 3000))]
    df = spark.createDataFrame(rows, "v double, id int").repartition(5)
    got = with_row_numbers(df, [F.col("v").desc(), F.col("id")]).collect()
    want = sorted(rows, key=lambda r: (-r[0], r[1]))
    assert sorted((r["rank"], r.v, r.id) for r in got) == [(i, *r) for i, r in enumerate(want, 1)]
    assert with_row_numbers(df.limit(0), [F.col("v")]).count() == 0


def test_a_heavy_value_stays_spread(spark):
    """Nine tenths of the rows hold one value: with no adaptive splitting, no partition of the
    join gets more than its share."""
    n = 20_000
    df = spark.range(n).selectExpr("'g' AS g", "CASE WHEN id % 10 < 9 THEN 1D WHEN id % 100 = 9 THEN NULL ELSE id * 1D END AS v", "id")
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, x in settings.items():
        spark.conf.set(k, x)
    try:
        ranked = average_rank(df, ["g"], "v", "r", "n")
        sizes = [r[0] for r in ranked.groupBy(F.spark_partition_id()).count().select("count").collect()]
        got = {r.id: (r.r, r.n) for r in ranked.collect()}
    finally:
        for k, x in before.items():
            spark.conf.set(k, x)
    assert len(got) == n and max(sizes) < 2 * n / 8
    assert got[0] == (9000.5, 18000 + 1800) and got[9] == (None, None) and got[19] == (18001.0, 19800)
