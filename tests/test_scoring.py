import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plotscope.operators import evaluation as E
from plotscope.operators import scoring as S
from plotscope.operators import signals as G

D = dt.date(2000, 1, 1)
SALES = (
    "parcel_id string, sale_date date, sale_year int, price double, recording_ref string, qual_code string,"
    " qualified boolean, comp_eligible boolean, dor_use_code string, source_year int"
)


def sale(pid, date, price, qualified=True, use="001", ref="r", eligible=None):
    eligible = qualified if eligible is None else eligible
    return (pid, date, date.year if date else None, price, ref, "01", qualified, eligible, use, 2000)


def test_last_price_may_be_older_than_last_sale(spark):
    rows = [sale("p", dt.date(1996, 1, 1), 100.0), sale("p", dt.date(1997, 1, 1), None), sale("p", D, 999.0)]
    rows += [sale("q", dt.date(1998, 1, 1), 5.0, qualified=False), sale("r", None, 7.0)]
    later = dt.date(2001, 1, 1)
    got = {(r.as_of, r.parcel_id): r for r in G.last_sales(spark.createDataFrame(rows, SALES), [D, later]).collect()}
    assert (got[D, "p"].last_sale_date, got[D, "p"].last_qual_price) == (dt.date(1997, 1, 1), 100.0)
    assert (got[later, "p"].last_sale_date, got[later, "p"].last_qual_price) == (D, 999.0)
    assert got[later, "q"].last_qual_price is None and (D, "r") not in got


def test_outcome_window_and_flags(spark):
    rows = [
        sale("in", D, 70.0), sale("end", dt.date(2002, 7, 1), 70.0), sale("other", D, 70.0, use="004"),
        sale("multi", D, 70.0, eligible=False), sale("early", dt.date(2000, 3, 1), 79.0, ref="b"),
        sale("early", dt.date(2000, 3, 1), 81.0, ref="a"),
    ]
    scored = spark.createDataFrame(
        [(D, p, 100.0) for p in ("in", "end", "other", "multi", "early")], "as_of date, parcel_id string, arv_estimate double"
    )
    snaps = spark.createDataFrame([("in", 1999, 75.0)], "parcel_id string, vintage_year int, just_value double")
    got = {r.parcel_id: r for r in G.attach_outcomes(scored, spark.createDataFrame(rows, SALES), snaps, [D]).collect()}
    assert (got["in"].sold_ce, got["in"].discounted, got["in"].below_jv) == (True, True, True)
    assert not got["end"].sold_q and not got["other"].sold_q
    assert (got["multi"].sold_ce, got["multi"].sold_q, got["multi"].has_jv_prior) == (False, True, False)
    assert (got["early"].ce_price, got["early"].discounted) == (81.0, False)  # ref "a" comes first


def frame(spark, n, seed=3):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(
        {
            "as_of": D,
            "parcel_id": [f"p{i}" for i in range(n)],
            "absentee": rng.random(n) < 0.3,
            "ownership_tenure_years": np.where(rng.random(n) < 0.6, 100.0, rng.random(n) * 5),
            "equity_proxy": np.where(rng.random(n) < 0.5, np.nan, rng.normal(0, 1e5, n)),
            "pct_spread": np.where(rng.random(n) < 0.1, np.nan, rng.normal(0.2, 0.2, n)),
        }
    )
    df = spark.createDataFrame(pdf)
    for c in ("equity_proxy", "pct_spread"):
        df = df.withColumn(c, F.nanvl(c, F.lit(None).cast("double")))
    return pdf, df.repartition(6)


def _minmax(s):
    return (s - s.min()) / (s.max() - s.min()) * 100


def reference_composite(pdf, rank):
    norm = (lambda s: s.rank(pct=True) * 100) if rank else _minmax
    equity = pdf.equity_proxy if rank else pdf.equity_proxy.clip(*pdf.equity_proxy.quantile([0.05, 0.95]))
    parts = np.column_stack(
        [pdf.absentee * 100.0, norm(pdf.ownership_tenure_years), norm(equity), norm(pdf.pct_spread)]
    )
    return np.nanmean(parts, axis=1)


@pytest.mark.parametrize("mode", ["minmax", "rank"])
def test_composite(spark, mode):
    pdf, df = frame(spark, 400)
    got = S.composite_score(df, mode).toPandas().set_index("parcel_id").loc[pdf.parcel_id]
    np.testing.assert_allclose(got.composite_score, reference_composite(pdf, mode == "rank"), rtol=1e-12)
    assert (got.equity_score.isna().to_numpy() == pdf.equity_proxy.isna().to_numpy()).all()


def test_constant_or_missing_component_is_left_out(spark):
    df = spark.createDataFrame(
        [("a", True, 5.0, None), ("b", False, 5.0, None)],
        "parcel_id string, absentee boolean, ownership_tenure_years double, equity_proxy double",
    )
    got = {r.parcel_id: r for r in S.motivation_score(df).collect()}
    assert (got["a"].tenure_score, got["a"].equity_proxy_score, got["a"].motivation_score) == (None, None, 100.0)
    assert (got["b"].motivation_score, got["b"].grade) == (0.0, "F")


def rank_frame(spark, n, seed=5):
    """Long rows of one cell with most values tied at one value."""
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame({"value": np.where(rng.random(n) < 0.7, 100.0, rng.random(n) * 100), "hit": rng.random(n) < 0.3})
    pdf = pdf.assign(as_of=D, population="u", outcome="o", signal="s", hit=pdf.hit.astype(int), tie=rng.permutation(n) * 977)
    return pdf, spark.createDataFrame(pdf).repartition(5)


@pytest.mark.parametrize("n, top, bottom", [(50, 5, 25), (109, 10, 54), (3000, 300, 1500)])
def test_rank_groups(spark, n, top, bottom):
    pdf, df = rank_frame(spark, n)
    got = E.evaluate_ranks(df).collect()
    order = pdf.sort_values(["value", "tie"], ascending=[False, True])
    hi, lo = order.head(n // 10), order.tail(n // 2)
    (r,) = got
    assert (r.n, r.hi_n, r.lo_n) == (n, top, bottom)
    assert r.hi_rate == pytest.approx(hi.hit.mean()) and r.lo_rate == pytest.approx(lo.hit.mean())
    assert r.boundary_tie_share == pytest.approx((pdf.value == hi.value.iloc[-1]).mean())


def test_too_few_rows_give_no_result(spark):
    _, df = rank_frame(spark, 49)
    assert E.evaluate_ranks(df).count() == 0


def test_rank_plan_never_sorts_a_cell(spark):
    _, df = rank_frame(spark, 200)
    plan = E.evaluate_ranks(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_both_outcomes_come_from_one_pass(spark):
    sales = spark.createDataFrame([sale("p", D, 1.0)], SALES)
    conditions = {"ce": F.col("comp_eligible"), "q": F.col("qualified")}
    plan = G.first_sales(sales, [D], 30, conditions)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") == 1 and plan.count("Exchange hashpartitioning") == 1
