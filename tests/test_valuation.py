import dataclasses
import datetime as dt

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plotscope.operators import comp_cells, comp_index
from plotscope.operators import index as I
from plotscope.operators import valuation as V
from plotscope.params import AS_OF_SETTINGS, SINGLE_ROLL_SETTINGS
from plotscope.storage import materialize

D = dt.date(2000, 1, 1)
SUBJECT = "as_of date, parcel_id string, nbrhd_cd string, living_area double, year_built double, just_value double"


def subjects(spark, data):
    return spark.createDataFrame([(D, *r) for r in data], SUBJECT)


def pool(spark, data):
    return spark.createDataFrame([(D, *r) for r in data], SUBJECT + ", psf double")


# -- brute force, straight from the definitions -------------------------------------------


def _trim(v):
    if len(v) == 0:
        return v
    q1, q3 = np.percentile(v, [25, 75])
    return v if q3 - q1 <= 0 else v[(v >= q1 - 1.5 * (q3 - q1)) & (v <= q3 + 1.5 * (q3 - q1))]


def _spread(v):
    if len(v) < 2 or np.median(v) == 0:
        return np.inf
    q1, q3 = np.percentile(v, [25, 75])
    return (q3 - q1) / np.median(v)


def brute(subject_rows, comp_rows, band=True):
    comps = pd.DataFrame(comp_rows, columns=["pid", "nb", "area", "yb", "jv", "psf"]).astype({"jv": float})
    out = {}
    for pid, nb, area, yb, jv in subject_rows:
        near = comps[comps.nb == nb]
        base = near[
            near.area.between(area * 0.8, area * 1.2) & near.yb.between(yb - 15, yb + 15) & (near.pid != pid)
        ]
        chosen, banded = _trim(base.psf.to_numpy()), False
        if band and len(near) >= 15:
            cuts = np.nanpercentile(near.jv, [33.3, 66.7])
            mine = np.digitize(np.nan if jv is None else jv, cuts)
            inside = _trim(base.psf.to_numpy()[np.digitize(base.jv, cuts) == mine])
            if len(inside) >= 5 and _spread(inside) < _spread(chosen):
                chosen, banded = inside, True
        if len(chosen) < 5:
            out[pid] = (None, len(chosen), None, False, False)
            continue
        med = np.median(chosen)
        q1, q3 = np.percentile(chosen, [25, 75])
        disp = round((q3 - q1) / med * 100, 1)
        out[pid] = (round(med * area, 0), len(chosen), disp, banded, len(chosen) >= 8 and disp <= 30.0)
    return out


def as_dict(df):
    return {
        r.parcel_id: (r.arv_estimate, r.arv_comp_count, r.arv_dispersion_pct, r.used_value_band, r.high_confidence)
        for r in df.collect()
    }


@pytest.fixture(scope="module")
def random_case():
    rng = np.random.default_rng(11)

    def parcel(i):
        jv = None if i % 17 == 0 else float(rng.integers(50, 90) * 1000)
        return (
            f"p{i}", "hot" if i % 3 else f"n{i % 4}", float(rng.integers(45, 70) * 20), float(rng.integers(1950, 2000)), jv,
        )

    parcels = [parcel(i) for i in range(400)]
    sold = [parcels[i] for i in rng.integers(0, 300, 900)]
    comps = [(*p, float(np.round(rng.lognormal(4.6, 0.35), 2))) for p in sold]
    comps += [(*parcels[1], 100.0)] * 40  # one parcel sold again and again at one price
    return parcels, comps


def test_matches_brute_force(spark, random_case):
    parcels, comps = random_case
    expected = brute(parcels, comps)
    got = as_dict(V.estimate(subjects(spark, parcels), pool(spark, comps), AS_OF_SETTINGS))
    assert got == expected
    assert any(v[3] for v in expected.values()) and any(v[0] is None for v in expected.values())


@pytest.mark.parametrize("page, children, requests", [(60, 4, 2000), (7, 3, 25), (1, 64, 500), (10_000, 2, 11)])
def test_pages_levels_and_blocks_change_nothing(spark, random_case, page, children, requests):
    parcels, comps = random_case
    small = dataclasses.replace(
        AS_OF_SETTINGS, task_comps=100, page_comps=page, fan_out=children, max_block_lookups=requests
    )
    assert as_dict(V.estimate(subjects(spark, parcels), pool(spark, comps), small)) == brute(parcels, comps)


def test_without_band(spark, random_case):
    parcels, comps = random_case
    expected = brute(parcels, comps, band=False)
    for most in (200_000, 50):
        settings = dataclasses.replace(SINGLE_ROLL_SETTINGS, task_comps=most, page_comps=50)
        assert as_dict(V.estimate(subjects(spark, parcels), pool(spark, comps), settings)) == expected


# -- one rule at a time, each in a neighbourhood of its own --------------------------------------


def same(n, psf=100.0, **change):
    base = {"pid": "c", "nb": None, "area": 1000.0, "yb": 1980.0, "jv": 1.0} | change
    return [(f"{base['pid']}{i}", base["nb"], base["area"], base["yb"], base["jv"], psf) for i in range(n)]


def spread_out(values):
    return [c for i, v in enumerate(values) for c in same(1, float(v), pid=f"v{i}")]


BOUNDS = {
    "area x0.8": ({"area": 800.0}, 6), "area below": ({"area": 799.0}, 5), "area x1.2": ({"area": 1200.0}, 6),
    "area above": ({"area": 1201.0}, 5), "year -15": ({"yb": 1965.0}, 6), "year +15": ({"yb": 1995.0}, 6),
    "year before": ({"yb": 1964.0}, 5), "year after": ({"yb": 1996.0}, 5), "elsewhere": ({"nb": "other"}, 5),
}
BAND = {"band": (5, 0, 15, True), "thin band": (4, 1, 15, False), "small pool": (5, 0, 14, False)}


def _band_case(near, far, pool_size):
    """The own tercile needs 5 matching comps and the neighbourhood 15 in all."""
    mine = same(near, 100.0, pid="m", jv=1.0) + same(far, 100.0, pid="far", jv=1.0, area=5000.0)
    return mine + [c for i in range(pool_size - 5) for c in same(1, 60.0 + 10 * i, pid=f"w{i}", jv=50.0 + i)]


CASES = {name: same(5) + same(1, pid="x", **change) for name, (change, _) in BOUNDS.items()}
CASES |= {name: _band_case(*case[:3]) for name, case in BAND.items()}
CASES |= {
    "own sale": same(5) + [("own sale", None, 1000.0, 1980.0, 1.0, 100.0)],
    "four": same(4),
    "seven": same(7),
    "eight": same(8),
    "no trim": same(8) + same(1, 900.0, pid="x"),  # the quartiles coincide
    "outlier": spread_out([90, 95, 100, 105, 110]) + same(1, 900.0, pid="x"),
    "on the fence": spread_out([100, 100, 100, 110, 110, 125]),  # quartiles 100 and 110, so the fence is 125
    "equal dispersion": same(10, jv=1.0) + same(10, pid="d", jv=9.0),
    "no year": same(5) + same(1, pid="x", yb=None),
}


@pytest.fixture(scope="module")
def ruled(spark):
    asked = [(name, name, 1000.0, 1980.0, 1.0) for name in CASES] + [("nowhere", None, 1000.0, 1980.0, 1.0)]
    comps = [(f"{name}:{c[0]}" if c[0] != name else c[0], c[1] or name, *c[2:]) for name, v in CASES.items() for c in v]
    comps += [(f"n{i}", None, 1000.0, 1980.0, 1.0, 100.0) for i in range(9)]
    got = V.estimate(subjects(spark, asked), pool(spark, comps), AS_OF_SETTINGS)
    return {r.parcel_id: r for r in got.collect()}


def test_matching_bounds(ruled):
    assert {name: ruled[name].arv_comp_count for name in BOUNDS} == {name: n for name, (_, n) in BOUNDS.items()}


def test_own_sale_is_no_comp(ruled):
    assert ruled["own sale"].arv_comp_count == 5 and ruled["no year"].arv_comp_count == 5


def test_null_neighbourhood_has_no_comps(ruled):
    assert (ruled["nowhere"].arv_comp_count, ruled["nowhere"].arv_estimate) == (0, None)


def test_minimum_count_is_still_reported(ruled):
    got = ruled["four"]
    assert (got.arv_estimate, got.arv_comp_count, got.high_confidence) == (None, 4, False)


def test_trim(ruled):
    assert [ruled[c].arv_comp_count for c in ("no trim", "outlier", "on the fence")] == [9, 5, 6]


def test_band_gate(ruled):
    assert {name: ruled[name].used_value_band for name in BAND} == {name: case[3] for name, case in BAND.items()}
    assert ruled["equal dispersion"].used_value_band is False


def test_confidence_gate(ruled):
    assert [ruled[c].high_confidence for c in ("seven", "eight")] == [False, True]


# -- index and windows ----------------------------------------------------------------------------


def events(spark, data):
    """(parcel, sale month, price per square foot)"""
    rows = [(p, d, d.year, 1000.0 * v, "n", 1000.0, 1980.0, 1.0, float(v)) for p, d, v in data]
    return spark.createDataFrame(
        rows,
        "parcel_id string, sale_date date, sale_year int, price double, nbrhd_cd string, living_area double,"
        " year_built double, just_value double, price_per_sqft double",
    )


HISTORY = [
    ("a", dt.date(1997, 3, 1), 80), ("b", dt.date(1997, 9, 1), 100), ("c", dt.date(1998, 5, 1), 120),
    ("d", dt.date(1999, 2, 1), 150), ("e", dt.date(1999, 11, 1), 170),
]


def anchors(spark, as_of, data=HISTORY):
    df = I.index_asof(events(spark, data), [as_of]).orderBy("anchor_date")
    return [(r.anchor_date, r.level) for r in df.collect()]


def test_anchors(spark):
    full = [(dt.date(1997, 7, 1), 90.0), (dt.date(1998, 7, 1), 120.0)]
    assert anchors(spark, dt.date(1999, 1, 1)) == full
    assert anchors(spark, dt.date(1999, 6, 15)) == full + [(dt.date(1999, 6, 14), 150.0)]
    assert anchors(spark, dt.date(1999, 1, 15)) == full  # no sale yet in the running year


def test_many_dates_equal_single_dates(spark):
    dates = [dt.date(1999, 1, 1), dt.date(1999, 6, 15), dt.date(2000, 1, 1)]
    df = I.index_asof(events(spark, HISTORY), dates)
    for d in dates:
        together = sorted((r.anchor_date, r.level) for r in df.filter(F.col("as_of") == F.lit(d)).collect())
        assert together == anchors(spark, d)


def test_level_is_linear_and_flat_outside(spark):
    df = I.anchor_arrays(I.index_asof(events(spark, HISTORY), [dt.date(1999, 1, 1)]))
    days = [dt.date(1995, 1, 1), dt.date(1997, 7, 1), dt.date(1998, 1, 1), dt.date(1998, 7, 1), dt.date(1999, 1, 1)]
    got = df.select(*[I.level_at(F.col("anchors"), F.lit(d)).alias(str(d)) for d in days]).first()
    assert list(got) == pytest.approx([90.0, 90.0, 90 + 30 * 184 / 365, 120.0, 120.0])


def test_no_sale_before_the_date_is_an_error(spark):
    with pytest.raises(PySparkException, match="no eligible sales before"):
        V.comp_pool(events(spark, HISTORY), [dt.date(1990, 1, 1)]).collect()
    with pytest.raises(PySparkException, match="no eligible sales before"):
        I.month_levels(I.index_asof(events(spark, HISTORY), [dt.date(1990, 1, 1)]), [dt.date(1990, 1, 1)], 36).collect()


def test_window_is_half_open(spark):
    data = [("in", dt.date(1997, 1, 1), 1), ("out", dt.date(1996, 12, 1), 1), ("last", dt.date(1999, 12, 1), 1)]
    data += [("late", dt.date(2000, 1, 1), 1)]
    got = {r.parcel_id for r in V.comp_pool(events(spark, data), [dt.date(2000, 1, 1)]).collect()}
    assert got == {"in", "last"}


# -- plans ----------------------------------------------------------------------------------------


def test_no_pairs_are_joined(spark, random_case):
    parcels, comps = random_case
    df = V.estimate(subjects(spark, parcels), pool(spark, comps), AS_OF_SETTINGS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "SinglePartition" not in plan
    assert "FlatMapCoGroupsInArrow" in plan


def test_result_is_the_same_without_broadcasts(spark, random_case):
    parcels, comps = random_case
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        got = as_dict(V.estimate(subjects(spark, parcels), pool(spark, comps), AS_OF_SETTINGS))
    finally:
        spark.conf.set(key, before)
    assert got == brute(parcels, comps)


# -- what a block of lookups costs ----------------------------------------------------------------


def test_copies_are_one_point_and_lookups_of_one_rectangle_one_block(spark):
    sold = pool(spark, same(2000, 100.0, nb="n") + same(500, 120.0, pid="d", nb="n")).withColumn("tercile", F.lit(0))
    points = materialize(comp_index.points_of(sold))
    assert sorted(r.w for r in points.collect()) == [500, 2000]
    asked = sold.select("as_of", "nbrhd_cd", "living_area", "year_built", "tercile", F.col("parcel_id").alias("excluded"))

    def sizes(left, right):
        return pa.table({"asked": [left.num_rows], "offered": [right.num_rows]})

    blocks = comp_index._rectangle_blocks(materialize(asked.distinct()), points, 1000).applyInArrow(sizes, "asked bigint, offered bigint")
    assert [tuple(r) for r in blocks.collect()] == [(2500, 2)]


def test_own_sales_are_brought_together_once(spark):
    sold = pool(spark, same(3, 100.0, nb="n", pid="a") + same(1, 90.0, nb="n", pid="a")).withColumn("tercile", F.lit(0))
    lists = comp_index.own_sales(sold)
    assert lists._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    found = {r.excluded: sorted((s.psf, s.w) for s in r.own) for r in lists.collect()}
    assert len(found) == sold.select("parcel_id").distinct().count()
    assert sum(w for own in found.values() for _, w in own) == 4


def test_own_sales_at_one_price_in_two_areas(spark):
    sold = [("p", "n", area, 1980.0, 1.0, 50.0) for area in (1000.0, 1000.0, 1100.0)]
    others = [c for i in range(9) for c in same(1, 40.0 + 5 * (i // 2), nb="n", pid=f"o{i}")]
    parcels = [("p", "n", 1000.0, 1980.0, 1.0), ("q", "n", 1000.0, 1980.0, 1.0)]
    got = as_dict(V.estimate(subjects(spark, parcels), pool(spark, sold + others), AS_OF_SETTINGS))
    assert got == brute(parcels, sold + others)


@pytest.mark.parametrize("page, children", [(2, 4), (1, 2)])
def test_equal_prices_through_an_index_with_empty_children(spark, page, children):
    sold = same(9, 100.0, nb="n") + [c for i in range(3) for c in same(1, 50.0 + i, nb="n", pid=f"far{i}", area=9000.0)]
    parcels = [("q", "n", 1000.0, 1980.0, 1.0), *((f"c{i}", "n", 1000.0, 1980.0, 1.0) for i in range(3))]
    settings = dataclasses.replace(AS_OF_SETTINGS, task_comps=1, page_comps=page, fan_out=children)
    got = as_dict(V.estimate(subjects(spark, parcels), pool(spark, sold), settings))
    assert got == brute(parcels, sold) and got["q"][1] == 9 and got["c0"][1] == 8


def test_lookups_of_one_rectangle_are_asked_once_through_the_index(spark, monkeypatch):
    rng = np.random.default_rng(5)
    parcels = [(f"p{i}", "n", 1000.0 + 100 * (i % 2), 1980.0, float(50 + i % 30)) for i in range(300)]
    sold = [(*parcels[i], float(np.round(rng.lognormal(4.6, 0.35), 1))) for i in rng.integers(0, 300, 1200)]
    sold += [(*parcels[7], 90.0)] * 70  # too many own sales to share
    asked = []

    def at_root(self, requests, *more, before=comp_index.PriceIndex.at_root):
        asked.append(requests.count())
        return before(self, requests, *more)

    monkeypatch.setattr(comp_index.PriceIndex, "at_root", at_root)
    settings = dataclasses.replace(AS_OF_SETTINGS, task_comps=10, page_comps=40)
    got = as_dict(V.estimate(subjects(spark, parcels), pool(spark, sold), settings))
    assert got == brute(parcels, sold)
    assert sum(asked) <= 2 * 4 + 2  # areas by bands, and the one parcel's own


def test_spans_that_own_sales_cut_into():
    """Every place of every rectangle, less own sales that lie before, at both ends of, in and after its span."""
    prices = np.array([1.0, 2, 2, 2, 3, 3, 4, 5, 5, 6, 7, 8])
    for own in ([1.0, 2.0], [2.0, 2.0, 2.0], [3.0, 5.0], [7.0, 8.0], [2.0, 3.0, 8.0], []):
        own = np.array(own)
        left = list(prices)
        for x in own:
            left.remove(x)
        for at in range(len(left)):
            begin, end = at, min(at + 1 + len(own), len(prices) - 1)
            piece = {"pos": [begin], "psf": [prices[begin : end + 1]], "w": [[1] * (end + 1 - begin)]}
            span = comp_cells.Spans(pa.table(piece), np.array([0]), 1)
            row = np.zeros(len(own), int)
            free = span.below(row, own, "left") - own.searchsorted(own, "left")
            assert span.price(np.array([0]), np.array([at + (free <= at).sum()]))[0] == left[at]
