import datetime as dt

from pyspark.sql import functions as F

from catalog import adapters
from plotscope.operators import index as I
from plotscope.operators.valuation import EVENT_COLUMNS, comp_events
from plotscope.plans import backtest, leakage
from plotscope.plans.leakage import _difference

D = dt.date(2000, 1, 1)


def test_deleting_the_future_changes_nothing(spark, tiny):
    report = leakage.invariance(adapters.history(spark, tiny), adapters.snapshots(spark, tiny), D)
    assert {r.compared: r.different for r in report.collect()} == {"index": 0, "valuation": 0, "signals": 0}


def test_the_leaky_index_would_be_caught(spark, tiny):
    events = comp_events(adapters.history(spark, tiny), adapters.snapshots(spark, tiny))
    past = events.filter(F.col("sale_date") < F.lit(D))
    assert _difference(I.leaky_index(events, [D]), I.leaky_index(past, [D])).count() > 0


def test_fixed_level_is_last_years_median(spark, tiny):
    events = comp_events(adapters.history(spark, tiny), adapters.snapshots(spark, tiny))
    got = I.compare_index_levels(events, adapters.AS_OF_DATES).collect()
    assert len(got) == 2 and all(r.equals_prior_median for r in got)


def test_sample_is_exact_and_repeatable(spark, tiny):
    df = adapters.snapshots(spark, tiny).filter("vintage_year = 1999")
    one = leakage.seeded_sample(df, 40)
    other = leakage.seeded_sample(df.repartition(5), 40)
    assert one.count() == 40 and _difference(one, other).count() == 0


def test_only_what_a_valuation_reads_of_the_events_is_written(spark, tiny, monkeypatch):
    written = []
    monkeypatch.setattr(backtest, "materialize", lambda df: written.append(df.columns) or df)
    monkeypatch.setattr(backtest, "value_as_of", lambda subjects, *_: subjects.select("as_of", "parcel_id").withColumns(
        {"arv_estimate": F.lit(1.0)}
    ))
    backtest.valued_subjects(adapters.history(spark, tiny), adapters.snapshots(spark, tiny), adapters.AS_OF_DATES)
    assert written == [EVENT_COLUMNS]
