"""Proof that no valuation or signal reads the future."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotscope.operators.accuracy import accuracy_by_band, valuation_errors
from plotscope.operators.index import index_asof
from plotscope.operators.parcels import subjects_as_of
from plotscope.operators.signals import owner_signals
from plotscope.operators.valuation import EVENT_COLUMNS, comp_events, value_as_of
from plotscope.params import AS_OF_SETTINGS, TIE_BREAK_SEED, ValuationSettings
from plotscope.storage import materialize

VERSIONS = {"leaky": "leaky (before)", "asof": "fixed (after)"}


def accuracy_before_after(
    sales: DataFrame,
    snapshots: DataFrame,
    as_of_dates: Sequence[dt.date],
    settings: ValuationSettings = AS_OF_SETTINGS,
) -> DataFrame:
    """Accuracy by date, index version and confidence band; only the index differs."""
    subjects = subjects_as_of(snapshots, as_of_dates)
    events = materialize(comp_events(sales, snapshots).select(*EVENT_COLUMNS))
    errors = None
    for strategy, label in VERSIONS.items():
        valued = value_as_of(subjects, events, as_of_dates, settings, strategy)
        part = valuation_errors(valued, sales, as_of_dates).withColumn("version", F.lit(label))
        errors = part if errors is None else errors.unionByName(part)
    return accuracy_by_band(materialize(errors))


def seeded_sample(subjects: DataFrame, n: int, seed: int = TIE_BREAK_SEED, draw: Column | None = None) -> DataFrame:
    """Exactly n rows, the same for any partitioning: the smallest draws, by default a seeded
    hash of the parcel."""
    draw = F.xxhash64("parcel_id", F.lit(seed)) if draw is None else draw
    return subjects.orderBy(draw, "parcel_id").limit(n)


def _difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows in one side only, with multiplicity. One shuffle; empty means identical."""
    columns = a.columns
    signed = a.withColumn("_s", F.lit(1)).unionByName(b.select(*columns).withColumn("_s", F.lit(-1)))
    return signed.groupBy(*columns).agg(F.sum("_s").alias("surplus")).filter("surplus <> 0")


def invariance(
    sales: DataFrame,
    snapshots: DataFrame,
    as_of: dt.date,
    settings: ValuationSettings = AS_OF_SETTINGS,
    sample: int | None = None,
) -> DataFrame:
    """Delete every sale dated on or after the date and compare index, valuations and
    signals. Returns what was compared and how many rows differ (0 when nothing reads
    the future). All subjects are compared unless a sample size is asked for."""
    subjects = subjects_as_of(snapshots, [as_of])
    if sample is not None:
        subjects = materialize(seeded_sample(subjects, sample))
    events = materialize(comp_events(sales, snapshots).select(*EVENT_COLUMNS))
    past_events, past_sales = (df.filter(F.col("sale_date") < F.lit(as_of)) for df in (events, sales))
    signal_columns = ["parcel_id", "absentee", "ownership_tenure_years", "equity_proxy"]
    pairs = {
        "index": (index_asof(events, [as_of]), index_asof(past_events, [as_of])),
        "valuation": (
            value_as_of(subjects, events, [as_of], settings),
            value_as_of(subjects, past_events, [as_of], settings),
        ),
        "signals": (
            owner_signals(subjects, sales, [as_of]).select(*signal_columns),
            owner_signals(subjects, past_sales, [as_of]).select(*signal_columns),
        ),
    }
    parts = [
        _difference(whole, past).agg(F.lit(name).alias("compared"), F.count("*").alias("different"))
        for name, (whole, past) in pairs.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])
