"""Back-test end to end: score all as-of dates, attach outcomes, evaluate."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotscope.operators.evaluation import evaluate, with_verdict
from plotscope.operators.parcels import subjects_as_of
from plotscope.operators.scoring import composite_score
from plotscope.operators.signals import attach_outcomes, owner_signals
from plotscope.operators.valuation import EVENT_COLUMNS, comp_events, value_as_of, with_spread
from plotscope.params import AS_OF_SETTINGS, OUTCOME_WINDOW_MONTHS, ValuationSettings
from plotscope.storage import materialize


def valued_subjects(
    sales: DataFrame,
    snapshots: DataFrame,
    as_of_dates: Sequence[dt.date],
    settings: ValuationSettings = AS_OF_SETTINGS,
    index: str = "asof",
) -> DataFrame:
    """Every subject of every date with its valuation and spread."""
    subjects = subjects_as_of(snapshots, as_of_dates)
    if index == "asof":  # no sale on or after the last date may be used, so none is read
        sales = sales.filter(F.col("sale_date") < F.lit(max(as_of_dates)))
    events = materialize(comp_events(sales, snapshots).select(*EVENT_COLUMNS))
    valued = value_as_of(subjects, events, as_of_dates, settings, index)
    return with_spread(subjects.join(valued, ["as_of", "parcel_id"], "left"))


def score_dates(
    sales: DataFrame,
    snapshots: DataFrame,
    as_of_dates: Sequence[dt.date],
    normalization: str = "minmax",
    window_months: int = OUTCOME_WINDOW_MONTHS,
    settings: ValuationSettings = AS_OF_SETTINGS,
) -> DataFrame:
    """Valuation, spread, owner signals, composite and outcomes of all dates at once.
    Scaling runs over all subjects of a date; populations are chosen afterwards."""
    valued = valued_subjects(sales, snapshots, as_of_dates, settings)
    signals = materialize(owner_signals(valued, sales, as_of_dates))
    scored = composite_score(signals, normalization)
    return attach_outcomes(scored, sales, snapshots, as_of_dates, window_months)


def run_backtest(
    sales: DataFrame,
    snapshots: DataFrame,
    as_of_dates: Sequence[dt.date],
    normalization: str = "minmax",
    tie: Column | None = None,
) -> DataFrame:
    """The evaluation table with p-values and the Bonferroni verdict."""
    scored = materialize(score_dates(sales, snapshots, as_of_dates, normalization))
    return with_verdict(evaluate(scored, tie))
