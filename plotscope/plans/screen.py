"""The ranked acquisition screen."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotscope.operators.order_stats import with_row_numbers
from plotscope.operators.parcels import subjects_as_of
from plotscope.operators.scoring import motivation_score
from plotscope.operators.valuation import EVENT_COLUMNS, comp_events, value_as_of, with_spread
from plotscope.params import AS_OF_SETTINGS, MIN_DOLLAR_SPREAD, MOTIVATION_WEIGHTS, ValuationSettings
from plotscope.storage import materialize

# Display names of the screen and its export.
DISPLAY_NAMES = {
    "parcel_id": "Parcel ID",
    "situs_addr1": "Address",
    "situs_city": "City",
    "just_value": "Just Value",
    "arv_estimate": "ARV",
    "pct_spread": "% Spread",
    "spread_estimate": "Spread ($, 70% rule)",
    "arv_comp_count": "Comps",
    "arv_dispersion_pct": "Disp %",
    "high_confidence": "High Conf.",
    "absentee": "Absentee",
    "out_of_state": "Out-of-State",
    "ownership_tenure_years": "Tenure (yrs)",
    "grade": "Grade (not validated)",
}
SORT_COLUMNS = ("pct_spread", "spread_estimate")


def screen_base(
    parcels: DataFrame,
    sales: DataFrame,
    snapshots: DataFrame,
    as_of: dt.date,
    settings: ValuationSettings = AS_OF_SETTINGS,
) -> DataFrame:
    """Parcels with their valuation and spread. The spread uses the snapshot's just
    value; the equity proxy keeps the one it was built from."""
    subjects = subjects_as_of(snapshots, [as_of]).select(
        "as_of", "parcel_id", "nbrhd_cd", "living_area", "year_built", "just_value"
    )
    # No sale on or after the date may be used, so none is read.
    past = sales.filter(F.col("sale_date") < F.lit(as_of))
    events = materialize(comp_events(past, snapshots).select(*EVENT_COLUMNS))
    valued = value_as_of(subjects, events, [as_of], settings).drop("used_value_band")
    engine = subjects.select("as_of", "parcel_id", "just_value").join(valued, ["as_of", "parcel_id"], "left")
    engine = engine.withColumn("high_confidence", F.coalesce("high_confidence", F.lit(False)))
    return with_spread(parcels.drop("just_value").join(engine, "parcel_id"))


def score_screen(
    base: DataFrame, weights: Mapping[str, float] = MOTIVATION_WEIGHTS
) -> DataFrame:
    """Motivation score and grade over the whole base, before any filter."""
    if sum(weights.values()) <= 0:
        raise ValueError("at least one weight must be above zero")
    return motivation_score(base, weights, keys=("as_of",))


def in_view(
    min_spread: float = MIN_DOLLAR_SPREAD,
    max_just_value: float | None = None,
    high_confidence: bool = True,
    absentee_only: bool = False,
) -> Column:
    """The row condition of a view."""
    kept = F.col("arv_estimate").isNotNull() & (F.col("spread_estimate") >= min_spread)
    if max_just_value is not None:
        kept = kept & (F.col("just_value") <= max_just_value)
    if high_confidence:
        kept = kept & F.col("high_confidence")
    if absentee_only:
        kept = kept & F.col("absentee")
    return kept


def filter_screen(scored: DataFrame, **controls) -> DataFrame:
    return scored.filter(in_view(**controls))


def rank_screen(filtered: DataFrame, sort_by: str = "pct_spread", limit: int | None = None) -> DataFrame:
    """Sorted view; with a limit, a top-k that never sorts the whole table."""
    if sort_by not in SORT_COLUMNS:
        raise ValueError(f"sort_by must be one of {SORT_COLUMNS}, not {sort_by!r}")
    ranked = filtered.orderBy(F.col(sort_by).desc(), "parcel_id")
    return ranked if limit is None else ranked.limit(limit)


def screen_places(filtered: DataFrame, sort_by: str = "pct_spread") -> DataFrame:
    """The view with each row's place in it as ``rank``, for an export to be stored."""
    if sort_by not in SORT_COLUMNS:
        raise ValueError(f"sort_by must be one of {SORT_COLUMNS}, not {sort_by!r}")
    return with_row_numbers(filtered, [F.col(sort_by).desc(), F.col("parcel_id")])


def screen(
    parcels: DataFrame,
    sales: DataFrame,
    snapshots: DataFrame,
    as_of: dt.date,
    weights: Mapping[str, float] = MOTIVATION_WEIGHTS,
    min_spread: float = MIN_DOLLAR_SPREAD,
    max_just_value: float | None = None,
    high_confidence: bool = True,
    absentee_only: bool = False,
    sort_by: str = "pct_spread",
    limit: int | None = None,
) -> DataFrame:
    """The whole screen with every control as an argument; all columns are kept."""
    base = materialize(screen_base(parcels, sales, snapshots, as_of))
    scored = score_screen(base, weights)
    kept = scored.filter(in_view(min_spread, max_just_value, high_confidence, absentee_only))
    return rank_screen(kept, sort_by, limit)


def display(view: DataFrame, limit: int | None = None) -> DataFrame:
    """Columns of the on-screen table under their display names; all rows unless a limit
    is asked for (the screen itself shows ``DISPLAY_ROWS``)."""
    shown = view.select(*[F.col(c).alias(name) for c, name in DISPLAY_NAMES.items()])
    return shown if limit is None else shown.limit(limit)


def screen_header(scored: DataFrame, **controls) -> DataFrame:
    """One row of counts: parcels, parcels with an estimate, parcels in the view."""
    return scored.agg(
        F.count("*").alias("parcels"),
        F.count("arv_estimate").alias("with_arv"),
        F.count_if(in_view(**controls)).alias("in_view"),
    )


def parcel_record(scored: DataFrame, parcel_id: str) -> DataFrame:
    """Full record of one parcel."""
    return scored.filter(F.col("parcel_id") == parcel_id)
