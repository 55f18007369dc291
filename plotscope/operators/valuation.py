"""Comparable-sales valuation of many subjects at many as-of dates in one job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotscope.functions.dates import matching_dates
from plotscope.functions.scores import round_half_even, spread
from plotscope.operators import comp_index
from plotscope.operators.guard import guarded
from plotscope.operators.index import INDEX_STRATEGIES, month_levels
from plotscope.operators.order_stats import exact_quantiles, with_row_numbers
from plotscope.params import AS_OF_SETTINGS, MIN_DOLLAR_SPREAD, ValuationSettings
from plotscope.storage import materialize

# All subjects with these values in common have the same comps.
LOOKUP_KEY = ["as_of", "nbrhd_cd", "living_area", "year_built", "tercile", "excluded"]
_STATS = ["n", "median", "q1", "q3"]
#: What a valuation reads of the comp events.
EVENT_COLUMNS = [
    "parcel_id", "sale_date", "sale_year", "nbrhd_cd", "living_area", "year_built", "just_value", "price_per_sqft"
]
NO_EXCLUSION = ""


# -- inputs ------------------------------------------------------------------------


def comp_events(
    sales: DataFrame, snapshots: DataFrame, use_code: str = "001", min_price: float | None = None
) -> DataFrame:
    """Eligible sales joined to the roll of their own sale year, with price per area.
    Sales without a price are left out; a lowest price is only applied if given."""
    eligible = sales.filter(
        F.col("comp_eligible") & (F.col("dor_use_code") == use_code) & F.col("price").isNotNull()
    )
    if min_price is not None:
        eligible = eligible.filter(F.col("price") >= min_price)
    then = snapshots.select(
        "parcel_id", F.col("vintage_year").alias("sale_year"), "nbrhd_cd", "living_area", "year_built", "just_value"
    ).filter(F.col("living_area") > 0)
    return eligible.join(then, ["parcel_id", "sale_year"]).withColumn(
        "price_per_sqft", F.col("price") / F.col("living_area")
    )


def comp_join_report(sales: DataFrame, snapshots: DataFrame, use_code: str = "001") -> DataFrame:
    """Eligible sales by what became of them in the join to their own year's roll."""
    eligible = sales.filter(F.col("comp_eligible") & (F.col("dor_use_code") == use_code))
    vintages = snapshots.groupBy("vintage_year").agg(F.lit(True).alias("has_vintage"))
    then = snapshots.select("parcel_id", "vintage_year", "living_area", F.lit(True).alias("has_parcel"))
    outcome = (
        F.when(F.col("has_vintage").isNull(), "no roll of that year")
        .when(F.col("has_parcel").isNull(), "parcel not on that roll")
        .when(F.col("price").isNull(), "no price")
        .when(F.coalesce(F.col("living_area"), F.lit(0.0)) <= 0, "no living area")
        .otherwise("used")
    )
    return (
        eligible.withColumnRenamed("sale_year", "vintage_year")
        .join(F.broadcast(vintages), "vintage_year", "left")
        .join(then, ["parcel_id", "vintage_year"], "left")
        .groupBy(outcome.alias("outcome"))
        .agg(F.count("*").alias("sales"))
    )


def comp_pool(
    events: DataFrame,
    as_of_dates: Sequence[dt.date],
    settings: ValuationSettings = AS_OF_SETTINGS,
    index: str = "asof",
) -> DataFrame:
    """Comps usable at each date: sold inside [date - window, date), price per area
    carried to the date by the index. Guarded against later sales inside the plan."""
    anchors = INDEX_STRATEGIES[index](events, as_of_dates)
    levels = month_levels(anchors, as_of_dates, settings.window_months)
    windows = matching_dates(
        as_of_dates,
        lambda d: (F.col("sale_date") < d) & (F.col("sale_date") >= F.add_months(d, -settings.window_months)),
    )
    pool = guarded(events.withColumn("as_of", F.explode(windows)))
    # The level table has one row per date and window month.
    joined = pool.join(F.broadcast(levels), ["as_of", "sale_date"])
    return joined.withColumn("psf", F.col("price_per_sqft") * (F.col("as_of_level") / F.col("sale_level")))


# -- statistics per lookup ------------------------------------------------------------


def _tercile(value, cut1, cut2):
    """0, 1 or 2; an unknown value (or cut) counts as the top tercile."""
    return F.coalesce((value >= cut1).cast("int") + (value >= cut2).cast("int"), F.lit(2))


def _pool_profile(pool: DataFrame, settings: ValuationSettings) -> DataFrame:
    """Per date and neighbourhood: comps and, where banding applies, tercile cuts."""
    keys = ["as_of", "nbrhd_cd"]
    if not settings.value_band:
        none = F.lit(None).cast("double")
        sizes = pool.groupBy(*keys).agg(F.count("*").alias("pool_size"))
        return sizes.withColumns({"cut1": none, "cut2": none, "banded": F.lit(False)})
    low, high = settings.tercile_cuts
    cuts = exact_quantiles(pool, keys, "just_value", {"cut1": low, "cut2": high}, total="pool_size")
    return cuts.drop("n").withColumn("banded", F.col("pool_size") >= settings.min_band_pool)


def _no_answers(columns: Sequence[str]) -> list:
    return [F.lit(None).cast("bigint" if c.endswith("_n") else "double").alias(c) for c in columns]


def comp_statistics(subjects: DataFrame, pool: DataFrame, settings: ValuationSettings) -> DataFrame:
    """Trimmed comp count, median and quartiles per subject, over all its comps
    (``all_*``) and over those of its value tercile (``band_*``).

    ``subjects`` and ``pool``: as_of, parcel_id, nbrhd_cd, living_area, year_built,
    just_value; the pool also psf. Subjects that look alike share one lookup; a subject
    with own sales in the pool has a lookup that leaves those out.
    """
    keys = ["as_of", "nbrhd_cd"]
    pool = pool.select(*keys, "parcel_id", "living_area", "year_built", "just_value", "psf").filter(
        F.col("nbrhd_cd").isNotNull() & F.col("psf").isNotNull()
    )
    pool = materialize(pool)
    profile = materialize(_pool_profile(pool, settings))
    own = pool.select("as_of", "nbrhd_cd", "parcel_id").distinct().withColumn("excluded", F.col("parcel_id"))
    pool = pool.join(profile.select(*keys, "cut1", "cut2"), keys)
    band = _tercile(F.col("just_value"), F.col("cut1"), F.col("cut2")) if settings.value_band else F.lit(0)
    pool = pool.withColumn("tercile", band)
    pool = pool.filter(F.col("year_built").isNotNull()).drop("cut1", "cut2", "just_value")
    subjects = subjects.select("as_of", "parcel_id", "nbrhd_cd", "living_area", "year_built", "just_value")
    tercile = F.when(F.col("banded"), _tercile(F.col("just_value"), F.col("cut1"), F.col("cut2"))).otherwise(-1)
    asked = (
        subjects.join(profile, keys, "left")
        .join(own, ["as_of", "nbrhd_cd", "parcel_id"], "left")
        .withColumns({"tercile": tercile, "excluded": F.coalesce("excluded", F.lit(NO_EXCLUSION))})
    )
    asked = materialize(asked.select("parcel_id", *LOOKUP_KEY))
    points = materialize(comp_index.points_of(pool))
    sizes = materialize(points.groupBy(*keys).agg((F.count("*") > settings.task_comps).alias("large")))
    lookups = materialize(asked.select(*LOOKUP_KEY).distinct().join(sizes, keys))
    pool = pool.join(sizes, keys)
    columns = [f"{prefix}_{s}" for prefix in ("all", "band") for s in _STATS]
    parts = []
    if not sizes.filter("NOT large").isEmpty():
        small = (df.filter("NOT large").drop("large") for df in (lookups, pool, points.join(sizes, keys)))
        parts.append(comp_index.whole_statistics(*small, settings, columns))
    if not sizes.filter("large").isEmpty():
        large = (df.filter("large").drop("large") for df in (lookups, pool))
        parts.append(comp_index.paged_statistics(*large, settings, columns))
    if not parts:
        return asked.select("parcel_id", *LOOKUP_KEY, *_no_answers(columns))
    answers = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return asked.select("parcel_id", *LOOKUP_KEY).join(answers, LOOKUP_KEY, "left")


# -- valuation --------------------------------------------------------------------------


def _dispersion(n, median, q1, q3):
    """Quartile range over median; infinite for fewer than two comps or a zero median."""
    ratio = F.try_divide(q3 - q1, median)
    return F.when((n >= 2) & (median != 0), ratio).otherwise(F.lit(float("inf")))


def estimate(subjects: DataFrame, pool: DataFrame, settings: ValuationSettings) -> DataFrame:
    """Estimate, comp count, dispersion, band use and confidence, one row per subject."""
    df = comp_statistics(subjects, pool, settings)
    all_n, band_n = F.coalesce("all_n", F.lit(0)), F.coalesce("band_n", F.lit(0))
    tighter = _dispersion(band_n, F.col("band_median"), F.col("band_q1"), F.col("band_q3")) < _dispersion(
        all_n, F.col("all_median"), F.col("all_q1"), F.col("all_q3")
    )
    df = df.withColumn("_banded", (band_n >= settings.min_comps) & tighter)
    chosen = {
        f"_{s}": F.when(F.col("_banded"), F.col(f"band_{s}")).otherwise(F.col(f"all_{s}")) for s in _STATS
    }
    df = df.withColumns(chosen).withColumn("_n", F.coalesce("_n", F.lit(0)))
    enough = F.col("_n") >= settings.min_comps
    share = F.try_divide(F.col("_q3") - F.col("_q1"), F.col("_median")) * 100.0
    df = df.select(
        "as_of",
        "parcel_id",
        F.when(enough, round_half_even(F.col("_median") * F.col("living_area"))).alias("arv_estimate"),
        F.col("_n").cast("int").alias("arv_comp_count"),
        F.when(enough & (F.col("_median") != 0), round_half_even(share, 1)).alias("arv_dispersion_pct"),
        (F.col("_banded") & enough).alias("used_value_band"),
    )
    confident = (
        F.col("arv_estimate").isNotNull()
        & (F.col("arv_comp_count") >= settings.confidence_min_comps)
        & (F.col("arv_dispersion_pct") <= settings.confidence_max_dispersion_pct)
    )
    return df.withColumn("high_confidence", F.coalesce(confident, F.lit(False)))


def value_as_of(
    subjects: DataFrame,
    events: DataFrame,
    as_of_dates: Sequence[dt.date],
    settings: ValuationSettings = AS_OF_SETTINGS,
    index: str = "asof",
) -> DataFrame:
    """As-of valuation of ``subjects`` (one row per as_of and parcel)."""
    return estimate(subjects, comp_pool(events, as_of_dates, settings, index), settings)


# -- spread, ranking, diagnostics ---------------------------------------------------------


def with_spread(scored: DataFrame) -> DataFrame:
    """Value times the offer rule minus just value, in dollars and per value."""
    return scored.withColumn("spread_estimate", spread(F.col("arv_estimate"), F.col("just_value"))).withColumn(
        "pct_spread", F.try_divide("spread_estimate", "arv_estimate")
    )


def default_ranked(
    scored: DataFrame, min_spread: float = MIN_DOLLAR_SPREAD, high_confidence: bool = True
) -> DataFrame:
    """Default view: confident estimates above a dollar floor, widest relative spread first."""
    return default_view(scored, min_spread, high_confidence).orderBy(F.col("pct_spread").desc(), "parcel_id")


def default_view(scored: DataFrame, min_spread: float = MIN_DOLLAR_SPREAD, high_confidence: bool = True) -> DataFrame:
    df = with_spread(scored).filter(F.col("spread_estimate") >= min_spread)
    return df.filter("high_confidence") if high_confidence else df


def default_places(
    scored: DataFrame, min_spread: float = MIN_DOLLAR_SPREAD, high_confidence: bool = True
) -> DataFrame:
    """The default view with each row's place in it as ``rank``, for a table to be stored."""
    order = [F.col("pct_spread").desc(), F.col("parcel_id"), F.col("as_of")]
    return with_row_numbers(default_view(scored, min_spread, high_confidence), order)


def neighbourhood_dispersion(events: DataFrame, threshold: float, min_sales: int) -> DataFrame:
    """Per neighbourhood: sales, median and quartile range over median of price per
    area, and whether it counts as coarse."""
    known = events.filter(F.col("nbrhd_cd").isNotNull())
    stats = exact_quantiles(known, ["nbrhd_cd"], "price_per_sqft", {"q1": 0.25, "median_psf": 0.5, "q3": 0.75})
    stats = stats.withColumn("iqr_ratio", F.try_divide(F.col("q3") - F.col("q1"), F.col("median_psf")))
    coarse = (F.col("iqr_ratio") >= threshold) & (F.col("n") >= min_sales)
    return stats.select("nbrhd_cd", "n", "median_psf", "iqr_ratio", F.coalesce(coarse, F.lit(False)).alias("coarse"))
