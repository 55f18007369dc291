"""The older single-roll valuation and the flip back-test built on it.

Kept for comparison. A roll of today describes past subjects here, which the guards
cannot see; the as-of valuation is the one to trust.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotscope.functions.dates import date_array, matching_dates, month_start, months_apart
from plotscope.functions.scores import round_half_even, spread
from plotscope.operators.order_stats import exact_quantiles, percent_rank_average
from plotscope.operators.valuation import estimate
from plotscope.params import (
    ARMS_LENGTH_CODES,
    FLIP_MIN_GAIN_PCT,
    FLIP_MONTHS,
    SINGLE_ROLL_SETTINGS,
    TOP_DECILE_PCT,
    ValuationSettings,
)
from plotscope.storage import materialize


def sale_events(parcels: DataFrame) -> DataFrame:
    """Both sale slots of each parcel as rows: arm's-length, priced, dated, with area."""
    slot = lambda i: F.struct(
        F.lit(i).alias("slot"),
        F.col(f"sale{i}_price").cast("double").alias("sale_price"),
        month_start(F.col(f"sale{i}_year"), F.col(f"sale{i}_month").try_cast("double")).alias("sale_date"),
        F.col(f"sale{i}_qual_cd").alias("qual_cd"),
    )
    rows = parcels.select(
        "parcel_id", "nbrhd_cd", "living_area", "year_built", "just_value", F.inline(F.array(slot(1), slot(2)))
    )
    return rows.filter(
        F.col("qual_cd").isin(*ARMS_LENGTH_CODES)
        & (F.col("sale_price") > 0)
        & F.col("sale_date").isNotNull()
        & (F.col("living_area") > 0)
    ).withColumn("price_per_sqft", F.col("sale_price") / F.col("living_area"))


def latest_as_of(parcels: DataFrame) -> dt.date:
    """The month after the last recorded sale, the default valuation date."""
    last = sale_events(parcels).agg(F.add_months(F.max("sale_date"), 1).alias("d")).first()
    return last["d"]


def value_single_roll(
    parcels: DataFrame,
    as_of_dates: Sequence[dt.date] | None = None,
    settings: ValuationSettings = SINGLE_ROLL_SETTINGS,
    built_by_date: bool = False,
) -> DataFrame:
    """Valuation from the two sale slots: 24-month window, no index, no value band.
    ``built_by_date`` leaves out parcels built after the year of the date."""
    dates = [latest_as_of(parcels)] if as_of_dates is None else list(as_of_dates)
    windows = matching_dates(
        dates, lambda d: (F.col("sale_date") < d) & (F.col("sale_date") >= F.add_months(d, -settings.window_months))
    )
    pool = sale_events(parcels).withColumn("as_of", F.explode(windows)).withColumnRenamed("price_per_sqft", "psf")
    when = matching_dates(dates, lambda d: F.col("year_built") <= F.year(d)) if built_by_date else date_array(dates)
    if built_by_date:
        pool = pool.filter(F.col("year_built") <= F.year("as_of"))
    subjects = parcels.withColumn("as_of", F.explode(when))
    return estimate(subjects, pool, settings).drop("used_value_band", "high_confidence")


def two_sale_parcels(parcels: DataFrame) -> DataFrame:
    """Parcels whose two slots are both qualified and priced, with holding months and
    gain. A month outside 1..12 is moved to the nearest valid one here."""
    date = lambda i: month_start(
        F.col(f"sale{i}_year"), F.col(f"sale{i}_month").try_cast("double"), on_bad_month="clip"
    )
    qualified = F.col("sale1_qual_cd").isin(*ARMS_LENGTH_CODES) & F.col("sale2_qual_cd").isin(*ARMS_LENGTH_CODES)
    priced = (F.col("sale1_price") > 0) & (F.col("sale2_price") > 0)
    return (
        parcels.filter(qualified & priced)
        .withColumn("sale1_date", date(1))
        .withColumn("sale2_date", date(2))
        .withColumn("holding_months", months_apart(F.col("sale1_date"), F.col("sale2_date")))
        .withColumn("price_delta_pct", (F.col("sale1_price") / F.col("sale2_price") - 1) * 100.0)
    )


def find_flips(
    parcels: DataFrame, months: tuple[int, int] = FLIP_MONTHS, min_gain_pct: float = FLIP_MIN_GAIN_PCT
) -> DataFrame:
    """Bought and resold within 6 to 18 months at a gain of 10 % or more."""
    held = F.col("holding_months").between(*months)
    return two_sale_parcels(parcels).filter(held & (F.col("price_delta_pct") >= min_gain_pct))


def flip_funnel(parcels: DataFrame) -> DataFrame:
    """One row of counts: two qualified sales, wrong order, right order, held long
    enough, flips."""
    months, gain = F.col("holding_months"), F.col("price_delta_pct")
    held = months.between(*FLIP_MONTHS)
    return two_sale_parcels(parcels).agg(
        F.count("*").alias("two_sales"),
        F.count_if(months <= 0).alias("not_later"),
        F.count_if(months > 0).alias("in_order"),
        F.count_if(held).alias("held"),
        F.count_if(held & (gain >= FLIP_MIN_GAIN_PCT)).alias("flips"),
    )


def flip_describe(parcels: DataFrame) -> DataFrame:
    """Distribution of holding months (pairs in order) and of the gain (pairs held)."""
    measure = F.array_compact(
        F.array(
            F.when(
                F.col("holding_months") > 0,
                F.struct(F.lit("holding_months").alias("measure"), F.col("holding_months").cast("double").alias("x")),
            ),
            F.when(
                F.col("holding_months").between(*FLIP_MONTHS),
                F.struct(F.lit("price_delta_pct").alias("measure"), F.col("price_delta_pct").alias("x")),
            ),
        )
    )
    rows = two_sale_parcels(parcels).select(F.inline(measure))
    basic = rows.groupBy("measure").agg(
        F.count("x").alias("count"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("std"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    quartiles = exact_quantiles(rows, ["measure"], "x", {"q25": 0.25, "q50": 0.5, "q75": 0.75}, few_groups=True)
    return basic.join(F.broadcast(quartiles.drop("n")), "measure", "left")


def flip_backtest(parcels: DataFrame, settings: ValuationSettings = SINGLE_ROLL_SETTINGS) -> DataFrame:
    """Rank every flip against the whole field, by spread, as of its acquisition month.
    One valuation serves all months; flips that have no estimate stay, with a reason."""
    parcels = materialize(parcels)
    flips = find_flips(parcels).withColumn("as_of", F.trunc("sale2_date", "month"))
    # Distinct calendar months only, so the list is short whatever the data size.
    months = [r.as_of for r in flips.select("as_of").distinct().collect()]
    found = flips.select("as_of", "parcel_id", "holding_months", "price_delta_pct")
    if not months:
        ranked = found.select("as_of", "parcel_id", F.lit(None).cast("double").alias("percentile"))
    else:
        valued = value_single_roll(parcels, months, settings, built_by_date=True)
        valued = valued.filter(F.col("arv_estimate").isNotNull()).join(
            parcels.select("parcel_id", "just_value"), "parcel_id"
        )
        field = valued.select(
            "as_of", "parcel_id", spread(F.col("arv_estimate"), F.col("just_value")).alias("spread_estimate")
        ).filter(F.col("spread_estimate").isNotNull())
        field = materialize(field)
        ranked = percent_rank_average(field, ["as_of"], "spread_estimate", "percentile")
    joined = found.join(ranked.select("as_of", "parcel_id", "percentile"), ["as_of", "parcel_id"], "left")
    known = F.col("percentile").isNotNull()
    return joined.select(
        "parcel_id",
        "as_of",
        round_half_even(F.col("percentile"), 1).alias("percentile"),
        F.coalesce(F.col("percentile") >= TOP_DECILE_PCT, F.lit(False)).alias("in_top_decile"),
        F.when(known, "").otherwise("no ARV / not in ranked pool at as_of").alias("reason"),
        F.when(known, F.col("holding_months")).alias("holding_months"),
        F.when(known, round_half_even(F.col("price_delta_pct"), 1)).alias("price_delta_pct"),
    )


def flip_hits(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if("in_top_decile").alias("hits"), F.count("*").alias("flips"))
