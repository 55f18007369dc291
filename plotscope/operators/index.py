"""County-wide price index per as-of date, built only from earlier sales."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotscope.functions.dates import date_array
from plotscope.operators.order_stats import exact_quantiles


def year_medians(events: DataFrame) -> DataFrame:
    """Median price per square foot of each sale year. The groups are few and huge."""
    return exact_quantiles(events, ["sale_year"], "price_per_sqft", {"median_psf": 0.5}, few_groups=True)


def _next_january(year: Column) -> Column:
    return F.make_date(year + 1, F.lit(1), F.lit(1))


def _cutoff_medians(events: DataFrame, as_of_dates: Sequence[dt.date]) -> DataFrame:
    """Medians by sale year up to a cutoff: the end of the year, which every later date
    shares, or an as-of date within the year (year to date)."""
    last = max(as_of_dates)
    mid_year = [d for d in sorted(set(as_of_dates)) if (d.month, d.day) != (1, 1)]
    cutoffs = F.array(_next_january(F.col("sale_year")))
    if mid_year:
        to_date = F.filter(
            date_array(mid_year), lambda d: (F.year(d) == F.col("sale_year")) & (F.col("sale_date") < d)
        )
        cutoffs = F.array_union(cutoffs, to_date)
    used = events.filter(F.col("sale_date") < F.lit(last)).select(
        "sale_year", F.explode(cutoffs).alias("cutoff"), "price_per_sqft"
    )
    return exact_quantiles(used, ["sale_year", "cutoff"], "price_per_sqft", {"level": 0.5}, few_groups=True)


def index_asof(events: DataFrame, as_of_dates: Sequence[dt.date]) -> DataFrame:
    """Anchors (as_of, anchor_date, level): the median of each complete earlier year at
    1 July, and a running year's median to date at the day before the as-of date."""
    whole_year = F.col("cutoff") == _next_january(F.col("sale_year"))
    usable = F.filter(
        date_array(as_of_dates),
        lambda d: F.when(whole_year, F.col("sale_year") < F.year(d)).otherwise(F.col("cutoff") == d),
    )
    anchors = _cutoff_medians(events, as_of_dates).withColumn("as_of", F.explode(usable))
    return anchors.select(
        "as_of",
        F.when(whole_year, F.make_date("sale_year", F.lit(7), F.lit(1)))
        .otherwise(F.date_sub("as_of", 1))
        .alias("anchor_date"),
        "level",
    )


def leaky_index(events: DataFrame, as_of_dates: Sequence[dt.date]) -> DataFrame:
    """Control with a known fault: one index over all years, whatever the as-of date."""
    medians = year_medians(events)
    return medians.select(
        F.explode(date_array(as_of_dates)).alias("as_of"),
        F.make_date("sale_year", F.lit(7), F.lit(1)).alias("anchor_date"),
        F.col("median_psf").alias("level"),
    )


INDEX_STRATEGIES = {"asof": index_asof, "leaky": leaky_index}


def anchor_arrays(anchors: DataFrame) -> DataFrame:
    """One row per as-of date with its anchors in date order (one per year, so short)."""
    return anchors.groupBy("as_of").agg(
        F.array_sort(F.collect_list(F.struct("anchor_date", "level"))).alias("anchors")
    )


def level_at(anchors: Column, date: Column) -> Column:
    """Index level on a date: linear in days between anchors, flat outside both ends."""
    before = F.try_element_at(F.filter(anchors, lambda a: a["anchor_date"] <= date), F.lit(-1))
    after = F.try_element_at(F.filter(anchors, lambda a: a["anchor_date"] > date), F.lit(1))
    share = F.datediff(date, before["anchor_date"]) / F.datediff(after["anchor_date"], before["anchor_date"])
    between = before["level"] + (after["level"] - before["level"]) * share
    return F.when(before.isNull(), after["level"]).when(after.isNull(), before["level"]).otherwise(between)


def month_levels(anchors: DataFrame, as_of_dates: Sequence[dt.date], months: int) -> DataFrame:
    """Level on each month start in the window before each as-of date, beside the level
    on the date itself. Dates times months rows; fails for a date without any anchor."""
    spark = anchors.sparkSession
    dates = spark.range(1).select(F.explode(date_array(as_of_dates)).alias("as_of"))
    found = dates.join(F.broadcast(anchor_arrays(anchors)), "as_of", "left")
    missing = F.concat(F.lit("no eligible sales before "), F.col("as_of").cast("string"))
    found = found.withColumn(
        "anchors",
        F.when(F.col("anchors").isNull(), F.raise_error(missing).cast(found.schema["anchors"].dataType)).otherwise(
            F.col("anchors")
        ),
    )
    first = F.trunc(F.add_months("as_of", -months), "month")
    month = F.explode(F.sequence(first, F.col("as_of"), F.expr("interval 1 month")))
    return (
        found.withColumn("sale_date", month)
        .filter(F.col("sale_date") < F.col("as_of"))
        .select(
            "as_of",
            "sale_date",
            level_at(F.col("anchors"), F.col("sale_date")).alias("sale_level"),
            level_at(F.col("anchors"), F.col("as_of")).alias("as_of_level"),
        )
    )


def compare_index_levels(
    events: DataFrame, as_of_dates: Sequence[dt.date]
) -> DataFrame:
    """Per date: fixed and leaky level, overstatement in percent, and whether the fixed
    level equals the median of the year before (it must on 1 January)."""
    def at_date(anchors: DataFrame, name: str) -> DataFrame:
        arrays = anchor_arrays(anchors)
        return arrays.select("as_of", level_at(F.col("anchors"), F.col("as_of")).alias(name))

    fixed = at_date(index_asof(events, as_of_dates), "fixed_level")
    leaky = at_date(leaky_index(events, as_of_dates), "leaky_level")
    before = year_medians(events).select(
        F.col("sale_year").alias("_year"), F.col("median_psf").alias("prior_year_median")
    )
    joined = fixed.join(F.broadcast(leaky), "as_of").join(
        F.broadcast(before), F.year("as_of") - 1 == F.col("_year"), "left"
    )
    return joined.select(
        "as_of",
        "fixed_level",
        "leaky_level",
        "prior_year_median",
        ((F.try_divide("leaky_level", "fixed_level") - 1) * 100).alias("overstated_pct"),
        (F.abs(F.col("fixed_level") - F.col("prior_year_median")) <= 1e-6 * F.abs("prior_year_median")).alias(
            "equals_prior_median"
        ),
    )
