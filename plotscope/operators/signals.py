"""Owner signals as of a date, and what happened after it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotscope.functions.dates import matching_dates
from plotscope.functions.scores import tenure_years
from plotscope.functions.text import is_absentee, zip5
from plotscope.operators.guard import guarded
from plotscope.operators.sales import SALE_ORDER
from plotscope.params import DISCOUNT_THRESHOLD, OUTCOME_WINDOW_MONTHS


def last_sales(sales: DataFrame, as_of_dates: Sequence[dt.date]) -> DataFrame:
    """Per date and parcel: date of the last earlier sale of any kind, and the last
    known qualified price (which may be from an older sale).

    Every sale is first reduced into the earliest date after it, map-side; only those
    reduced rows are then carried to the later dates.
    """
    sales = sales.filter(F.col("sale_date") < F.lit(max(as_of_dates)))
    first_after = F.array_min(matching_dates(as_of_dates, lambda d: F.col("sale_date") < d))
    priced = F.col("qualified") & F.col("price").isNotNull()
    reduced = (
        sales.withColumn("as_of", first_after)
        .filter(F.col("as_of").isNotNull())
        .transform(guarded)
        .groupBy("parcel_id", F.col("as_of").alias("_from"))
        .agg(
            F.max("sale_date").alias("last_sale_date"),
            F.max(F.when(priced, F.struct(*SALE_ORDER))).alias("_last"),
        )
    )
    carried = reduced.withColumn("as_of", F.explode(matching_dates(as_of_dates, lambda d: d >= F.col("_from"))))
    return carried.groupBy("as_of", "parcel_id").agg(
        F.max("last_sale_date").alias("last_sale_date"), F.max("_last").getField("price").alias("last_qual_price")
    )


def owner_signals(subjects: DataFrame, sales: DataFrame, as_of_dates: Sequence[dt.date]) -> DataFrame:
    """Add absentee, no_sale_on_record, ownership_tenure_years, last_qual_price and
    equity_proxy to the subjects, from earlier sales only."""
    joined = subjects.join(last_sales(sales, as_of_dates), ["as_of", "parcel_id"], "left")
    years = F.datediff("as_of", "last_sale_date") / F.lit(365.25)
    return (
        joined.withColumn(
            "absentee",
            is_absentee(
                F.col("own_addr1"), F.col("situs_addr1"), zip5(F.col("own_zip")), zip5(F.col("situs_zip"))
            ),
        )
        .withColumn("no_sale_on_record", F.col("last_sale_date").isNull())
        .withColumn("ownership_tenure_years", tenure_years(years))
        .withColumn("equity_proxy", F.col("just_value") - F.col("last_qual_price"))
        .drop("last_sale_date")
    )


def first_sales(
    sales: DataFrame,
    as_of_dates: Sequence[dt.date],
    months: int,
    conditions: Mapping[str, Column],
    use_code: str = "001",
) -> DataFrame:
    """Per date and parcel the first sale in [date, date + months) that meets each of the named
    conditions, as a struct (price, sale_year) of that name, null if none does. All are found
    in one pass: one scan, one shuffle."""
    window = matching_dates(
        as_of_dates, lambda d: (F.col("sale_date") >= d) & (F.col("sale_date") < F.add_months(d, months))
    )
    last = F.add_months(F.lit(max(as_of_dates)), months)
    near = sales.filter((F.col("sale_date") >= F.lit(min(as_of_dates))) & (F.col("sale_date") < last))
    near = near.filter((F.col("sale_year") >= min(as_of_dates).year) & (F.col("sale_year") <= F.year(last)))
    any_of = reduce(or_, conditions.values())
    kept = near.filter((F.col("dor_use_code") == use_code) & any_of).withColumn("as_of", F.explode(window))
    found = {
        name: F.min(F.when(condition, F.struct(*SALE_ORDER, "sale_year"))) for name, condition in conditions.items()
    }
    first = kept.groupBy("as_of", "parcel_id").agg(*(agg.alias(name) for name, agg in found.items()))
    small = {
        name: F.when(F.col(name).isNotNull(), F.struct(F.col(name)["price"].alias("price"), F.col(name)["sale_year"].alias("sale_year")))
        for name in conditions
    }
    return first.select("as_of", "parcel_id", *(c.alias(name) for name, c in small.items()))


def attach_outcomes(
    scored: DataFrame,
    sales: DataFrame,
    snapshots: DataFrame,
    as_of_dates: Sequence[dt.date],
    window_months: int = OUTCOME_WINDOW_MONTHS,
    discount: float = DISCOUNT_THRESHOLD,
) -> DataFrame:
    """What happened in the window after each date: sold at a discount to the estimate,
    sold at all, sold below the just value of the year before the sale."""
    first = first_sales(
        sales, as_of_dates, window_months, {"ce": F.col("comp_eligible"), "q": F.col("qualified")}
    ).select(
        "as_of",
        "parcel_id",
        F.col("ce.price").alias("ce_price"),
        F.col("q.price").alias("q_price"),
        F.col("q.sale_year").alias("q_sale_year"),
        (F.col("q.sale_year") - 1).alias("jv_vintage"),
    )
    prior = snapshots.select(
        "parcel_id", F.col("vintage_year").alias("jv_vintage"), F.col("just_value").alias("jv_prior")
    )
    first = first.join(prior, ["parcel_id", "jv_vintage"], "left")
    gap = F.try_divide(F.col("arv_estimate") - F.col("ce_price"), F.col("arv_estimate"))
    no = F.lit(False)
    return (
        scored.join(first, ["as_of", "parcel_id"], "left")
        .withColumn("sold_ce", F.col("ce_price").isNotNull())
        .withColumn("discount_pct", gap)
        .withColumn("discounted", F.coalesce(F.col("sold_ce") & (F.col("discount_pct") >= discount), no))
        .withColumn("sold_q", F.col("q_price").isNotNull())
        .withColumn("has_jv_prior", F.col("sold_q") & F.col("jv_prior").isNotNull())
        .withColumn("below_jv", F.coalesce(F.col("has_jv_prior") & (F.col("q_price") < F.col("jv_prior")), no))
    )
