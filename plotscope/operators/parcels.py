"""Parcel table of one assessment year and yearly parcel snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotscope.functions.dates import date_array
from plotscope.functions.scores import round_half_even, tenure_years
from plotscope.functions.text import is_absentee, is_out_of_state, to_number, zip5
from plotscope.operators.order_stats import exact_quantiles
from plotscope.params import (
    ARMS_LENGTH_CODES,
    ASSESSMENT_YEAR,
    CORE_USE_CODES,
    EXTRA_RESIDENTIAL_USE_CODES,
    HOME_STATE_NAMES,
)

# Raw roll column -> output column of the parcel table, in output order.
_TEXT = {
    "PARCEL_ID": "parcel_id", "county": "county", "DOR_UC": "dor_use_code", "NBRHD_CD": "nbrhd_cd",
    "PHY_ADDR1": "situs_addr1", "PHY_CITY": "situs_city", "OWN_NAME": "owner_name", "OWN_ADDR1": "own_addr1",
    "OWN_CITY": "own_city", "OWN_STATE": "own_state", "SALE_MO1": "sale1_month", "QUAL_CD1": "sale1_qual_cd",
    "SALE_MO2": "sale2_month", "QUAL_CD2": "sale2_qual_cd",
}
_NUMBERS = {
    "TOT_LVG_AREA": "living_area", "ACT_YR_BLT": "year_built", "LND_VAL": "land_value", "JV": "just_value",
    "SALE_PRC1": "sale1_price", "SALE_YR1": "sale1_year", "SALE_PRC2": "sale2_price", "SALE_YR2": "sale2_year",
}
PARCEL_COLUMNS = [
    "parcel_id", "county", "dor_use_code", "nbrhd_cd", "situs_addr1", "situs_city", "situs_zip", "owner_name",
    "own_addr1", "own_city", "own_state", "mail_zip", "living_area", "year_built", "land_value", "just_value",
    "sale1_price", "sale1_year", "sale1_month", "sale1_qual_cd", "sale2_price", "sale2_year", "sale2_month",
    "sale2_qual_cd", "absentee", "out_of_state", "ownership_tenure_years", "equity_proxy",
    "equity_proxy_annualized_pct",
]
_SNAPSHOT_NAMES = {
    "PARCEL_ID": "parcel_id", "DOR_UC": "dor_use_code", "NBRHD_CD": "nbrhd_cd", "TOT_LVG_AREA": "living_area",
    "ACT_YR_BLT": "year_built", "JV": "just_value", "PHY_ADDR1": "situs_addr1", "PHY_CITY": "situs_city",
    "PHY_ZIPCD": "situs_zip", "OWN_ADDR1": "own_addr1", "OWN_CITY": "own_city", "OWN_STATE": "own_state",
    "OWN_ZIPCD": "own_zip", "vintage_year": "vintage_year",
}


def residential(roll: DataFrame, include_extra: bool = False, code: str = "DOR_UC") -> DataFrame:
    codes = CORE_USE_CODES + (EXTRA_RESIDENTIAL_USE_CODES if include_extra else ())
    return roll.filter(F.col(code).isin(*codes))


def equity_columns(trusted: Column, just_value: Column, price: Column, tenure: Column) -> tuple[Column, Column]:
    """Just value minus last price, and its yearly rate in percent; null unless the last
    sale was at arm's length with a price (and, for the rate, some tenure)."""
    proxy = F.when(trusted, just_value - price)
    rate = F.when(trusted & (tenure > 0), (just_value / price - 1) / tenure * 100.0)
    return proxy, rate


def build_parcels(
    roll: DataFrame, include_extra: bool = False, assessment_year: int = ASSESSMENT_YEAR
) -> DataFrame:
    """Raw roll rows (text, with a county label) to the parcel table, 29 columns. All
    steps are row-wise, so the plan is one scan without any shuffle."""
    df = residential(roll, include_extra).select(
        *[F.col(c).alias(n) for c, n in _TEXT.items()],
        *[to_number(F.col(c)).alias(n) for c, n in _NUMBERS.items()],
        zip5(F.col("PHY_ZIPCD")).alias("situs_zip"),
        zip5(F.col("OWN_ZIPCD")).alias("mail_zip"),
    )
    df = df.filter((F.col("living_area") > 0) & (F.col("year_built") > 0) & (F.col("situs_zip") != "00000"))
    trusted = F.coalesce(F.col("sale1_qual_cd").isin(*ARMS_LENGTH_CODES) & (F.col("sale1_price") > 0), F.lit(False))
    df = (
        df.withColumn(
            "absentee",
            is_absentee(F.col("own_addr1"), F.col("situs_addr1"), F.col("mail_zip"), F.col("situs_zip")),
        )
        .withColumn("out_of_state", is_out_of_state(F.col("own_state"), HOME_STATE_NAMES))
        .withColumn("ownership_tenure_years", tenure_years(F.lit(assessment_year) - F.col("sale1_year")))
    )
    proxy, rate = equity_columns(trusted, F.col("just_value"), F.col("sale1_price"), F.col("ownership_tenure_years"))
    df = df.withColumn("equity_proxy", proxy).withColumn("equity_proxy_annualized_pct", rate)
    return df.select(*PARCEL_COLUMNS)


def parcel_summary(parcels: DataFrame) -> DataFrame:
    """One row: parcels, absentee and out-of-state share, median tenure, equity coverage."""
    shares = parcels.agg(
        F.count("*").alias("parcels"),
        (F.avg(F.col("absentee").cast("double")) * 100).alias("absentee_pct"),
        (F.avg(F.col("out_of_state").cast("double")) * 100).alias("out_of_state_pct"),
        F.count("equity_proxy").alias("with_equity"),
    ).withColumn("equity_pct", F.try_divide(F.col("with_equity") * 100.0, F.col("parcels")))
    whole = parcels.withColumn("_all", F.lit(1))
    median = exact_quantiles(whole, ["_all"], "ownership_tenure_years", {"median_tenure": 0.5}, few_groups=True)
    rows = shares.unionByName(median.drop("_all", "n"), allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def zip_summary(parcels: DataFrame) -> DataFrame:
    """Per property ZIP: parcels, absentee and out-of-state rate, mean tenure, median value."""
    known = parcels.filter(F.col("situs_zip").isNotNull())
    share = lambda c: round_half_even(F.avg(F.col(c).cast("double")) * 100.0, 2)
    means = known.groupBy("situs_zip").agg(
        F.count("parcel_id").alias("property_count"),
        share("absentee").alias("absentee_rate"),
        share("out_of_state").alias("out_of_state_rate"),
        round_half_even(F.avg("ownership_tenure_years"), 1).alias("avg_tenure_years"),
    )
    medians = exact_quantiles(known, ["situs_zip"], "just_value", {"median_just_value": 0.5}).drop("n")
    return means.join(medians, "situs_zip", "left")


def build_snapshots(roll: DataFrame, use_codes: Sequence[str] = CORE_USE_CODES) -> DataFrame:
    """Raw yearly rolls to one row per parcel and vintage, numbers coerced, names unified."""
    kept = roll.filter(F.col("DOR_UC").isin(*use_codes)).select(*_SNAPSHOT_NAMES).withColumnsRenamed(_SNAPSHOT_NAMES)
    return kept.withColumns({c: to_number(F.col(c)) for c in ("living_area", "year_built", "just_value")})


def duplicate_snapshots(snapshots: DataFrame) -> DataFrame:
    """Parcel-vintages that occur more than once; joins on them would fan out."""
    return snapshots.groupBy("parcel_id", "vintage_year").agg(F.count("*").alias("rows")).filter("rows > 1")


def subjects_as_of(snapshots: DataFrame, as_of_dates: Sequence) -> DataFrame:
    """Parcels as described by the last roll certified before each date (the year
    before), with area and year built. One pruned scan serves all dates."""
    vintages = sorted({d.year - 1 for d in as_of_dates})
    dates = F.filter(date_array(as_of_dates), lambda d: F.year(d) - 1 == F.col("vintage_year"))
    return (
        snapshots.filter(F.col("vintage_year").isin(*vintages) & (F.col("living_area") > 0) & (F.col("year_built") > 0))
        .withColumn("as_of", F.explode(dates))
    )
