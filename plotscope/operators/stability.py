"""How stable parcel ids are from one yearly roll to the next.

The years of an id, or of an owner at an address, are one number with a bit per year. Unions,
intersections and every step from a year to the next follow from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotscope.functions.text import normalize_address


def roll_years(roll: DataFrame) -> list[int]:
    """The years that have a roll, ascending; one bit each must fit a long."""
    years = sorted(r[0] for r in roll.select("vintage_year").distinct().collect())
    if years and years[-1] - years[0] > 62:
        raise ValueError("rolls of more than 63 years")
    return years


def _bit(year: Column, first: int) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), year - first)


def year_masks(rows: DataFrame, key: str, first: int) -> DataFrame:
    """Per key the bits of its years, combined map-side, so a hot key is one row per task."""
    return rows.groupBy(key).agg(F.bit_or(_bit(F.col("vintage_year"), first)).alias("years"))


def ids_in_every_year(roll: DataFrame) -> DataFrame:
    """One row: distinct ids over all rolls, ids on every roll, their share."""
    years = roll_years(roll)
    first = years[0] if years else 0
    every = sum(1 << (y - first) for y in years)
    counted = year_masks(roll, "PARCEL_ID", first).agg(
        F.count("*").alias("all_ids"), F.count_if(F.col("years") == every).alias("ids_every_year")
    )
    return counted.withColumn("every_year_pct", F.try_divide(F.col("ids_every_year") * 100.0, F.col("all_ids")))


def id_transitions(roll: DataFrame) -> DataFrame:
    """Per pair of consecutive years: rows whose id is gone the next year, how many of
    them have their owner and address on the next roll (likely renumbered), how many do
    not. A total row has a null year. A missing id is an id like any other."""
    years = roll_years(roll)
    first = years[0] if years else 0
    owner = F.concat(F.coalesce("OWN_NAME", F.lit("")), F.lit("|"), F.coalesce("PHY_ADDR1", F.lit("")))
    rows = roll.select("PARCEL_ID", "vintage_year", normalize_address(owner).alias("owner_key"))
    next_year = F.col("vintage_year") + 1
    ids = year_masks(rows, "PARCEL_ID", first).withColumnsRenamed({"PARCEL_ID": "id", "years": "id_years"})
    followed = rows.filter(F.col("vintage_year").isin([y for y in years if y + 1 in years]))
    gone = followed.join(
        ids,
        F.col("PARCEL_ID").eqNullSafe(F.col("id")) & (F.col("id_years").bitwiseAND(_bit(next_year, first)) == 0),
    )
    # Rows are counted per owner key before the lookup, so a hot key is one row a year.
    counted = gone.groupBy("vintage_year", "owner_key").agg(F.count("*").alias("rows"))
    owners = year_masks(rows, "owner_key", first).withColumnRenamed("years", "owner_years")
    marked = counted.join(owners, "owner_key")
    again = F.col("owner_years").bitwiseAND(_bit(next_year, first)) != 0
    return (
        marked.rollup("vintage_year")
        .agg(F.sum("rows").alias("disappeared"), F.sum(F.when(again, F.col("rows")).otherwise(0)).alias("renumbered"))
        .withColumn("dropped", F.col("disappeared") - F.col("renumbered"))
        .withColumn("renumbered_pct", F.try_divide(F.col("renumbered") * 100.0, F.col("disappeared")))
        .withColumnRenamed("vintage_year", "from_year")
    )
