"""How far valuations were from the next sale."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotscope.operators.order_stats import exact_quantiles
from plotscope.operators.signals import first_sales
from plotscope.params import ACCURACY_WINDOW_MONTHS


def valuation_errors(
    valued: DataFrame, sales: DataFrame, as_of_dates: Sequence[dt.date], months: int = ACCURACY_WINDOW_MONTHS
) -> DataFrame:
    """Relative error of each estimate against the parcel's first eligible sale in the
    months after the date."""
    sold = first_sales(sales, as_of_dates, months, {"sold": F.col("comp_eligible")})
    sold = sold.select("as_of", "parcel_id", F.col("sold.price").alias("price"))
    joined = valued.filter(F.col("arv_estimate").isNotNull()).join(sold, ["as_of", "parcel_id"])
    return joined.withColumn("error", F.try_divide(F.abs(F.col("arv_estimate") - F.col("price")), F.col("price")))


def accuracy_by_band(
    errors: DataFrame, keys: Sequence[str] = ("as_of", "version")
) -> DataFrame:
    """Per key and confidence band: n, median and mean error, share within 10 and 20 %."""
    by = [*keys, "band"]
    own_band = F.when(F.col("high_confidence"), "high_conf").otherwise("low_conf")
    banded = errors.select(*keys, "error", F.explode(F.array(F.lit("overall"), own_band)).alias("band"))
    within = lambda limit: F.avg(F.coalesce(F.col("error") <= limit, F.lit(False)).cast("double")) * 100.0
    means = banded.groupBy(*by).agg(
        F.count("*").alias("n"),
        (F.avg("error") * 100.0).alias("mean"),
        within(0.10).alias("w10"),
        within(0.20).alias("w20"),
    )
    medians = exact_quantiles(banded, by, "error", {"median": 0.5}, few_groups=True).drop("n")
    return means.join(F.broadcast(medians), by, "left").withColumn("median", F.col("median") * 100.0)
