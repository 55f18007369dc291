"""Parquet tables between steps and CSV files at the edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from plotscope.operators.parcels import PARCEL_COLUMNS

_KEEP_BLANKS = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
_FLAGS = ("absentee", "out_of_state")
_PARCEL_TEXT = {
    "parcel_id", "county", "dor_use_code", "nbrhd_cd", "situs_addr1", "situs_city", "situs_zip", "owner_name",
    "own_addr1", "own_city", "own_state", "mail_zip", "sale1_month", "sale1_qual_cd", "sale2_month", "sale2_qual_cd",
}
PARCEL_SCHEMA = T.StructType(
    [
        T.StructField(
            c, T.StringType() if c in _PARCEL_TEXT else T.BooleanType() if c in _FLAGS else T.DoubleType()
        )
        for c in PARCEL_COLUMNS
    ]
)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet sink. Rows are gathered per year or county so that each gets few files;
    the rebalance hint lets adaptive execution split a large one over many tasks."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV sink; blanks at the ends of text are kept."""
    df.write.mode("overwrite").options(header=True, **_KEEP_BLANKS).csv(path)


def read_parcels_csv(spark: SparkSession, path: str) -> DataFrame:
    """Parcel table written as CSV; codes stay text with their leading zeros."""
    return spark.read.schema(PARCEL_SCHEMA).options(header=True, **_KEEP_BLANKS).csv(path)
