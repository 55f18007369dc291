"""Zipped yearly text files and the tables staged from them.

Each member of a zip is a partition of its own, a large one several. Staging streams them
into a Parquet table once; every later step scans that table.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotscope.sources import zips
from plotscope.sources.tables import read_table, write_table

# Source column lists.
ROLL_COLUMNS = [
    "PARCEL_ID", "DOR_UC", "NBRHD_CD", "JV", "LND_VAL", "TOT_LVG_AREA", "ACT_YR_BLT", "QUAL_CD1", "SALE_PRC1",
    "SALE_YR1", "SALE_MO1", "QUAL_CD2", "SALE_PRC2", "SALE_YR2", "SALE_MO2", "OWN_NAME", "OWN_ADDR1", "OWN_ADDR2",
    "OWN_CITY", "OWN_STATE", "OWN_ZIPCD", "PHY_ADDR1", "PHY_ADDR2", "PHY_CITY", "PHY_ZIPCD",
]
SALE_COLUMNS = [
    "PARCEL_ID", "DOR_UC", "NBRHD_CD", "SALE_ID_CD", "VI_CD", "OR_BOOK", "OR_PAGE", "CLERK_NO", "QUAL_CD", "SALE_YR",
    "SALE_MO", "SALE_PRC", "MULTI_PAR_SAL",
]
STABILITY_COLUMNS = ["PARCEL_ID", "OWN_NAME", "PHY_ADDR1"]
SNAPSHOT_COLUMNS = [
    "PARCEL_ID", "DOR_UC", "NBRHD_CD", "TOT_LVG_AREA", "ACT_YR_BLT", "JV", "PHY_ADDR1", "PHY_CITY", "PHY_ZIPCD",
    "OWN_ADDR1", "OWN_CITY", "OWN_STATE", "OWN_ZIPCD",
]
COUNTY_FILES = {
    "Miami-Dade": ("Dade 23 Final NAL 2025.zip", "NAL23F202501.csv"),
    "Broward": ("Broward 16 Final NAL 2025.zip", "NAL16F202501.csv"),
    "Palm Beach": ("Palm Beach 60 Final NAL 2025.zip", "NAL60F202501.csv"),
}


def text_schema(columns: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(c, T.StringType()) for c in columns])


def require_paths(paths: Sequence[str]) -> None:
    """Fail before any work if an input is missing."""
    missing = [p for p in paths if not zips.exists(p)]
    if missing:
        raise FileNotFoundError("missing inputs: " + ", ".join(missing))


def read_zips(
    spark: SparkSession, files: Mapping[str, tuple[str, str | None]], columns: Sequence[str]
) -> DataFrame:
    """Zipped CSV files (label -> path and member, None for the first) as cleaned text columns
    plus ``file_label``."""
    if not files:
        raise RuntimeError("no input files found")
    zips.register(spark)
    listed = json.dumps([[label, path, member] for label, (path, member) in files.items()])
    source = spark.read.format(zips.FORMAT).schema(text_schema([*columns, zips.LABEL]))
    return source.options(files=listed, tasks=2 * spark.sparkContext.defaultParallelism).load()


def staged(rows: DataFrame, out: str, by: str) -> DataFrame:
    """The rows written once to Parquet and read from there. A task reads one member or a part of it, so its
    files hold one ``by`` as they are: the rows are not shuffled for it."""
    write_table(rows, out)
    return read_table(rows.sparkSession, out).select(*rows.columns)


def read_county_rolls(
    spark: SparkSession,
    folder: str,
    counties: Sequence[str],
    files: Mapping[str, tuple[str, str]] = COUNTY_FILES,
    skip_missing: bool = False,
) -> DataFrame:
    """Rolls of several counties with a county label. A county without a file is an error,
    unless ``skip_missing``: then it is left out with a warning. None at all is an error."""
    paths = {county: (f"{folder}/{files[county][0]}", files[county][1]) for county in counties}
    found = {county: file for county, file in paths.items() if zips.exists(file[0])}
    missing = [f"{county} ({path})" for county, (path, _) in paths.items() if county not in found]
    if not found or missing and not skip_missing:
        raise RuntimeError(f"no county files found in {folder} for {', '.join(missing) or 'any county'}")
    if missing:
        warnings.warn(f"left out, no file: {', '.join(missing)}", stacklevel=2)
    return read_zips(spark, found, ROLL_COLUMNS).withColumnRenamed(zips.LABEL, "county")


def _yearly(spark: SparkSession, folder: str, years: Sequence[int], columns: Sequence[str], year_name: str) -> DataFrame:
    paths = {str(y): f"{folder}/{y}F.zip" for y in years}
    require_paths(list(paths.values()))
    rows = read_zips(spark, {label: (path, None) for label, path in paths.items()}, columns)
    return rows.withColumn(year_name, F.col(zips.LABEL).cast("int")).drop(zips.LABEL)


def read_sale_files(spark: SparkSession, folder: str, years: Sequence[int]) -> DataFrame:
    """Yearly sale files ``<year>F.zip`` with their ``source_year``."""
    return _yearly(spark, folder, years, SALE_COLUMNS, "source_year")


def read_roll_vintages(
    spark: SparkSession, folder: str, years: Sequence[int], columns: Sequence[str] = SNAPSHOT_COLUMNS
) -> DataFrame:
    """Yearly rolls ``<year>F.zip`` with their ``vintage_year``."""
    return _yearly(spark, folder, years, columns, "vintage_year")
