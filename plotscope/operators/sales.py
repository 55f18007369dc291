"""Sale history: overlapping yearly sale files to one row per distinct sale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotscope.functions.dates import month_start
from plotscope.functions.text import recording_ref, to_number
from plotscope.params import ARMS_LENGTH_CODES

EXACT_KEY = ["parcel_id", "sale_year", "sale_month", "price", "recording_ref"]

# Total order of sales of one parcel, oldest first; nulls come first.
SALE_ORDER = ["sale_date", "source_year", "recording_ref", "price", "qual_code"]

HISTORY_COLUMNS = [
    "parcel_id", "sale_year", "sale_month", "price", "recording_ref", "qual_code", "qualified",
    "multi_parcel_sale", "comp_eligible", "vi_code", "dor_use_code", "sale_date", "source_year",
]


def typed_sales(raw: DataFrame) -> DataFrame:
    """Raw all-text sale records to typed columns with a recording reference."""
    return raw.select(
        F.col("PARCEL_ID").alias("parcel_id"),
        to_number(F.col("SALE_YR")).cast("int").alias("sale_year"),
        to_number(F.col("SALE_MO")).cast("int").alias("sale_month"),
        to_number(F.col("SALE_PRC")).alias("price"),
        recording_ref(F.col("OR_BOOK"), F.col("OR_PAGE"), F.col("CLERK_NO")).alias("recording_ref"),
        F.col("QUAL_CD").alias("qual_code"),
        F.col("VI_CD").alias("vi_code"),
        F.col("DOR_UC").alias("dor_use_code"),
        F.col("MULTI_PAR_SAL").alias("multi_par_sal"),
        F.col("source_year").cast("int").alias("source_year"),
    )


def _latest_first() -> list[Column]:
    later = [F.col("source_year").desc()]
    rest = ["sale_year", "sale_month", "price", "qual_code", "vi_code", "dor_use_code", "multi_par_sal"]
    return later + [F.col(c).desc_nulls_last() for c in rest]


def _keep_latest(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """Row from the latest file per key. The rank filter lets Spark limit every key
    before the shuffle, so a key with countless copies stays small."""
    order = Window.partitionBy(*keys).orderBy(*_latest_first())
    return df.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def drop_exact_duplicates(sales: DataFrame) -> DataFrame:
    """One row per parcel, year, month, price and reference: the latest file's."""
    return _keep_latest(sales, EXACT_KEY)


def resolve_conflicts(sales: DataFrame) -> DataFrame:
    """Of rows with one parcel and recording reference, keep the latest file's.
    Rows without a reference cannot conflict, so they stand apart by their other keys."""
    no_ref = F.col("recording_ref").isNull()
    own = [F.when(no_ref, F.col(c)) for c in ("sale_year", "sale_month", "price")]
    return _keep_latest(sales, ["parcel_id", "recording_ref", *own])


def deduplicate(sales: DataFrame) -> DataFrame:
    """Both steps at once. The latest row of a conflicting reference is also the latest
    of its exact copies, and rows without a reference are keyed by the exact key, so one
    shuffle gives the result of ``resolve_conflicts(drop_exact_duplicates(...))``."""
    return resolve_conflicts(sales)


def with_flags(sales: DataFrame, codes: tuple[str, ...] = ARMS_LENGTH_CODES) -> DataFrame:
    """Qualified, multi-parcel and comp-eligible flags and the month-start date."""
    return (
        sales.withColumn("qualified", F.coalesce(F.col("qual_code").isin(*codes), F.lit(False)))
        .withColumn("sale_date", month_start(F.col("sale_year"), F.col("sale_month")))
        .withColumn("multi_parcel_sale", F.coalesce(F.col("multi_par_sal") != "", F.lit(False)))
        .withColumn("comp_eligible", F.col("qualified") & ~F.col("multi_parcel_sale"))
    )


def sale_history(raw: DataFrame) -> DataFrame:
    """Raw sale records of all years to the deduplicated history (13 columns)."""
    return with_flags(deduplicate(typed_sales(raw))).select(*HISTORY_COLUMNS)


def codes_by_file_year(raw: DataFrame) -> DataFrame:
    """Qualification-code counts per file year, nulls counted."""
    return raw.groupBy("source_year", F.col("QUAL_CD").alias("qual_code")).agg(F.count("*").alias("n"))


def dedup_report(sales: DataFrame) -> DataFrame:
    """One row: raw rows, rows without a reference, exact duplicates, conflict groups
    and their rows, survivors. Copies are counted map-side at both steps."""
    exact = sales.groupBy(*EXACT_KEY).agg(F.count("*").alias("copies"))
    has_ref = F.col("recording_ref").isNotNull()
    own = F.when(~has_ref, F.struct("sale_year", "sale_month", "price")).alias("_own")
    groups = exact.groupBy("parcel_id", "recording_ref", own).agg(
        F.sum("copies").alias("copies"), F.count("*").alias("variants")
    )
    conflict = has_ref & (F.col("variants") > 1)
    return groups.agg(
        F.sum("copies").alias("raw_rows"),
        F.sum(F.when(~has_ref, F.col("copies")).otherwise(0)).alias("no_ref_rows"),
        F.sum(F.col("copies") - F.col("variants")).alias("exact_duplicates"),
        F.count_if(conflict).alias("conflict_groups"),
        F.sum(F.when(conflict, F.col("variants")).otherwise(0)).alias("conflict_rows"),
        F.count("*").alias("distinct_sales"),
    ).withColumn("no_ref_pct", F.try_divide(F.col("no_ref_rows") * 100.0, F.col("raw_rows")))


def same_file_conflicts(sales: DataFrame) -> DataFrame:
    """Number of parcel-reference groups whose latest file itself holds several rows
    (their survivor is decided by the total order, not by the file year)."""
    per_file = sales.filter(F.col("recording_ref").isNotNull()).groupBy("parcel_id", "recording_ref", "source_year")
    latest = (
        per_file.agg(F.count("*").alias("rows"))
        .groupBy("parcel_id", "recording_ref")
        .agg(F.max(F.struct("source_year", "rows")).alias("latest"))
    )
    return latest.agg(F.count_if(F.col("latest.rows") > 1).alias("groups"))


def conflict_groups(sales: DataFrame) -> DataFrame:
    """Parcel-reference groups that still hold several rows after exact dedup."""
    exact = sales.filter(F.col("recording_ref").isNotNull()).select(*EXACT_KEY).distinct()
    return exact.groupBy("parcel_id", "recording_ref").agg(F.count("*").alias("variants")).filter("variants > 1")


def multi_parcel_report(history: DataFrame) -> DataFrame:
    return history.agg(
        F.count_if("qualified").alias("qualified"),
        F.count_if(F.col("qualified") & F.col("multi_parcel_sale")).alias("qualified_multi"),
        F.count_if("comp_eligible").alias("comp_eligible"),
    ).withColumn("multi_pct", F.try_divide(F.col("qualified_multi") * 100.0, F.col("qualified")))


def qualified_per_year(history: DataFrame, use_code: str = "001") -> DataFrame:
    kept = history.filter(F.col("qualified") & (F.col("dor_use_code") == use_code))
    return kept.groupBy("sale_year").agg(F.count("*").alias("n"))


def date_coverage(history: DataFrame) -> DataFrame:
    return history.agg(F.min("sale_date").alias("first_sale"), F.max("sale_date").alias("last_sale"))
