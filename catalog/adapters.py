"""Property tables derived from the driver's tables.

``part`` stands for parcels, ``lineitem`` with ``orders`` for recorded sales. All rows
are used; the arithmetic on keys only spreads attributes (codes, owners, gaps) over them.
The raw tables are all text, as the yearly source files are.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.zipping import write_zips
from plotscope.operators.parcels import build_parcels, build_snapshots
from plotscope.operators.sales import sale_history
from plotscope.storage import materialize, shared_folder

AS_OF_DATES = [dt.date(1999, 1, 1), dt.date(2000, 1, 1)]
SCREEN_DATE = dt.date(2002, 1, 1)
ASSESSMENT_YEAR = 2002
VINTAGES = (1996, 2001)

_tables: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """Derived source tables are written once per session and folder, then scanned."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _tables:
        _tables[key] = materialize(build())
    return _tables[key]


def is_stored(spark: SparkSession, sf_dir: str, name: str) -> bool:
    return (spark.sparkContext.applicationId, sf_dir, name) in _tables


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(spark: SparkSession, sf_dir: str, name: str, key: str, *columns: str) -> DataFrame:
    """A driver's table, which is one file, dealt by its key, so that what is derived from it
    has several files, as a real table would. It is dealt before it is widened: a hash of
    narrow rows, where dealing the finished text rows in turn would sort them all first."""
    return table(spark, sf_dir, name).select(key, *columns).repartition(key)


def _area20(year: str) -> str:
    """A twentieth of the living area; every tenth parcel was extended in 1998."""
    return f"(40 + 2 * p_size + CASE WHEN p_partkey % 10 = 0 AND {year} >= 1998 THEN 20 ELSE 0 END)"


_LINE_COLUMNS = [
    "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
    "l_linestatus",
]
_PART_COLUMNS = ["p_name", "p_brand", "p_type", "p_size"]


def _recorded_sales(spark: SparkSession, sf_dir: str, stored_rows: bool = True) -> DataFrame:
    """Every line is a sale. Some parcels only sold early and some only late, so that
    all owner signals and outcomes occur. Rows that are not stored need no order: they look
    orders up by hash, and stay where their parcel is (``PARCEL_ID``)."""
    orders = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS l_orderkey", "year(o_orderdate) AS order_year", "month(o_orderdate) AS sale_month"
    )
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey", "p_type", "p_size")
    lines = spread(spark, sf_dir, "lineitem", "l_orderkey", *_LINE_COLUMNS).withColumn("p_partkey", F.col("l_partkey"))
    parcel = "p_partkey"
    if not stored_rows:
        parcel = "PARCEL_ID"
        lines = lines.withColumn(parcel, F.col("p_partkey").cast("string"))
        parts = parts.select(F.col("p_partkey").cast("string").alias(parcel), "p_type", "p_size").hint("shuffle_hash")
        orders = orders.hint("shuffle_hash")
    price = (
        f"floor({_area20('sale_year')} * 20 * (100 + (l_extendedprice / l_quantity) % 50) * (sale_year - 1975) / 20"
        " * CASE WHEN l_tax >= 75e-3 THEN 25e-1 WHEN l_tax < 15e-3 THEN 7e-1 ELSE 1e0 END + 5e-1)"
    )
    year = (
        "CASE WHEN p_partkey % 7 = 3 THEN 2000 + order_year % 2 WHEN p_partkey % 3 = 1 THEN 1995 + order_year % 2"
        " ELSE order_year END"
    )
    joined = lines.join(orders, "l_orderkey").join(parts, parcel).withColumn("sale_year", F.expr(year))
    return joined.withColumn("price", F.expr(price).cast("long"))


def _raw_sales(spark: SparkSession, sf_dir: str, stored_rows: bool = True) -> DataFrame:
    copies = F.expr(
        "filter(array(named_struct('back', 0, 'extra', 0L, 'present', true),"
        " named_struct('back', 1, 'extra', 0L, 'present', l_suppkey % 4 = 0),"
        " named_struct('back', 1, 'extra', 1000L, 'present', l_suppkey % 10 = 1)), c -> c.present)"
    )
    rows = _recorded_sales(spark, sf_dir, stored_rows).select("*", F.inline(copies))
    return rows.selectExpr(
        "CAST(p_partkey AS STRING) AS PARCEL_ID" if stored_rows else "PARCEL_ID",
        "CASE WHEN p_partkey % 20 = 7 THEN '004' ELSE '001' END AS DOR_UC",
        "p_type AS NBRHD_CD",
        "CAST(l_orderkey AS STRING) AS SALE_ID_CD",
        "CASE WHEN l_linestatus = 'F' THEN 'I' ELSE 'V' END AS VI_CD",
        "CASE WHEN l_linenumber <> 7 THEN CAST(l_orderkey AS STRING) END AS OR_BOOK",
        "CASE WHEN l_linenumber <> 7 THEN CAST(l_linenumber AS STRING) END AS OR_PAGE",
        "CASE WHEN l_linenumber = 7 AND l_suppkey % 3 <> 0 THEN CAST(l_orderkey AS STRING) END AS CLERK_NO",
        "CASE l_returnflag WHEN 'A' THEN '11' WHEN 'N' THEN '01' ELSE '02' END AS QUAL_CD",
        "CAST(sale_year AS STRING) AS SALE_YR",
        "CAST(CASE WHEN l_suppkey % 97 = 96 THEN 13 ELSE sale_month END AS STRING) AS SALE_MO",
        "CASE WHEN l_suppkey % 89 = 88 THEN 'n/a' ELSE CAST(price + extra AS STRING) END AS SALE_PRC",
        "CASE WHEN l_discount >= 95e-3 THEN 'M' END AS MULTI_PAR_SAL",
        "sale_year + 1 - back AS source_year",
    )


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sale records of all file years, with exact and conflicting copies."""
    return stored(spark, sf_dir, "raw_sales", lambda: _raw_sales(spark, sf_dir))


def raw_sales_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records for a single pass over them: unless they are stored already, they are
    not written first. They come dealt by parcel, so their history needs no shuffle of its own."""
    if is_stored(spark, sf_dir, "raw_sales"):
        return raw_sales(spark, sf_dir)
    return _raw_sales(spark, sf_dir, stored_rows=False)


_OWNER_COLUMNS = [
    "concat(CAST(p_partkey AS STRING), ' ', p_name, ' St.') AS PHY_ADDR1",
    "p_brand AS PHY_CITY",
    "CASE WHEN p_partkey % 101 <> 0 THEN concat(' ', CAST(33000 + p_partkey % 50 AS STRING), '-1234') END AS PHY_ZIPCD",
    "CASE WHEN p_partkey % 4 = 2 THEN concat('PO Box ', CAST(p_partkey AS STRING))"
    " ELSE upper(concat(' ', CAST(p_partkey AS STRING), '  ', p_name, ' st ')) END AS OWN_ADDR1",
    "p_brand AS OWN_CITY",
    "CASE p_partkey % 11 WHEN 0 THEN 'NY' WHEN 1 THEN 'florida' WHEN 2 THEN NULL ELSE 'FL' END AS OWN_STATE",
    "CASE WHEN p_partkey % 31 <> 0 THEN CAST(33000 + p_partkey % 50"
    " + CASE WHEN p_partkey % 5 = 0 THEN 1 ELSE 0 END AS STRING) END AS OWN_ZIPCD",
    "concat('Owner ', p_name, ' ', CAST(p_partkey AS STRING)) AS OWN_NAME",
]


def _roll_columns(year: str) -> list[str]:
    return [
        "CAST(p_partkey AS STRING) AS PARCEL_ID",
        "CASE WHEN p_partkey % 20 = 7 THEN '004' ELSE '001' END AS DOR_UC",
        "CASE WHEN p_partkey % 83 <> 1 THEN p_type END AS NBRHD_CD",
        f"CASE WHEN p_partkey % 97 = 5 THEN 'n/a' ELSE CAST(20 * {_area20(year)} AS STRING) END AS TOT_LVG_AREA",
        "CASE WHEN p_partkey % 89 = 3 THEN '0' ELSE CAST(1950 + p_partkey % 60 AS STRING) END AS ACT_YR_BLT",
        f"CAST({_area20(year)} * (60 + p_partkey % 50) * ({year} - 1975) AS STRING) AS JV",
    ]


def _raw_rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = F.explode(F.sequence(F.lit(VINTAGES[0]), F.lit(VINTAGES[1]))).alias("vintage_year")
    rows = spread(spark, sf_dir, "part", "p_partkey", *_PART_COLUMNS).select("*", years)
    return rows.selectExpr(*_roll_columns("vintage_year"), *_OWNER_COLUMNS, "vintage_year")


def raw_rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly rolls of all parcels; the first sale year has none, on purpose."""
    return stored(spark, sf_dir, "raw_rolls", lambda: _raw_rolls(spark, sf_dir))


def raw_rolls_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rolls for a single pass over them, not written first unless they are already."""
    return raw_rolls(spark, sf_dir) if is_stored(spark, sf_dir, "raw_rolls") else _raw_rolls(spark, sf_dir)


def stability_rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly ids and owners; from 1999 every 13th parcel is renumbered or gone."""

    def build() -> DataFrame:
        changed = "p_partkey % 13 = 0 AND vintage_year >= 1999"
        years = F.explode(F.sequence(F.lit(VINTAGES[0]), F.lit(VINTAGES[1]))).alias("vintage_year")
        rows = spread(spark, sf_dir, "part", "p_partkey", *_PART_COLUMNS).select("*", years).filter(f"NOT ({changed}) OR p_partkey % 26 = 0")
        parcel = f"CASE WHEN {changed} THEN concat('R', CAST(p_partkey AS STRING)) ELSE CAST(p_partkey AS STRING) END"
        return rows.selectExpr(f"{parcel} AS PARCEL_ID", _OWNER_COLUMNS[-1], _OWNER_COLUMNS[0], "vintage_year")

    return stored(spark, sf_dir, "stability_rolls", build)


def zipped(df: DataFrame, label: str, name: str, member: str = "rows.csv") -> tuple[str, list[str]]:
    """The folder of ``df`` as zipped CSV files, one per ``label``, named as ``name`` (with {}
    for the label) says, and their labels."""
    folder = f"{shared_folder(df.sparkSession)}/zips-{uuid.uuid4().hex}"
    return folder, write_zips(df, label, folder, name, member)


def raw_county_roll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest roll with a county label and the last two recorded sales per parcel."""

    def build() -> DataFrame:
        order = "sale_year DESC, sale_month DESC, l_orderkey DESC, l_linenumber DESC, price DESC, l_suppkey DESC"
        sales = _recorded_sales(spark, sf_dir).selectExpr(
            "p_partkey",
            "sale_year",
            "sale_month",
            "price",
            "CASE l_returnflag WHEN 'A' THEN '11' WHEN 'N' THEN '01' ELSE '02' END AS qual",
            f"row_number() OVER (PARTITION BY p_partkey ORDER BY {order}) AS slot",
        )
        slots = (
            sales.filter("slot <= 2")
            .groupBy("p_partkey")
            .agg(
                *[
                    F.max(F.when(F.col("slot") == i, F.col(c).cast("string"))).alias(f"{name}{i}")
                    for i in (1, 2)
                    for c, name in (
                        ("qual", "QUAL_CD"), ("price", "SALE_PRC"), ("sale_year", "SALE_YR"), ("sale_month", "SALE_MO"),
                    )
                ]
            )
        )
        rows = spread(spark, sf_dir, "part", "p_partkey", *_PART_COLUMNS).join(slots, "p_partkey", "left")
        slot_columns = [f"{c}{i}" for i in (1, 2) for c in ("QUAL_CD", "SALE_PRC", "SALE_YR", "SALE_MO")]
        return rows.selectExpr(
            *_roll_columns("2001"),
            f"CAST({_area20('2001')} * (60 + p_partkey % 50) * 5 AS STRING) AS LND_VAL",
            *_OWNER_COLUMNS,
            *slot_columns,
            "CASE WHEN p_partkey % 3 = 0 THEN 'North' ELSE 'South' END AS county",
        )

    return stored(spark, sf_dir, "raw_county_roll", build)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "history", lambda: sale_history(raw_sales_once(spark, sf_dir)))


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir, "snapshots", lambda: build_snapshots(raw_rolls_once(spark, sf_dir)))


def parcels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(
        spark,
        sf_dir,
        "parcels",
        lambda: build_parcels(raw_county_roll(spark, sf_dir), assessment_year=ASSESSMENT_YEAR),
    )
