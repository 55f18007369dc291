"""Run registered queries and their SQL twins side by side and compare the rows.

    python tools/check_oracles.py [sf_dir] [query ...]
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

from catalog.oracles import ORACLES  # noqa: E402
from catalog.queries import QUERIES  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}


def normal(rows: list[tuple]) -> list[tuple]:
    def cell(v):
        if v is None or (isinstance(v, float) and pd.isna(v)):
            return "null"
        if isinstance(v, float):
            return repr(0.0 if v == 0 else v)
        return str(v)

    return sorted(tuple(cell(v) for v in row) for row in rows)


def compare(spark: SparkSession, con, name: str, sf_dir: str) -> str:
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    quoted = [f"`{c}`" for c in columns]
    mine = normal([tuple(r) for r in df.select(*quoted).collect()])
    if name not in ORACLES:
        return f"rows only ({len(mine)})"
    relation = con.sql(ORACLES[name])
    kinds = dict(zip(relation.columns, map(str, relation.types)))
    if sorted(kinds) != columns:
        return f"COLUMNS {columns} vs {sorted(kinds)}"
    for c, kind in df.dtypes:
        if TYPES.get(kind) != kinds[c]:
            return f"TYPE {c}: {kind} vs {kinds[c]}"
    theirs = normal(relation.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
    if mine == theirs:
        return f"ok ({len(mine)})"
    extra = [r for r in mine if r not in set(theirs)][:3]
    lack = [r for r in theirs if r not in set(mine)][:3]
    return f"VALUES {len(mine)} vs {len(theirs)} rows; columns {columns}\n   spark {extra}\n   duck  {lack}"


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    bad = 0
    for name in names:
        start = time.time()
        try:
            result = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001 - a check tool reports and goes on
            result = f"ERROR {type(e).__name__}: {str(e)[:600]}"
        bad += not result.startswith(("ok", "rows only"))
        print(f"{name:28s} {time.time() - start:6.1f}s  {result}", flush=True)
    print("queries without a twin:", sorted(set(QUERIES) - set(ORACLES)), "unused twins:", sorted(set(ORACLES) - set(QUERIES)))
    sys.exit(bad > 0)


if __name__ == "__main__":
    main()
