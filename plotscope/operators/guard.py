"""Look-ahead guards: no row dated on or after the as-of date may feed a score."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class LookaheadError(AssertionError):
    """An as-of input holds rows dated on or after its as-of date."""


def late_rows(rows: DataFrame, as_of: dt.date, date_col: str = "sale_date") -> DataFrame:
    """The rows that may not feed an input of this date. Rows without a date may."""
    if date_col not in rows.columns:
        raise LookaheadError(f"column {date_col!r} is missing, so the input cannot be checked")
    return rows.filter(F.col(date_col) >= F.lit(as_of))


def assert_no_lookahead(rows: DataFrame, as_of: dt.date, date_col: str = "sale_date") -> None:
    """Check a whole input now; names up to five offending parcels."""
    late = late_rows(rows, as_of, date_col)
    n = late.count()
    if n:
        ids = "unknown"
        if "parcel_id" in rows.columns:
            ids = [r.parcel_id for r in late.select("parcel_id").orderBy("parcel_id").limit(5).collect()]
        raise LookaheadError(f"{n} row(s) dated on or after {as_of} in an as-of-{as_of} input; first parcels: {ids}")


def guarded(rows: DataFrame, date_col: str = "sale_date", as_of_col: str = "as_of") -> DataFrame:
    """The same check inside the plan: the job fails on the first offending row."""
    for c in (date_col, as_of_col):
        if c not in rows.columns:
            raise LookaheadError(f"column {c!r} is missing, so the input cannot be checked")
    late = F.col(date_col) >= F.col(as_of_col)
    message = F.concat(
        F.lit("look-ahead: row dated "), F.col(date_col).cast("string"), F.lit(" in as-of "), F.col(as_of_col).cast("string")
    )
    return rows.filter(F.when(late, F.raise_error(message).cast("boolean")).otherwise(True))
