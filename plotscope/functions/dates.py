"""Month-grain dates and membership of rows in as-of windows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(year: Column, month: Column, on_bad_month: str = "null") -> Column:
    """First day of the month. A month outside 1..12 gives null, or the nearest valid
    month with ``on_bad_month="clip"``."""
    y, m = year.cast("int"), month.cast("int")
    if on_bad_month == "clip":
        m = F.when(m.isNotNull(), F.least(F.greatest(m, F.lit(1)), F.lit(12)))
    elif on_bad_month != "null":
        raise ValueError(f"on_bad_month must be 'null' or 'clip', not {on_bad_month!r}")
    return F.when(y.between(1, 9999) & m.between(1, 12), F.make_date(y, m, F.lit(1)))


def date_array(dates: Sequence[dt.date]) -> Column:
    """The as-of dates of a job as one literal array (a short, caller-given list)."""
    if not dates:
        raise ValueError("at least one as-of date is needed")
    return F.array(*[F.lit(d).cast("date") for d in sorted(set(dates))])


def matching_dates(dates: Sequence[dt.date], condition: Callable[[Column], Column]) -> Column:
    """Array of the as-of dates for which ``condition(date)`` holds on the row. Exploding
    it places a row in exactly the windows it belongs to, without any join."""
    return F.filter(date_array(dates), condition)


def months_apart(later: Column, earlier: Column) -> Column:
    return (F.year(later) - F.year(earlier)) * 12 + (F.month(later) - F.month(earlier))
