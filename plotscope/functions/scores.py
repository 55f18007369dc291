"""Row-wise scoring formulas and the two-proportion test."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotscope.params import GRADE_FLOORS, LONG_TENURE_YEARS, OFFER_RULE


def round_half_even(c: Column, digits: int = 0) -> Column:
    """Scale, round to the even neighbour, scale back."""
    if digits == 0:
        return F.rint(c)
    return F.rint(c * float(10**digits)) / float(10**digits)


def clip(c: Column, low: Column, high: Column) -> Column:
    """Limit to [low, high]; null stays null (``least``/``greatest`` alone skip nulls)."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, low), high))


def tenure_years(years_since_sale: Column) -> Column:
    """Years since the last sale, limited to 0..100; never sold counts as 100."""
    limit = F.lit(float(LONG_TENURE_YEARS))
    return clip(F.coalesce(years_since_sale.cast("double"), limit), F.lit(0.0), limit)


def min_max(c: Column, low: Column, high: Column) -> Column:
    """Scale to 0..100; null where the range is empty."""
    return F.when(high > low, (c - low) / (high - low) * 100.0)


def weighted_mean(weights: Mapping[str, float]) -> Column:
    """Weighted mean of the columns that are present on the row, weights renormalised;
    null if none is present or the present weights add up to zero."""
    total = sum((F.coalesce(F.col(c) * float(w), F.lit(0.0)) for c, w in weights.items()), F.lit(0.0))
    weight = sum((F.when(F.col(c).isNull(), 0.0).otherwise(float(w)) for c, w in weights.items()), F.lit(0.0))
    return F.when(weight > 0, F.try_divide(total, weight))


def letter_grade(score: Column) -> Column:
    grade = F.when(score.isNull(), "N/A")
    for letter, floor in GRADE_FLOORS:
        grade = grade.when(score >= floor, letter)
    return grade.otherwise("F")


def max_offer(arv: Column, repairs: Column, rule: Column | float = OFFER_RULE) -> Column:
    """Largest allowable offer: value times rule minus repairs, never below zero."""
    rule = rule if isinstance(rule, Column) else F.lit(rule)
    return F.when(arv.isNotNull(), F.greatest(F.lit(0.0), arv * rule - repairs))


def spread(arv: Column, just_value: Column) -> Column:
    return arv * OFFER_RULE - just_value


def two_proportion_z(x1: Column, n1: Column, x2: Column, n2: Column) -> Column:
    """Pooled two-proportion z; null for an empty side or a zero standard error."""
    pooled = F.try_divide(x1 + x2, n1 + n2)
    inverse = F.try_divide(F.lit(1.0), n1) + F.try_divide(F.lit(1.0), n2)
    error = F.sqrt(pooled * (1 - pooled) * inverse)
    return F.when(error > 0, (F.try_divide(x1, n1) - F.try_divide(x2, n2)) / error)


def erfc(x: Column) -> Column:
    """Complementary error function of x >= 0, to about 15 digits: a series of positive terms
    up to 3, a continued fraction beyond."""
    square, scale = x * x, F.exp(-x * x) / math.sqrt(math.pi)
    term = lambda s, k: s["term"] * 2.0 * square / (2.0 * k + 1.0)
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(80)),
        F.struct(x.alias("term"), x.alias("sum")),
        lambda s, k: F.struct(term(s, k).alias("term"), (s["sum"] + term(s, k)).alias("sum")),
        lambda s: s["sum"],
    )
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1)), F.lit(1.0), lambda t, k: 1.0 + k / (2.0 * square) / t)
    return F.when(x <= 3.0, 1.0 - 2.0 * scale * series).otherwise(scale / x / fraction)


def two_sided_p(z: Column) -> Column:
    """Two-sided normal p-value."""
    return erfc(F.abs(z) / math.sqrt(2.0))
