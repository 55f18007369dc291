"""Component scaling and weighted scores over whole populations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotscope.functions.scores import clip, letter_grade, max_offer, min_max, weighted_mean
from plotscope.operators.order_stats import exact_quantiles, percent_rank_average
from plotscope.params import COMPOSITE_WEIGHTS, MOTIVATION_WEIGHTS, OFFER_RULES, WINSOR_BAND


def _bounds(
    df: DataFrame, keys: Sequence[str], winsorised: str, plain: Sequence[str]
) -> DataFrame:
    """One row per population: scaling range of each column, the winsorised one's from
    its quantile band. Clipping to a band inside the data makes the band the range."""
    ranges = df.groupBy(*keys).agg(
        *[f(c).alias(f"_{c}_{name}") for c in plain for name, f in (("min", F.min), ("max", F.max))]
    )
    low, high = WINSOR_BAND
    band = exact_quantiles(
        df, keys, winsorised, {f"_{winsorised}_min": low, f"_{winsorised}_max": high}, few_groups=True
    ).drop("n")
    return ranges.join(F.broadcast(band), list(keys), "left")


def _scale(
    df: DataFrame, keys: Sequence[str], winsorised: str, scores: Mapping[str, str]
) -> DataFrame:
    """Min-max scores (output name -> column) per population. The range table has one
    row per as-of date, so it is broadcast instead of shuffling the population; for one
    population its single row is a scalar subquery."""
    plain = [c for c in scores.values() if c != winsorised]
    if keys:
        wide = df.join(F.broadcast(_bounds(df, keys, winsorised, plain)), list(keys), "left")
        limit = F.col
    else:
        one = _bounds(df.withColumn("_all", F.lit(1)), ["_all"], winsorised, plain)
        row = one.select(F.struct("*")).scalar()
        wide, limit = df, row.getField
    scaled = {}
    for name, c in scores.items():
        low, high = limit(f"_{c}_min"), limit(f"_{c}_max")
        value = clip(F.col(c), low, high) if c == winsorised else F.col(c)
        scaled[name] = min_max(value, low, high)
    return wide.withColumns(scaled).drop(*[f"_{c}_{end}" for c in scores.values() for end in ("min", "max")])


def motivation_score(
    parcels: DataFrame,
    weights: Mapping[str, float] = MOTIVATION_WEIGHTS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Add the three component scores, their weighted mean and its grade, scaled over the
    whole frame (or per ``keys``, which must be few, such as as-of dates)."""
    columns = {"tenure_score": "ownership_tenure_years", "equity_proxy_score": "equity_proxy"}
    df = _scale(parcels, list(keys), "equity_proxy", columns)
    df = df.withColumn("absentee_score", F.col("absentee").cast("double") * 100.0)
    df = df.withColumn("motivation_score", weighted_mean(weights))
    return df.withColumn("grade", letter_grade(F.col("motivation_score")))


def composite_score(
    scored: DataFrame,
    normalization: str = "minmax",
    weights: Mapping[str, float] = COMPOSITE_WEIGHTS,
    keys: Sequence[str] = ("as_of",),
) -> DataFrame:
    """Equal-weight composite of absentee, tenure, equity and relative spread, scaled
    per as-of date either by range (equity winsorised) or by percentile rank."""
    df = scored.withColumn("absentee_score", F.col("absentee").cast("double") * 100.0)
    columns = {"tenure_score": "ownership_tenure_years", "equity_score": "equity_proxy", "pct_spread_score": "pct_spread"}
    if normalization == "minmax":
        df = _scale(df, keys, "equity_proxy", columns)
    elif normalization == "rank":
        for name, c in columns.items():
            df = percent_rank_average(df, keys, c, name)
    else:
        raise ValueError(f"normalization must be 'minmax' or 'rank', not {normalization!r}")
    return df.withColumn("composite_score", weighted_mean(weights))


def offer_grid(
    valued: DataFrame, repairs: Sequence[float], rules: Sequence[float] = OFFER_RULES
) -> DataFrame:
    """Largest allowable offer per parcel for every rule and repair cost asked for."""
    scenario = lambda name, values: F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name)
    grid = valued.filter(F.col("arv_estimate").isNotNull()).select("*", scenario("rule", rules))
    grid = grid.select("*", scenario("repair_cost", repairs))
    return grid.withColumn("max_offer", max_offer(F.col("arv_estimate"), F.col("repair_cost"), F.col("rule")))
