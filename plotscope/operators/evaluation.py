"""Do the signals predict the outcomes? Rate comparisons for every population, outcome
and signal of every as-of date, computed together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotscope.functions.scores import two_proportion_z, two_sided_p
from plotscope.operators.order_stats import average_rank, cut_points, exact_quantiles
from plotscope.params import (
    COMPOSITE_WEIGHTS,
    MIN_DOLLAR_SPREAD,
    MIN_GROUP_ROWS,
    MIN_RANK_ROWS,
    TIE_BREAK_SEED,
)

NO_SALE_SIGNAL = "tenure: no sale on record"
HAS_SALE_SIGNAL = "tenure: years, among parcels with a sale on record"

# signal label -> (value column, flag the row must not have)
RANK_SIGNALS = {
    "composite": ("composite_score", None),
    "pct_spread": ("pct_spread", None),
    "equity_proxy": ("equity_proxy", None),
    HAS_SALE_SIGNAL: ("ownership_tenure_years", "no_sale_on_record"),
}
GROUP_SIGNALS = {"absentee": "absentee", NO_SALE_SIGNAL: "no_sale_on_record"}
# outcome label -> (flag the row must have, outcome flag)
OUTCOMES = {
    "discount": ("sold_ce", "discounted"),
    "A_any_sale": (None, "sold_q"),
    "B_below_jv": ("has_jv_prior", "below_jv"),
}
CELL = ["as_of", "population", "outcome", "signal"]


def populations(scored: DataFrame, min_spread: float = MIN_DOLLAR_SPREAD) -> DataFrame:
    """Rows labelled by population: ``ungated`` has an estimate, ``default`` is also
    confident and above the dollar floor. A row may be in both."""
    default = F.col("high_confidence") & (F.col("spread_estimate") >= min_spread)
    member = F.array_compact(
        F.array(
            F.when(F.coalesce(default, F.lit(False)), "default"), F.when(F.col("arv_estimate").isNotNull(), "ungated")
        )
    )
    return scored.withColumn("population", F.explode(member))


def _long(pops: DataFrame, signals: Column, *keep: str) -> DataFrame:
    """One row per (row, applicable outcome, applicable signal)."""
    outcomes = F.array_compact(
        F.array(
            *[
                F.when(
                    F.lit(True) if need is None else F.col(need),
                    F.struct(F.lit(label).alias("outcome"), F.col(flag).cast("int").alias("hit")),
                )
                for label, (need, flag) in OUTCOMES.items()
            ]
        )
    )
    wide = pops.select("as_of", "population", *keep, outcomes.alias("_o"), F.array_compact(signals).alias("_s"))
    wide = wide.select("as_of", "population", *keep, "_s", F.inline("_o"))
    return wide.select("as_of", "population", "outcome", "hit", *keep, F.inline("_s"))


def rank_rows(pops: DataFrame, tie: Column | None = None, seed: int = TIE_BREAK_SEED) -> DataFrame:
    """Long form of the ranked signals with a tie-breaker: a seeded hash of the parcel
    unless given."""
    tie = F.xxhash64(F.col("parcel_id"), F.lit(seed)) if tie is None else tie
    signals = F.array(
        *[
            F.when(
                F.col(c).isNotNull() & (F.lit(True) if unless is None else ~F.col(unless)),
                F.struct(F.lit(label).alias("signal"), F.col(c).cast("double").alias("value")),
            )
            for label, (c, unless) in RANK_SIGNALS.items()
        ]
    )
    return _long(pops.withColumn("tie", tie), signals, "tie")


def _rates(counts: DataFrame) -> DataFrame:
    """Shared tail: rates, lift and z from hit and row counts of both sides."""
    return counts.select(
        *CELL,
        "method",
        "n",
        F.try_divide("hits", "n").alias("base_rate"),
        F.try_divide("hi_hits", "hi_n").alias("hi_rate"),
        "hi_n",
        F.try_divide("lo_hits", "lo_n").alias("lo_rate"),
        "lo_n",
        F.try_divide(F.try_divide("hi_hits", "hi_n"), F.try_divide("hits", "n")).alias("lift"),
        two_proportion_z(F.col("hi_hits"), F.col("hi_n"), F.col("lo_hits"), F.col("lo_n")).alias("z"),
        "boundary_tie_share",
    )


def evaluate_ranks(rows: DataFrame) -> DataFrame:
    """Top tenth against bottom half of each cell, in the order value descending, tie
    ascending. The cut rows are found by exact selection, so a cell of any size is
    counted in place."""
    positions = {"top": "n div 10 - 1", "bottom": "n - n div 2"}
    cuts = cut_points(rows, CELL, "value", "tie", positions).filter(F.col("n") >= MIN_RANK_ROWS)
    placed = rows.join(F.broadcast(cuts), CELL)
    value, tie = F.col("value"), F.col("tie")
    top = (value > F.col("top_value")) | ((value == F.col("top_value")) & (tie <= F.col("top_tie")))
    bottom = (value < F.col("bottom_value")) | ((value == F.col("bottom_value")) & (tie >= F.col("bottom_tie")))
    tied = F.max("top_weight")
    counts = placed.groupBy(*CELL).agg(
        F.max("n").alias("n"),
        F.sum("hit").alias("hits"),
        F.count_if(top).alias("hi_n"),
        F.sum(F.when(top, F.col("hit")).otherwise(0)).alias("hi_hits"),
        F.count_if(bottom).alias("lo_n"),
        F.sum(F.when(bottom, F.col("hit")).otherwise(0)).alias("lo_hits"),
        (tied / F.max("n")).alias("boundary_tie_share"),
    )
    return _rates(counts.withColumn("method", F.lit("top10 vs bottom50")))


def evaluate_groups(pops: DataFrame) -> DataFrame:
    """Rows with a yes/no signal against those without; both sides need 20 rows."""
    signals = F.array(
        *[
            F.when(
                F.col(c).isNotNull(),
                F.struct(
                    F.lit(label).alias("signal"),
                    F.col(c).cast("int").alias("flag"),
                    F.lit(f"{c} vs not").alias("method"),
                ),
            )
            for label, c in GROUP_SIGNALS.items()
        ]
    )
    yes = F.col("flag") == 1
    counts = (
        _long(pops, signals)
        .groupBy(*CELL, "method")
        .agg(
            F.count("*").alias("n"),
            F.sum("hit").alias("hits"),
            F.count_if(yes).alias("hi_n"),
            F.sum(F.when(yes, F.col("hit")).otherwise(0)).alias("hi_hits"),
            F.count_if(~yes).alias("lo_n"),
            F.sum(F.when(~yes, F.col("hit")).otherwise(0)).alias("lo_hits"),
        )
        .filter((F.col("hi_n") >= MIN_GROUP_ROWS) & (F.col("lo_n") >= MIN_GROUP_ROWS))
    )
    return _rates(counts.withColumn("boundary_tie_share", F.lit(None).cast("double")))


def evaluate(
    scored: DataFrame, tie: Column | None = None, seed: int = TIE_BREAK_SEED
) -> DataFrame:
    """The whole matrix, one row per as-of date, population, outcome and signal."""
    pops = populations(scored)
    return evaluate_ranks(rank_rows(pops, tie, seed)).unionByName(evaluate_groups(pops))


def with_verdict(results: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Add p and the Bonferroni verdict over the number of comparisons made. The result
    table has at most a few dozen rows per date."""
    tested = results.withColumn("p", two_sided_p(F.col("z")))
    tested = tested.withColumn("comparisons", F.count("*").over(Window.partitionBy()))
    return tested.withColumn("significant", F.coalesce(F.col("p") < alpha / F.col("comparisons"), F.lit(False)))


def component_diagnostic(
    pops: DataFrame, components: Sequence[str] = tuple(COMPOSITE_WEIGHTS)
) -> DataFrame:
    """How much each component moves the composite, per date and population: sample
    deviation, quartile range, rank correlation with the composite, coverage."""
    cell = ["as_of", "population", "component"]
    pair = F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("value")) for c in components])
    long = pops.select("as_of", "population", F.col("composite_score").alias("score"), F.inline(pair))
    spread_stats = long.groupBy(*cell).agg(
        F.stddev_samp("value").alias("std"), F.avg(F.col("value").isNotNull().cast("double")).alias("coverage")
    )
    quartiles = exact_quantiles(long, cell, "value", {"q1": 0.25, "q3": 0.75}, few_groups=True)
    both = long.filter(F.col("value").isNotNull() & F.col("score").isNotNull())
    ranked = average_rank(both, cell, "value", "rank_value", "_n1")
    ranked = average_rank(ranked, cell, "score", "rank_score", "_n2")
    # Correlation from sums, so that a constant side gives null rather than an error.
    x, y = F.col("rank_value"), F.col("rank_score")
    sums = ranked.groupBy(*cell).agg(
        F.covar_pop(x, y).alias("_cov"), F.stddev_pop(x).alias("_sx"), F.stddev_pop(y).alias("_sy")
    )
    product = F.col("_sx") * F.col("_sy")
    spearman = F.when(product > 0, F.col("_cov") / product).alias("spearman_with_composite")
    return (
        spread_stats.join(F.broadcast(quartiles), cell, "left")
        .join(F.broadcast(sums), cell, "left")
        .select(*cell, "std", (F.col("q3") - F.col("q1")).alias("iqr"), spearman, "coverage")
    )


def year_header(scored: DataFrame) -> DataFrame:
    """Per date: subjects and sale rate over all, size and owner shares per population."""
    every = scored.withColumn("population", F.lit("all"))
    labelled = every.unionByName(populations(scored))
    share = lambda c: F.avg(F.col(c).cast("double")) * 100.0
    return labelled.groupBy("as_of", "population").agg(
        F.count("*").alias("parcels"),
        share("sold_q").alias("any_sale_pct"),
        share("absentee").alias("absentee_pct"),
        share("no_sale_on_record").alias("no_sale_pct"),
    )
