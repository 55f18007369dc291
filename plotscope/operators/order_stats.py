"""Exact order statistics of groups of any size.

``percentile`` and an ordered window both bring a whole group to one task. Here the
groups may be a single county-wide price series or one neighbourhood with a third of
all rows, so each routine works in two levels: a histogram over value bins (combined
map-side, so its shuffle is tiny), then only the bins that hold a wanted rank. Results
are exact; bins only decide where to look.

Key columns must not be null. ``few_groups`` says that the number of groups is bounded by
the caller (dates, years, report cells), so that the wanted bins can be broadcast; with
many groups, distinct values are counted first, which spreads a hot group over its values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotscope.storage import materialize

_BINS_PER_OCTAVE = 1024
#: A value is heavy from this part of its group's rows on.
_HEAVY = 1000


def _bin(c: str) -> str:
    """Monotone integer bin of a number, about 0.07 % wide (0.0007 near zero)."""
    return f"CAST(signum({c}) * floor(log2(abs({c}) + 1e0) * {_BINS_PER_OCTAVE}) AS BIGINT)"


# Column names the statements use themselves; a key may not be called so.
_RESERVED = {"v", "w", "n", "bin", "below", "cut", "tie", "tie_bin", "tie_rank", "weight", "rank", "place"}


def _names(keys: Sequence[str]) -> str:
    if clash := _RESERVED.intersection(keys):
        raise ValueError(f"key columns {sorted(clash)} must be renamed first")
    return ", ".join(f"`{k}`" for k in keys)


def _hit(ranks: Sequence[str]) -> str:
    """SQL: one of the ranks lies in the rows [below, below + w)."""
    return " OR ".join(f"({r} >= below AND {r} < below + w)" for r in ranks)


def _placed_values(k: str, value: str, ranks: Sequence[str], few_groups: bool, extra: str = "") -> str:
    """CTEs ending in ``placed``: the distinct values ``v`` of the bins that hold a rank,
    with ``w`` rows each, ``below`` rows before them, and the group size ``n``."""
    if few_groups:
        histogram = f"SELECT {k}, bin, count(*) AS w FROM data GROUP BY {k}, bin"
        inside = f"""SELECT /*+ BROADCAST(hit) */ {k}, bin, v, count(*) AS w, min(below) AS below, min(n) AS n
            FROM data JOIN hit USING ({k}, bin) GROUP BY {k}, bin, v"""
    else:
        histogram = f"SELECT {k}, bin, sum(w) AS w FROM distinct_values GROUP BY {k}, bin"
        inside = f"SELECT {k}, bin, v, w, below, n FROM distinct_values JOIN hit USING ({k}, bin)"
    return f"""
        data AS (SELECT *, {_bin("v")} AS bin
            FROM (SELECT {k}, {value} AS v{extra} FROM {{df}}) WHERE v IS NOT NULL),
        distinct_values AS (SELECT {k}, bin, v, count(*) AS w FROM data GROUP BY {k}, bin, v),
        histogram AS ({histogram}),
        bins AS (SELECT {k}, bin, w, sum(w) OVER (PARTITION BY {k} ORDER BY bin) - w AS below,
            sum(w) OVER (PARTITION BY {k}) AS n FROM histogram),
        hit AS (SELECT {k}, bin, below, n FROM bins WHERE {_hit(ranks)}),
        inside AS ({inside}),
        placed AS (SELECT {k}, v, w, n,
            below + sum(w) OVER (PARTITION BY {k}, bin ORDER BY v) - w AS below FROM inside)"""


def _quantile(name: str, p: float) -> str:
    """SQL: linear interpolation, taken from the nearer end as numeric libraries do it."""
    low, high, share = f"`{name}_lo`", f"`{name}_hi`", f"({p!r}D * (n - 1) - floor({p!r}D * (n - 1)))"
    if math.isclose(p, 0.5):
        return f"CASE WHEN {share} = 0 THEN {low} ELSE ({low} + {high}) / 2 END AS `{name}`"
    return (
        f"CASE WHEN {share} < 0.5D THEN {low} + ({high} - {low}) * {share}"
        f" ELSE {high} - ({high} - {low}) * (1 - {share}) END AS `{name}`"
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    few_groups: bool = False,
    total: str | None = None,
) -> DataFrame:
    """Linearly interpolated quantiles per group: keys, n (non-null rows), one column
    per name in ``probs``. Groups without any non-null value yield no row, unless
    ``total`` names a column for the count of all rows: then every group is kept."""
    k = _names(keys)
    if total:
        totals = df.groupBy(*keys).agg(F.count("*").alias(total))
        return totals.join(exact_quantiles(df, keys, value, probs, few_groups), list(keys), "left")
    ranks = {}
    for name, p in probs.items():
        ranks[f"{name}_lo"] = f"floor({p!r}D * (n - 1))"
        ranks[f"{name}_hi"] = f"least(floor({p!r}D * (n - 1)) + 1, n - 1)"
    ends = ", ".join(f"max(CASE WHEN {_hit([r])} THEN v END) AS `{name}`" for name, r in ranks.items())
    found = f"""{_placed_values(k, f"`{value}`", list(ranks.values()), few_groups)},
        ends AS (SELECT {k}, max(n) AS n, {ends} FROM placed GROUP BY {k})"""
    query = f"""
        WITH {found}
        SELECT {k}, n, {", ".join(_quantile(name, p) for name, p in probs.items())} FROM ends"""
    return df.sparkSession.sql(query, df=df)


def average_rank(
    df: DataFrame, keys: Sequence[str], value: str, rank: str, size: str
) -> DataFrame:
    """Add the 1-based rank (ties share their average) and the group's non-null size.

    Distinct values are counted first, so a value held by most rows of a group is one
    row in the ordered part; the ranks are then joined back by value. Values that hold a
    thousandth of their group or more, a thousand per group at most, are broadcast, so no
    partition of the join gets a heavy one; the number of groups is bounded by the
    caller, as dates and report cells are.
    """
    k, v = _names(keys), f"`{value}`"
    query = f"""
        WITH counts AS (SELECT {k}, {v}, {_bin(v)} AS bin, count(*) AS w
            FROM {{df}} WHERE {v} IS NOT NULL GROUP BY {k}, {v}),
        bins AS (SELECT {k}, bin, sum(w) AS w FROM counts GROUP BY {k}, bin),
        offsets AS (SELECT {k}, bin, sum(w) OVER (PARTITION BY {k} ORDER BY bin) - w AS below,
            sum(w) OVER (PARTITION BY {k}) AS n FROM bins),
        running AS (SELECT {k}, bin, {v}, w,
            sum(w) OVER (PARTITION BY {k}, bin ORDER BY {v}) - w AS inside FROM counts)
        SELECT {k}, {v}, below + inside + (w + 1) / 2D AS `{rank}`, n AS `{size}`,
            w * {_HEAVY} >= n AS _heavy, 0L AS _spread
        FROM running JOIN offsets USING ({k}, bin)"""
    # Once written, the zeros are no constant that would be dropped from the join's keys.
    ranks = materialize(df.sparkSession.sql(query, df=df))
    heavy = ranks.filter("_heavy").select(*keys, value, F.struct(rank, size).alias("_known"))
    light = ranks.filter("NOT _heavy").select(*keys, value, "_spread", F.struct(rank, size).alias("_found"))
    marked = df.join(F.broadcast(heavy), [*keys, value], "left")
    # Rows that have no value, or their rank already, match nothing: they are spread.
    row = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    done = F.col(v).isNull() | F.col("_known").isNotNull()
    spread = marked.withColumn("_spread", F.when(done, row).otherwise(F.lit(0).cast("long")))
    joined = spread.join(light, [*keys, value, "_spread"], "left")
    ranked = joined.withColumn("_known", F.coalesce("_known", "_found"))
    return ranked.select(*df.columns, *(F.col("_known")[c].alias(c) for c in (rank, size)))


def percent_rank_average(
    df: DataFrame, keys: Sequence[str], value: str, out: str
) -> DataFrame:
    """Average rank as a percentage of the group's non-null rows; null stays null."""
    ranked = average_rank(df, keys, value, "_rank", "_size")
    return ranked.selectExpr("* EXCEPT (_rank, _size)", f"_rank / _size * 100D AS `{out}`")


def cut_points(
    df: DataFrame, keys: Sequence[str], value: str, tie: str, positions: Mapping[str, str]
) -> DataFrame:
    """Exact cut rows of the order (value descending, tie ascending) in a few groups of
    any size.

    ``positions`` maps names to 0-based positions, as SQL in the group size ``n``.
    Returns keys, n and, per name, ``<name>_value``, ``<name>_tie`` and ``<name>_weight``
    (rows sharing the value). A row is at or before a cut if its value is larger, or
    equal with a tie-breaker not larger. The tied rows at a cut may be most of the
    group, so their tie-breakers are selected through a histogram as well.
    """
    k = _names(keys)
    wanted = ", ".join(f"named_struct('cut', '{name}', 'rank', {p})" for name, p in positions.items())
    columns = ", ".join(
        f"max(CASE WHEN cut = '{name}' THEN {c} END) AS `{name}_{suffix}`"
        for name in positions
        for suffix, c in (("value", "-v"), ("tie", "tie"), ("weight", "weight"))
    )
    query = f"""
        WITH {_placed_values(k, f"-`{value}`", list(positions.values()), True, f", `{tie}` AS tie")},
        edges AS (SELECT {k}, v, w AS weight, n, cut, rank - below AS tie_rank FROM placed
            LATERAL VIEW inline(filter(array({wanted}), c -> c.rank >= below AND c.rank < below + w)) t AS cut, rank),
        tied AS (SELECT /*+ BROADCAST(edges) */ {k}, cut, tie, {_bin("CAST(tie AS DOUBLE)")} AS tie_bin, tie_rank
            FROM data JOIN edges USING ({k}, v)),
        tie_histogram AS (SELECT {k}, cut, tie_bin, count(*) AS w, min(tie_rank) AS tie_rank
            FROM tied GROUP BY {k}, cut, tie_bin),
        tie_bins AS (SELECT {k}, cut, tie_bin, w, tie_rank,
            sum(w) OVER (PARTITION BY {k}, cut ORDER BY tie_bin) - w AS below FROM tie_histogram),
        tie_hit AS (SELECT {k}, cut, tie_bin, tie_rank - below AS inner_rank FROM tie_bins
            WHERE tie_rank >= below AND tie_rank < below + w),
        candidates AS (SELECT /*+ BROADCAST(tie_hit) */ {k}, cut, tie, inner_rank,
            row_number() OVER (PARTITION BY {k}, cut ORDER BY tie) - 1 AS place
            FROM tied JOIN tie_hit USING ({k}, cut, tie_bin)),
        ties AS (SELECT {k}, cut, tie FROM candidates WHERE place = inner_rank)
        SELECT /*+ BROADCAST(ties) */ {k}, max(n) AS n, {columns}
        FROM edges JOIN ties USING ({k}, cut) GROUP BY {k}"""
    return df.sparkSession.sql(query, df=df)


def with_row_numbers(df: DataFrame, order: Sequence[Column], name: str = "rank") -> DataFrame:
    """Adds 1, 2, 3... in ``order``, which must tell all rows apart. Ranges of the order are
    sorted on their own; a row's place is its place in the range plus the rows of the ranges
    before, of which there are as many as shuffle partitions."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # The number of a partition's rows counts up from 2^33 times the partition.
    numbered = materialize(ranges.withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33)
    sizes = numbered.groupBy(part.alias("_part")).agg(F.count("*").alias("_rows"))
    before = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    placed = numbered.join(F.broadcast(offsets), part == F.col("_part"))
    inside = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(*df.columns, (F.col("_before") + inside + 1).alias(name))
