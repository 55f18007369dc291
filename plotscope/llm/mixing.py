"""Mixing sources to target weights by pivotal dependent rounding.

Every document of a source starts with the same number of copies, its source's target over
its size. The whole copies are settled at once; the fractions are paired: words move from
one document of a pair to the other, by a fair draw, until one of the two has a whole
number of copies, so the words of the pair stay what they were. The document left with a
fraction meets the next. Groups of bounded size do this independently, the one fraction
each leaves goes up to the next level, and so on: a reduction tree of a few levels over
a few numbers per document. Only DataFrame and SQL functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotscope.llm.common import cut_lineage

#: Groups of the tree that merge into one; documents per group of the lowest level.
FAN_IN = 24
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
#: Up to so many sources their table is broadcast; beyond, it is joined by shuffle.
FEW_SOURCES = 10_000
#: The same for the documents taken, in ``mix_documents``.
FEW_KEYS = 1_000_000
#: Equal rows are counted, and dealt out again in blocks of so many.
_BLOCK = 4096
#: Fractions this close to a whole number of copies count as whole.
_NEAR = 1e-9


def word_count(text: Column) -> Column:
    """Number of runs of other characters than ASCII white space; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def with_running_sums(rows: DataFrame, order: Sequence[Column], sums: dict[str, str]) -> DataFrame:
    """Adds, per name, the sum of an SQL expression over the rows up to each in ``order``,
    which must tell all rows apart. Ranges of the order are summed on their own; the sum of
    the ranges before is added from a table with one row per range."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumns({name: F.expr(e) for name, e in sums.items()})
    dealt = cut_lineage(dealt.repartitionByRange(parts, *order).withColumn("range", F.spark_partition_id()))
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranges = dealt.groupBy("range").agg(*(F.sum(name).alias(f"{name}_all") for name in sums))
    # There are at most as many ranges as shuffle partitions.
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(
        F.col("range").alias("of"), *(F.coalesce(F.sum(f"{n}_all").over(before), F.lit(0)).alias(f"{n}_before") for n in sums)
    )
    summed = dealt.select(*rows.columns, "range", *(F.sum(name).over(inside).alias(name) for name in sums))
    found = summed.join(F.broadcast(ranges), F.col("range") == F.col("of"))
    return found.select(*rows.columns, *((F.col(n) + F.col(f"{n}_before")).alias(n) for n in sums))


def source_targets(totals: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """From one row per source (source, source_size, documents) its share of all words:
    adds ``target``.

    Sources in code point order, null last, take the ``weights`` in turn and share all
    words by them. A target stops at ``most`` times its source's size, and the excess is
    shared again by weight among the others. Sources stop in the order of that limit per
    weight, so running sums settle all of them at once.
    """
    limit = f"({most} * source_size)"
    place = [F.col("source").asc_nulls_last()]
    ranked = with_running_sums(totals.withColumn("one", F.lit(1).cast("long")), place, {"number": "one"})
    turn = f"get(array({', '.join(map(str, weights))}), CAST((number - 1) % {len(weights)} AS INT))"
    ranked = ranked.withColumn("weight", F.expr(turn)).withColumn("stop_at", F.expr(f"{limit} / weight"))
    order = [F.col("stop_at").asc(), *place]
    running = cut_lineage(with_running_sums(ranked, order, {"words": limit, "weights": "weight"}))
    query = f"""
        WITH whole AS (SELECT sum(source_size) AS all_words, sum(weight) AS all_weight FROM {{running}}),
        -- Does a source stop, given that all before it do?
        tested AS (
            SELECT *, {limit} * (all_weight - (weights - weight)) < weight * (all_words - (words - {limit})) AS stops
            FROM {{running}} CROSS JOIN whole),
        stopped AS (
            SELECT coalesce(max(CASE WHEN stops THEN words END), 0) AS stopped_words,
                coalesce(max(CASE WHEN stops THEN weights END), 0) AS stopped_weight
            FROM tested)
        SELECT source, source_size, documents, CASE WHEN stops THEN CAST({limit} AS DOUBLE)
            ELSE CAST(weight * (all_words - stopped_words) AS DOUBLE) / (all_weight - stopped_weight) END AS target
        FROM tested CROSS JOIN stopped"""
    return totals.sparkSession.sql(query, running=running)


def _draw(seed: int, column: str) -> str:
    """SQL: a number in [0, 1) that follows from the seed and a column."""
    return f"((xxhash64({seed}L, {column}) & 9007199254740991L) / 9007199254740992D)"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` bound to ``value``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def _settle(seed: int) -> str:
    """SQL over an array ``docs`` of (ticket, size, part): the state after all are paired.

    The state holds the open document (its place ``i``, size and part; ``i`` is -1 if
    there is none) and the settled ones as (place, 1 or 0 copies more).
    """
    whole = f"(abs({{0}} - round({{0}})) <= {_NEAR}D)"
    settled = "named_struct('i', {0}, 'up', CAST(round({1}) AS INT))"
    room = (
        "named_struct('up', least((1D - s.part) * s.size, d.part * d.size),"
        " 'down', least(s.part * s.size, (1D - d.part) * d.size))"
    )
    moved = f"CASE WHEN {_draw(seed, 'd.ticket')} * (r.up + r.down) < r.down THEN r.up ELSE -r.down END"
    parts = "named_struct('a', s.part + m / s.size, 'b', d.part - m / d.size)"
    after = f"""CASE
        WHEN {whole.format("p.a")} AND {whole.format("p.b")} THEN named_struct('i', -1, 'size', 0L, 'part', 0D,
            'done', concat(s.done, array({settled.format("s.i", "p.a")}, {settled.format("d.i", "p.b")})))
        WHEN {whole.format("p.a")} THEN named_struct('i', d.i, 'size', d.size, 'part', p.b,
            'done', concat(s.done, array({settled.format("s.i", "p.a")})))
        ELSE named_struct('i', s.i, 'size', s.size, 'part', p.a,
            'done', concat(s.done, array({settled.format("d.i", "p.b")}))) END"""
    paired = _let(room, "r", _let(moved, "m", _let(parts, "p", after)))
    none = "named_struct('i', -1, 'size', 0L, 'part', 0D, 'done', CAST(array() AS ARRAY<STRUCT<i: INT, up: INT>>))"
    placed = "transform(docs, (x, i) -> named_struct('i', i, 'ticket', x.ticket, 'size', x.size, 'part', x.part))"
    first = "named_struct('i', d.i, 'size', d.size, 'part', d.part, 'done', s.done)"
    return f"aggregate({placed}, {none}, (s, d) -> CASE WHEN s.i < 0 THEN {first} ELSE {paired} END)"


def _one_level(rows: DataFrame, seed: int, last: bool) -> DataFrame:
    """Reduce every group (source, group) to one open document at most. At the last level
    that one has nothing to pair with and goes to the nearer whole number."""
    docs = "array_sort(collect_list(struct(ticket, key, copy, size, copies, part)))"
    up = "coalesce(element_at(map_from_entries(state.done), i), 0)"
    part = "CASE WHEN i = state.i THEN state.part ELSE 0D END"
    if last:
        up = f"CASE WHEN i = state.i THEN CAST(round(state.part) AS INT) ELSE {up} END"
        part = "0D"
    query = f"""
        WITH grouped AS (SELECT source, `group`, {docs} AS docs FROM {{rows}} GROUP BY source, `group`),
        settled AS (SELECT *, {_settle(seed)} AS state FROM grouped)
        SELECT source, `group`, inline(transform(docs, (x, i) -> named_struct('ticket', x.ticket, 'key', x.key,
            'copy', x.copy, 'size', x.size, 'copies', x.copies + {up}, 'part', {part}))) FROM settled"""
    return rows.sparkSession.sql(query, rows=rows)


def pivotal_copies(
    units: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    most: int = MOST_COPIES,
    seed: int = 7,
    fan_in: int = FAN_IN,
) -> DataFrame:
    """Whole copies of every unit (key, source, size) for the mix that ``weights`` ask for.

    Returns key, source, size, source_size, target and copies, a row per input row. The
    expected copies of a unit with words are target / source_size, so none exceeds
    ``most``; the words of a source come within half its largest unit of its target. Units
    without words get no copies. Draws follow from key, size and ``seed``: reruns agree
    however the rows lie. Equal rows count separately. ``key`` may be any orderable
    type; null keys and sources are values like any other.
    """
    counted = cut_lineage(units.groupBy("key", "source", "size").agg(F.count("*").alias("rows")))
    totals = counted.groupBy("source").agg(
        F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("documents")
    )
    targets = cut_lineage(source_targets(totals, weights, most)).withColumnRenamed("source", "of_source")
    few = targets.count() <= FEW_SOURCES
    sized = counted.join(
        F.broadcast(targets) if few else targets, F.col("source").eqNullSafe(F.col("of_source"))
    ).drop("of_source")
    single = (
        sized.withColumn("block", F.explode(F.expr(f"sequence(0L, (rows - 1) div {_BLOCK})")))
        .withColumn("copy", F.explode(F.expr(f"sequence(block * {_BLOCK}, least(rows, (block + 1) * {_BLOCK}) - 1)")))
        .withColumn("ticket", F.xxhash64(F.lit(seed), "key", "size", "copy"))
        .withColumn("share", F.expr("CASE WHEN size > 0 THEN target / source_size ELSE 0D END"))
        .withColumn("copies", F.expr(f"CAST(floor(share + {_NEAR}D) AS BIGINT)"))
        .withColumn("part", F.greatest(F.col("share") - F.col("copies"), F.lit(0.0)))
        .withColumn("part", F.expr(f"CASE WHEN part <= {_NEAR}D THEN 0D ELSE part END"))
        .withColumn("group", F.expr(f"pmod(xxhash64({seed + 1}L, ticket), (documents + {fan_in - 1}) div {fan_in})"))
        .select("source", "group", "ticket", "key", "copy", "size", "copies", "part")
    )
    level = cut_lineage(single)
    largest = targets.agg(F.max("documents")).collect()[0][0] or 0
    groups, settled = -(-largest // fan_in), [level.filter("part = 0")]
    while groups:
        last = groups == 1
        seed += 2
        level = cut_lineage(_one_level(level.filter("part > 0"), seed, last))
        settled.append(level.filter("part = 0"))
        level = level.withColumn("group", F.expr(f"`group` div {fan_in}"))
        groups = 0 if last else -(-groups // fan_in)
    done = settled[0]
    for part in settled[1:]:
        done = done.unionByName(part)
    done = done.join(F.broadcast(targets) if few else targets, F.col("source").eqNullSafe(F.col("of_source")))
    return done.select("key", "source", "size", "source_size", "target", "copies")


def mix_digest(
    docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7
) -> DataFrame:
    """Per document its size in words, its source's size and target, and the words taken."""
    units = docs.select(F.col(key).alias("key"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    return pivotal_copies(units, seed=seed).select(
        F.col("key").alias(key), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )


def mix_documents(docs: DataFrame, text: str = "text", source: str = "source", seed: int = 7) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as it is taken.

    Rows that agree in every column are interchangeable: their copies are counted together
    and handed out as that many rows.
    """
    names = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")).withColumn("key", F.xxhash64("row"))
    units = row.select("key", F.col(f"row.{source}").alias("source"), word_count(F.col(f"row.{text}")).alias("size"))
    copies = pivotal_copies(units, seed=seed).groupBy("key")
    taken = cut_lineage(copies.agg(F.sum("copies").alias("taken"), F.count("*").alias("rows")))
    several = not taken.filter("rows > 1").isEmpty()
    taken = taken.filter("taken > 0").select("key", "taken")
    if taken.count() <= FEW_KEYS:
        taken = F.broadcast(taken)
    once = row.join(taken, "key")
    if several:
        once = once.groupBy("key").agg(F.first("row").alias("row"), F.first("taken").alias("taken"))
    repeated = once.withColumn("block", F.explode(F.expr(f"sequence(0L, (taken - 1) div {_BLOCK})")))
    repeated = repeated.withColumn(
        "copy", F.explode(F.expr(f"sequence(block * {_BLOCK}, least(taken, (block + 1) * {_BLOCK}) - 1)"))
    )
    return repeated.select("row.*")
