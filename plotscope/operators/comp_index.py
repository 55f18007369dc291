"""Order statistics of comparable sales, from an index of each neighbourhood's prices.

Matching a subject with every comp of its neighbourhood as joined rows would grow with the
square of the neighbourhood, so no pairs are emitted. A neighbourhood with up to
``task_comps`` comps goes to one task whole, with blocks of its lookups. A larger one, of
any size, is never brought together: its comps are dealt by price into pages of
about ``page_comps``, and above the pages stand levels of nodes with ``fan_out`` children,
as many as the largest neighbourhood needs. A node knows its comps as cells: the number
of one area, year and tercile in one child. A lookup counts its matches at the root once, from
running counts over cells; a wanted rank, or price, then leads down to one page, and only
that page gives the exact value. So a request meets cells and a few pages, at any size of
the neighbourhood, and no comp is ever joined with a subject.

What is asked is asked per rectangle (area and year) and tercile, however many lookups share
it: own sales, of which a lookup has few, move its ranks by few places, so all its lookups find
their values in one span of prices around the rectangle's own. A rectangle's spans and its lookups
then meet once. Lookups that leave many sales out, and those of rectangles where the fences may
lie far apart, are asked one by one.

The quartiles of all matches give the fences; the matches inside the fences are a run of
the same order, so their quartiles are ranks again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotscope.operators import comp_cells
from plotscope.params import ValuationSettings
from plotscope.storage import materialize

# The helpers travel with the tasks, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(comp_cells)

KEYS = ["as_of", "nbrhd_cd"]
_PRICE_BINS_PER_OCTAVE = 1024
_QUARTILES = (("q1", 0.25), ("q3", 0.75))
_SUMMARY = (("q1", 0.25), ("median", 0.5), ("q3", 0.75))
_REQUEST = ["lookup", *KEYS, "living_area", "year_built", "own", "band"]
_WANT = ["label", "kind", "x", "base", "node"]
_SPAN = ["label", "kind", "lo", "hi", "base", "node"]
CORNER = [*KEYS, "living_area", "year_built"]
#: Own sales of a lookup that shares its rectangle's spans; a span of fences may hold so many times
#: the prices that own sales account for.
SHARED_OWN = 64
_FENCE_SLACK = 64
#: Rectangles counted at the root together, and lookups that meet their spans, as blocks.
_LIGHT_BLOCKS = 16


def paged(pool: DataFrame, page_comps: int) -> DataFrame:
    """Adds ``page``: the price order of a date and neighbourhood, cut at bins of 0.07 %.
    Bins are counted map-side and summed in order, so no neighbourhood is sorted."""
    price_bin = F.signum("psf") * F.floor(F.log2(F.abs("psf") + 1.0) * _PRICE_BINS_PER_OCTAVE)
    binned = pool.withColumn("bin", price_bin.cast("long"))
    counts = binned.groupBy(*KEYS, "bin").agg(F.count("*").alias("comps"))
    before = F.sum("comps").over(Window.partitionBy(*KEYS).orderBy("bin")) - F.col("comps")
    pages = counts.select(*KEYS, "bin", F.floor(before / page_comps).cast("long").alias("page"))
    return binned.join(pages, [*KEYS, "bin"]).drop("bin")


def _in_blocks(left: DataFrame, right: DataFrame, by: list[str], rows: int, spread: Sequence[str] = ("lookup", "band")):
    """Both sides grouped by ``by`` in blocks of about ``rows`` requests; the right side goes
    to every block that its group has, and only where there are requests."""
    sizes = left.groupBy(*by).agg(F.count("*").alias("_n")).select(*by, F.ceil(F.col("_n") / rows).cast("int").alias("_blocks"))
    spot = F.pmod(F.xxhash64(*spread), F.col("_blocks")).cast("int")
    asked = left.join(sizes, by).withColumn("block", spot).drop("_blocks")
    copies = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    offered = right.join(sizes, by).withColumn("block", copies).drop("_blocks")
    # A fixed number of partitions: the work is in the matching, not in the bytes.
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = (df.repartition(tasks, *by, "block").groupBy(*by, "block") for df in (asked, offered))
    return next(sides).cogroup(next(sides))


def _schema(df: DataFrame, names: Sequence[str], more: str = "") -> str:
    kinds = dict(df.dtypes)
    return ", ".join([*(f"{n} {kinds[n]}" for n in names), *([more] if more else [])])


def _ends(probs, n: Column) -> list[tuple[str, Column]]:
    """The two ranks between which each quantile of ``n`` values lies."""
    out = []
    for name, p in probs:
        low = F.floor(p * (n - 1))
        out += [(f"{name}_lo", low), (f"{name}_hi", F.least(low + 1, n - 1))]
    return out


def _between(name: str, p: float, n: Column) -> Column:
    """Linear interpolation, taken from the nearer end as numeric libraries do it."""
    low, high, at = F.col(f"{name}_lo"), F.col(f"{name}_hi"), p * (n - 1)
    share = at - F.floor(at)
    if p == 0.5:
        return F.when(share == 0, low).otherwise((low + high) / 2.0)
    return F.when(share < 0.5, low + (high - low) * share).otherwise(high - (high - low) * (1 - share))


class PriceIndex:
    """Pages and cells of a pool (date, neighbourhood, area, year, tercile, psf, page)."""

    def __init__(self, pool: DataFrame, settings: ValuationSettings):
        self.settings = settings
        self.reach = (settings.area_tolerance, settings.year_tolerance)
        point = [*KEYS, "page", "living_area", "year_built", "tercile", "psf"]
        self.points = materialize(pool.groupBy(*point).agg(F.count("*").alias("w")))
        self._cells: dict[int, DataFrame] = {}
        last = self.points.agg(F.max("page")).first()[0] or 0
        self.levels = max(1, math.ceil(math.log(last + 1, settings.fan_out) - 1e-9))
        while settings.fan_out**self.levels <= last:
            self.levels += 1

    def _span(self, level: int) -> int:
        return self.settings.fan_out**level

    def cells(self, level: int) -> DataFrame:
        """Cells of the nodes ``level`` levels above the pages, written once."""
        if level not in self._cells:
            self._cells[level] = materialize(self._counted(level))
        return self._cells[level]

    def _counted(self, level: int) -> DataFrame:
        child = F.floor(F.col("page") / self._span(level - 1)).cast("long")
        node = F.floor(F.col("page") / self._span(level)).cast("long")
        placed = self.points.withColumns({"child": child, "node": node})
        return placed.groupBy(*KEYS, "node", "child", "living_area", "year_built", "tercile").agg(
            F.sum("w").alias("w"), F.min("psf").alias("lo")
        )

    def at_root(self, lookups: DataFrame, blocks: int = 1) -> DataFrame:
        """Per request the matches before each child of the root (``running``), in all (``n``),
        and the least prices of the children (``starts``)."""
        cells = self.cells(self.levels)
        names = ["lookup", "band"]
        counted = _in_blocks(lookups, cells, KEYS, blocks * self.settings.max_block_lookups).applyInArrow(
            comp_cells.running_counts(*self.reach, self.settings.fan_out, self._span(self.levels - 1), names),
            _schema(lookups, names, "running array<bigint>"),
        )
        starts = cells.groupBy(*KEYS, "child").agg(F.min("lo").alias("lo")).groupBy(*KEYS)
        starts = starts.agg(F.collect_list(F.struct("child", "lo")).alias("all"))
        # An empty child starts where the next one does.
        later = F.transform(
            F.sequence(F.lit(0), F.lit(self.settings.fan_out - 1)),
            lambda i: F.coalesce(
                F.array_min(F.transform(F.filter("all", lambda c: c["child"] >= i), lambda c: c["lo"])), F.lit(float("inf"))
            ),
        )
        found = lookups.join(counted, names).filter(F.element_at("running", -1) > 0)
        return found.join(starts.select(*KEYS, later.alias("starts")), KEYS).withColumn("n", F.element_at("running", -1))

    def answers(self, root: DataFrame, wants: Sequence[tuple[str, int, Column]]) -> DataFrame:
        """lookup, band and a column per wanted label: prices of ranks, or counts."""
        names = [*_REQUEST, *_WANT]
        known = root.select(*_REQUEST, "running", "starts", *(x.cast("double").alias(label) for label, _, x in wants))
        kinds = dict(known.dtypes) | {"label": "string", "kind": "int", "x": "double", "base": "bigint", "node": "bigint"}
        schema = ", ".join(f"{n} {kinds[n]}" for n in names)
        labels = [(label, kind) for label, kind, _ in wants]
        fan_out, rows = self.settings.fan_out, self.settings.max_block_lookups
        asked = known.mapInArrow(comp_cells.first_steps(labels, fan_out, self._span(self.levels - 1), names), schema)
        by = [*KEYS, "node"]
        for level in range(self.levels - 1, 0, -1):
            step = comp_cells.descend(*self.reach, fan_out, self._span(level - 1), names)
            asked = _in_blocks(materialize(asked), self.cells(level), by, rows).applyInArrow(step, schema)
        pages = self.points.withColumnRenamed("page", "node")
        values = _in_blocks(materialize(asked), pages, by, rows).applyInArrow(
            comp_cells.page_answers(*self.reach), _schema(asked, ["lookup", "band", "label"], "value double")
        )
        columns = [F.max(F.when(F.col("label") == label, F.col("value"))).alias(label) for label, _ in labels]
        return values.groupBy("lookup", "band").agg(*columns)

    def spans(self, root: DataFrame, wants: Sequence[tuple[str, int, Column, Column]]) -> DataFrame:
        """Per rectangle and wanted label the prices at the places, or in the range, between two
        ends, in pieces: ``pos`` (place of the first), ``psf`` and ``w``."""
        names = [*_REQUEST, *_SPAN]
        ends = [x.cast("double").alias(f"{label}_{end}") for label, _, lo, hi in wants for end, x in (("lo", lo), ("hi", hi))]
        known = root.select(*_REQUEST, "running", "starts", *ends)
        kinds = dict(known.dtypes)
        kinds |= {"label": "string", "kind": "int", "lo": "double", "hi": "double", "base": "bigint", "node": "bigint"}
        schema = ", ".join(f"{n} {kinds[n]}" for n in names)
        fan_out, rows, by = self.settings.fan_out, self.settings.max_block_lookups, [*KEYS, "node"]
        labels = [(label, kind) for label, kind, _, _ in wants]
        asked = known.mapInArrow(comp_cells.first_spans(labels, fan_out, names), schema)
        for level in range(self.levels - 1, 0, -1):
            step = comp_cells.descend_spans(*self.reach, fan_out, self._span(level - 1), names)
            asked = _in_blocks(materialize(asked), self.cells(level), by, rows).applyInArrow(step, schema)
        pages = self.points.withColumnRenamed("page", "node")
        kept = ["lookup", "band", *CORNER, "label"]
        step = comp_cells.page_spans(*self.reach, [*kept, "pos", "psf", "w"])
        schema = _schema(asked, kept, "pos bigint, psf array<double>, w array<bigint>")
        return _in_blocks(materialize(asked), pages, by, rows).applyInArrow(step, schema)

    def shared(self, rectangles: DataFrame) -> tuple[DataFrame, DataFrame]:
        """For rectangles whose lookups leave out up to ``most`` sales each: the spans of prices that hold
        all that their lookups ask for, and the rectangles that have no such narrow spans."""
        n, most, m = F.col("n"), F.col("most"), self.settings.iqr_multiplier
        root = materialize(self.at_root(rectangles, _LIGHT_BLOCKS))

        def places(p: float, start: tuple[Column, Column], stop: tuple[Column, Column]) -> tuple[Column, Column]:
            low, high = (a + F.floor(p * (b - a - 1)) for a, b in zip(start, stop))
            return F.greatest(low, F.lit(0)), F.least(high + 1 + most, n - 1)

        none = (F.lit(0), F.lit(0))
        wants = [(name, comp_cells.PLACES, *places(p, none, (n - most, n))) for name, p in _QUARTILES]
        quartiles = materialize(self.spans(root, wants))
        ends = [
            agg(F.when(F.col("label") == name, inner("psf"))).alias(f"{name}_{end}")
            for name, _ in _QUARTILES
            for end, agg, inner in (("lo", F.min, F.array_min), ("hi", F.max, F.array_max))
        ]
        q1, q3 = ((F.col(f"{name}_lo"), F.col(f"{name}_hi")) for name, _ in _QUARTILES)
        least, widest = q3[0] - q1[1], q3[1] - q1[0]
        known = root.join(quartiles.groupBy("lookup").agg(*ends), "lookup").withColumns(
            {"low_lo": q1[0] - m * widest, "low_hi": q1[1] - m * least, "high_lo": q3[0] + m * least, "high_hi": q3[1] + m * widest}
        )
        width = F.greatest(F.col("low_hi") - F.col("low_lo"), F.col("high_hi") - F.col("high_lo"))
        narrow = (least > 0) & (width * n <= _FENCE_SLACK * (2 * most + 2) * least)
        known = materialize(known.withColumn("narrow", F.coalesce(narrow, F.lit(False))))
        fenced = known.filter("narrow")
        wants = [(name, comp_cells.PRICES, F.col(f"{name}_lo"), F.col(f"{name}_hi")) for name in ("low", "high")]
        fences = materialize(self.spans(fenced, wants))
        held = F.aggregate("w", F.lit(0).cast("bigint"), lambda a, b: a + b)
        counts = [
            agg(F.when(F.col("label") == name, x)).alias(f"{name}_{end}")
            for name in ("low", "high")
            for end, agg, x in (("at", F.min, F.col("pos")), ("held", F.sum, held))
        ]
        inside = materialize(fenced.join(fences.groupBy("lookup").agg(*counts), "lookup"))
        start, stop = (
            (F.greatest(F.col(f"{name}_at") - most, F.lit(0)), F.col(f"{name}_at") + F.col(f"{name}_held")) for name in ("low", "high")
        )
        final = self.spans(inside, [(f"in_{name}", comp_cells.PLACES, *places(p, start, stop)) for name, p in _SUMMARY])
        empty = {"psf": F.array().cast("array<double>"), "w": F.array().cast("array<bigint>")}
        totals = fenced.withColumns({"label": F.lit("n"), "pos": n, **empty}).select(*final.columns)
        spans = totals.unionByName(quartiles).unionByName(fences).unionByName(final)
        return spans, known.filter("NOT narrow").select(*CORNER, "band")

    def summaries(self, requests: DataFrame) -> DataFrame:
        """lookup, band, n, q1, median and q3 of the matches inside the quartile fences, bounds
        included; of all matches where the quartiles coincide."""
        rank, n = comp_cells.RANK, F.col("n")
        root = materialize(self.at_root(requests))
        found = self.answers(root, [(name, rank, r) for name, r in _ends(_QUARTILES, n)])
        known = root.join(found, ["lookup", "band"])
        q1, q3 = (_between(name, p, n) for name, p in _QUARTILES)
        span, m = q3 - q1, self.settings.iqr_multiplier
        low = F.when(span > 0, q1 - m * span).otherwise(F.lit(float("-inf")))
        high = F.when(span > 0, q3 + m * span).otherwise(F.lit(float("inf")))
        fenced = materialize(known.select(*root.columns, low.alias("low"), high.alias("high")))
        wants = [("start", comp_cells.BELOW, F.col("low")), ("stop", comp_cells.UP_TO, F.col("high"))]
        run = self.answers(fenced, wants)
        inside = materialize(
            root.join(run, ["lookup", "band"])
            .withColumn("start", F.col("start").cast("long"))
            .withColumn("kept", F.col("stop").cast("long") - F.col("start"))
        )
        kept = F.col("kept")
        values = self.answers(inside, [(name, rank, F.col("start") + r) for name, r in _ends(_SUMMARY, kept)])
        done = inside.select("lookup", "band", "kept").join(values, ["lookup", "band"])
        return done.select("lookup", "band", kept.alias("n"), *(_between(name, p, kept).alias(name) for name, p in _SUMMARY))


def points_of(pool: DataFrame) -> DataFrame:
    """Comps alike in area, year, tercile and price are one point of weight ``w``."""
    return pool.groupBy(*KEYS, "living_area", "year_built", "tercile", "psf").agg(F.count("*").alias("w"))


def own_sales(pool: DataFrame) -> DataFrame:
    """The sales of every parcel as a list (``own``), alike ones counted. They are few and mostly
    differ, so they are brought together once, as they are, and counted there."""
    sold = pool.select(*KEYS, F.col("parcel_id").alias("excluded"), "living_area", "year_built", "tercile", "psf")
    alike = sold.repartition(*KEYS, "excluded").groupBy(*sold.columns).agg(F.count("*").alias("w"))
    sale = F.struct("living_area", "year_built", "tercile", "psf", "w")
    return alike.groupBy(*KEYS, "excluded").agg(F.collect_list(sale).alias("own"))


def _rectangle_blocks(lookups: DataFrame, points: DataFrame, rows: int, own: DataFrame | None = None):
    """Lookups, with their ``own`` sales if given, and points by date and neighbourhood, in blocks of about
    ``rows`` rectangles. So points are copied as often as there are rectangles to serve, however
    many lookups share them. A rectangle of more than ``rows`` lookups counts as several."""
    corner = [*KEYS, "living_area", "year_built"]
    parts = lookups.groupBy(*corner).agg(F.ceil(F.count("*") / rows).cast("int").alias("_parts"))
    sizes = parts.groupBy(*KEYS).agg(F.ceil(F.sum("_parts") / rows).cast("int").alias("_blocks"))
    parts = parts.join(sizes, KEYS)
    part = F.pmod(F.xxhash64("excluded"), F.col("_parts"))
    spot = F.pmod(F.xxhash64("living_area", "year_built", part), F.col("_blocks")).cast("int")
    left = lookups.join(parts, corner).withColumn("block", spot).drop("_parts", "_blocks")
    if own is not None:
        left = left.join(own, [*KEYS, "excluded"], "left").withColumn("band", F.col("tercile"))
    copies = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    right = points.join(sizes, KEYS).withColumn("block", copies).drop("_blocks")
    tasks = int(lookups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = (df.repartition(tasks, *KEYS, "block").groupBy(*KEYS, "block") for df in (left, right))
    return next(sides).cogroup(next(sides))


def whole_statistics(
    lookups: DataFrame, pool: DataFrame, points: DataFrame, settings: ValuationSettings, columns: Sequence[str]
) -> DataFrame:
    """The lookups with ``columns``, from neighbourhoods whose points one task can hold: a block
    of rectangles, with all their lookups, meets the points of its neighbourhood. A lookup
    brings the sales that it leaves out."""
    names = lookups.columns
    run = comp_cells.whole_summaries(
        settings.area_tolerance, settings.year_tolerance, settings.iqr_multiplier, names, list(columns)
    )
    types = ", ".join(f"{c} {'bigint' if c.endswith('_n') else 'double'}" for c in columns)
    blocks = _rectangle_blocks(lookups, points, settings.max_block_lookups, own_sales(pool))
    return blocks.applyInArrow(run, _schema(lookups, names, types))


def _in_reach(settings: ValuationSettings) -> Column:
    """The own sales that a lookup could match at all."""
    area, year = F.col("living_area"), F.col("year_built")
    return F.filter(
        "own",
        lambda s: (s["living_area"] >= area * (1 - settings.area_tolerance))
        & (s["living_area"] <= area * (1 + settings.area_tolerance))
        & (s["year_built"] >= year - settings.year_tolerance)
        & (s["year_built"] <= year + settings.year_tolerance),
    )


def _with_spans(lookups: DataFrame, spans: DataFrame, rows: int):
    """Lookups and the spans of their rectangles in blocks of about ``rows`` lookups. A rectangle
    of more lookups goes to several blocks."""
    parts = lookups.groupBy(*CORNER).agg(F.count("*").alias("_n"))
    blocks = parts.groupBy(*KEYS).agg(F.ceil(F.sum("_n") / rows).cast("int").alias("_blocks"))
    parts = parts.withColumn("_parts", F.ceil(F.col("_n") / rows).cast("int")).drop("_n").join(blocks, KEYS)

    def spot(part: Column) -> Column:
        return F.pmod(F.xxhash64("living_area", "year_built", part.cast("int")), F.col("_blocks")).cast("int")

    part = F.pmod(F.xxhash64("excluded"), F.col("_parts"))
    left = lookups.join(parts, CORNER).withColumn("block", spot(part)).drop("_parts", "_blocks")
    spots = F.array_distinct(F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), spot))
    right = spans.join(parts, CORNER).withColumn("block", F.explode(spots)).drop("_parts", "_blocks")
    tasks = int(lookups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sides = (df.repartition(tasks, *KEYS, "block").groupBy(*KEYS, "block") for df in (left, right))
    return next(sides).cogroup(next(sides))


def paged_statistics(lookups: DataFrame, pool: DataFrame, settings: ValuationSettings, columns: Sequence[str]) -> DataFrame:
    """The same from neighbourhoods of any size, through the price index."""
    pool = materialize(paged(pool, settings.page_comps))
    index = PriceIndex(pool, settings)
    sale = F.struct("living_area", "year_built", "tercile", "psf", "page")
    sold = pool.select(*KEYS, F.col("parcel_id").alias("excluded"), sale.alias("sale")).repartition(*KEYS, "excluded")
    own = sold.groupBy(*KEYS, "excluded").agg(F.collect_list("sale").alias("own"))
    none = F.array().cast(own.schema["own"].dataType)
    every = lookups.join(own, [*KEYS, "excluded"], "left").withColumn("own", F.coalesce(_in_reach(settings), none))
    every = materialize(every)
    bands = F.explode(F.when(F.col("tercile") >= 0, F.array(F.lit(-1), F.col("tercile"))).otherwise(F.array(F.lit(-1))))
    few = every.filter(F.size("own") <= SHARED_OWN).select(*CORNER, bands.alias("band"), F.size("own").alias("most"))
    few = few.groupBy(*CORNER, "band").agg(F.max("most").alias("most"))
    rectangles = materialize(few.withColumns({"own": none, "lookup": F.monotonically_increasing_id()}))
    spans, loose = index.shared(rectangles)
    marked = every.join(loose.groupBy(*CORNER).agg(F.collect_set("band").alias("_loose")), CORNER, "left")
    in_loose = F.array_contains("_loose", -1) | F.array_contains("_loose", F.col("tercile"))
    alone = (F.size("own") > SHARED_OWN) | F.coalesce(in_loose, F.lit(False))
    marked = marked.withColumn("_alone", alone).drop("_loose")
    sold = F.transform("own", lambda s: F.struct(s["tercile"].alias("tercile"), s["psf"].alias("psf")))
    sharing = marked.filter("NOT _alone").drop("_alone").withColumn("own", sold)
    types = ", ".join(f"{c} {'bigint' if c.endswith('_n') else 'double'}" for c in columns)
    run = comp_cells.shared_summaries(settings.iqr_multiplier, lookups.columns, list(columns))
    blocks = _with_spans(sharing, spans, _LIGHT_BLOCKS * settings.max_block_lookups)
    shared = blocks.applyInArrow(run, _schema(lookups, lookups.columns, types))
    every = materialize(marked.filter("_alone").drop("_alone").withColumn("own", F.array_sort("own")))
    if every.isEmpty():
        return shared
    # Parcels alike that leave alike sales out share one request.
    alike = [*KEYS, "living_area", "year_built", "tercile", "own"]
    asked = materialize(every.select(*alike).distinct().withColumn("lookup", F.monotonically_increasing_id()))
    found = index.summaries(asked.withColumn("band", bands))
    pick = {"all": F.col("band") < 0, "band": F.col("band") >= 0}
    stats = [F.max(F.when(pick[c.split("_")[0]], F.col(c.split("_")[1]))).alias(c) for c in columns]
    known = asked.join(found.groupBy("lookup").agg(*stats), "lookup")
    return shared.unionByName(every.join(known, alike).select(*lookups.columns, *columns))
