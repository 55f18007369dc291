"""Task-local part of the comparable search, all of it array work over many requests.

A request asks within its own rectangle of areas and years, and its own tercile or all (-1),
less the sales of one parcel. Neighbourhoods that one task can hold are answered from their
comps at once, a rectangle's lookups together. Of larger ones a task sees cells (all comps of one area, year and tercile
in one price range, as a number) or one page of comps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Requests compared with a page at a time; pairs of a request and a comp looked at together.
ROWS_AT_ONCE = 1024
PAIRS_AT_ONCE = 1 << 22
TERCILES = 3
#: What a request wants: the price at a rank, or the number of prices below or up to a value.
RANK, BELOW, UP_TO = 0, 1, 2
#: What a rectangle wants for all its lookups: the prices at places, or the prices in a range.
PLACES, PRICES = 3, 4


def array(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _own(table: pa.Table) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """The sales that requests leave out, as (row, columns)."""
    lists = table.column("own").combine_chunks()
    rows = np.repeat(np.arange(len(lists)), np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(int))
    flat = lists.flatten()
    return rows, {f.name: flat.field(f.name).to_numpy(zero_copy_only=False) for f in flat.type}


class Reach:
    """The rectangles and terciles that requests ask within."""

    def __init__(self, table: pa.Table, area_tolerance: float, year_tolerance: int):
        area, year = (array(table, c).astype(float) for c in ("living_area", "year_built"))
        self.area, self.year, self.band = area, year, array(table, "band")
        self.low, self.high = area * (1 - area_tolerance), area * (1 + area_tolerance)
        self.first, self.last = year - year_tolerance, year + year_tolerance

    def holds(self, rows, area, year, tercile) -> np.ndarray:
        band = self.band[rows]
        return (
            (area >= self.low[rows])
            & (area <= self.high[rows])
            & (year >= self.first[rows])
            & (year <= self.last[rows])
            & ((band < 0) | (tercile == band))
        )


def child_counts(
    requests: pa.Table, reach: Reach, cells: pa.Table, first: int, children: int, span: int
) -> np.ndarray:
    """Matches of every request per child, from the cells (child, area, year, tercile, w). A
    child has ``span`` pages."""
    cells = cells.sort_by("living_area")
    area, year = (array(cells, c).astype(float) for c in ("living_area", "year_built"))
    years, at = np.unique(year, return_inverse=True)
    child = array(cells, "child") - first
    spot = ((child * TERCILES + array(cells, "tercile")) * len(years) + at).astype(np.int64)
    weight = array(cells, "w").astype(float)
    counts = np.zeros((requests.num_rows, children))
    from_year = years.searchsorted(reach.first, "left")
    to_year = np.maximum(years.searchsorted(reach.last, "right"), from_year)
    shape = (children, TERCILES, len(years))
    order = np.argsort(reach.area, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(reach.area[order])) + 1) if len(order) else []:
        lo, hi = area.searchsorted(reach.low[rows[0]], "left"), area.searchsorted(reach.high[rows[0]], "right")
        if hi <= lo or np.isnan(reach.area[rows[0]]):
            continue
        table = np.bincount(spot[lo:hi], weight[lo:hi], minlength=children * TERCILES * len(years)).reshape(shape)
        running = np.concatenate((np.zeros((children, TERCILES, 1)), table.cumsum(2)), 2)
        inside = running[:, :, to_year[rows]] - running[:, :, from_year[rows]]
        band = reach.band[rows]
        own_band = inside[:, np.maximum(band, 0), np.arange(len(rows))]
        counts[rows] = np.where(band < 0, inside.sum(1), own_band).T
    owner, own = _own(requests)
    at = own["page"] // span - first
    mine = (at >= 0) & (at < children) & reach.holds(owner, own["living_area"], own["year_built"], own["tercile"])
    np.subtract.at(counts, (owner[mine], at[mine].astype(int)), 1)
    return counts.astype(np.int64)


def _kept_own(own: pa.ListArray, node: np.ndarray, span: int) -> pa.ListArray:
    """The lists of own sales without those outside the rows' nodes of ``span`` pages."""
    size = np.nan_to_num(own.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
    flat = own.flatten()
    stays = flat.field("page").to_numpy(zero_copy_only=False) // span == np.repeat(node, size)
    ends = np.concatenate(([0], np.cumsum(stays)))[np.concatenate(([0], np.cumsum(size)))]
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), flat.filter(pa.array(stays)))


def first_steps(wants: list[tuple[str, int]], children: int, span: int, names: list[str]):
    """From requests with their counts at the root (``running``, ``starts``) and a column per
    wanted label: a row per request and label, sent to its child of the root."""

    def matrix(column: pa.ListArray, width: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            running = matrix(batch.column("running"), children + 1)
            starts = matrix(batch.column("starts"), children)
            every = np.arange(batch.num_rows)
            for label, kind in wants:
                x = batch.column(label).to_numpy(zero_copy_only=False).astype(float)
                if kind == RANK:
                    child = (running <= x[:, None]).sum(1) - 1
                    x, base = x - running[every, child], np.zeros(len(x), np.int64)
                else:
                    # Empty children at the end start at infinity: nothing is found there.
                    at = np.minimum(x, np.finfo(float).max)[:, None]
                    before = starts < at if kind == BELOW else starts <= at
                    child = np.maximum(before.sum(1) - 1, 0)
                    base = running[every, child]
                made = {
                    "own": _kept_own(batch.column("own"), child, span),
                    "label": pa.array([label] * len(x), pa.string()),
                    "kind": pa.array(np.full(len(x), kind, np.int32)),
                    "x": pa.array(x),
                    "base": pa.array(base, pa.int64()),
                    "node": pa.array(child, pa.int64()),
                }
                columns = [made[n] if n in made else batch.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def running_counts(area_tolerance: float, year_tolerance: int, children: int, span: int, names: list[str]):
    """Adds ``running`` to the requests at the root: matches before each child, and in all."""

    def run(requests: pa.Table, cells: pa.Table) -> pa.Table:
        counts = np.zeros((requests.num_rows, children), np.int64)
        if cells.num_rows and requests.num_rows:
            reach = Reach(requests, area_tolerance, year_tolerance)
            counts = child_counts(requests, reach, cells, 0, children, span)
        running = np.concatenate((np.zeros((len(counts), 1), np.int64), counts.cumsum(1)), 1)
        lists = pa.ListArray.from_arrays(np.arange(len(counts) + 1, dtype=np.int32) * (children + 1), running.ravel())
        return requests.select(names).append_column("running", lists)

    return run


def descend(area_tolerance: float, year_tolerance: int, children: int, span: int, names: list[str]):
    """Send every request from its node to the child that holds what it wants."""

    def run(requests: pa.Table, cells: pa.Table) -> pa.Table:
        if not requests.num_rows or not cells.num_rows:
            return requests.select(names).slice(0, 0)
        first = int(array(requests, "node")[0]) * children
        counts = child_counts(requests, Reach(requests, area_tolerance, year_tolerance), cells, first, children, span)
        running = np.concatenate((np.zeros((len(counts), 1), np.int64), counts.cumsum(1)), 1)
        kind, x, base = (array(requests, c) for c in ("kind", "x", "base"))
        starts = np.full(children, np.inf)
        np.minimum.at(starts, array(cells, "child") - first, array(cells, "lo"))
        starts = np.minimum.accumulate(starts[::-1])[::-1]  # an empty child starts where the next does
        by_rank = (running <= x[:, None]).sum(1) - 1
        below = starts.searchsorted(x, "left") - 1
        up_to = starts.searchsorted(np.minimum(x, np.finfo(float).max), "right") - 1
        to = np.clip(np.select([kind == RANK, kind == BELOW], [by_rank, below], up_to), 0, children - 1)
        before = running[np.arange(len(to)), to]
        moved = {
            "own": _kept_own(requests.column("own").combine_chunks(), first + to, span),
            "node": pa.array(first + to, pa.int64()),
            "x": pa.array(np.where(kind == RANK, x - before, x)),
            "base": pa.array(np.where(kind == RANK, base, base + before)),
        }
        return pa.table([moved.get(n, requests.column(n)) for n in names], names)

    return run


def page_answers(area_tolerance: float, year_tolerance: int):
    """Per request the price at its rank within one page of comps, or its count."""

    def answers(requests: pa.Table, page: pa.Table) -> Iterator[np.ndarray]:
        page = page.sort_by([(c, "ascending") for c in ("psf", "living_area", "year_built", "tercile")])
        area, year, psf = (array(page, c).astype(float) for c in ("living_area", "year_built", "psf"))
        tercile, weight = array(page, "tercile"), array(page, "w").astype(np.int64)
        for at in range(0, requests.num_rows, ROWS_AT_ONCE):
            some = requests.slice(at, ROWS_AT_ONCE)
            reach = Reach(some, area_tolerance, year_tolerance)
            rows = np.arange(some.num_rows)[:, None]
            found = np.where(reach.holds(rows, area, year, tercile), weight, 0)
            owner, own = _own(some)
            mine = reach.holds(owner, own["living_area"], own["year_built"], own["tercile"])
            mine &= own["page"] == array(some, "node")[owner]
            # Any place among equal prices does: only prices and counts are asked for.
            place = psf.searchsorted(own["psf"][mine], "left")
            np.subtract.at(found, (owner[mine], place), 1)
            running = np.concatenate((np.zeros((len(found), 1), np.int64), found.cumsum(1)), 1)
            np.maximum.accumulate(running, 1, out=running)  # it may dip inside equal prices
            kind, x, base = (array(some, c) for c in ("kind", "x", "base"))
            rank_at = np.minimum((running[:, 1:] <= x[:, None]).sum(1), len(psf) - 1)
            until = np.where(kind == BELOW, psf.searchsorted(x, "left"), psf.searchsorted(x, "right"))
            yield np.where(kind == RANK, psf[rank_at], base + running[rows[:, 0], until])

    def run(requests: pa.Table, page: pa.Table) -> pa.Table:
        kept = requests.select(["lookup", "band", "label"])
        if not page.num_rows or not requests.num_rows:
            return kept.slice(0, 0).append_column("value", pa.array([], pa.float64()))
        return kept.append_column("value", pa.array(np.concatenate(list(answers(requests, page)))))

    return run


# -- spans of prices that the lookups of one rectangle share --------------------------------


def _reached(kind: np.ndarray, lo: np.ndarray, hi: np.ndarray, running: np.ndarray, starts: np.ndarray):
    """Rows and children that spans meet, given the matches before each child (and after the
    last) and the children's least prices. The first child of a span of prices is met even
    without a match: it knows the place where the span begins."""
    lo, hi, places = lo[:, None], hi[:, None], (kind == PLACES)[:, None]
    edges = np.where(places, running[:, :-1], starts)
    first = np.maximum(np.where(places, edges <= lo, edges < lo).sum(1) - 1, 0)[:, None]
    last = np.maximum((edges <= hi).sum(1)[:, None] - 1, first)
    child = np.arange(running.shape[1] - 1)
    matched = (np.diff(running, axis=1) > 0) | (~places & (child == first))
    return np.nonzero((child >= first) & (child <= last) & matched)


def first_spans(wants: list[tuple[str, int]], children: int, names: list[str]):
    """From rectangles with their counts at the root, and the ends of every wanted label
    (``<label>_lo``, ``<label>_hi``): a row per label and child of the root that it meets."""

    def matrix(column: pa.ListArray, width: int) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            running = matrix(batch.column("running"), children + 1)
            starts = matrix(batch.column("starts"), children)
            for label, kind in wants:
                lo, hi = (batch.column(f"{label}_{end}").to_numpy(zero_copy_only=False) for end in ("lo", "hi"))
                rows, child = _reached(np.full(len(lo), kind), lo, hi, running, starts)
                made = {
                    "label": pa.array([label] * len(rows), pa.string()),
                    "kind": pa.array(np.full(len(rows), kind, np.int32)),
                    "lo": pa.array(lo[rows]),
                    "hi": pa.array(hi[rows]),
                    "base": pa.array(running[rows, child], pa.int64()),
                    "node": pa.array(child, pa.int64()),
                }
                columns = [made[n] if n in made else batch.column(n).take(pa.array(rows)) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def descend_spans(area_tolerance: float, year_tolerance: int, children: int, span: int, names: list[str]):
    """Send every span from its node to the children that it meets."""

    def run(requests: pa.Table, cells: pa.Table) -> pa.Table:
        if not requests.num_rows or not cells.num_rows:
            return requests.select(names).slice(0, 0)
        first = int(array(requests, "node")[0]) * children
        counts = child_counts(requests, Reach(requests, area_tolerance, year_tolerance), cells, first, children, span)
        running = np.concatenate((np.zeros((len(counts), 1), np.int64), counts.cumsum(1)), 1)
        running += array(requests, "base")[:, None]
        starts = np.full(children, np.inf)
        np.minimum.at(starts, array(cells, "child") - first, array(cells, "lo"))
        starts = np.minimum.accumulate(starts[::-1])[::-1]  # an empty child starts where the next does
        rows, child = _reached(*(array(requests, c) for c in ("kind", "lo", "hi")), running, starts)
        moved = {"node": pa.array(first + child, pa.int64()), "base": pa.array(running[rows, child], pa.int64())}
        kept = requests.take(pa.array(rows))
        return pa.table([moved.get(n, kept.column(n)) for n in names], names)

    return run


def page_spans(area_tolerance: float, year_tolerance: int, names: list[str]):
    """What one page of comps holds of every span: the place of its first price (``pos``), the
    prices in order and how often each occurs."""

    def pieces(requests: pa.Table, page: pa.Table) -> Iterator[pa.Table]:
        page = page.sort_by("psf")
        area, year, psf = (array(page, c).astype(float) for c in ("living_area", "year_built", "psf"))
        tercile, weight = array(page, "tercile"), array(page, "w").astype(np.int64)
        for at in range(0, requests.num_rows, ROWS_AT_ONCE):
            some = requests.slice(at, ROWS_AT_ONCE)
            kind, lo, hi = (array(some, c)[:, None] for c in ("kind", "lo", "hi"))
            rows = np.arange(some.num_rows)[:, None]
            reach = Reach(some, area_tolerance, year_tolerance)
            found = np.where(reach.holds(rows, area, year, tercile), weight, 0)
            until = found.cumsum(1) + array(some, "base")[:, None]
            by_place = np.minimum(until, hi + 1) - np.maximum(until - found, lo)
            by_price = np.where((psf >= lo) & (psf <= hi), found, 0)
            taken = np.where(kind == PLACES, np.maximum(by_place, 0), by_price).astype(np.int64)
            before = np.where(psf < lo, found, 0).sum(1) + array(some, "base")
            pos = np.where(kind == PLACES, np.maximum(lo, array(some, "base")[:, None]), before[:, None])[:, 0]
            row, column = np.nonzero(taken)
            ends = np.concatenate(([0], np.cumsum(np.bincount(row, minlength=some.num_rows)))).astype(np.int32)
            made = {
                "pos": pa.array(pos.astype(np.int64)),
                "psf": pa.ListArray.from_arrays(ends, psf[column]),
                "w": pa.ListArray.from_arrays(ends, taken[row, column]),
            }
            yield pa.table([made[n] if n in made else some.column(n) for n in names], names)

    def run(requests: pa.Table, page: pa.Table) -> pa.Table:
        if not page.num_rows or not requests.num_rows:
            empty = {"pos": pa.int64(), "psf": pa.list_(pa.float64()), "w": pa.list_(pa.int64())}
            return pa.table([pa.array([], empty.get(n) or requests.schema.field(n).type) for n in names], names)
        return pa.concat_tables(pieces(requests, page))

    return run


class Spans:
    """Prices in order, those of every row from a known place of the row's whole order on."""

    def __init__(self, pieces: pa.Table, row: np.ndarray, rows: int):
        pos = array(pieces, "pos")
        order = np.lexsort((pos, row))
        psf, w = (pieces.column(c).combine_chunks().take(pa.array(order)) for c in ("psf", "w"))
        sizes = psf.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.prices = psf.flatten().to_numpy(zero_copy_only=False)
        self.near = np.unique(self.prices)
        self.width = len(self.near) + 1
        self.place = np.repeat(row[order], sizes) * self.width + self.near.searchsorted(self.prices)
        self.running = np.concatenate(([0], np.cumsum(w.flatten().to_numpy(zero_copy_only=False)))).astype(np.int64)
        ends = self.place.searchsorted(np.arange(rows + 1) * self.width)
        self.begin, self.end = ends[:-1], ends[1:]
        self.first = np.full(rows, np.iinfo(np.int64).max)
        np.minimum.at(self.first, row, pos)

    def below(self, row: np.ndarray, x: np.ndarray, side: str) -> np.ndarray:
        """Places before a price inside the span; before the span its first place, after it the
        place after its last."""
        at = self.place.searchsorted(row * self.width + self.near.searchsorted(x, side))
        return self.first[row] + self.running[at] - self.running[self.begin[row]]

    def price(self, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        if not len(self.prices):
            return np.full(len(place), np.nan)
        among = self.running[self.begin[row]] + place - self.first[row]
        at = self.running[1:].searchsorted(among, "right")
        return self.prices[np.clip(at, self.begin[row], np.maximum(self.end[row] - 1, self.begin[row])).clip(max=len(self.prices) - 1)]


def _spanned(row: np.ndarray, total: np.ndarray, spans: dict[str, Spans], who, own, multiplier: float) -> list[np.ndarray]:
    """n, median, q1 and q3 as ``Runs.summaries`` gives them, per lookup of a rectangle ``row``
    with ``total`` comps, less its ``own`` prices (of lookup ``who``, in price order). The
    quartiles differ. A span begins at or before every place asked for, and goes on past it by as
    many as a lookup's own sales, unless all prices end before: so own prices outside the span are
    rightly taken as before or after all of it."""
    own_count = np.bincount(who, minlength=len(row))
    before = np.arange(len(who)) - np.concatenate(([0], np.cumsum(own_count)))[who]
    fresh = np.ones(len(who), bool)
    fresh[1:] = (who[1:] != who[:-1]) | (own[1:] != own[:-1])
    lower = before[np.flatnonzero(fresh)[np.cumsum(fresh) - 1]] if len(who) else before
    free = {label: spans[label].below(row[who], own, "left") - lower for label in spans}

    def left_out(chosen: np.ndarray) -> np.ndarray:
        return np.bincount(who[chosen], minlength=len(row))

    def price(label: str):
        return lambda rank: spans[label].price(row, rank + left_out(free[label] <= rank[who]))

    none, n = np.zeros(len(row), np.int64), total[row] - own_count
    q1, q3 = (interpolated(price(label), none, n, p) for label, p in (("q1", 0.25), ("q3", 0.75)))
    low, high = q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)
    start = spans["low"].below(row, low, "left") - left_out(own < low[who])
    stop = spans["high"].below(row, high, "right") - left_out(own <= high[who])
    kept = np.where(n > 0, stop - start, 0)
    inside = (("in_median", 0.5), ("in_q1", 0.25), ("in_q3", 0.75))
    return [kept, *(np.where(n > 0, interpolated(price(label), start, kept, p), np.nan) for label, p in inside)]


def shared_summaries(multiplier: float, names: list[str], columns: list[str]):
    """Per lookup the statistics of all its comps and of those of its tercile, from the spans of
    prices of its rectangle; a label ``n`` gives the rectangle's number of comps (``pos``)."""

    def run(lookups: pa.Table, pieces: pa.Table) -> pa.Table:
        label = np.array(pieces.column("label").to_pylist(), dtype=object)
        counted = pieces.filter(pa.array(label == "n", pa.bool_()))
        counted = counted.sort_by("lookup")
        ids, total = array(counted, "lookup"), array(counted, "pos")
        corners = zip(*(counted.column(c).to_pylist() for c in ("living_area", "year_built", "band")), strict=True)
        number = {corner: i for i, corner in enumerate(corners)}
        spans = {}
        for name in ("q1", "q3", "low", "high", "in_q1", "in_median", "in_q3"):
            some = pieces.filter(pa.array(label == name, pa.bool_()))
            row = ids.searchsorted(array(some, "lookup"))
            known = row < len(ids)
            known[known] = ids[row[known]] == array(some, "lookup")[known]
            spans[name] = Spans(some.filter(pa.array(known, pa.bool_())), row[known], len(ids))
        who, own = _own(lookups)
        in_order = np.lexsort((own["psf"], who))
        who, psf, tercile = who[in_order], own["psf"][in_order], own["tercile"][in_order]
        areas, years = (lookups.column(c).to_pylist() for c in ("living_area", "year_built"))
        results = []
        for bands in (np.full(lookups.num_rows, -1), array(lookups, "tercile")):
            at = np.array([number.get(c, -1) for c in zip(areas, years, bands.tolist(), strict=True)], np.int64)
            here = at >= 0
            mine = here[who] & ((bands[who] < 0) | (tercile == bands[who]))
            place = np.cumsum(here) - 1
            values = _spanned(at[here], total, spans, place[who[mine]], psf[mine], multiplier)
            for value in values:
                results.append(np.full(lookups.num_rows, np.nan))
                results[-1][here] = value
            results[-len(values)][~here] = 0
            if len(results) > len(values):  # a lookup without a tercile has no band
                for result in results[len(values) :]:
                    result[bands < 0] = np.nan
                results[len(values)][bands < 0] = 0
        kept = lookups.select(names)
        for name, values in zip(columns, results, strict=True):
            kind = pa.int64() if name.endswith("_n") else pa.float64()
            kept = kept.append_column(name, pa.array(values, from_pandas=True).cast(kind))
        return kept

    return run


# -- neighbourhoods that one task can hold -------------------------------------------------


def interpolated(price: Callable[[np.ndarray], np.ndarray], start: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
    """A quantile of the ``n`` prices from rank ``start`` on, linearly interpolated, from the nearer
    end as numeric libraries do it."""
    n = np.maximum(n, 1)
    position = p * (n - 1)
    whole = np.floor(position).astype(np.int64)
    share = position - whole
    low, high = price(start + whole), price(start + np.minimum(whole + 1, n - 1))
    if p == 0.5:
        return np.where(share == 0, low, (low + high) / 2.0)
    return np.where(share < 0.5, low + (high - low) * share, high - (high - low) * (1 - share))


class Runs:
    """The prices of several rectangles, each in order and weighted, with lookups into them.

    Rectangles are rows of ``found`` over the points ``prices``, which are in price order. A
    lookup is a rectangle (``row``) less its own sales: of lookup ``who``, ``own`` prices with
    ``times`` sales each, in price order. Rows are answered together, and lookups of one
    rectangle share its prices: a rank among what is left is a rank among all, moved up by the
    own sales before it.
    """

    def __init__(self, found: np.ndarray, prices, weight, row, who, own, times):
        self.row, self.who, self.own, self.times = row, who, own, times
        rows, at = np.nonzero(found)
        self.width, self.near, self.prices = len(prices), prices, prices[at]
        self.place = rows * self.width + at
        self.running = np.concatenate(([0], np.cumsum(weight[at])))
        ends = np.cumsum(np.bincount(rows, minlength=len(found)))
        self.base = self.running[np.concatenate(([0], ends[:-1]))][row]
        self.size = self.running[ends][row] - self.base - self._own(np.ones(len(who), bool))
        # Own sales of one price stand together, after the own sales of lower prices.
        before = np.concatenate(([0], np.cumsum(times)))[:-1]
        fresh = np.ones(len(who), bool)
        fresh[1:] = (who[1:] != who[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        starts = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=len(row)))))[who]
        self.free = self._below(row[who], own, "left") - self.base[who] - (before[first] - before[starts])

    def _own(self, chosen: np.ndarray) -> np.ndarray:
        return np.bincount(self.who, np.where(chosen, self.times, 0), len(self.row)).astype(np.int64)

    def _below(self, row: np.ndarray, x: np.ndarray, side: str) -> np.ndarray:
        return self.running[self.place.searchsorted(row * self.width + self.near.searchsorted(x, side))]

    def _price(self, rank: np.ndarray) -> np.ndarray:
        if not len(self.prices):
            return np.full(len(rank), np.nan)
        among_all = self.base + rank + self._own(self.free <= rank[self.who])
        return self.prices[np.minimum(self.running[1:].searchsorted(among_all, "right"), len(self.prices) - 1)]

    def _quantile(self, start: np.ndarray, n: np.ndarray, p: float) -> np.ndarray:
        return interpolated(self._price, start, n, p)

    def summaries(self, multiplier: float) -> list[np.ndarray]:
        """n, median, q1 and q3 per lookup, inside its quartile fences, bounds included; of all
        its prices where the quartiles coincide. Without any price n is 0."""
        none = np.zeros(len(self.row), np.int64)
        q1, q3 = self._quantile(none, self.size, 0.25), self._quantile(none, self.size, 0.75)
        span = q3 - q1
        low = np.where(span > 0, q1 - multiplier * span, -np.inf)
        high = np.where(span > 0, q3 + multiplier * span, np.inf)
        start = self._below(self.row, low, "left") - self.base - self._own(self.own < low[self.who])
        stop = self._below(self.row, high, "right") - self.base - self._own(self.own <= high[self.who])
        some = self.size > 0
        kept = np.where(some, stop - start, 0)
        return [kept, *(np.where(some, self._quantile(start, kept, p), np.nan) for p in (0.5, 0.25, 0.75))]


def whole_summaries(area_tolerance: float, year_tolerance: int, multiplier: float, names: list[str], columns: list[str]):
    """Per lookup the statistics of all its comps and of those of its tercile (``band``), from
    all points of the neighbourhood: comps alike in area, year, tercile and price, ``w`` of them.
    Lookups of one area and year share the prices within their reach."""

    def run(lookups: pa.Table, comps: pa.Table) -> pa.Table:
        comps = comps.sort_by("psf")
        area, year, psf = (array(comps, c).astype(float) for c in ("living_area", "year_built", "psf"))
        tercile, weight = array(comps, "tercile"), array(comps, "w").astype(np.int64)
        reach = Reach(lookups, area_tolerance, year_tolerance)
        results = [np.full(lookups.num_rows, np.nan) for _ in columns]
        who, own = _own(lookups)
        in_order = np.lexsort((own["psf"], who))
        who, own = who[in_order], {c: values[in_order] for c, values in own.items()}
        mine = (own["living_area"] >= reach.low[who]) & (own["living_area"] <= reach.high[who])
        mine &= (own["year_built"] >= reach.first[who]) & (own["year_built"] <= reach.last[who])
        who, own = who[mine], {c: values[mine] for c, values in own.items()}
        starts = np.concatenate(([0], np.cumsum(np.bincount(who, minlength=lookups.num_rows))))
        order = np.lexsort((reach.year, reach.area))
        for same in np.split(order, np.flatnonzero(np.diff(reach.area[order])) + 1) if len(order) else []:
            near = np.flatnonzero((area >= reach.low[same[0]]) & (area <= reach.high[same[0]]))
            years, at = np.unique(reach.year[same], return_inverse=True)
            for part in np.array_split(np.arange(len(years)), -(-len(years) * max(len(near), 1) // PAIRS_AT_ONCE)):
                if not len(part):
                    continue
                asked = same[(at >= part[0]) & (at <= part[-1])]
                row = at[(at >= part[0]) & (at <= part[-1])] - part[0]
                low, high = years[part, None] - year_tolerance, years[part, None] + year_tolerance
                found = (year[near] >= low) & (year[near] <= high)
                sizes = starts[asked + 1] - starts[asked]
                sales = np.arange(sizes.sum()) + np.repeat(starts[asked] - (np.cumsum(sizes) - sizes), sizes)
                owner = np.repeat(np.arange(len(asked)), sizes)
                price, times, kind = own["psf"][sales], own["w"][sales], own["tercile"][sales]
                every = Runs(found, psf[near], weight[near], row, owner, price, times).summaries(multiplier)
                for result, values in zip(results, every, strict=False):
                    result[asked] = values
                results[len(every)][asked] = 0
                band = reach.band[asked]
                for one in np.unique(band[band >= 0]):
                    here = band == one
                    points, inside = near[tercile[near] == one], tercile[near] == one
                    held = here[owner] & (kind == one)
                    number = np.cumsum(here) - 1
                    banded = Runs(
                        found[:, inside], psf[points], weight[points], row[here], number[owner[held]], price[held], times[held]
                    )
                    for result, values in zip(results[len(every) :], banded.summaries(multiplier), strict=True):
                        result[asked[here]] = values
        kept = lookups.select(names)
        for name, values in zip(columns, results, strict=True):
            kind = pa.int64() if name.endswith("_n") else pa.float64()
            kept = kept.append_column(name, pa.array(values, from_pandas=True).cast(kind))
        return kept

    return run
