"""Fingerprints of texts under edits, by a randomised edit embedding.

A walk reads a text once: at every step it writes the character it stands on and moves on
or stays, as a random bit shared by all texts for this step and character says. Texts at a
small edit distance soon walk in step again, so edit distance becomes Hamming distance
between the written strings. Of those only shared sampled steps are kept, more thinly the
further out, and of each a few bits: that is the fingerprint. Bands of places sampled all over it
find candidates and its likeness verifies them.

All texts of a batch walk together, one array operation per step.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotscope.llm import jaccard
from plotscope.llm.common import cut_lineage, small_slices, written
from plotscope.llm.components import component_labels, joined_labels
from plotscope.llm.shingles import mix, wrapped

SEED = 20240607
#: The first steps are all kept, then so many of every doubling of the steps.
FIRST_STEPS = 64
PER_LEVEL = 32
LEVELS = 40
#: Characters that walk together: bounds the memory of a task.
WALK_CHARS = 1 << 24
#: Rows of one range of keys, and most ranges.
RANGE_ROWS = 128
MOST_RANGES = 4096
#: Sampled characters per band, bands per end, and ends that a print is banded for. A pair at
#: the least likeness of 0.8 agrees in 0.19 of such bands, so one of 18 meets in 97 of 100.
BAND = 8
BANDS = 6
ENDS = 3
#: Last characters of a fingerprint that rule pairs out before whole fingerprints travel.
TAIL = 32
#: Up to so many classes of several rows their table is broadcast; beyond, joined by shuffle.
FEW_CLASSES = 1_000_000

_CLASSES = 64
_HEX = np.frombuffer(b"0123456789abcdef", np.uint8)


def sampled_steps() -> np.ndarray:
    """The steps that are kept, ascending; the same for all texts."""
    rng = np.random.default_rng(SEED)
    steps = [np.arange(FIRST_STEPS)]
    for level in range(LEVELS):
        low = FIRST_STEPS << level
        steps.append(np.sort(low + rng.choice(min(low, 1 << 30), PER_LEVEL, replace=False) * max(1, low >> 30)))
    return np.concatenate(steps)


class Walk:
    """Shared randomness: moves per step and class of characters, and the bits kept."""

    def __init__(self):
        self.steps = sampled_steps()
        self.kept = np.random.default_rng(SEED + 1).integers(0, 16, (len(self.steps), _CLASSES + 1), dtype=np.uint8)

    def moves(self, block: int, size: int) -> np.ndarray:
        """Moves of ``size`` steps: 0 or 1 per class; past the end of a text none."""
        table = np.random.default_rng([SEED + 2, block]).integers(0, 2, (size, _CLASSES + 1), dtype=np.int64)
        table[:, _CLASSES] = 0
        return table

    def fingerprints(self, texts: Sequence[str]) -> list[str]:
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        flat = np.full(int(lengths.sum()) + len(texts), _CLASSES, np.uint8)
        for text, end, n in zip(texts, ends, lengths, strict=True):
            points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
            flat[end - n : end] = (points * np.uint32(0x9E3779B1)) >> np.uint32(26)
        at, live = ends - lengths, np.flatnonzero(lengths)
        kept: list[tuple[np.ndarray, np.ndarray]] = []
        step, slot, size = 0, 0, 512
        place, stop = at[live], ends[live]
        while len(live):
            moves = self.moves(step // size, size)
            for i in range(size):
                here = flat[place]
                if self.steps[slot] == step + i:
                    on = place < stop
                    kept.append((live[on], self.kept[slot][here[on]]))
                    slot += 1
                place += moves[i][here]
            step += size
            on = place < stop
            live, place, stop = live[on], place[on], stop[on]
        prints = np.zeros((len(kept), len(texts)), np.uint8)
        width = np.zeros(len(texts), np.int64)
        for row, (which, symbols) in enumerate(kept):
            prints[row, which] = _HEX[symbols]
            width[which] = row + 1
        columns = np.ascontiguousarray(prints.T)
        return [columns[i, :w].tobytes().decode("ascii") for i, w in enumerate(width)]


def _level(slot: np.ndarray) -> np.ndarray:
    return np.maximum(0, (slot - FIRST_STEPS) // PER_LEVEL + 1)


def _weights(slots: np.ndarray) -> np.ndarray:
    """Steps that each sampled one stands for."""
    return np.where(slots < FIRST_STEPS, 1.0, (FIRST_STEPS / PER_LEVEL) * 2.0 ** (_level(slots) - 1))


def likeness(a: str, b: str) -> float:
    """Share of equal steps of the longer walk, estimated from the sample and corrected
    for the bits that agree by chance: 1 for equal prints, about 0 for unrelated ones."""
    longer = max(len(a), len(b))
    if a == b:
        return 1.0
    if not longer or not min(len(a), len(b)):
        return 0.0
    shorter = min(len(a), len(b))
    weight = _weights(np.arange(longer))
    left, right = (np.frombuffer(x[:shorter].encode("ascii"), np.uint8) for x in (a, b))
    same = float(weight[:shorter][left == right].sum()) / float(weight.sum())
    return max(0.0, (same - 1 / 16) / (1 - 1 / 16))


def edited(text: str, follower: str) -> str:
    """The last third of the text replaced by as much of the follower's beginning."""
    cut = len(text) // 3
    return text[: len(text) - cut] + follower[:cut]


class Bands:
    """Bands of fingerprints: each a few places, drawn as often as the steps they stand for,
    so that a beginning that many texts share fills no band alone.

    The places of a band lie before an end. Ends are a quarter of a doubling of the steps
    apart, and a print has the bands of the last few ends before its own: of two alike prints
    the shorter has at least 13/16 of the longer one's steps, so they share an end. Bands of
    short prints have fewer places.
    """

    def __init__(self):
        most = FIRST_STEPS + PER_LEVEL * LEVELS
        fine = [e for low in (8, 16, 32) for e in range(low, 2 * low, low // 4)]
        self.ends = np.array([*range(1, 8), *fine, *range(FIRST_STEPS, most + 1, PER_LEVEL // 4)])
        self._drawn: dict[int, np.ndarray] = {}

    def places(self, end: int) -> np.ndarray:
        """The places of all bands of an end, one row a band; the same for all prints."""
        if end not in self._drawn:
            weight = _weights(np.arange(end))
            rng = np.random.default_rng([SEED + 3, end])
            size = min(BAND, max(1, 3 * end // 8))
            drawn = [rng.choice(end, size, replace=False, p=weight / weight.sum()) for _ in range(BANDS)]
            self._drawn[end] = np.array(drawn)
        return self._drawn[end]

    def keys(self, prints: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Bands as 64-bit hashes of end, number and symbols, and the print each is of."""
        sizes = np.array([len(p) for p in prints], np.int64)
        flat = np.frombuffer("".join(prints).encode("ascii"), np.uint8)
        starts = np.cumsum(sizes) - sizes
        last = np.searchsorted(self.ends, sizes, side="right") - 1
        found, owners = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
        for at in np.unique(last):
            of = np.flatnonzero(last == at)
            for end in self.ends[max(0, at - ENDS + 1) : at + 1].tolist():
                for number, places in enumerate(self.places(end)):
                    key = np.full(len(of), wrapped(end * BANDS + number), np.uint64)
                    for place in places.tolist():
                        key = mix(key * np.uint64(31) + flat[starts[of] + place])
                    found.append(key)
                    owners.append(of)
        return np.concatenate(found), np.concatenate(owners)


def band_postings(sets: DataFrame) -> DataFrame:
    """The bands of every fingerprint, as rows (key, name)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands()
        for batch in batches:
            keys, owners = bands.keys(batch.column(1).to_pylist())
            names = batch.column(0).to_numpy()[owners]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(names)], ["key", "name"])

    return sets.select("name", "fingerprint").mapInArrow(run, "key BIGINT, name BIGINT")


def _ranges(ids: DataFrame) -> list[int]:
    """Descending bounds that deal the keys into ranges of some hundred rows."""
    n = ids.count()
    wanted = min(MOST_RANGES, n // RANGE_ROWS)
    if wanted < 2:
        return []
    shares = [i / wanted for i in range(1, wanted)]
    return sorted({int(x) for x in ids.approxQuantile("doc_id", shares, 0.25 / wanted)}, reverse=True)


def _range_of(bounds: list[int]) -> F.Column:
    """Number of bounds above the key: found in a coarse list, then in one block of it."""
    if not bounds:
        return F.lit(0)
    side = max(1, int(len(bounds) ** 0.5))
    blocks = [bounds[i : i + side] for i in range(0, len(bounds), side)]
    longs = lambda xs: "array(" + ", ".join(f"{x}L" for x in xs) + ")"
    coarse = longs(b[0] for b in blocks)
    fine = "array(" + ", ".join(longs(b) for b in blocks) + ")"
    block = f"greatest(size(filter({coarse}, b -> b > doc_id)) - 1, 0)"
    found = f"{block} * {side} + size(filter(get({fine}, {block}), b -> b > doc_id))"
    return F.expr(f"CASE WHEN doc_id IS NULL THEN {len(bounds)} ELSE {found} END")


def _packed(rows: DataFrame, pack: bool) -> DataFrame:
    """Rows (range, tail, doc_id, text) with the text packed for the way, or unpacked again."""
    code = (lambda t: zlib.compress(t.encode("utf-8", "surrogatepass"), 1)) if pack else (lambda b: zlib.decompress(b))
    kind = pa.binary() if pack else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            texts = pa.array([code(t) for t in batch.column(3).to_pylist()], pa.binary()).cast(kind)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], texts], names=batch.schema.names)

    form = f"range INT, tail INT, doc_id BIGINT, text {'BINARY' if pack else 'STRING'}"
    return rows.select(F.col("range").cast("int"), F.col("tail").cast("int"), "doc_id", "text").mapInArrow(run, form)


def with_followers(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Rows (range, tail, doc_id, text), to be read in this order within their partition:
    each is followed by the next document in descending key order.

    Only whole ranges of keys move, once, their texts packed. The last row of a range is followed by a copy of
    the first one of the next range, marked ``tail``; the last range by the very first.
    Equal keys are ordered by text, null keys come last.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    bounds = _ranges(rows.select("doc_id").filter("doc_id IS NOT NULL"))
    dealt = rows.withColumn("range", _range_of(bounds))
    top = cut_lineage(dealt.groupBy("range").agg(F.max("doc_id").alias("top")))
    order = sorted(r["range"] for r in top.select("range").collect())
    before = dict(zip(order, [order[-1], *order[:-1]], strict=True)) if order else {}
    follows = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else None
    # There is one row per range in ``top``, and there are at most MOST_RANGES.
    heads = dealt.join(
        F.broadcast(top.withColumnRenamed("range", "of")),
        (F.col("range") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("top")),
    )
    heads = heads.groupBy("range", "doc_id").agg(F.min("text").alias("text"))
    columns = ["range", "tail", "doc_id", "text"]
    every = dealt.withColumn("tail", F.lit(0)).select(*columns)
    if follows is not None:
        tails = heads.withColumn("range", follows[F.col("range")]).withColumn("tail", F.lit(1)).select(*columns)
        every = every.unionByName(tails)
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    moved = _packed(_packed(every, True).repartition(parts, "range"), False)
    return moved.sortWithinPartitions(
        "range", "tail", F.col("doc_id").desc_nulls_last(), "text"
    )


def _pieces(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """Rows of a batch in runs of bounded length."""
    rows, size = [], 0
    for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
        rows.append(row)
        size += len(row[3])
        if size >= WALK_CHARS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def edit_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited form, and their likeness.

    The edited form has the last third of its code points replaced by the first as many
    (or all) of the next document in descending key order; the last is followed by the
    first. Returns the key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited and near_next (likeness to the edited form's and the next document's).
    Null texts count as empty; an empty text has an empty fingerprint. Equal keys are
    ordered by text, null keys come last. Repeated rows are kept; a lone document follows
    itself. Equal texts have equal fingerprints.
    """
    out = T.StructType.fromDDL(
        "doc_id BIGINT, n_chars BIGINT, edited_sha256 STRING, fingerprint STRING, edited_fingerprint STRING,"
        " near_edited DOUBLE, near_next DOUBLE"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, held = Walk(), []
        for batch in batches:
            for rows in _pieces(batch):
                rows = held + rows
                held = rows[-1:]
                changed = {}
                for i, (row, after) in enumerate(zip(rows, rows[1:], strict=False)):
                    if not row[1] and row[0] == after[0]:
                        changed[i] = edited(row[3], after[3])
                prints = walk.fingerprints([r[3] for r in rows] + list(changed.values()))
                made = dict(zip(changed, prints[len(rows) :], strict=True))
                found = [
                    (
                        rows[i][2],
                        len(rows[i][3]),
                        hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(),
                        prints[i],
                        made[i],
                        likeness(prints[i], made[i]),
                        likeness(prints[i], prints[i + 1]),
                    )
                    for i, new in changed.items()
                ]
                columns = list(zip(*found, strict=True)) or [()] * len(out.names)
                kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
                arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    found = with_followers(docs, key, text).mapInArrow(run, out)
    return found.withColumnRenamed("doc_id", key)


class Tails:
    """Sizes and last characters of some fingerprints, those of one step in one column."""

    def __init__(self, sizes: np.ndarray, tails: Sequence[bytes], least: float):
        self.total = np.concatenate([[0.0], np.cumsum(_weights(np.arange(max(sizes, default=0))))])[sizes]
        raw = np.frombuffer(b"".join(tails), np.uint8).reshape(len(sizes), TAIL // 2)
        turn = (np.arange(TAIL) - sizes[:, None]) % TAIL
        self.symbols = np.take_along_axis(np.stack([raw >> 4, raw & 15], axis=2).reshape(-1, TAIL), turn, axis=1)
        self.slots = (sizes[:, None] - TAIL + turn).astype(np.int16)
        # Likeness is cut off at 0, and rounding must not lose a pair.
        self.most = 1 - (least * 15 / 16 + 1 / 16 - 1e-9) if least > 0 else 1.0

    def near(self, one: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the others whose likeness to ``one`` may be enough, and the share of
        steps in which they differ at least."""
        longer = np.maximum(self.total[others], self.total[one])
        lost = np.abs(self.total[others] - self.total[one]) / longer
        others, lost, longer = (x[lost <= self.most] for x in (others, lost, longer))
        differ = (self.slots[others] == self.slots[one]) & (self.symbols[others] != self.symbols[one])
        lost = lost + differ @ _weights(self.slots[one].astype(np.int64)) / longer
        return others[lost <= self.most], lost[lost <= self.most]


def _links(least: float):
    """Links between members of a tile that are in different components, one per two components."""

    def run(group: pa.Table) -> pa.Table:
        names, labels, side, sizes = (group[c].to_numpy() for c in ("name", "label", "side", "n"))
        weight = _weights(np.arange(int(sizes.max())))
        total = np.concatenate([[0.0], np.cumsum(weight)])[sizes]
        symbols = np.full((len(names), int(sizes.max())), 255, np.uint8)
        for row, print_ in zip(symbols, group["fingerprint"].to_pylist(), strict=True):
            row[: len(print_)] = np.frombuffer(print_.encode("ascii"), np.uint8)
        part = np.unique(labels, return_inverse=True)[1]
        left, far = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        found = []
        for place, i in enumerate(left):
            right = far if len(far) else left[place + 1 :]
            others = right[part[right] != part[i]]
            equal = symbols[others, : sizes[i]] == symbols[i, : sizes[i]]
            same = (equal @ weight[: sizes[i]]) / np.maximum(total[others], total[i])
            for j in others[np.maximum(0.0, (same - 1 / 16) / (1 - 1 / 16)) >= least]:
                if part[j] != part[i]:
                    part[part == part[j]] = part[i]
                    found.append((names[i], names[j]))
        columns = zip(*found, strict=True) if found else ((), ())
        return pa.table([pa.array(list(c), pa.int64()) for c in columns], names=["u", "v"])

    return run


def open_links(lists: DataFrame, labels: DataFrame, sets: DataFrame, least: float, tile: int) -> DataFrame:
    """Links (u, v) between members of a band that are in different components.

    The members outside the largest component of their band are compared, in tiles, with each
    other and with that component, whose members are not compared with each other. A tile
    has whole prints and gives at most one link per two of its components.
    """
    rows = lists.select("key", F.explode("members").alias("name"))
    rows = rows.join(labels.withColumnRenamed("node", "name"), "name", "left")
    rows = rows.withColumn("label", F.coalesce("label", "name"))
    parts = rows.groupBy("key", "label").agg(F.count("*").alias("many"))
    main = parts.groupBy("key").agg(
        F.max(F.struct("many", "label")).alias("main"), F.sum("many").alias("total"), F.count("*").alias("parts")
    )
    tiles = "CAST(({} + {} - 1) div {} AS INT)"
    main = main.filter("parts > 1").select(
        "key",
        F.col("main.label").alias("main"),
        F.expr(tiles.format("main.many", tile, tile)).alias("mains"),
        F.expr(tiles.format("total - main.many", tile, tile)).alias("rests"),
    )
    rows = rows.join(main, "key")
    own = rows.withColumn(
        "own", F.expr("CAST(pmod(xxhash64(name), IF(label = main, mains, rests)) AS INT)")
    )
    met = own.withColumn(
        "met",
        F.expr(
            "explode(IF(label = main,"
            " transform(sequence(0, rests - 1), i -> struct(1 AS kind, i AS a, own AS b, 1 AS side)),"
            " concat(transform(sequence(0, rests - 1),"
            " i -> struct(0 AS kind, least(own, i) AS a, greatest(own, i) AS b, IF(own <= i, 0, 1) AS side)),"
            " transform(sequence(0, mains - 1), i -> struct(1 AS kind, own AS a, i AS b, 0 AS side)))))"
        ),
    ).select("key", "met.*", "name", "label")
    met = met.join(sets.select("name", "n", "fingerprint"), "name")
    return met.groupBy("key", "kind", "a", "b").applyInArrow(_links(least), "u BIGINT, v BIGINT").distinct()


def _checked(alike):
    """The candidates of a leader that ``alike`` finds: it gets the place of the leader, sizes
    and prints, and says which rows stay."""

    def run(group: pa.Table) -> pa.Table:
        leader, names = group["leader"][0].as_py(), group["name"].to_pylist()
        kept = alike(names.index(leader), group["n"].to_numpy(), group["prints"].to_pylist()) if leader in names else []
        return jaccard._dealt(leader, group["block"][0].as_py(), sorted({names[i] for i in kept} - {leader}))

    return run


def _may_be_alike(least: float):
    return _checked(lambda at, sizes, tails: Tails(sizes, tails, least).near(at, np.arange(len(sizes)))[0])


def _alike(least: float):
    return _checked(lambda at, _, prints: [i for i, x in enumerate(prints) if likeness(prints[at], x) >= least])


def with_classes(prints: DataFrame, least: float = 0.8, key: str = "doc_id", tile: int = jaccard.TILE) -> DataFrame:
    """Adds ``class_id`` to rows with a fingerprint: the smallest key that links reach.

    Two documents link when their fingerprints share one of their ``Bands`` and their
    likeness is ``least`` or more. The members of a band are first verified against one
    leader; of those, what is then in different components is compared in tiles, so no link
    is lost. Documents with equal fingerprints are always together; an empty print is alike
    only to empty ones. Rows with a null key link nothing and have no class. Different
    fingerprints are told apart by 64-bit hashes. Other columns stay as they are; a column
    ``class_id`` is replaced.
    """
    rows = prints.filter(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("doc_id"), "fingerprint")
    sets = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"))
    n = "length(fingerprint)"
    sets = written(
        sets.select(
            F.xxhash64("fingerprint").alias("name"),
            F.expr(f"CAST({n} AS BIGINT)").alias("n"),
            F.expr(f"unhex(right(lpad(fingerprint, greatest({n}, {TAIL}), '0'), {TAIL}))").alias("sketch"),
            "fingerprint",
            "first_id",
            "rows",
        )
    )
    postings = band_postings(sets.filter("n > 0"))
    lists = cut_lineage(jaccard.merged_lists(cut_lineage(jaccard.shared_lists(postings, tile))))
    checks = (("sketch", _may_be_alike), ("fingerprint", _alike))
    stars = jaccard.verified_links(jaccard.star_pairs(lists), sets, least, checks=checks)
    labels = component_labels(cut_lineage(stars))
    more = cut_lineage(open_links(lists, labels, sets, least, tile))
    if not more.isEmpty():
        labels = joined_labels(labels, more)
    named = sets.select("name", "first_id", "rows").join(labels.withColumnRenamed("node", "name"), "name", "left")
    named = named.withColumn("label", F.coalesce("label", "name"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("class_id"))
    shared = named.join(smallest, "label").filter("rows > 1 OR class_id <> first_id")
    shared = cut_lineage(shared.select(F.col("name").alias("print_name"), "class_id"))
    if shared.count() <= FEW_CLASSES:
        shared = F.broadcast(shared)
    # Rows travel in one column, so no name of theirs meets one of the classes.
    whole = prints.select(F.struct(*[prints[f"`{c}`"] for c in prints.columns]).alias("row"))
    found = whole.join(shared, F.xxhash64("row.fingerprint") == F.col("print_name"), "left")
    own_key = F.col(f"row.`{key}`")
    own = F.when(own_key.isNotNull(), F.coalesce("class_id", own_key.cast("long")))
    kept = [F.col(f"row.`{c}`").alias(c) for c in prints.columns if c != "class_id"]
    return found.select(*kept, own.alias("class_id"))


def near_classes(prints: DataFrame, least: float = 0.8, key: str = "doc_id") -> DataFrame:
    """Classes of documents with like fingerprints: the key and ``class_id`` of every row
    with a key, as ``with_classes`` finds them."""
    found = with_classes(prints.select(key, "fingerprint"), least, key).filter(F.col(key).isNotNull())
    return found.select(F.col(key).cast("long").alias(key), "class_id")
