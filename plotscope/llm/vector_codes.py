"""Vector codes by product quantization: Lloyd's rounds over two trees.

Vectors of whole numbers are cut into parts; each part position has a codebook of its own.
The vectors stay where they are, in blocks that a task holds one at a time. Per block and
part position a tree over the parts (boxes, cached sums and counts) is built once; each round
builds a tree over the codebook's entries, goes down both at once and drops pairs of nodes
whose least distance exceeds the largest distance to another one. A node of parts that is
left with one entry goes to it whole, by its cached sum; the parts of leaves that are left
with several are decided one by one in integers. Only sums per entry leave the tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from plotscope.llm.common import cut_lineage
from plotscope.llm.topk import quantized, usable

PARTS = 8
ENTRIES = 16
ROUNDS = 6
SCALE = 4096
#: Parts of a leaf, about; vectors of a block, and numbers in one that bound it for long vectors.
LEAF = 32
BLOCK_ROWS = 4096
BLOCK_NUMBERS = 1 << 19
#: Label totals up to this many rows are broadcast; beyond, they are joined by shuffle.
FEW_LABELS = 100_000


@dataclass
class Tree:
    """A balanced tree over points in tree order. ``cuts`` are the borders of the leaves;
    ``lo``, ``hi`` and ``sums`` hold one array per level, from the root on."""

    points: np.ndarray
    order: np.ndarray
    cuts: np.ndarray
    lo: list[np.ndarray]
    hi: list[np.ndarray]
    sums: list[np.ndarray]

    @property
    def depth(self) -> int:
        return len(self.lo) - 1

    def borders(self, level: int) -> np.ndarray:
        return self.cuts[:: 1 << (self.depth - level)]


def leaf_cuts(n: int, leaf: int) -> np.ndarray:
    depth = max(0, (n // leaf).bit_length() - 1)
    return np.arange((1 << depth) + 1) * n >> depth


def tree_order(points: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Halve the points along the widest side of their box, down to the leaves."""
    order, step = np.arange(len(points)), len(cuts) - 1
    while step > 1 and points.shape[1]:
        for at in range(0, len(cuts) - 1, step):
            a, b = cuts[at], cuts[at + step]
            inside = points[order[a:b]]
            side = inside[:, np.argmax(inside.max(0) - inside.min(0))]
            order[a:b] = order[a:b][np.argsort(side, kind="stable")]
        step //= 2
    return order


def levels(points: np.ndarray, cuts: np.ndarray) -> tuple[list, list, list]:
    lo, hi, sums = ([f.reduceat(points, cuts[:-1])] for f in (np.minimum, np.maximum, np.add))
    while len(lo[0]) > 1:
        for f, found in ((np.minimum, lo), (np.maximum, hi), (np.add, sums)):
            found.insert(0, f(found[0][::2], found[0][1::2]))
    return lo, hi, sums


def grow(points: np.ndarray, leaf: int) -> Tree:
    cuts = leaf_cuts(len(points), leaf)
    order = tree_order(points, cuts)
    return Tree(points[order], order, cuts, *levels(points[order], cuts))


def _squares(gaps: np.ndarray) -> np.ndarray:
    return (gaps * gaps).sum(1)


def _nearer(p_lo, p_hi, e_lo, e_hi, of: np.ndarray) -> np.ndarray:
    """Which pairs of boxes stay: those not farther than another entry node surely is. ``of``
    numbers the node of parts of every pair, ascending."""
    least = _squares(np.maximum(np.maximum(p_lo - e_hi, e_lo - p_hi), 0))
    most = _squares(np.maximum(p_hi - e_lo, e_hi - p_lo))
    starts = np.flatnonzero(np.diff(of, prepend=-1))
    best = np.minimum.reduceat(most, starts)
    return least <= np.repeat(best, np.diff([*starts, len(of)]))


def _alone(of: np.ndarray) -> np.ndarray:
    """Which pairs are the only one of their node."""
    change = np.diff(of, prepend=-1, append=-1) != 0
    return change[:-1] & change[1:]


def _children(nodes: np.ndarray, entries: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the children: of the nodes of parts and, if ``both``, of those of entries."""
    if both:
        entries = (2 * entries[:, None] + [0, 1]).ravel()
        nodes = np.repeat(nodes, 2)
    starts = np.flatnonzero(np.diff(nodes, prepend=-1))
    sizes = np.diff([*starts, len(nodes)])
    # Per node its pairs for the left child, then the same for the right one.
    place = np.arange(2 * len(nodes)) - np.repeat(2 * starts, 2 * sizes)
    wide = np.repeat(sizes, 2 * sizes)
    return np.repeat(2 * nodes[starts], 2 * sizes) + place // wide, entries[np.repeat(starts, 2 * sizes) + place % wide]


def assign(tree: Tree, codebook: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The nearest entry of every point in tree order (ties to the lower index), per entry
    the sum and the count of its points, and how many points were decided one by one."""
    n, k = len(tree.points), len(codebook)
    codes = np.zeros(n, np.int64)
    sums = np.zeros((k, tree.points.shape[1]), np.int64)
    counts = np.zeros(k, np.int64)
    # Of equal entries only the first can be nearest.
    distinct = np.sort(np.unique(codebook, axis=0, return_index=True)[1]) if codebook.shape[1] else np.zeros(1, np.int64)
    cuts = leaf_cuts(len(distinct), 1)
    book = codebook[distinct]
    order = tree_order(book, cuts)
    book, index = book[order], distinct[order]
    e_lo, e_hi, _ = levels(book, cuts)
    nodes = entries = np.zeros(1, np.int64)
    level = e_level = 0

    def settle(done: np.ndarray) -> None:
        """Give whole nodes to single entries."""
        at, to = nodes[done], index[entries[done]]
        np.add.at(sums, to, tree.sums[level][at])
        borders = tree.borders(level)
        for a, b, e in zip(borders[at], borders[at + 1], to, strict=True):
            codes[a:b] = e
            counts[e] += b - a

    single = False
    while len(nodes):
        if not single and e_level == len(e_lo) - 1:
            # Below the leaves of the entries' tree come the entries themselves.
            size = np.diff(cuts)[entries]
            first = cuts[entries]
            entries = np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())
            nodes, single = np.repeat(nodes, size), True
        if single:
            lo, hi = book[entries], book[entries]
        else:
            lo, hi = e_lo[e_level][entries], e_hi[e_level][entries]
        near = _nearer(tree.lo[level][nodes], tree.hi[level][nodes], lo, hi, nodes)
        nodes, entries = nodes[near], entries[near]
        if single:
            done = _alone(nodes)
            settle(done)
            nodes, entries = nodes[~done], entries[~done]
        if level < tree.depth:
            nodes, entries = _children(nodes, entries, not single and e_level < len(e_lo) - 1)
            level += 1
            e_level += not single and e_level < len(e_lo) - 1
        elif single:
            break
        elif e_level < len(e_lo) - 1:
            entries, nodes = (2 * entries[:, None] + [0, 1]).ravel(), np.repeat(nodes, 2)
            e_level += 1
    # Uncertain leaves: exact distances, entries in ascending order.
    best = np.full(n, np.iinfo(np.int64).max)
    open_points = np.zeros(n, bool)
    borders = tree.borders(tree.depth)
    for e in np.argsort(index):
        at = nodes[entries == e]
        size = borders[at + 1] - borders[at]
        spots = np.repeat(borders[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
        distance = _squares(tree.points[spots] - book[e])
        better = distance < best[spots]
        best[spots[better]] = distance[better]
        codes[spots[better]] = index[e]
        open_points[spots] = True
    for e in index:
        mine = open_points & (codes == e)
        sums[e] += tree.points[mine].sum(0)
        counts[e] += np.count_nonzero(mine)
    return codes, sums, counts, int(np.count_nonzero(open_points))


def part_borders(dim: int, parts: int) -> list[int]:
    return [dim * i // parts for i in range(parts + 1)]


_BLOCK = "dim INT, n INT, points BINARY, orders BINARY, sides BINARY, sums BINARY"


def _pack(vectors: np.ndarray, parts: int) -> dict:
    """A block's trees: points in tree order part by part, then orders, boxes and sums."""
    cut = part_borders(vectors.shape[1], parts)
    trees = [grow(vectors[:, a:b], LEAF) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    narrow = np.int32 if np.abs(vectors).max(initial=0) < 2**31 else np.int64

    def joined(arrays: list[np.ndarray], kind: type) -> bytes:
        return b"".join(a.astype(kind).tobytes() for a in arrays)

    return {
        "dim": vectors.shape[1],
        "n": len(vectors),
        "points": joined([t.points for t in trees], narrow),
        "orders": joined([t.order for t in trees], np.int32),
        "sides": joined([a for t in trees for a in (*t.lo, *t.hi)], narrow),
        "sums": joined([a for t in trees for a in t.sums], np.int64),
    }


def _unpack(block: dict, parts: int) -> Iterator[Tree]:
    dim, n = block["dim"], block["n"]
    narrow = np.int32 if len(block["points"]) == 4 * n * dim else np.int64
    cuts = leaf_cuts(n, LEAF)
    sizes = [1 << i for i in range((len(cuts) - 1).bit_length())]
    at = {name: 0 for name in ("points", "orders", "sides", "sums")}

    def take(name: str, rows: int, width: int, kind: type) -> np.ndarray:
        found = np.frombuffer(block[name], kind, rows * width, at[name])
        at[name] += found.nbytes
        return found.astype(np.int64).reshape(rows, width)

    borders = part_borders(dim, parts)
    for m in np.diff(borders).tolist():
        points, order = take("points", n, m, narrow), take("orders", n, 1, np.int32)[:, 0]
        lo, hi = ([take("sides", s, m, narrow) for s in sizes] for _ in range(2))
        yield Tree(points, order, cuts, lo, hi, [take("sums", s, m, np.int64) for s in sizes])


def tree_blocks(rows: DataFrame, parts: int) -> DataFrame:
    """Blocks of (key, label, v) rows with their trees, cut within the partitions."""
    lists = [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in ("key", "label")]
    out = T.StructType([*lists, *T.StructType.fromDDL(_BLOCK)])

    def blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        v = batch.column(2)
        lengths = np.diff(v.offsets.to_numpy())
        starts = v.offsets.to_numpy()[:-1] - v.offsets[0].as_py()
        flat = v.flatten().to_numpy(zero_copy_only=False)
        for dim in np.unique(lengths).tolist():
            same = np.flatnonzero(lengths == dim)
            size = max(LEAF, min(BLOCK_ROWS, BLOCK_NUMBERS // max(dim, 1)))
            for some in np.array_split(same, -(-len(same) // size)):
                vectors = flat[starts[some][:, None] + np.arange(dim)]
                # The squared distance of a whole vector must fit a long.
                if 4 * dim * np.abs(vectors).max(initial=0) ** 2 >= 2.0**62:
                    raise ValueError("a component is too large for exact distances")
                block = _pack(vectors.astype(np.int64), parts)
                kept = [pa.ListArray.from_arrays([0, len(some)], batch.column(i).take(pa.array(some))) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array([x]) for x in block.values())], out.names)

    kinds = [to_arrow_type(f.dataType) for f in out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch):
                columns = zip(block.columns, kinds, strict=True)
                yield pa.RecordBatch.from_arrays([c.cast(kind) for c, kind in columns], out.names)

    return rows.mapInArrow(run, out)


def _whole_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(name)[i].as_py() for name in ("dim", "n", "points", "orders", "sides", "sums")}


def lloyd_round(blocks: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """The codebooks after one round. A task sends one row per entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros_like(book) for book in codebooks]
        counts = np.zeros((len(codebooks), len(codebooks[0])), np.int64)
        for block in _whole_blocks(batches):
            for part, tree in enumerate(_unpack(block, len(codebooks))):
                _, added, found, _ = assign(tree, codebooks[part])
                sums[part] += added
                counts[part] += found
        for part, entry in zip(*np.nonzero(counts), strict=True):
            row = [int(part), int(entry), int(counts[part, entry]), sums[part][entry].tolist()]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            columns = [pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, ["part", "entry", "n", "total"])

    sent = blocks.mapInArrow(run, "part INT, entry INT, n BIGINT, total ARRAY<BIGINT>")
    by_place = sent.select("part", "entry", "n", F.posexplode_outer("total").alias("at", "x"))
    summed = by_place.groupBy("part", "entry", "at").agg(
        F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")
    )
    after = [book.copy() for book in codebooks]
    for part, entry, at, n, x in summed.collect():
        if at is not None:
            after[part][entry, at] = int(x) // n
    return after


def coded_rows(blocks: DataFrame, codebooks: list[np.ndarray]) -> DataFrame:
    """Per row of the blocks its key, label, code and error."""
    kinds = [T.StructField(c, blocks.schema[c].dataType.elementType) for c in ("key", "label")]
    out = T.StructType([*kinds, *T.StructType.fromDDL("code STRING, error BIGINT")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, block in enumerate(_whole_blocks([batch])):
                codes = np.zeros((block["n"], len(codebooks)), np.uint8)
                error = np.zeros(block["n"], np.int64)
                for part, tree in enumerate(_unpack(block, len(codebooks))):
                    found, *_ = assign(tree, codebooks[part])
                    codes[tree.order, part] = found
                    error[tree.order] += _squares(tree.points - codebooks[part][found])
                text, wide = codes.tobytes().hex(), 2 * len(codebooks)
                code = [text[at : at + wide] for at in range(0, len(text), wide)]
                kept = [batch.column(c)[i].values for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(code), pa.array(error)], out.names)

    return blocks.mapInArrow(run, out)


def codebook_text(codebooks: list[np.ndarray]) -> str:
    return ",".join(str(x) for book in codebooks for entry in book.tolist() for x in entry)


def compress_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: int = SCALE,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """Code every vector by the nearest entries of its parts' learned codebooks.

    Components x become floor(scale * x). A codebook starts as the parts of the vectors with
    the smallest keys, null last, of repeated keys in the order of their vectors. Returns
    key, code (two hex digits a part), error (squared distance), label_error (error summed
    over equal labels, nulls together) and codebooks_sha256, a row for every row whose vector
    is not null and holds no null or non-finite component; repeated rows each. With fewer
    rows than ``entries`` there are as many entries. Vectors of another length have
    codebooks of their own; a length that ``parts`` does not divide gives parts whose lengths
    differ by one, an empty vector the code of zeros. An empty table gives no row. Components
    whose squared distances exceed a long fail the job rather than wrap.
    """
    if entries > 256:
        raise ValueError("two hex digits name at most 256 entries")
    kept = vectors.filter(usable(F.col(f"`{vector}`"))).select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), quantized(F.col(f"`{vector}`"), scale).alias("v")
    )
    blocks = cut_lineage(tree_blocks(kept, parts))
    coded = None
    for (dim,) in sorted(blocks.select("dim").distinct().collect()):
        first = kept.filter(F.size("v") == dim).orderBy(F.col("key").asc_nulls_last(), "v").limit(entries).collect()
        start = np.array([r.v for r in first], np.float64).reshape(len(first), dim).astype(np.int64)
        cut = part_borders(dim, parts)
        codebooks = [start[:, a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]
        same = blocks.filter(F.col("dim") == dim)
        for _ in range(rounds):
            codebooks = lloyd_round(same, codebooks)
        digest = hashlib.sha256(codebook_text(codebooks).encode()).hexdigest()
        found = coded_rows(same, codebooks).withColumn("codebooks_sha256", F.lit(digest))
        coded = found if coded is None else coded.unionByName(found)
    if coded is None:
        coded = coded_rows(blocks, []).withColumn("codebooks_sha256", F.lit(""))
    coded = cut_lineage(coded)
    totals = coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    if totals.count() <= FEW_LABELS:
        totals = F.broadcast(totals)
    joined = coded.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("key").alias(key), "code", "error", "label_error", "codebooks_sha256")
