"""N-gram Jaccard join by a size-aware split into light and heavy sets.

Documents become sets of word shingles; equal sets are one node. Two sets may only link
if their sizes are close, so every pair is looked for in the size class of its larger set:

* light classes (small sets): every subset of the size that a linked pair must share is
  enumerated; two sets that share one are nearly always linked;
* heavy classes: the shingles are dealt by hash into more blocks than a linked pair can
  have differences, so the pair agrees on a whole block. Sets go into the inverted list of
  every block they have, and the lists are scanned. Several shingles make up a block, so
  a passage that many documents share does not put them all into one list.

Enumeration grows with the binomial of the size, scanning with the length of the lists;
the boundary between the two is where their cost per set crosses.

Lists are not expanded into all pairs. Every list first checks its members against the
one that shares most; what links is contracted to components. Only members of a list that
are then still in different components are compared, in tiles, through bit sketches that
bound their difference from below, and what the sketches leave is checked exactly, the
likeliest pair of two components first. Before whole sets travel, a finer sketch that grows
with the set turns down most pairs that do not link. So no link between different sets is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotscope.llm.common import cut_lineage, small_slices
from plotscope.llm.components import component_labels, joined_labels
from plotscope.llm.shingles import Powers, mix, shingle_sets, wrapped

WIDTH = 4
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Cost of scanning one entry of an inverted list, in enumerated subsets.
SCAN_COST = 4
#: Growth of heavy size classes.
CLASS_GROWTH = 1.4
#: Members of a list that one task compares with as many others.
TILE = 2048
#: Up to so many nodes a table of them is broadcast; beyond, it is joined by shuffle.
FEW_NODES = 1_000_000
#: The same for candidate pairs.
FEW_PAIRS = 400_000
SKETCH_BITS = 1024
#: Sets a task remembers to post equal ones once.
_SEEN = 50_000

_U = np.uint64
#: Lists are told apart by 56 bits, a byte less to shuffle; lists that share a key by chance
#: are one list, whose pairs are verified like any others.
_KEY_CUT = np.uint64(8)
_STEP, _TURN = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F


def largest_partner(n: int, percent: int = PERCENT) -> int:
    return n * 100 // percent


def most_differences(sizes: int, percent: int = PERCENT) -> int:
    """Most elements in only one of two linked sets whose sizes add up to ``sizes``."""
    return sizes * (100 - percent) // (100 + percent)


class Classes:
    """Size classes of the larger set of a pair, and what its sets are listed under."""

    def __init__(self, percent: int = PERCENT, scan_cost: float = SCAN_COST):
        self.percent = percent
        self.light = 1
        while self.subsets(self.light + 1) <= self.scans(self.light + 1) * (1 + scan_cost):
            self.light += 1
        self.bounds = [self.light + 1]

    def shared(self, size: int) -> int:
        """Elements that a set of ``size`` shares with any linked set that is not larger."""
        return -(-size * self.percent // 100)

    def subsets(self, n: int) -> int:
        return sum(math.comb(n, self.shared(b)) for b in range(n, largest_partner(n, self.percent) + 1))

    def scans(self, n: int) -> int:
        return 2 * self.blocks(most_differences(2 * n, self.percent))

    @staticmethod
    def blocks(differences: int) -> int:
        """More blocks than differences, with some to spare for empty ones."""
        return differences + differences // 10 + 3

    def heavy(self, n: int) -> Iterator[tuple[int, int]]:
        """(class number, most differences) of the heavy classes that partners may be in."""
        top = largest_partner(n, self.percent)
        while self.bounds[-1] <= top:
            self.bounds.append(max(self.bounds[-1] + 1, int(self.bounds[-1] * CLASS_GROWTH)))
        for i, (low, high) in enumerate(zip(self.bounds, self.bounds[1:], strict=False)):
            if high > n and low <= top:
                yield i, most_differences(2 * (high - 1), self.percent)

    def keys(self, elements: np.ndarray) -> np.ndarray:
        """What a sorted set is listed under: a linked pair shares at least one key."""
        n, out = len(elements), []
        mixed = mix(elements * _U(_TURN))
        total = mixed.sum(dtype=_U)
        for size in range(n, min(largest_partner(n, self.percent), self.light) + 1):
            drop = n - self.shared(size)
            if drop >= 0 and not size == n == self.shared(n):
                gone = [mixed[list(c)].sum(dtype=_U) for c in combinations(range(n), drop)]
                out.append(mix(wrapped(int(total) + size * _STEP) - np.array(gone, _U)))
        for number, most in self.heavy(n):
            blocks = self.blocks(most)
            place = ((elements >> _U(32)) * _U(blocks)) >> _U(32)
            first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
            label = place[first] * _U(_STEP) + wrapped((number + 1) * _TURN)
            out.append(mix(np.add.reduceat(mixed, first) + label))
            if len(first) <= most:  # too few blocks hold anything: such sets have a list of their own
                out.append(mix(np.array([wrapped((number + 1) * _TURN)], _U)))
        return np.concatenate(out) if out else np.empty(0, _U)


def set_name(elements: np.ndarray) -> int:
    """A 64-bit name of a set."""
    total = int(mix(elements + _U(_STEP)).sum(dtype=_U))
    return int(mix(np.array([wrapped(total + len(elements) * _TURN)], _U)).view(np.int64)[0])


def sketch(elements: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parities of the set in ``bits`` buckets (a power of two): two sketches differ in no
    more bits than the sets differ in elements."""
    counts = np.bincount((elements & _U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def fine_sketch(elements: np.ndarray) -> bytes:
    """A sketch of at least two buckets an element, a small part of the set's own bytes."""
    return sketch(elements, max(SKETCH_BITS, 1 << (2 * len(elements) - 1).bit_length()))


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """The sketch of the same set in fewer buckets, ``size`` bytes."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def listed_sets(docs: DataFrame, key: str, text: str, width: int, percent: int, scan_cost: float) -> DataFrame:
    """Per document its key as ``doc_id``, n_shingles, name and list keys. A task leaves out
    the keys of a set that it has listed already."""
    picked = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    out = T.StructType([picked.schema["doc_id"], *T.StructType.fromDDL("n BIGINT, name BIGINT, keys ARRAY<BIGINT>")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        classes, powers, seen = Classes(percent, scan_cost), Powers(), set()
        for batch in small_slices(batches):
            sizes, names, keys = [], [], []
            for elements in shingle_sets(batch.column(1).to_pylist(), width, powers):
                name = set_name(elements) if len(elements) else None
                new = name is not None and name not in seen
                if new:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(name)
                sizes.append(len(elements))
                names.append(name)
                keys.append((classes.keys(elements) >> _KEY_CUT).view(np.int64) if new else np.empty(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            flat = np.concatenate(keys) if keys else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return picked.mapInArrow(run, out)


def shared_lists(postings: DataFrame, tile: int) -> DataFrame:
    """The lists that several sets are in: key, tile number and members, at most ``tile`` in
    a row. Rows pass sorted by key; a run is cut as it goes by, never held whole."""
    parts = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = "key BIGINT, tile BIGINT, members ARRAY<BIGINT>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tiles, held = None, 0, np.empty(0, np.int64)
        for batch in batches:
            keys, names = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(keys):
                continue
            found: list[tuple] = []
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            ends = np.append(first[1:], len(keys))
            whole = (ends - first > 1) & (names[first] != names[ends - 1])
            whole[[0, -1]] = True  # may go on from, or into, another batch
            for lo, hi in zip(first[whole], ends[whole], strict=True):
                if keys[lo] != key:
                    if len(held) > 1 or tiles:
                        found.append((key, tiles, held))
                    key, tiles, held = keys[lo], 0, np.empty(0, np.int64)
                held = np.unique(np.concatenate([held, names[lo:hi]]))
                while len(held) > tile:
                    found.append((key, tiles, held[:tile]))
                    tiles, held = tiles + 1, held[tile:]
            yield _lists(found)
        if len(held) > 1 or tiles:
            yield _lists([(key, tiles, held)])

    return postings.repartition(parts, "key").sortWithinPartitions("key", "name").mapInArrow(run, out)


def merged_lists(lists: DataFrame) -> DataFrame:
    """Lists with the same members say the same, so one stays; those of several tiles keep their key."""
    long = lists.filter("tile > 0").select("key").distinct()
    single = lists.filter("tile = 0").join(long, "key", "left_anti")
    merged = single.groupBy("members").agg(F.min("key").alias("key")).withColumn("tile", F.lit(0).cast("long"))
    return merged.unionByName(lists.join(long, "key", "left_semi")).select("key", "tile", "members")


def _lists(found: list[tuple]) -> pa.RecordBatch:
    keys, tiles, members = zip(*found, strict=True) if found else ((), (), ())
    ends = np.cumsum([0, *map(len, members)]).astype(np.int32)
    flat = np.concatenate(members) if members else np.empty(0, np.int64)
    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))
    return pa.RecordBatch.from_arrays(
        [pa.array([int(k) for k in keys], pa.int64()), pa.array(tiles, pa.int64()), lists], ["key", "tile", "members"]
    )


def member_sets(docs: DataFrame, nodes: DataFrame, key: str, text: str, width: int, few: bool) -> DataFrame:
    """name, n, sketch, fine and elements (packed) of the nodes, each from one of its documents. If
    the rows of that document repeat, a task gives them once, but several tasks may."""
    picked = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    fields = "name BIGINT, n BIGINT, sketch BINARY, fine BINARY, elements BINARY"
    out = T.StructType([*T.StructType.fromDDL(fields), picked.schema["doc_id"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, seen = Powers(), set()
        for batch in small_slices(batches):
            rows = []
            texts = shingle_sets(batch.column(1).to_pylist(), width, powers)
            for k, e in zip(batch.column(0).to_pylist(), texts, strict=True):
                mark = (set_name(e), tuple(k.values()) if isinstance(k, dict) else k)
                if len(e) and mark not in seen:
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(mark)
                    rows.append((mark[0], len(e), sketch(e), fine_sketch(e), e.tobytes(), k))
            kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), batch.schema.field(0).type]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=out.names)

    sets = picked.mapInArrow(run, out)
    wanted = nodes.select(F.col("node"), F.col("first_id"))
    wanted = F.broadcast(wanted) if few else wanted
    same = (F.col("name") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("first_id"))
    return sets.join(wanted, same).select("name", "n", "sketch", "fine", "elements")


def _dealt(leader: int, block: int, names: list[int]) -> pa.Table:
    columns = ([leader] * len(names), [block] * len(names), names)
    return pa.table([pa.array(c, pa.int64()) for c in columns], names=["u", "block", "v"])


def _may_link(percent: int):
    """Pairs of a leader and its candidates that sizes and fine sketches do not rule out."""

    def run(group: pa.Table) -> pa.Table:
        leader = group["leader"][0].as_py()
        names = group["name"].to_pylist()
        at = names.index(leader) if leader in names else None
        near = set()
        if at is not None:
            sizes = group["n"].to_pylist()
            own = np.frombuffer(group["prints"][at].as_py(), np.uint8)
            for name, n, raw in zip(names, sizes, group["prints"], strict=True):
                most = most_differences(n + sizes[at], percent)
                if name != leader and abs(n - sizes[at]) <= most:
                    other = np.frombuffer(raw.as_py(), np.uint8)
                    size = min(len(own), len(other))
                    if np.bitwise_count(folded(own, size) ^ folded(other, size)).sum(dtype=np.int64) <= most:
                        near.add(name)
        return _dealt(leader, group["block"][0].as_py(), sorted(near))

    return run


def _verify(percent: int):
    """Links between a leader and its candidates, by exact intersection."""

    def run(group: pa.Table) -> pa.Table:
        leader = group["leader"][0].as_py()
        names = group["name"].to_pylist()
        at = names.index(leader) if leader in names else None
        linked = []
        if at is not None:
            own = np.frombuffer(group["prints"][at].as_py(), _U)
            for name, raw in zip(names, group["prints"], strict=True):
                if name != leader:
                    other = np.frombuffer(raw.as_py(), _U)
                    place = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    both = int((own[place] == other).sum())
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        linked.append(name)
        return _dealt(leader, group["block"][0].as_py(), sorted(set(linked)))

    return run


def checked_pairs(dealt: DataFrame, sets: DataFrame, prints: str, check, few: bool) -> DataFrame:
    """The dealt pairs (u, block, v) that ``check`` keeps by the column ``prints`` of their sets."""
    members = dealt.select(F.col("u").alias("leader"), "block", F.col("v").alias("name"))
    leaders = dealt.select(F.col("u").alias("leader"), "block", F.col("u").alias("name")).distinct()
    asked = members.union(leaders)
    asked = F.broadcast(asked) if few else asked
    rows = sets.select("name", "n", F.col(prints).alias("prints")).join(asked, "name")
    rows = rows.select("leader", "block", "name", "n", "prints")
    return rows.groupBy("leader", "block").applyInArrow(check, "u BIGINT, block BIGINT, v BIGINT")


#: What pairs are checked by, in turn: a column of the sets, and the check that gets it.
CHECKS = (("fine", _may_link), ("elements", _verify))


def verified_links(
    pairs: DataFrame, sets: DataFrame, least: float, few_pairs: int = FEW_PAIRS, block: int = 256, checks=CHECKS
) -> DataFrame:
    """The pairs (u, v) that link: by fine sketches first, what they leave by whole sets. The
    candidates of a leader are checked in blocks, each of which gets the leader's set, so a
    leader with very many of them is spread over tasks."""
    dealt = pairs.distinct().withColumn("block", F.pmod(F.xxhash64("v"), F.lit(1 << 20)))
    size = dealt.groupBy("u").agg(F.count("*").alias("many"))
    dealt = cut_lineage(
        dealt.join(size, "u").select("u", F.expr(f"block % ((many + {block - 1}) div {block})").alias("block"), "v")
    )
    few = dealt.count() <= few_pairs
    for prints, check in checks[:-1]:
        dealt = cut_lineage(checked_pairs(dealt, sets, prints, check(least), few))
    prints, check = checks[-1]
    return checked_pairs(dealt, sets, prints, check(least), few).select("u", "v")


def _compare(percent: int):
    """Pairs of two tiles of a list that are in different components and may link, by
    their sizes and sketches."""

    def run(group: pa.Table) -> pa.Table:
        names, labels, sizes = (group[c].to_numpy() for c in ("name", "label", "n"))
        side = group["side"].to_numpy()
        bits = np.frombuffer(b"".join(group["sketch"].to_pylist()), _U).reshape(len(names), -1)
        left = np.flatnonzero(side == 0)
        far = np.flatnonzero(side == 1)
        us, vs, ds = [], [], []
        for place, i in enumerate(left):
            right = far if len(far) else left[place + 1 :]
            others = right[(labels[right] != labels[i]) & (names[right] != names[i])]
            total = sizes[others] + sizes[i]
            most = total * (100 - percent) // (100 + percent)
            near = np.abs(sizes[others] - sizes[i]) <= most
            others, most = others[near], most[near]
            differ = np.bitwise_count(bits[others] ^ bits[i]).sum(axis=1, dtype=np.int64)
            others, differ = others[differ <= most], differ[differ <= most]
            ds.append(differ)
            us.append(np.minimum(names[others], names[i]))
            vs.append(np.maximum(names[others], names[i]))
        u, v, d = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (us, vs, ds))
        rows = np.unique(np.stack([u, v, d], axis=1), axis=0)
        return pa.table({c: pa.array(rows[:, i], pa.int64()) for i, c in enumerate(("u", "v", "differ"))})

    return run


def open_pairs(lists: DataFrame, labels: DataFrame, sets: DataFrame, least: float, compare=_compare) -> DataFrame:
    """Candidate pairs (u, v) that share a list but no component, and the bits in which
    their sketches differ."""
    rows = lists.select("key", "tile", F.explode("members").alias("name"))
    rows = rows.join(labels.withColumnRenamed("node", "name"), "name", "left")
    rows = rows.withColumn("label", F.coalesce("label", "name"))
    split = rows.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("tile").alias("last"))
    rows = rows.join(split.filter("lo <> hi").select("key", "last"), "key")
    met = rows.withColumn("other", F.explode(F.expr("sequence(0L, last)"))).select(
        "key",
        F.least("tile", "other").alias("a"),
        F.greatest("tile", "other").alias("b"),
        F.expr("CASE WHEN tile <= other THEN 0 ELSE 1 END").alias("side"),
        "name",
        "label",
    )
    met = met.join(sets.select("name", "n", "sketch"), "name")
    met = met.select("key", "a", "b", "side", "name", "label", "n", "sketch")
    return met.groupBy("key", "a", "b").applyInArrow(compare(least), "u BIGINT, v BIGINT, differ BIGINT").distinct()


def labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs with the components ``lu`` and ``lv`` of their ends; a node may have no label yet."""
    for end in "uv":
        of = labels.select(F.col("node").alias(end), F.col("label").alias(f"l{end}"))
        pairs = pairs.join(of, end, "left").withColumn(f"l{end}", F.coalesce(f"l{end}", end))
    return pairs


def nearest_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Of all pairs between the same two components the one with the nearest sketches."""
    ends = labelled(pairs, labels).withColumns({"a": F.least("lu", "lv"), "b": F.greatest("lu", "lv")})
    best = ends.groupBy("a", "b").agg(F.min(F.struct("differ", "u", "v")).alias("best"))
    return best.select("best.u", "best.v")


def separate_pairs(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """All pairs whose ends are in different components."""
    return labelled(pairs, labels).filter("lu <> lv").select("u", "v")


def star_pairs(lists: DataFrame) -> DataFrame:
    """Every set with one leader: of the members of its lists, the one that shares most
    lists with most others. What this leaves out is compared later."""
    rows = lists.select("key", F.explode("members").alias("name"), F.size("members").alias("many"))
    weight = rows.groupBy("name").agg(F.sum("many").alias("weight"))
    rows = rows.select("key", "name").join(weight, "name")
    leader = rows.groupBy("key").agg(F.max(F.struct("weight", "name")).alias("lead"))
    best = rows.join(leader, "key").groupBy("name").agg(F.max("lead").alias("lead"))
    return best.select(F.col("lead.name").alias("u"), F.col("name").alias("v")).filter("u <> v")


def list_components(
    lists: DataFrame, sets: DataFrame, least: float, few_pairs: int = FEW_PAIRS, checks=CHECKS, compare=_compare
) -> DataFrame:
    """Components (node, label) of all links between sets that share a list."""
    labels = component_labels(cut_lineage(verified_links(star_pairs(lists), sets, least, few_pairs, checks=checks)))
    rest = cut_lineage(open_pairs(lists, labels, sets, least, compare))
    # Between two components one link is enough, so the likeliest pair is tried first.
    for choose in (nearest_pairs, separate_pairs):
        asked = cut_lineage(choose(rest, labels))
        if not asked.isEmpty():
            more = cut_lineage(verified_links(asked, sets, least, few_pairs, checks=checks))
            if not more.isEmpty():
                labels = joined_labels(labels, more)
    return labels


def jaccard_components(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    width: int = WIDTH,
    percent: int = PERCENT,
    scan_cost: float = SCAN_COST,
    tile: int = TILE,
    few_nodes: int = FEW_NODES,
    few_pairs: int = FEW_PAIRS,
) -> DataFrame:
    """Per document its key, n_shingles and component_id, the smallest key that links reach.

    A document is the set of its distinct ``width``-word shingles (A to Z lower-cased, words
    end at ASCII white space; with fewer words the whole sequence is one shingle). Two
    documents link when 100 * intersection >= ``percent`` * union. Documents without words
    link with nothing and are their own component. Rows with a null key link like others
    but name no component: theirs is null where no other key is reached. Repeated rows
    are kept. Sets are compared by 64-bit hashes of their shingles.
    """
    listed = cut_lineage(listed_sets(docs, key, text, width, percent, scan_cost))
    found = listed.select(F.explode("keys").alias("key"), "name")
    lists = cut_lineage(shared_lists(found, tile))
    lists = cut_lineage(merged_lists(lists))
    first = listed.filter("name IS NOT NULL").groupBy("name").agg(F.min("doc_id").alias("first_id"))
    in_lists = lists.select(F.explode("members").alias("node")).distinct()
    nodes = cut_lineage(in_lists.join(first.withColumnRenamed("name", "node"), "node"))
    few = nodes.count() <= few_nodes
    sets = cut_lineage(member_sets(docs, nodes, key, text, width, few))
    labels = list_components(lists, sets, percent, few_pairs)
    named = first.join(labels.withColumnRenamed("node", "name"), "name", "left")
    named = named.withColumn("label", F.coalesce("label", "name"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_name = named.join(smallest, "label").select("name", "component_id")
    documents = listed.select("doc_id", F.col("n").alias("n_shingles"), "name")
    result = documents.join(by_name, "name", "left")
    own = F.when(F.col("name").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return result.select(F.col("doc_id").alias(key), "n_shingles", own.alias("component_id"))
