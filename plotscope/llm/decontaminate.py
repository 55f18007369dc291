"""Benchmark passages in documents, by a prefix-filtered set join.

An item's windows are sets of shingles, and a document that holds a window holds all of
them. So one shingle is the necessary prefix of a window: the rarest, by the number of
documents that hold it, counted over all documents. Documents join the windows by these
alone; the place of the shingle and the window's length say where the window would lie,
which must be inside the document, and there the words are compared.

The benchmark is split into blocks of bounded size. Words are numbered within a block, so
shingles are whole numbers and all comparisons are exact. Documents stay in their
partitions and meet the blocks one after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotscope.llm.common import cut_lineage, small_slices
from plotscope.llm.words import raw_texts, word_lists

WINDOW = 10
SHINGLE = 3
#: Windows of a long item that travel as one row, and words of the benchmark that make a block.
#: A shingle of three of a block's words must fit a long.
CHUNK_WINDOWS = 4096
BLOCK_WORDS = 1 << 20


@dataclass
class Block:
    """Windows of some chunks of items. ``ids`` are the chunks' words as numbers; ``starts``
    and ``lengths`` are the distinct windows in it. Lists kept as one array with cuts: the
    chunks of every window, the items of every chunk, as places in ``names``."""

    vocabulary: dict[bytes, int]
    ids: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    chunks: np.ndarray
    chunk_cuts: np.ndarray
    items: np.ndarray
    item_cuts: np.ndarray
    names: list[str | None]


def item_chunks(benchmark: DataFrame, key: str, text: str, window: int) -> DataFrame:
    """The words of every item, long ones in overlapping chunks that hold every window."""
    picked = benchmark.select(F.col(key).cast("string").alias("item"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            for item, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                words = [w for part in word_lists(raw) for w in part]
                for at in range(0, max(1, len(words) - window + 1) if words else 0, CHUNK_WINDOWS):
                    chunk = b" ".join(words[at : at + CHUNK_WINDOWS + window - 1])
                    columns = [pa.array([item], pa.string()), pa.array([chunk], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["item", "words"])

    return picked.mapInArrow(run, "item STRING, words BINARY")


def blocks_of(chunks: DataFrame, window: int) -> Iterator[Block]:
    """Blocks of chunks, one at a time. Equal chunks of many items are one in a block."""
    some: dict[bytes, list[str | None]] = {}
    held = 0
    for item, words in chunks.distinct().toLocalIterator():
        owners = some.setdefault(bytes(words), [])
        held += 1 if owners else 1 + words.count(b" ") + 1
        owners.append(item)
        if held >= BLOCK_WORDS:
            yield make_block(some, window)
            some, held = {}, 0
    if some:
        yield make_block(some, window)


def make_block(chunks: dict[bytes, list[str | None]], window: int) -> Block:
    vocabulary: dict[bytes, int] = {}
    texts = [[vocabulary.setdefault(w, len(vocabulary)) for w in words.split(b" ")] for words in chunks]
    ids = np.array([i for text in texts for i in text], np.int64)
    sizes = np.array(list(map(len, texts)), np.int64)
    names: dict[str | None, int] = {}
    owners = [names.setdefault(i, len(names)) for items in chunks.values() for i in items]
    lengths = np.minimum(sizes, window)
    # All windows of all chunks, then the distinct ones of each length.
    per = sizes - lengths + 1
    chunk = np.repeat(np.arange(len(sizes)), per)
    every = np.arange(len(chunk)) + np.repeat(np.cumsum(sizes) - sizes - np.cumsum(per) + per, per)
    starts, long, of, which = [], [], [], []
    for length in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths[chunk] == length)
        rows = ids[every[mine][:, None] + np.arange(length)]
        _, first, window_of = np.unique(rows, axis=0, return_index=True, return_inverse=True)
        which.append(window_of.ravel() + sum(map(len, starts)))
        starts.append(every[mine][first])
        long.append(np.full(len(first), length))
        of.append(chunk[mine])
    none = [np.empty(0, np.int64)]
    starts, long, of, which = (np.concatenate(x or none) for x in (starts, long, of, which))
    by_window = np.argsort(which, kind="stable")
    return Block(
        vocabulary,
        ids,
        starts,
        long,
        of[by_window],
        np.searchsorted(which[by_window], np.arange(len(starts) + 1)),
        np.array(owners, np.int64),
        np.cumsum([0, *map(len, chunks.values())]),
        list(names),
    )


def shingles(ids: np.ndarray, width: int, words: int) -> np.ndarray:
    """The shingle that starts at each place as one whole number, -1 where it holds a word
    that the block does not have."""
    n = max(0, len(ids) - width + 1)
    out, known = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(width):
        out = out * words + ids[i : n + i]
        known &= ids[i : n + i] >= 0
    out[~known] = -1
    return out


def _found(keys: np.ndarray, sought: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose key is among the sorted ``sought`` ones, and which."""
    if not len(sought):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.searchsorted(sought, keys)
    at[at == len(sought)] = 0
    here = np.flatnonzero(sought[at] == keys)
    return here, at[here]


def _spread(cuts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists kept as one array with ``cuts``: the places of the lists ``rows``, and to
    which of ``rows`` each belongs."""
    size = cuts[rows + 1] - cuts[rows]
    of = np.repeat(np.arange(len(rows)), size)
    return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + cuts[rows][of], of


def window_shingles(block: Block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The shingles of ``width`` words of all windows that use this width: (window, place in
    the window, shingle). Windows use ``SHINGLE`` words, shorter ones their length."""
    mine = np.flatnonzero(np.minimum(block.lengths, SHINGLE) == width)
    per = block.lengths[mine] - width + 1
    window = np.repeat(mine, per)
    place = np.arange(len(window)) - np.repeat(np.cumsum(per) - per, per)
    keys = shingles(block.ids, width, len(block.vocabulary))
    return window, place, keys[block.starts[window] + place]


def widths(block: Block) -> list[int]:
    return sorted(set(np.minimum(block.lengths, SHINGLE).tolist()))


def _numbers(words: list[bytes], vocabulary: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(vocabulary.get, words, repeat(-1)), np.int64, len(words))


def _document(raw: bytes | None, vocabulary: dict[bytes, int]) -> np.ndarray:
    parts = [_numbers(words, vocabulary) for words in word_lists(raw)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


def shingle_counts(docs: DataFrame, text: str, block: Block) -> dict[int, np.ndarray]:
    """Per width the block's shingles (sorted) and the number of documents that hold each,
    over all documents. A task sends one row per shingle."""
    sought = {w: np.unique(window_shingles(block, w)[2]) for w in widths(block)}
    firsts = dict(zip(sought, np.cumsum([0, *map(len, sought.values())]).tolist(), strict=False))
    n = sum(map(len, sought.values()))
    sent = docs.sparkSession.sparkContext.broadcast((block.vocabulary, sought))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, wanted = sent.value
        counts = np.zeros(n, np.int64)
        for batch in small_slices(batches):
            for raw in raw_texts(batch.column(0)):
                ids = _document(raw, vocabulary)
                for width, keys in wanted.items():
                    _, which = _found(shingles(ids, width, len(vocabulary)), keys)
                    counts[firsts[width] + np.unique(which)] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["shingle", "n"])

    total = np.zeros(n, np.int64)
    counted = docs.select(F.col(text).alias("text")).mapInArrow(run, "shingle BIGINT, n BIGINT")
    for shingle, found in counted.groupBy("shingle").agg(F.sum("n").alias("n")).collect():
        total[shingle] = found
    sent.unpersist()
    return {w: total[firsts[w] : firsts[w] + len(keys)] for w, keys in sought.items()}


def prefixes(block: Block, counts: dict[int, np.ndarray]) -> dict[int, tuple]:
    """Per width the prefix shingles (sorted) and, as lists with cuts, the windows of each and
    the place in them. Of a window's shingles the rarest counts, then the smallest number."""
    out = {}
    for width, found in counts.items():
        window, place, key = window_shingles(block, width)
        rarity = found[np.searchsorted(np.unique(key), key)]
        order = np.lexsort((place, key, rarity, window))
        first = order[np.flatnonzero(np.diff(window[order], prepend=-1))]
        first = first[np.argsort(key[first], kind="stable")]
        keys, starts = np.unique(key[first], return_index=True)
        out[width] = (keys, np.append(starts, len(first)), window[first], place[first])
    return out


def _scan(ids: np.ndarray, block: Block, sought: dict[int, tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Where windows occur in a document, and which."""
    starts, windows = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for width, (keys, cuts, window, place) in sought.items():
        here, which = _found(shingles(ids, width, len(block.vocabulary)), keys)
        at, of = _spread(cuts, which)
        start, found = here[of] - place[at], window[at]
        inside = (start >= 0) & (start + block.lengths[found] <= len(ids))
        start, found = start[inside], found[inside]
        for i in range(int(block.lengths[found].max(initial=0))):
            long = block.lengths[found] > i
            same = ~long
            same[long] = ids[start[long] + i] == block.ids[block.starts[found[long]] + i]
            start, found = start[same], found[same]
        starts.append(start)
        windows.append(found)
    return np.concatenate(starts), np.concatenate(windows)


_STATE = "n_words BIGINT, spans ARRAY<INT>, items ARRAY<STRING>"


def _merged(spans: np.ndarray) -> np.ndarray:
    """Rows (start, end) as disjoint ones in order."""
    spans = spans[np.lexsort((spans[:, 1], spans[:, 0]))]
    reach = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.append(True, spans[1:, 0] > reach[:-1]))
    return np.column_stack((spans[first, 0], reach[np.append(first[1:], len(spans)) - 1]))


def with_block(docs: DataFrame, block: Block, last: bool) -> DataFrame:
    """Add what a block finds to (key, text, n_words, spans, items); the last one drops the
    text."""
    sought = prefixes(block, shingle_counts(docs, "text", block))
    sent = docs.sparkSession.sparkContext.broadcast((block, sought))
    kept = ["key"] if last else ["key", "text"]
    out = T.StructType([*(docs.schema[c] for c in kept), *T.StructType.fromDDL(_STATE)])
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, wanted = sent.value
        for batch in small_slices(batches):
            rows = []
            old = zip(raw_texts(batch.column(1)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            for raw, spans, names in old:
                ids = _document(raw, items.vocabulary)
                start, window = _scan(ids, items, wanted)
                if len(start):
                    ends = start + items.lengths[window]
                    before = np.array(spans or [], np.int64).reshape(-1, 2)
                    spans = _merged(np.concatenate((before, np.column_stack((start, ends))))).ravel().tolist()
                    at, _ = _spread(items.chunk_cuts, np.unique(window))
                    at, _ = _spread(items.item_cuts, np.unique(items.chunks[at]))
                    added = (items.names[i] for i in np.unique(items.items[at]).tolist())
                    names = sorted({*(names or []), *(name for name in added if name is not None)})
                rows.append((len(ids), spans, names))
            new = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], out.names)

    return docs.mapInArrow(run, out)


def benchmark_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
) -> DataFrame:
    """Which words of every document belong to a passage of the benchmark.

    A passage is any run of ``window`` words of an item; an item of fewer words is one passage,
    an item without words none. Returns a row per row of ``docs``: key, n_words, spans (word
    places from, to, from, to..., disjoint and in order) and items (keys as strings,
    sorted, each once); both are null where nothing occurs. A null or empty text has no words.
    Words of an item with a null key are hit but name no item; repeated items count once.
    """
    if window < 1:
        raise ValueError("a window has at least one word")
    empty = [F.lit(None).cast(kind).alias(name) for name, kind in (f.split(" ") for f in _STATE.split(", "))]
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"), *empty)
    chunks = cut_lineage(item_chunks(benchmark, item_key, item_text, window))
    before = None
    for block in blocks_of(chunks, window):
        if before is not None:
            # One block is held at a time: what the blocks before found is written.
            rows = cut_lineage(with_block(rows, before, last=False))
        before = block
    if before is None:
        before = make_block({}, window)
    return with_block(rows, before, last=True).withColumnRenamed("key", key)


def contamination_digest(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """Per document n_words, n_hit, n_items, items_sha256 and contaminated (n_hit > 0)."""
    hits = benchmark_hits(docs, benchmark, key, **how)
    n_hit = F.expr("aggregate(coalesce(spans, array()), 0L, (s, x) -> x - s)")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return hits.select(
        key,
        "n_words",
        n_hit.alias("n_hit"),
        F.size(names).cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def without_passages(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **how) -> DataFrame:
    """Rows (key, n_words, spans, items) of the documents that hold no benchmark passage."""
    return benchmark_hits(docs, benchmark, key, **how).filter("spans IS NULL")
