"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Documents are tokenised and cut inside tasks; a piece then travels as a few numbers. The
pieces are dealt into lanes, and each lane is packed online with a bounded number of open
bins: a bitset has one bit per amount of free space, so the fullest bin that still takes
a piece is the lowest set bit from its length on. When no open bin fits and all places
are taken, the fullest bin closes.
"""

from __future__ import annotations

import json
import sys
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from plotscope.llm.common import cut_lineage, held, small_slices

CAPACITY = 4096
END_ID = 1
#: Bins that stay open in a lane.
OPEN_BINS = 1024
#: Pieces per lane: many enough that the bins still open at its end hardly count.
LANE_PIECES = 16_384
#: Chunks, and words of mixed chunks, that a worker remembers before it starts again: some
#: 100 MB in all, let go when the worker gets a task of another operator.
CHUNKS_HELD = 300_000
WORDS_HELD = 100_000

#: Up to here letters have one code point in every normal form and lower-case alone.
_PLAIN = "ƀ"


class Remembered(dict):
    """Answers of ``compute`` by argument; starts again after ``most`` of them."""

    def __init__(self, compute: Callable, most: int):
        self.compute, self.most = compute, most

    def __missing__(self, asked):
        answer = self.compute(asked)
        if len(self) >= self.most:
            self.clear()
        self[asked] = answer
        return answer


class WordTokenizer:
    """Token ids of whole texts, as little-endian 32-bit numbers.

    The vocabulary drops white space and never joins across it, so a text's ids are
    those of its chunks between ASCII white space, which repeat a lot and are remembered.
    A new plain chunk goes straight to the merges of the tokenizer's model; any other goes
    through the whole tokenizer.
    """

    def __init__(self, path: str):
        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are laid out as the machine's own unsigned 32-bit numbers")
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            split = json.load(file)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.split = regex.compile(split)
        names = [regex.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = regex.compile("|".join(names) or "(?!)")
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        shifted = [b for b in range(256) if b not in printable]
        self.byte_letters = {b: b for b in printable} | {b: 256 + i for i, b in enumerate(shifted)}
        self.chunks = Remembered(self._chunk, CHUNKS_HELD)
        self.words = Remembered(self._word, WORDS_HELD)

    def _word(self, word: str) -> bytes:
        letters = word.encode().decode("latin-1").translate(self.byte_letters)
        return array("I", [t.id for t in self.tokenizer.model.tokenize(letters)]).tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        if max(text) < _PLAIN:
            lower = text.lower()
            if lower.isalpha():
                # Letters alone are one word, which need not be remembered twice.
                return self._word(lower)
            if not self.special.search(text):
                words = self.words
                return b"".join([words[w] for w in self.split.findall(lower)])
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        chunks = self.chunks
        return b"".join([chunks[c] for c in text.encode().split()])


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
) -> DataFrame:
    """Every document as token ids with ``end_id`` appended, cut into pieces of ``capacity``.

    Returns the key, piece (from 0), start (ids before it), length and ids (little-endian
    unsigned 32-bit). A null or empty text is the end id alone. Repeated rows give
    repeated pieces, a null key stays null.
    """
    picked = docs.select(key, text)
    out = T.StructType([picked.schema[key], *T.StructType.fromDDL("piece INT, start BIGINT, length BIGINT, ids BINARY")])
    names, end, step = out.names, np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"tokenizer {tokenizer}"
        words = held(name, partial(WordTokenizer, tokenizer))
        for batch in small_slices(batches, name):
            at, piece, start, parts = [], [], [], []
            for row, value in enumerate(batch.column(1).to_pylist()):
                ids = words.ids(value or "") + end
                for i in range(0, len(ids), step):
                    at.append(row)
                    piece.append(i // step)
                    start.append(i // 4)
                    parts.append(ids[i : i + step])
            keys = batch.column(0).take(pa.array(at, pa.int64()))
            columns = [
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array([len(p) // 4 for p in parts], pa.int64()),
                pa.array(parts, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([keys, *columns], names=names)

    return picked.mapInArrow(run, out)


class OpenBins:
    """Bounded-space online best fit for one lane."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.free = 0  # bit f is set if an open bin has f tokens of free space
        self.bins: dict[int, list[int]] = defaultdict(list)
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        """Bin number and offset for a piece of ``length`` tokens (1 to capacity)."""
        fitting = self.free >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            if self.open == self.most_open:
                self._take((self.free & -self.free).bit_length() - 1)
            space, number = self.capacity, self.made
            self.made += 1
        if space > length:
            self.bins[space - length].append(number)
            self.free |= 1 << (space - length)
            self.open += 1
        return number, self.capacity - space

    def _take(self, space: int) -> int:
        number = self.bins[space].pop()
        if not self.bins[space]:
            del self.bins[space]
            self.free &= ~(1 << space)
        self.open -= 1
        return number


def pack(lengths: Iterable[int], capacity: int, most_open: int) -> Iterator[tuple[int, int]]:
    bins = OpenBins(capacity, most_open)
    return map(bins.place, lengths)


def best_fit(
    pieces: DataFrame,
    length: str = "length",
    capacity: int = CAPACITY,
    most_open: int = OPEN_BINS,
    lane_pieces: int = LANE_PIECES,
) -> DataFrame:
    """Give every piece a place: adds sequence_id (any number) and offset (from 0, gapless).

    Lengths are 1 to ``capacity``; others fail the job. Pieces reach their lane in an order
    set by a hash of the whole row, so a result does not depend on how the input lies. All
    rows and columns are kept, repeated rows too. The pieces are written once: their count
    sets the number of lanes.
    """
    spark = pieces.sparkSession
    pieces = cut_lineage(pieces)
    dealt = F.xxhash64(*[F.col(f"`{c}`") for c in pieces.columns])
    wanted = pieces.select(*[F.col(f"`{c}`").alias(f"in_{i}") for i, c in enumerate(pieces.columns)], dealt.alias("deal"))
    lanes = max(1, -(-pieces.count() // lane_pieces))
    # The rest of the hash below the lane number orders a lane.
    laned = wanted.withColumn("lane", F.pmod(F.col("deal"), F.lit(lanes)))
    place = pieces.columns.index(length)
    out = T.StructType([*pieces.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lane, bins = None, OpenBins(capacity, most_open)
        for batch in batches:
            found = []
            for number, tokens in zip(batch.column("lane").to_pylist(), batch.column(place).to_pylist(), strict=True):
                if number != lane:
                    lane, bins = number, OpenBins(capacity, most_open)
                if not tokens or not 1 <= tokens <= capacity:
                    raise ValueError(f"a piece of {tokens} tokens does not fit {capacity}")
                sequence, offset = bins.place(tokens)
                found.append(((lane << 40) + sequence, offset))
            columns = list(zip(*found, strict=True)) or [(), ()]
            kept = batch.columns[: len(batch.columns) - 2]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, pa.int64()) for c in columns)], names=out.names)

    parts = min(lanes, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = laned.repartition(parts, "lane").sortWithinPartitions("lane", "deal", *wanted.columns[:-1])
    return ordered.mapInArrow(run, out)


def fill_rate(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: sequences, tokens and the share of the sequences that tokens fill."""
    total = packed.agg(F.count_distinct("sequence_id").alias("sequences"), F.sum("length").alias("tokens"))
    return total.withColumn("fill", F.col("tokens") / (F.col("sequences") * capacity))
