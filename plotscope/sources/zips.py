"""A data source for zipped text files: every member is a partition, a large one several.

Members are streamed from the shared file system, so neither a zip nor a decoded file is ever
held whole. A zip can only be decoded from its start: a later part of a member decodes what is
before it too, but parses and returns only its own rows, which is most of the work. Paths may be
local or those of any store that Arrow's file systems reach.
"""

from __future__ import annotations

import io
import json
import os
import re
import sys
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark import cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# The reader travels with the tasks, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FORMAT = "zipped_csv"
#: Name of the column that holds the label of a row's file.
LABEL = "file_label"
_BATCH_ROWS = 20_000
#: Bytes of text decoded and parsed at a time, and below which a member is not split.
_BLOCK_BYTES = 4 << 20
_SPLIT_BYTES = 16 << 20
_BOM = b"\xef\xbb\xbf"
# A quote opens a quoted field only where the field begins; inside, two stand for one.
_FIELD = rb'(?:"(?:[^"]++|"")*+"?+)?+[^,\r\n]*+'
_RECORD = re.compile(_FIELD + rb"(?:," + _FIELD + rb")*+(?:\r\n|\r|\n)")
# White space of every kind, as ``strip`` removes it.
_SPACES = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
_BEFORE_QUOTE = np.isin(np.arange(256), list(b',\r\n"'))


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path.removeprefix("file:")))


def exists(path: str) -> bool:
    store, inner = open_store(path)
    return store.get_file_info(inner).type != fs.FileType.NotFound


def cleaned(column: pa.ChunkedArray) -> pa.ChunkedArray:
    """What ``clean_text`` makes of a column: stripped text, with empty text as null."""
    text = pc.utf8_trim(column, characters=_SPACES)
    return pc.if_else(pc.greater(pc.binary_length(text), 0), text, None)


def _last_record_end(data: bytes) -> tuple[int, bool]:
    """Where the last whole record of ``data``, which begins with a record, ends (0: nowhere),
    and whether its quotes stand around whole fields only, so that every parser reads it alike."""
    if b'"' not in data:
        return max(data.rfind(b"\n"), data.rfind(b"\r")) + 1, b"\0" not in data
    text = np.frombuffer(data, np.uint8)
    quotes = np.flatnonzero(text == ord('"'))
    opening = quotes[::2][int(quotes[0] == 0) :]
    if _BEFORE_QUOTE[text[opening - 1]].all():
        ends = np.flatnonzero((text == ord("\n")) | (text == ord("\r")))
        ends = ends[np.searchsorted(quotes, ends) % 2 == 0]
        return int(ends[-1]) + 1 if len(ends) else 0, b"\0" not in data
    end = 0
    for record in iter(_RECORD.scanner(data).match, None):
        end = record.end()
    return end, False


def _first_records(data: bytes) -> list[bytes]:
    """Text up to the end of the header, and of the first row after it. Blank lines are no records."""
    found = []
    for record in iter(_RECORD.scanner(data).match, None):
        if record.group().strip(b" \t\r\n"):
            found.append(data[: record.end()])
        if len(found) == 2:
            break
    return found


def _blocks(text: BinaryIO, end: int | None) -> Iterator[tuple[int, bytes, bool]]:
    """A member's records in blocks, up to the block that holds place ``end``: the place of the block
    in the text, its bytes, and whether every parser reads it alike. The same for every ``end``;
    the first block holds the header and the first row."""
    at, rest, first = 0, b"", True
    while end is None or at < end:
        more = text.read(_BLOCK_BYTES)
        rest = rest + more if rest else more
        if first:
            rest = rest.removeprefix(_BOM)
        if first and more and len(_first_records(rest)) < 2:
            continue
        cut, alike = _last_record_end(rest)
        if not more:
            cut, alike = len(rest), alike and cut == len(rest)
        if cut or first:
            yield at, rest[:cut], alike
        at, rest, first = at + cut, rest[cut:], False
        if not more:
            return


class _Parser:
    """Blocks of one member to rows. What pandas and Arrow might read differently is left to pandas."""

    def __init__(self, block: bytes, wanted: list[str]):
        records = _first_records(block if block.endswith((b"\n", b"\r")) else block + b"\n")
        self.wanted = wanted
        self.head = records[-1] if records else block
        self.skip = len(records[0]) if records else 0
        # As in a read of the whole member, the first row tells whether rows are wider than the header.
        self.first_rows = len(self._pandas(b""))
        header = pd.read_csv(io.BytesIO(self.head), dtype=str, keep_default_na=False)
        self.names = [str(c) for c in header.columns]
        self.arrow = len(self.names) > 1 and isinstance(header.index, pd.RangeIndex)

    def _pandas(self, block: bytes) -> pd.DataFrame:
        return pd.read_csv(io.BytesIO(self.head + block), usecols=self.wanted, dtype=str, keep_default_na=False)

    def rows(self, block: bytes, alike: bool) -> pa.Table:
        schema = pa.schema([(c, pa.string()) for c in self.wanted])
        if self.arrow and alike:
            try:
                return csv.read_csv(
                    pa.BufferReader(block),
                    csv.ReadOptions(use_threads=False, block_size=len(block) + 1, column_names=self.names),
                    csv.ParseOptions(newlines_in_values=True),
                    csv.ConvertOptions(include_columns=self.wanted, column_types=schema, strings_can_be_null=False),
                )
            except pa.ArrowInvalid:  # such as rows of unequal width
                pass
        return pa.Table.from_pandas(self._pandas(block)[self.wanted][self.first_rows :], schema, preserve_index=False)


@dataclass
class Member(InputPartition):
    """The records of a member whose block begins from place ``start`` of its text to before ``end``."""

    label: str
    path: str
    name: str
    start: int
    end: int | None

    def __init__(self, label: str, path: str, name: str, start: int = 0, end: int | None = None):
        super().__init__((label, path, name, start, end))
        self.label, self.path, self.name, self.start, self.end = label, path, name, start, end


class ZippedCsvReader(DataSourceReader):
    """Options: ``files``, a JSON list of [label, path, member]; without a member the first
    one of the zip counts; ``tasks``, into how many parts all members together may be split.
    The schema names the columns, all text and cleaned; the label comes last."""

    def __init__(self, columns: list[str], files: list[list], tasks: int = 1):
        self.columns, self.files, self.tasks = columns, files, tasks

    def partitions(self) -> list[Member]:
        found = []
        for label, path, member in self.files:
            store, inner = open_store(path)
            with store.open_input_file(inner) as raw, zipfile.ZipFile(raw) as archive:
                info = archive.infolist()[0] if member is None else archive.getinfo(member)
            found.append((label, path, info.filename, info.file_size))
        share = max(_SPLIT_BYTES, -(-sum(size for *_, size in found) // self.tasks))
        parts = []
        for *member, size in found:
            count = max(1, -(-size // share))
            places = [size * k // count for k in range(count)]
            parts += [(end or size, Member(*member, start, end)) for start, end in zip(places, [*places[1:], None])]
        return [part for _, part in sorted(parts, key=lambda p: -p[0])]  # what takes longest comes first

    def read(self, partition: Member) -> Iterator[pa.RecordBatch]:
        store, inner = open_store(partition.path)
        with store.open_input_file(inner) as raw, zipfile.ZipFile(raw) as archive, archive.open(partition.name) as text:
            parser = None
            for at, block, alike in _blocks(text, partition.end):
                if parser is None:
                    parser = _Parser(block, self.columns[:-1])
                    block = block[parser.skip :]
                if at >= partition.start and block:
                    rows = parser.rows(block, alike)
                    label = pa.repeat(pa.scalar(partition.label, pa.string()), rows.num_rows)
                    texts = [*map(cleaned, rows.columns), label]
                    yield from pa.table(texts, names=self.columns).to_batches(max_chunksize=_BATCH_ROWS)


class ZippedCsv(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ZippedCsvReader(schema.names, json.loads(self.options["files"]), int(self.options.get("tasks", 1)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ZippedCsv)
