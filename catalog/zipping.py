"""Tables as zipped CSV files, one per label, each with one member.

A member is one stream, but its pieces can be compressed apart: each ends on a whole byte without
ending the stream, so every task compresses its own rows, and one task per file then only copies.
"""

from __future__ import annotations

import io
import sys
import uuid
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv
from pyspark import cloudpickle
from pyspark.sql import DataFrame

from plotscope.sources import zips

# The functions travel with the tasks, so executors need no installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LEVEL = 1
_COPY_BYTES = 4 << 20
#: An empty last block, which ends a stream.
_LAST = b"\x03\x00"


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of CRC-32, bits reflected as there."""
    product = 0
    while a:
        if a & 0x80000000:
            product ^= b
        a = a << 1 & 0xFFFFFFFF
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return product


def crc_of_both(first: int, second: int, second_bytes: int) -> int:
    """CRC-32 of two texts in turn, from those of each and the length of the second."""
    shift, power, bits = 0x80000000, 0x40000000, 8 * second_bytes
    while bits:
        if bits & 1:
            shift = _times(power, shift)
        power, bits = _times(power, power), bits >> 1
    return _times(shift, first) ^ second


def _csv_text(rows: pa.RecordBatch | pa.Table) -> bytes:
    """Rows as CSV without a header; quotes stand only where a text of the batch needs them."""
    out = io.BytesIO()
    if rows.num_columns > 1:
        try:
            csv.write_csv(rows, out, csv.WriteOptions(include_header=False, quoting_style="none"))
            return out.getvalue()
        except pa.ArrowInvalid:  # a text holds a comma, a quote or a line break
            out = io.BytesIO()
    else:  # an empty line would be no row
        rows = pa.table([pc.fill_null(pc.cast(rows.column(0), pa.string()), "")], names=rows.schema.names)
    csv.write_csv(rows, out, csv.WriteOptions(include_header=False, quoting_style="needed"))
    return out.getvalue()


class _Piece:
    """Compressed rows of one label in one task."""

    def __init__(self, path: str):
        store, inner = zips.open_store(path)
        store.create_dir(inner.rpartition("/")[0])
        self.path, self.out = path, store.open_output_stream(inner)
        self.packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, -zlib.MAX_WBITS)
        self.crc = self.text_bytes = self.packed_bytes = 0

    def _write(self, packed: bytes) -> None:
        self.out.write(packed)
        self.packed_bytes += len(packed)

    def add(self, text: bytes) -> None:
        self.crc = zlib.crc32(text, self.crc)
        self.text_bytes += len(text)
        self._write(self.packer.compress(text))

    def close(self) -> None:
        self._write(self.packer.flush(zlib.Z_FULL_FLUSH))
        self.out.close()


def _write_pieces(df: DataFrame, label: str, folder: str) -> list:
    """One piece per task and label, as rows of label, path, CRC and bytes of text and of the piece."""
    columns = [c for c in df.columns if c != label]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, _Piece] = {}
        for batch in batches:
            labels = batch.column(label)
            for value in pc.unique(labels):
                rows = batch.filter(pc.equal(labels, value) if value.is_valid else pc.is_null(labels))
                name = str(value.as_py())
                if name not in pieces:
                    pieces[name] = _Piece(f"{folder}/{uuid.uuid4().hex}")
                pieces[name].add(_csv_text(rows.select(columns)))
        for piece in pieces.values():
            piece.close()
        yield pa.RecordBatch.from_pydict(
            {
                "label": pa.array(pieces, pa.string()),
                "path": pa.array([p.path for p in pieces.values()], pa.string()),
                "crc": pa.array([p.crc for p in pieces.values()], pa.int64()),
                "text_bytes": pa.array([p.text_bytes for p in pieces.values()], pa.int64()),
                "packed_bytes": pa.array([p.packed_bytes for p in pieces.values()], pa.int64()),
            }
        )

    return df.mapInArrow(run, "label STRING, path STRING, crc BIGINT, text_bytes BIGINT, packed_bytes BIGINT").collect()


def _join_pieces(path: str, member: str, header: bytes, pieces: list[tuple[str, int, int, int]]) -> None:
    packer = zlib.compressobj(_LEVEL, zlib.DEFLATED, -zlib.MAX_WBITS)
    start = packer.compress(header) + packer.flush(zlib.Z_FULL_FLUSH)
    info = zipfile.ZipInfo(member)
    info.compress_type = zipfile.ZIP_DEFLATED
    info.external_attr, info.header_offset = 0o600 << 16, 0
    info.CRC = zlib.crc32(header)
    info.file_size = len(header) + sum(text for _, _, text, _ in pieces)
    info.compress_size = len(start) + sum(packed for *_, packed in pieces) + len(_LAST)
    for _, crc, text, _ in pieces:
        info.CRC = crc_of_both(info.CRC, crc, text)
    store, inner = zips.open_store(path)
    with store.open_output_stream(inner) as raw, zipfile.ZipFile(raw, "w") as archive:
        archive.fp.write(info.FileHeader() + start)
        for piece, *_ in pieces:
            store, inner = zips.open_store(piece)
            with store.open_input_file(inner) as packed:
                while part := packed.read(_COPY_BYTES):
                    archive.fp.write(part)
        archive.fp.write(_LAST)
        archive.filelist.append(info)
        archive.start_dir = archive.fp.tell()


def write_zips(df: DataFrame, label: str, folder: str, name: str, member: str) -> list[str]:
    """``df`` as zipped CSV files in ``folder``, one per ``label``, named as ``name`` (with {} for
    the label) says. Returns the labels."""
    spark = df.sparkSession
    header = (",".join(c for c in df.columns if c != label) + "\n").encode()
    written = f"{folder}/pieces"
    files: dict[str, list] = {}
    for row in _write_pieces(df, label, written):
        files.setdefault(row.label, []).append((row.path, row.crc, row.text_bytes, row.packed_bytes))

    def run(file: tuple[str, list]) -> None:
        _join_pieces(f"{folder}/{name.format(file[0])}", member, header, file[1])

    if files:
        spark.sparkContext.parallelize(list(files.items()), len(files)).foreach(run)
        store, inner = zips.open_store(written)
        store.delete_dir(inner)
    return list(files)
