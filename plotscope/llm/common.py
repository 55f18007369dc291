"""Helpers shared by the operators: text scans inside tasks, lineage cuts, digests."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

Span = tuple[str, int, int]

#: Arrow bytes of the rows that a task holds as Python values at a time; one row may have more.
SLICE_BYTES = 1 << 21


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder that all executors share. A folder of our own is used only
    where the session names none, as in tests, and then only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can read")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="plotscope-checkpoint-"))
    return context.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder, so that a lost executor costs the current
    step only."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Like ``cut_lineage``, as a packed Parquet table: for wide rows, which a checkpoint
    writes as they lie in memory."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_held: dict[str, object] = {}


def let_go(but: str | None = None) -> None:
    for name in [n for n in _held if n != but]:
        del _held[name]


def held(name: str, make: Callable[[], object]):
    """What a worker keeps from one task to the next, made once. It is let go when the worker
    gets a task that asks for something else, or for nothing."""
    let_go(name)
    if name not in _held:
        _held[name] = make()
    return _held[name]


def small_slices(batches: Iterator[pa.RecordBatch], keep: str | None = None) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``SLICE_BYTES`` of text, so that a task keeps the
    Python form of few rows. Freed buffers go back to the system at the end. What the worker
    holds from tasks before is let go, but for ``keep``."""
    let_go(keep)
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.full(batch.num_rows, 8, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
                ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
                sizes += np.diff(ends)
        place = np.cumsum(sizes) // SLICE_BYTES
        cuts = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.slice(lo, hi - lo)
    pa.default_memory_pool().release_unused()


def map_texts(
    df: DataFrame,
    key: str,
    inputs: Sequence[str],
    fields: str,
    start: Callable[[], Callable[..., tuple]],
) -> DataFrame:
    """One output row per input row: the key column, then ``fields`` (a DDL string).

    ``start`` runs once per task and returns the function that gets the ``inputs`` of a
    row and returns its ``fields``. Rows stay in their partition; a task holds a slice of an
    Arrow batch, whose bytes Spark bounds, at a time.
    """
    picked = df.select(key, *inputs)
    out = T.StructType([picked.schema[key], *T.StructType.fromDDL(fields)])
    kinds = [to_arrow_type(f.dataType) for f in out.fields[1:]]
    names = out.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer = start()
        for batch in small_slices(batches):
            rows = [answer(*values) for values in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True)]
            columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
            arrays = [pa.array(list(c), kind) for c, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=names)

    return picked.mapInArrow(run, out)


def spans_text(spans: Sequence[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
