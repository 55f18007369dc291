"""Importance resampling towards a target, by array scores and regular sampling.

Features are hashed to buckets. The counts of all documents and of the target texts give
every bucket a gain, one array for all tasks; a document's weight is the sum of its
features' gains. Noise that follows from the key turns the highest scores into a draw
without replacement. Scores are ranked by parallel sorting by regular sampling: every
partition sorts its rows, regular samples of these runs give splitters, the segments
between splitters are exchanged and merged, and counts of the segments before give exact
ranks.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotscope.llm.common import cut_lineage, small_slices
from plotscope.llm.words import raw_texts, word_lists

BUCKETS = 10_000
MOST_WORDS = 1
SEED = 2024
#: Documents with fewer words are not drawn; percent of the others that are.
LEAST_WORDS = 20
PERCENT = 10
#: Segments at most; the driver holds the square of it in samples.
MOST_SEGMENTS = 1024


def feature_buckets(raw: bytes | None, buckets: int, most_words: int) -> Iterator[np.ndarray]:
    """Buckets of all runs of 1 to ``most_words`` words of a text, in arrays of bounded size.
    The first array of each list of words has its single words."""
    before: list[bytes] = []
    for words in word_lists(raw):
        joined = [*before, *words]
        for n in range(1, most_words + 1):
            # Runs that end in this list: the words before reach n - 1 back.
            part = words if n == 1 else joined[max(0, len(before) - n + 1) :]
            runs = part if n == 1 else list(map(b" ".join, zip(*(part[i:] for i in range(n)), strict=False)))
            yield np.fromiter(map(crc32, runs), np.uint32, len(runs)) % np.uint32(buckets)
        before = joined[max(0, len(joined) - most_words + 1) :] if most_words > 1 else []


def bucket_counts(texts: DataFrame, text: str, buckets: int, most_words: int) -> np.ndarray:
    """Features of all texts per bucket. A task sends one row per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in small_slices(batches):
            for raw in raw_texts(batch.column(0)):
                for found in feature_buckets(raw, buckets, most_words):
                    counts += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    sent = texts.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket BIGINT, n BIGINT")
    total = np.zeros(buckets, np.int64)
    for bucket, n in sent.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        total[bucket] = n
    return total


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln of its smoothed share of the target over that of the source)."""
    in_source, in_target, buckets = int(source.sum()), int(target.sum()), len(source)
    ratio = ((target + 1.0) * (in_source + buckets)) / ((source + 1.0) * (in_target + buckets))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def noise(name: str, seed: int) -> int:
    """Gumbel noise in thousandths that follows from a name."""
    h = int(hashlib.sha256(f"{seed}:{name}".encode("utf-8", "surrogatepass")).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored_documents(
    docs: DataFrame, gains: np.ndarray, key: str, text: str, most_words: int = MOST_WORDS, seed: int = SEED
) -> DataFrame:
    """Per row its key, n_words, n_features, weight and score."""
    buckets = len(gains)
    picked = docs.select(
        F.col(key).alias("key"), F.coalesce(F.col(key).cast("string"), F.lit("")).alias("name"), F.col(text).alias("text")
    )
    fields = "n_words BIGINT, n_features BIGINT, weight BIGINT, score BIGINT"
    out = T.StructType([picked.schema["key"], *T.StructType.fromDDL(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_slices(batches):
            rows = []
            for name, raw in zip(batch.column(1).to_pylist(), raw_texts(batch.column(2)), strict=True):
                words = features = weight = 0
                for i, found in enumerate(feature_buckets(raw, buckets, most_words)):
                    words += len(found) if i % most_words == 0 else 0
                    features += len(found)
                    weight += int(gains[found].sum())
                rows.append((words, features, weight, weight + noise(name, seed)))
            columns = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], out.names)

    return picked.mapInArrow(run, out)


def _places(score: pa.Array, key: pa.Array, spot: pa.Array) -> list[tuple]:
    """What rows are sorted by, as tuples: score descending, then key, null last, then spot."""
    rows = zip(score.to_pylist(), key.to_pylist(), spot.to_pylist(), strict=True)
    return [(-s, k is None, 0 if k is None else k, p) for s, k, p in rows]


def with_ranks(rows: DataFrame, score: str = "score", key: str = "key") -> tuple[DataFrame, int]:
    """Adds ``rank``: 1, 2, 3... by score descending, ties to the smaller key, null last; also
    returns how many rows have one.

    Rows equal in both get successive ranks in the order of their run, so that many copies
    of a row are cut into several segments like any others. Rows with a null score take no
    part; their rank is null.
    """
    spark = rows.sparkSession
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_SEGMENTS))
    order = [F.col(score).desc_nulls_last(), F.col(key).asc_nulls_last()]
    sorted_runs = rows.sortWithinPartitions(*order, *(c for c in rows.columns if c not in (score, key)))
    # A checkpoint keeps partitions and their order: they are the runs.
    everyone = cut_lineage(sorted_runs.withColumn("spot", F.monotonically_increasing_id()))
    runs = everyone.filter(F.col(score).isNotNull())
    place = runs.select(F.col(score).alias("score"), F.col(key).alias("key"), "spot")
    n = runs.count()
    step = max(1, n // parts**2)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = 0
        for batch in batches:
            yield batch.take(pa.array(range(-seen % step, batch.num_rows, step), pa.int64()))
            seen += batch.num_rows

    # At most parts**2 samples, and one more of every run.
    samples = place.mapInArrow(sample, place.schema).toArrow().combine_chunks()
    regular = sorted(_places(*(samples[c] for c in ("score", "key", "spot"))))
    splitters = [regular[len(regular) * i // parts] for i in range(1, parts)] if regular else []
    at = [rows.columns.index(c) for c in (score, key)]
    out = T.StructType([*runs.schema, T.StructField("segment", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = _places(batch.column(at[0]), batch.column(at[1]), batch.column(batch.num_columns - 1))
            ends = [bisect_left(places, s) for s in splitters]
            segment = np.repeat(np.arange(len(ends) + 1), np.diff([0, *ends, len(places)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment, pa.int64())], out.names)

    segments = runs.mapInArrow(cut, out)
    counts = dict(segments.groupBy("segment").count().collect())
    before = accumulate((counts.get(i, 0) for i in range(parts)), initial=0)
    offsets = spark.createDataFrame(list(zip(range(parts), before, strict=False)), "of BIGINT, before BIGINT")
    inside = F.row_number().over(Window.partitionBy("segment").orderBy(*order, "spot"))
    merged = segments.withColumn("place", inside).join(F.broadcast(offsets), F.col("segment") == F.col("of"))
    ranked = merged.select(*rows.columns, (F.col("before") + F.col("place")).alias("rank"))
    rest = everyone.filter(F.col(score).isNull()).select(*rows.columns, F.lit(None).cast("long").alias("rank"))
    return ranked.unionByName(rest), n


def resample(
    docs: DataFrame,
    target: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    buckets: int = BUCKETS,
    most_words: int = MOST_WORDS,
    least_words: int = LEAST_WORDS,
    percent: int = PERCENT,
    seed: int = SEED,
) -> DataFrame:
    """Draw ``percent`` of the documents with ``least_words`` or more, by their likeness to
    the ``target`` texts.

    Returns every row's key, n_features, weight, score and rank (long; from 1 in the order
    of the scores, null where not drawn). A null or empty text has no features and is never
    drawn; an empty target is like one without any feature; a null key takes noise as an
    empty one and comes last among ties. Repeated rows are documents of their own.
    """
    source_counts = bucket_counts(docs, text, buckets, most_words)
    gains = bucket_gains(source_counts, bucket_counts(target, text, buckets, most_words))
    scored = scored_documents(docs, gains, key, text, most_words, seed)
    # Documents that cannot be drawn have no chance and get no rank.
    chance = F.when(F.col("n_words") >= least_words, F.col("score"))
    ranked, n = with_ranks(scored.withColumn("chance", chance).drop("n_words"), "chance")
    drawn = F.when(F.col("rank") <= n * percent // 100, F.col("rank"))
    return ranked.select(F.col("key").alias(key), "n_features", "weight", "score", drawn.alias("rank"))


def drawn_documents(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` draws, all columns. Keys should be unique: of
    rows that share one all come if one is drawn, and rows with a null key never do."""
    ranks = resample(docs, target, key, text, **how).filter("rank IS NOT NULL")
    drawn = ranks.select(F.col(key).alias("drawn_key")).distinct()
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return row.join(drawn, F.col(f"row.{key}") == F.col("drawn_key"), "left_semi").select("row.*")
