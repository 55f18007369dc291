"""Exact top-k search by tiles.

Queries and vectors are dealt into tiles of bounded size. Each pair of a query tile and a
vector shard is one matrix product inside a task, which keeps only the k best of every
query in that shard; the short lists are then merged pairwise in a tree of key-wise
aggregations. The queries are a stated set that meets every row in blocks; no row-by-row
pairs are emitted.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotscope.llm.common import cut_lineage

#: Most queries and vectors of a tile, and the vectors worth a task of their own.
QUERY_TILE = 1024
VECTOR_TILE = 4096
LEAST_TILE = 256
#: Lists merged at one step of the tree.
FAN_IN = 16
#: Products up to this are whole numbers in a double, whatever the order of the sum.
_EXACT = 2.0**53


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components; an empty vector is usable."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact integer products: doubles where they suffice, Python integers beyond."""
    largest = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * max(queries.shape[1], 1)
    if largest < _EXACT:
        return (queries @ vectors.T).astype(np.int64)
    exact = [[int(x) for x in row] for row in vectors]
    return np.array([[sum(int(a) * b for a, b in zip(q, v, strict=True)) for v in exact] for q in queries], object)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of one query: score descending, then id."""
    if scores.dtype != object and len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= edge)
    else:
        places = np.arange(len(scores))
    return np.array(sorted(places, key=lambda p: (-scores[p], ids[p]))[:k], dtype=np.int64)


def _tile(k: int):
    """The best k of every query of a tile within one shard."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        queries, vectors = _matrix(left["v"].combine_chunks()), _matrix(right["v"].combine_chunks())
        query_ids = left["id"].to_numpy().astype(np.int64)
        ids = right["id"].to_numpy().astype(np.int64)
        out: list[tuple] = []
        if len(query_ids) and len(ids):
            scores = _products(queries, vectors)
            for q, row in zip(query_ids, scores, strict=True):
                others = np.flatnonzero(ids != q)
                for p in _best(row[others], ids[others], k):
                    out.append((int(q), int(row[others[p]]), int(ids[others[p]])))
        shard = right["shard"][0].as_py() if len(right) else 0
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        arrays = [pa.array(c, pa.int64()) for c in columns]
        return pa.table([*arrays, pa.array([shard] * len(out), pa.int64())], ["query_id", "score", "vec_id", "shard"])

    return run


def _keep_best(lists: Column, k: int) -> Column:
    """Sorted by score descending, then id: the first k of the collected rows."""
    return F.slice(F.array_sort(lists), 1, k)


def exact_top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    key: str = "vec_id",
    vector: str = "vector",
    query_tile: int = QUERY_TILE,
    vector_tile: int = VECTOR_TILE,
) -> DataFrame:
    """Per query its k rows of ``vectors`` with the highest inner product.

    Components must be whole numbers held in doubles. Returns query_id, rank (from 1),
    vec_id and score (long); ties go to the smaller vec_id, a query never meets rows of
    its own id, and only vectors of its own length. Rows with a null id, a null vector
    or a null or non-finite component take no part, on either side; a repeated row is a
    candidate of its own, of repeated query ids the smallest vector asks. A product beyond a long fails the job rather than wrap.
    """

    def clean(df: DataFrame) -> DataFrame:
        kept = df.filter(F.col(key).isNotNull() & usable(F.col(vector)))
        return kept.select(F.col(key).alias("id"), F.size(vector).alias("dim"), F.col(vector).alias("v"))

    spark = vectors.sparkSession
    rows = clean(vectors)
    asked = clean(queries).groupBy("id").agg(F.min(F.struct("v", "dim")).alias("q")).select("id", "q.dim", "q.v")
    n_rows, n_asked = (df.agg(F.count("*")).collect()[0][0] for df in (rows, asked))
    tasks = min(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_rows / LEAST_TILE))
    shards = max(1, math.ceil(n_rows / vector_tile), tasks)
    tiles = max(1, math.ceil(n_asked / query_tile))
    # The running number keeps many copies of one row from meeting in one shard.
    dealt = F.pmod(F.xxhash64("id", "v", F.monotonically_increasing_id()), F.lit(shards))
    left = asked.select(
        "*",
        F.pmod(F.xxhash64("id"), F.lit(tiles)).alias("tile"),
        F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
    )
    right = rows.withColumn("shard", dealt).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))).alias("tile")
    )
    long = [F.col(c).cast("long").alias(c) for c in ("dim", "tile", "shard")]
    grouped = (df.select("id", "v", *long).groupBy("dim", "tile", "shard") for df in (left, right))
    lists = next(grouped).cogroup(next(grouped)).applyInArrow(
        _tile(k), "query_id BIGINT, score BIGINT, vec_id BIGINT, shard BIGINT"
    )
    # Each shard adds at most k rows to a query, so a list never exceeds FAN_IN * k rows.
    entry = F.struct((-F.col("score")).alias("worse"), F.col("vec_id"), F.col("score"))
    while shards > 1:
        shards = math.ceil(shards / FAN_IN)
        best = lists.groupBy("query_id", F.floor(F.col("shard") / FAN_IN).cast("long").alias("shard")).agg(
            _keep_best(F.collect_list(entry), k).alias("best")
        )
        lists = best.select("query_id", "shard", F.inline("best")).select("query_id", "score", "vec_id", "shard")
        if shards > 1:
            lists = cut_lineage(lists)
    merged = lists.groupBy("query_id").agg(_keep_best(F.collect_list(entry), k).alias("best"))
    ranked = merged.select("query_id", F.posexplode("best"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), "col.vec_id", "col.score")


def quantized(vector: Column, scale: int = 256) -> Column:
    """Every component x as floor(scale * x), in doubles; those beyond 2^52 are whole already."""

    def whole(x: Column) -> Column:
        y = x.cast("double") * scale
        return F.when(F.abs(y) < 2.0**52, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, whole)
