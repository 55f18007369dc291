import random

import pytest

from plotscope.llm import topk


def brute(rows, asked, k):
    out = []
    for q, v in asked:
        scores = [(-sum(int(a) * int(b) for a, b in zip(v, w, strict=True)), i) for i, w in rows if i != q and len(w) == len(v)]
        out += [(q, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame(
        [(i, v, 0, 0, "x") for i, v in rows], "vec_id BIGINT, vector ARRAY<DOUBLE>, shard INT, tile INT, id STRING"
    )


@pytest.mark.parametrize("tile", [3, 7, 1000])
def test_matches_brute_force_with_ties(spark, tile):
    pick = random.Random(tile)
    rows = [(i, [float(pick.randrange(-2, 3)) for _ in range(4)]) for i in range(60)]
    rows += [(7, rows[7][1]), (90, rows[1][1]), (91, [1.0, 2.0])]
    asked = [r for r in rows[:60] if r[0] % 10 == 0]
    got = topk.exact_top_k(frame(spark, rows), frame(spark, asked), 5, query_tile=tile, vector_tile=tile)
    assert sorted(map(tuple, got.collect())) == brute(rows, asked, 5)


def test_unusable_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0]), (2, None), (3, [None]), (4, [nan]), (5, [inf]), (None, [9.0]), (6, [2.0]), (7, [-inf])]
    got = topk.exact_top_k(frame(spark, rows), frame(spark, rows), 5)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 6, 2), (6, 1, 1, 2)]


def test_empty_tables_and_empty_vectors(spark):
    none = frame(spark, [])
    assert topk.exact_top_k(none, none, 5).count() == 0
    assert topk.exact_top_k(frame(spark, [(1, [1.0])]), none, 5).count() == 0
    got = topk.exact_top_k(frame(spark, [(1, []), (2, [])]), frame(spark, [(1, [])]), 5)
    assert [tuple(r) for r in got.collect()] == [(1, 1, 2, 0)]


def test_products_beyond_doubles_stay_exact(spark):
    big = float(2**28 + 1)
    rows = [(1, [big, 1.0]), (2, [big, 1.0]), (3, [big, 2.0])]
    got = topk.exact_top_k(frame(spark, rows), frame(spark, rows[:1]), 2)
    assert sorted(map(tuple, got.collect())) == brute(rows, rows[:1], 2)


def test_quantized_floors(spark):
    from pyspark.sql import functions as F

    row = spark.sql("SELECT array(CAST(-0.001 AS FLOAT), 0.5F, 1e38F, NULL) AS e")
    got = row.select(topk.quantized(F.col("e")).alias("v")).collect()[0].v
    assert got[:2] == [-1.0, 128.0] and got[2] > 1e40 and got[3] is None
