import random
from collections import Counter, defaultdict
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from plotscope.llm import mixing
from tests.llm.helpers import AWKWARD


def brute_targets(sizes, most=3):
    """Share by weight, stop what exceeds its limit, share the rest again, until none does."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s])
    names += [None] if None in sizes else []
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, stopped = sum(sizes.values()), {}
    while True:
        rest = total - sum(stopped.values())
        open_ = [s for s in names if s not in stopped]
        share = {s: Fraction(rest * weight[s], sum(weight[x] for x in open_)) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return {**stopped, **share}
        stopped |= {s: Fraction(most * sizes[s]) for s in over}


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    pick = random.Random(seed)
    names = [None, "b", "a", "ä", "\U0001f600", "￮", "", "c", "d"][: seed + 4]
    sizes = {n: pick.choice([0, 1, 5, 40, 1000, 70_000]) for n in names}
    rows = spark.createDataFrame([(n, s, 1) for n, s in sizes.items()], "source STRING, source_size BIGINT, documents BIGINT")
    got = {r.source: r.target for r in mixing.source_targets(rows).collect()}
    assert got == {s: pytest.approx(float(t), abs=1e-9) for s, t in brute_targets(sizes).items()}


def corpus(spark, n=3000, seed=1):
    pick = random.Random(seed)
    rows = [(i, "w " * pick.randint(0, 300), pick.choice(["hot"] * 6 + ["b", "c", "d", None, "e"])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")


def test_sources_meet_their_targets(spark):
    rows, df = corpus(spark)
    got = mixing.mix_digest(df).collect()
    assert len(got) == len(rows)
    source, sizes = {i: s for i, _, s in rows}, Counter()
    for i, t, s in rows:
        sizes[s] += len(t.split())
    targets, taken = brute_targets(sizes), Counter()
    for r in got:
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(float(targets[source[r.doc_id]]))
        share = r.target / r.source_size
        assert r.taken == 0 if r.size == 0 else r.taken % r.size == 0 and int(share) <= r.taken / r.size < share + 1
        taken[source[r.doc_id]] += r.taken
    for s, target in targets.items():
        assert abs(taken[s] - target) <= 150


def test_reruns_agree_however_rows_lie(spark):
    _, df = corpus(spark, 500)
    first = sorted(map(tuple, mixing.mix_digest(df).collect()))
    assert first == sorted(map(tuple, mixing.mix_digest(df.repartition(5, "text").orderBy("text")).collect()))


def test_draws_are_fair(spark):
    """Over many seeds a document is taken as often as its share asks for."""
    rows = [(i, "w " * (10 * (i % 4) + 5), "a" if i % 3 else "b") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, source STRING")
    copies, share = defaultdict(list), {}
    for seed in range(12):
        for r in mixing.mix_digest(df, seed=1000 * seed).collect():
            kind = (r.size, rows[r.doc_id][2])
            copies[kind].append(r.taken / r.size)
            share[kind] = r.target / r.source_size
    for kind, taken in copies.items():
        assert sum(taken) / len(taken) == pytest.approx(share[kind], abs=0.25)


def test_awkward_rows(spark):
    rows = [(*r, s) for r, s in zip(AWKWARD, [None, "a", "a", "b", "b", "b", None, None, "c"], strict=True)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id BIGINT, text STRING, source STRING, copies INT, part INT, `group` STRING")
    got = mixing.mix_digest(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    assert {r.source_size for r in got} == set(sizes.values())
    assert mixing.mix_digest(df.filter("false")).count() == 0
    assert mixing.mix_digest(df.filter("doc_id = 2")).collect()[0].taken == 0


def test_many_equal_rows_are_mixed_one_by_one(spark):
    df = spark.range(10_000).selectExpr("1L AS doc_id", "'a b c' AS text", "if(id % 2 = 0, 'x', 'y') AS source")
    got = mixing.mix_digest(df).groupBy("source_size", "target").agg({"taken": "sum", "*": "count"}).collect()
    assert sorted((r["count(1)"], abs(r["sum(taken)"] - r.target) <= 3) for r in got) == [(5000, True)] * 2


def test_documents_come_as_often_as_taken(spark):
    rows, df = corpus(spark, 400)
    df = df.unionByName(df.limit(40))
    want = defaultdict(int)
    keyed = df.selectExpr("doc_id", "source", "text")
    for r in mixing.mix_digest(df).collect():
        want[r.doc_id] += r.taken // r.size if r.size else 0
    mixed = mixing.mix_documents(keyed).collect()
    words = Counter()
    for r in mixed:
        words[r.source] += len(r.text.split())
    sizes = Counter()
    for r in keyed.collect():
        sizes[r.source] += len(r.text.split())
    for s, target in brute_targets(sizes).items():
        assert abs(words[s] - target) <= 150
    assert set(mixed[0].asDict()) == set(keyed.columns)
    assert mixing.mix_documents(keyed.filter("false")).count() == 0


def test_many_sources_are_numbered_in_ranges(spark):
    pick = random.Random(9)
    sizes = {**{f"s{i:04}": pick.choice([0, 1, 5, 40, 1000, 70_000]) for i in range(400)}, None: 7}
    rows = [(n, s, 1) for n, s in sizes.items()]
    pick.shuffle(rows)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        totals = spark.createDataFrame(rows, "source STRING, source_size BIGINT, documents BIGINT")
        found = mixing.source_targets(totals).withColumn("task", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {r.source: r.target for r in found} == {s: pytest.approx(float(t)) for s, t in brute_targets(sizes).items()}
    assert max(Counter(r.task for r in found).values()) < len(rows) / 2
