import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from plotscope.llm import resampling, words

from .helpers import AWKWARD, docs

_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(_UPPER))


def features(text, most):
    w = words_of(text)
    return [" ".join(w[i : i + n]) for n in range(1, most + 1) for i in range(len(w) - n + 1)]


def brute(rows, target, buckets=10_000, most=1, least=20, percent=10, seed=2024):
    def counts(texts):
        out = [0] * buckets
        for text in texts:
            for f in features(text, most):
                out[zlib.crc32(f.encode()) % buckets] += 1
        return out

    s, t = counts([x for _, x in rows]), counts(target)
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in range(buckets)]
    out = []
    for key, text in rows:
        f = features(text, most)
        weight = sum(gain[zlib.crc32(x.encode()) % buckets] for x in f)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = [r for r, (_, text) in zip(out, rows, strict=True) if len(words_of(text)) >= least]
    enough.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for i, r in enumerate(enough[: len(enough) * percent // 100], 1):
        r[4] = i
    return sorted(map(tuple, out), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def texts(seed, n):
    pick = random.Random(seed)
    some = ["the", "a", "Katze", "naïve", "42", "word-list", "文字", "x`y", "q" * 30]
    return [" ".join(pick.choice(some) for _ in range(pick.randrange(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("most", [1, 3])
def test_matches_brute_force(spark, most):
    rows = list(enumerate(texts(most, 300)))
    rows += [(i, rows[5][1]) for i in range(400, 500)]
    target = [(i, t) for i, t in enumerate(texts(9, 20))]
    found = resampling.resample(docs(spark, rows).repartition(5), docs(spark, target), most_words=most)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert got(found) == brute(rows, [t for _, t in target], most=most)


def test_awkward_rows_and_a_target_without_words(spark):
    rows = AWKWARD + [(9, "\x00 a\x7fb `c` {d}"), (10, "ÄÖ Ü"), *((11, "twenty words " * 10) for _ in range(30))]
    for target in ([], [(1, None), (2, "")]):
        assert got(resampling.resample(docs(spark, rows), docs(spark, target))) == brute(rows, [t for _, t in target])


def test_no_documents(spark):
    assert resampling.resample(docs(spark, []), docs(spark, [(1, "a")])).count() == 0


def test_ranks_of_many_equal_rows(spark):
    pick = random.Random(4)
    rows = [(pick.choice([5, None, *range(40)]), pick.randrange(-3, 3), i) for i in range(3000)]
    rows += [(7, 1, 0)] * 1500
    df = spark.createDataFrame(rows, "key BIGINT, score BIGINT, spot INT").drop("spot").repartition(11)
    ranked, n = resampling.with_ranks(df)
    found = ranked.orderBy("rank").collect()
    assert n == len(rows)
    want = sorted(((-s, k is None, k or 0) for k, s, _ in rows))
    assert [r["rank"] for r in found] == list(range(1, len(rows) + 1))
    assert [(-r.score, r.key is None, r.key or 0) for r in found] == want


def test_keys_of_text(spark):
    df = spark.createDataFrame([("b", 1), ("ä", 1), ("no", None), ("a", 1), ("z", 2)], "key STRING, score BIGINT")
    ranked, n = resampling.with_ranks(df)
    assert n == 4
    assert [(r.key, r.rank) for r in ranked.orderBy(F.col("rank").asc_nulls_last()).collect()] == [
        ("z", 1), ("a", 2), ("b", 3), ("ä", 4), ("no", None)
    ]


def test_drawn_documents_keep_their_columns(spark):
    rows = list(enumerate(texts(2, 200)))
    target = docs(spark, rows[:5])
    table = docs(spark, rows)
    drawn = resampling.drawn_documents(table, target)
    ranks = resampling.resample(table, target).filter("rank IS NOT NULL")
    assert drawn.columns == table.columns
    assert sorted(r.doc_id for r in drawn.collect()) == sorted(r.doc_id for r in ranks.collect())


@pytest.mark.parametrize("size", [1, 7, 40])
def test_words_of_pieces(monkeypatch, size):
    monkeypatch.setattr(words, "PIECE_BYTES", size)
    for text in [*texts(5, 20), *(t for _, t in AWKWARD[:7])]:
        raw = None if text is None else text.encode()
        assert [w.decode() for part in words.word_lists(raw) for w in part] == words_of(text)
        for most in (1, 2, 4):
            found = [int(b) for a in resampling.feature_buckets(raw, 1000, most) for b in a]
            assert sorted(found) == sorted(zlib.crc32(f.encode()) % 1000 for f in features(text, most))
