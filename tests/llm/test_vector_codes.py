import hashlib
import math
import random

import numpy as np
import pytest

from plotscope.llm import vector_codes


def brute(rows, scale=4096, parts=8, entries=16, rounds=6):
    """Rows of (key, vector, label), all vectors of one length."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not rows:
        return []
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(scale * x) for x in r[1]] for r in rows]
    dim = len(whole[0])
    cut = [dim * i // parts for i in range(parts + 1)]
    books, codes, errors = [], [[] for _ in rows], [0] * len(rows)
    for a, b in zip(cut[:-1], cut[1:], strict=True):
        points = [v[a:b] for v in whole]
        book = [list(p) for p in points[:entries]]

        def nearest(p, book=book):
            d = [sum((x - y) ** 2 for x, y in zip(p, e, strict=True)) for e in book]
            return d.index(min(d)), min(d)

        for _ in range(rounds):
            of = [nearest(p)[0] for p in points]
            for e in range(len(book)):
                mine = [p for p, o in zip(points, of, strict=True) if o == e]
                if mine:
                    book[e][:] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
        for i, p in enumerate(points):
            code, d = nearest(p)
            codes[i].append(f"{code:02x}")
            errors[i] += d
        books.append(book)
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    totals = {}
    for r, e in zip(rows, errors, strict=True):
        totals[r[2]] = totals.get(r[2], 0) + e
    return [(r[0], "".join(c), e, totals[r[2]], digest) for r, c, e in zip(rows, codes, errors, strict=True)]


def frame(spark, rows):
    names = "vec_id BIGINT, embedding ARRAY<FLOAT>, label INT, key INT, v STRING, code STRING, of INT, dim INT"
    return spark.createDataFrame([(*r, 7, "x", "y", 1, 2) for r in rows], names)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def vectors(seed, n, dim, spread=1.0, centres=5):
    pick = random.Random(seed)
    at = [[pick.uniform(-1, 1) for _ in range(dim)] for _ in range(centres)]
    out = []
    for i in range(n):
        c = pick.choice(at)
        out.append((i, [float(np.float32(x + spread * pick.gauss(0, 1))) for x in c], pick.choice([0, 1, None])))
    return out


@pytest.mark.parametrize("dim,spread", [(16, 0.05), (24, 1.0), (13, 0.5), (5, 0.2)])
def test_matches_brute_force(spark, dim, spread):
    rows = vectors(dim, 400, dim, spread)
    rows += [(1000 + i, rows[3][1], 9) for i in range(150)]
    result = vector_codes.compress_vectors(frame(spark, rows).repartition(3))
    assert result.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert got(result) == sorted(brute(rows), key=str)


def test_unusable_vectors_repeated_and_null_keys(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [None] * 8, 1), (3, [nan] * 8, 1), (4, [inf] * 8, 1), (5, [1.0] * 7 + [-inf], None)]
    rows = [(i % 20, [float(i % 7), *([0.25 * i] * 7)], None) for i in range(60)]
    rows += [(None, [3.0] * 8, 4), (None, [3.0] * 8, 4), (7, [1.0] * 8, 4)]
    assert got(vector_codes.compress_vectors(frame(spark, odd + rows))) == sorted(brute(rows), key=str)


def test_few_rows_and_none(spark):
    rows = [(3, [0.1] * 8, None), (1, [0.9] * 8, 2)]
    assert got(vector_codes.compress_vectors(frame(spark, rows))) == sorted(brute(rows), key=str)
    assert vector_codes.compress_vectors(frame(spark, [])).count() == 0
    assert vector_codes.compress_vectors(frame(spark, [(1, None, 1)])).count() == 0


def test_each_length_has_codebooks_of_its_own(spark):
    short, long, none = vectors(1, 40, 8), vectors(2, 40, 16), [(1, [], 5), (2, [], 5)]
    want = []
    for rows in (short, long, none):
        want += [(k, c, e, None, d) for k, c, e, _, d in brute([(k, v, k) for k, v, _ in rows])]
    found = vector_codes.compress_vectors(frame(spark, short + long + none)).collect()
    assert sorted(((r[0], r[1], r[2], None, r[4]) for r in found), key=str) == sorted(want, key=str)


def test_components_beyond_exact_distances_fail(spark):
    with pytest.raises(Exception, match="too large for exact distances"):
        vector_codes.compress_vectors(frame(spark, [(1, [1e30] * 8, 1)])).collect()


def test_whole_nodes_are_assigned_by_their_sums():
    """Far groups are settled without looking at their points."""
    pick = np.random.default_rng(3)
    centres = np.arange(8)[:, None] * 100_000 + np.zeros((8, 4), np.int64)
    points = np.repeat(centres, 512, 0) + pick.integers(-50, 50, (4096, 4))
    tree = vector_codes.grow(points, vector_codes.LEAF)
    codes, sums, counts, one_by_one = vector_codes.assign(tree, centres)
    assert one_by_one == 0 and counts.tolist() == [512] * 8
    assert (codes == tree.points[:, 0].round(-5) // 100_000).all()
    assert (sums == np.add.reduceat(points, np.arange(0, 4096, 512))).all()


@pytest.mark.parametrize("n,k,m,spread", [(1, 1, 3, 5), (5, 16, 2, 2), (2500, 16, 8, 400), (2500, 7, 3, 3), (300, 3, 0, 1)])
def test_assignment_of_a_block(n, k, m, spread):
    pick = np.random.default_rng(n + k)
    points = pick.integers(-spread, spread + 1, (n, m))
    points[: n // 3] = points[0]
    book = points[pick.integers(0, n, k)]
    [tree] = vector_codes._unpack(vector_codes._pack(points, 1), 1)
    codes, sums, counts, _ = vector_codes.assign(tree, book)
    want = ((tree.points[:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert (codes == want).all() and (points[tree.order] == tree.points).all()
    for e in range(k):
        assert counts[e] == (want == e).sum() and (sums[e] == tree.points[want == e].sum(0)).all()
