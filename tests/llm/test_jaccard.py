import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from plotscope.llm import jaccard
from plotscope.llm.components import component_labels, joined_labels
from plotscope.llm.shingles import Powers, shingle_sets
from tests.llm.helpers import AWKWARD, docs

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, width=4):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", (text or "").translate(LOWER)) if x]
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(zip(*(w[i:] for i in range(width)), strict=False))


def brute(rows, width=4, percent=85):
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    own = [key if not sets[i] else least.get(find(i)) for i, (key, _) in enumerate(rows)]
    return sorted(((k, len(sets[i]), own[i]) for i, (k, _) in enumerate(rows)), key=repr)


def run(spark, rows, **settings):
    found = jaccard.jaccard_components(docs(spark, rows), **settings).collect()
    return sorted(map(tuple, found), key=repr)


def families(seed, many=60, sizes=(5, 8, 12, 16, 20, 40, 90, 200)):
    """Texts and copies of copies with a few words changed, added or dropped."""
    pick = random.Random(seed)
    word = lambda: f"w{pick.randrange(4000)}"
    passage = [word() for _ in range(25)]
    texts = []
    for _ in range(many):
        base = [word() for _ in range(pick.choice(sizes))]
        if pick.random() < 0.4:
            base[3:3] = passage
        for _ in range(pick.choice([1, 1, 2, 6])):
            copy = list(base)
            for _ in range(pick.choice([0, 0, 1, 1, 2, 4])):
                at = pick.randrange(len(copy))
                copy[at : at + pick.choice([0, 1, 1, 2])] = [word()] * pick.choice([0, 1, 1])
                copy = copy or [word()]
            texts.append(" ".join(copy))
    pick.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("seed", "settings"), [(1, {}), (2, {"tile": 3}), (3, {"scan_cost": 0}), (4, {"few_nodes": 0, "few_pairs": 0, "tile": 5})])
def test_components_match_brute_force(spark, seed, settings):
    rows = families(seed)
    assert run(spark, rows, **settings) == brute(rows)


@pytest.mark.parametrize("scan_cost", [0, 4, 200])
def test_every_linked_pair_shares_a_key(scan_cost):
    """The lists are exhaustive: no pair that links has disjoint keys."""
    pick = random.Random(scan_cost)
    classes = jaccard.Classes(scan_cost=scan_cost)
    linked = 0
    for _ in range(1500):
        n = pick.choice([1, 2, 6, 7, 8, 13, 14, 15, 20, 33, 60, 150])
        a = {pick.getrandbits(64) for _ in range(n)}
        b = set(a)
        for _ in range(pick.randint(1, 2 + n // 8)):
            if pick.random() < 0.5 and len(b) > 1:
                b.remove(pick.choice(sorted(b)))
            else:
                b.add(pick.getrandbits(64))
        if a != b and 100 * len(a & b) >= 85 * len(a | b):
            linked += 1
            keys = [set(classes.keys(np.array(sorted(x), np.uint64)).tolist()) for x in (a, b)]
            assert keys[0] & keys[1], (len(a), len(b))
    assert linked > 200


def test_boundary_follows_cost():
    assert jaccard.Classes(scan_cost=0).light < jaccard.Classes().light < jaccard.Classes(scan_cost=500).light


def test_shingle_hashes_tell_sets_apart():
    texts = ["", None, " \t", "A b", "a B", "b a", "a b c d", "a b c d a b c d", "ab c d e", "a bc d e", "é b c d e", "x" * 3_000_000]
    got = list(shingle_sets(texts, 4, Powers()))
    want = [shingles(t) for t in texts]
    assert [len(g) for g in got] == [len(w) for w in want]
    for i, a in enumerate(want):
        for j, b in enumerate(want):
            assert (got[i].tolist() == got[j].tolist()) == (a == b)


def test_copies_around_a_hidden_centre_are_one_component(spark):
    """Copies link with their source but hardly with each other; the source comes last."""
    pick = random.Random(5)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(60):
        copy = list(base)
        for at in pick.sample(range(400), 6):
            copy[at] = f"x{i}_{at}"
        rows.append((i, " ".join(copy)))
    rows.append((60, " ".join(base)))
    assert run(spark, rows, tile=16) == brute(rows)
    assert {c for *_, c in run(spark, rows)} == {0}


def test_awkward_rows(spark):
    assert run(spark, AWKWARD) == brute(AWKWARD)
    assert run(spark, []) == []
    assert run(spark, [(1, None)]) == [(1, 0, 1)]
    many = [(i % 7, "the same six words in all rows") for i in range(500)]
    assert run(spark, many) == brute(many)


def test_component_labels(spark):
    pick = random.Random(9)
    edges = [(pick.randrange(300), pick.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    got = {r.node: r.label for r in component_labels(spark.createDataFrame(edges, "u BIGINT, v BIGINT")).collect()}
    near = defaultdict(set)
    for u, v in edges:
        near[u].add(v)
        near[v].add(u)
    for start in near:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got.get(start, start) == min(seen)
    assert component_labels(spark.createDataFrame([], "u BIGINT, v BIGINT")).count() == 0


def test_joined_labels(spark):
    pick = random.Random(4)
    before, more = ([(pick.randrange(200), pick.randrange(200)) for _ in range(n)] for n in (90, 40))
    frames = [spark.createDataFrame(e, "u BIGINT, v BIGINT") for e in (before, more, before + more)]
    joined = joined_labels(component_labels(frames[0]), frames[1])
    assert sorted(joined.collect()) == sorted(component_labels(frames[2]).collect())


def test_fine_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(3)
    for n, gone in ((5, 0), (700, 50), (9000, 700)):
        own = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        other = np.unique(np.concatenate([own[gone:], rng.integers(0, 1 << 63, gone, dtype=np.uint64)]))
        differ = len(np.setxor1d(own, other))
        a, b = (np.frombuffer(jaccard.fine_sketch(x), np.uint8) for x in (own, other))
        size = min(len(a), len(b))
        assert np.bitwise_count(jaccard.folded(a, size) ^ jaccard.folded(b, size)).sum() <= differ
        assert jaccard.folded(a, 128).tobytes() == jaccard.sketch(own)


def test_fine_sketches_rule_out_unrelated_long_sets():
    rng = np.random.default_rng(4)
    one, two = (np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)) for _ in range(2))
    rows = [(1, len(one), jaccard.fine_sketch(one)), (2, len(two), jaccard.fine_sketch(two)), (3, len(one), jaccard.fine_sketch(one))]
    group = pa.table({"leader": [1] * 3, "block": [0] * 3, "name": [r[0] for r in rows], "n": [r[1] for r in rows], "prints": [r[2] for r in rows]})
    assert jaccard._may_link(85)(group).to_pydict() == {"u": [1], "block": [0], "v": [3]}
