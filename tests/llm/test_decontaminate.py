import hashlib
import random

import pytest

from plotscope.llm import decontaminate

from .helpers import AWKWARD, docs
from .test_resampling import words_of


def brute(rows, benchmark, window=10):
    out = []
    windows = {}
    for item, text in benchmark:
        w = words_of(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(item)
    sizes = {len(w) for w in windows}
    for key, text in rows:
        w = words_of(text)
        hit, items = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (found := windows.get(tuple(w[i : i + size]))) is not None:
                    hit.update(range(i, i + size))
                    items |= found
        names = sorted(str(i) for i in items if i is not None)
        digest = hashlib.sha256(",".join(names).encode()).hexdigest()
        out.append((key, len(w), len(hit), len(names), digest, bool(hit)))
    return sorted(out, key=str)


def items(spark, rows):
    return spark.createDataFrame([(*r, "x", 3) for r in rows], "item_id BIGINT, text STRING, words STRING, key INT")


def got(spark, rows, benchmark, **how):
    return sorted(map(tuple, decontaminate.contamination_digest(docs(spark, rows), items(spark, benchmark), **how).collect()), key=str)


def case(seed, alphabet):
    pick = random.Random(seed)
    some = ["Ab", "c", "ñandú", "7", "longer", "words"][:alphabet]

    def text(n):
        return "".join(pick.choice(some) + pick.choice([" ", ", ", "\n", "-"]) for _ in range(n))

    benchmark = [(i, text(pick.randrange(0, 30))) for i in range(30)]
    benchmark += [(100 + i, benchmark[3][1]) for i in range(10)] + [(3, benchmark[3][1]), (None, text(12)), (200, None)]
    rows = [(i, text(pick.randrange(0, 40))) for i in range(60)]
    for i in range(60, 160):
        t = pick.choice(benchmark)[1] or ""
        w = t.split()
        cut = " ".join(w[pick.randrange(0, 3) : len(w) - pick.randrange(0, 3)])
        rows.append((i, f"{text(pick.randrange(0, 9))} {cut.upper()} {text(pick.randrange(0, 9))}"))
    return rows, benchmark


@pytest.mark.parametrize("seed,alphabet", [(1, 6), (2, 2), (3, 1)])
@pytest.mark.parametrize("window", [10, 4, 2])
def test_matches_brute_force(spark, seed, alphabet, window):
    rows, benchmark = case(seed, alphabet)
    assert got(spark, rows, benchmark, window=window) == brute(rows, benchmark, window)


@pytest.mark.parametrize("chunk,block", [(4, 50), (1, 200), (7, 1)])
def test_blocks_and_chunks_of_any_size(spark, monkeypatch, chunk, block):
    monkeypatch.setattr(decontaminate, "CHUNK_WINDOWS", chunk)
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    rows, benchmark = case(4, 6)
    benchmark = benchmark[:8] + benchmark[-3:]
    assert got(spark, rows[::4], benchmark) == brute(rows[::4], benchmark)


def test_awkward_rows(spark):
    benchmark = [(1, "plain words of a plain text"), (2, "word " * 12), (3, ""), (4, None), (5, "row")]
    assert got(spark, AWKWARD, benchmark) == brute(AWKWARD, benchmark)


def test_empty_tables(spark):
    assert got(spark, [], [(1, "a b")]) == []
    for benchmark in ([], [(1, None), (2, " .,")]):
        assert got(spark, AWKWARD, benchmark) == brute(AWKWARD, benchmark)


def test_spans_are_word_places(spark):
    hits = decontaminate.benchmark_hits(docs(spark, [(1, "x A b. c y a B C"), (2, "a b")]), items(spark, [(8, "a b c")]))
    found = {r.doc_id: (r.n_words, r.spans, r["items"]) for r in hits.collect()}
    assert found == {1: (8, [1, 4, 5, 8], ["8"]), 2: (2, None, None)}
    clean = decontaminate.without_passages(docs(spark, [(1, "a b c"), (2, "a b")]), items(spark, [(8, "a b c")]))
    assert [r.doc_id for r in clean.collect()] == [2]


def test_the_prefix_of_a_window_is_its_rarest_shingle(spark):
    block = decontaminate.make_block({b"the of the of rare one the": ["1"]}, 10)
    table = docs(spark, [(i, "the of the of the of") for i in range(5)] + [(9, "of rare one"), (10, "of rare one the")])
    counts = decontaminate.shingle_counts(table, "text", block)
    [(keys, _, window, place)] = decontaminate.prefixes(block, counts).values()
    assert len(keys) == 1 and window.tolist() == [0] and place.tolist() == [2]
