import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from plotscope.llm import mixing, quality, secrets
from tests.llm.helpers import AWKWARD
from tests.llm.test_jaccard import brute as components
from tests.llm.test_packing import check_sequences


def frame(spark, rows):
    return spark.createDataFrame(
        [(k, t, "en", s, len(t or ""), "x", 1) for k, t, s in rows],
        "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, found STRING, size INT",
    )


def test_every_stage_follows_from_its_input(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    stages = [f for _, f in corpus_pipeline.STAGES]
    assert len(stages) == 5
    good = stages[0](spark, docs, tiny)
    net = quality.train_on_sample(docs, spark.read.parquet(f"{tiny}/labels.parquet"))
    rows = docs.collect()
    kept = [r for r, s in zip(rows, quality.scores(net, [r.text for r in rows]), strict=True) if s >= 0.3]
    assert sorted(good.collect()) == sorted(kept) and good.columns == docs.columns

    unique = stages[1](spark, good, tiny)
    near = components([(r.doc_id, r.text) for r in kept], width=5, percent=80)
    lead = {k for k, _, c in near if k == c}
    assert sorted(unique.collect()) == sorted(r for r in kept if r.doc_id in lead)

    clean = stages[2](spark, unique, tiny).cache()
    scan = secrets.start_scanner()
    want = {r.doc_id: secrets.replace_spans(r.text, scan(r.text), "[SECRET]") for r in unique.collect()}
    assert {r.doc_id: (r.text, r.n_chars) for r in clean.collect()} == {k: (t, len(t)) for k, t in want.items()}

    mixed = stages[3](spark, clean, tiny)
    taken = {r.doc_id: r.taken for r in mixing.mix_digest(clean).collect()}
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(r.text.split())
    assert {k: words[k] for k in taken if taken[k]} and all(abs(words[k] - n) <= 3 * len(want[k].split()) for k, n in taken.items())
    assert mixed.columns == docs.columns

    packed = stages[4](spark, clean, tiny).collect()
    check_sequences(packed)
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sums = {
        k: zlib.crc32(np.array([*whole.encode(t, add_special_tokens=False).ids, 1][:4096], "<u4").tobytes())
        for k, t in want.items()
    }
    assert {r.doc_id: r.ids_crc32 for r in packed if r.piece == 0} == sums


def test_run_is_the_stages_in_turn(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, tiny)
    key = lambda df: sorted(tuple(r)[:5] for r in df.collect())
    assert key(corpus_pipeline.run(spark, tiny)) == key(docs)


def test_awkward_rows(spark, tiny):
    rows = [(*r, s) for r, s in zip(AWKWARD, [None, "a", "a", "b", "b", "b", None, None, "c"], strict=True)]
    for name, stage in corpus_pipeline.STAGES:
        df = frame(spark, rows)
        out = stage(spark, df, tiny)
        if name != "best-fit packing":
            assert out.columns == df.columns
        out.collect()
        assert stage(spark, frame(spark, []), tiny).count() == 0
    kept = corpus_pipeline.keep_one_of_each(spark, frame(spark, rows), tiny).collect()
    assert sorted((r.doc_id for r in kept), key=repr) == [1, 2, 3, 4, 5, 6, None, None]


def five_word_sets(rows):
    words = [(t or "").lower().split() for t in rows]
    return [set(zip(*(w[i:] for i in range(5)), strict=False)) if len(w) >= 5 else {tuple(w)} for w in words]


def test_near_copies_are_those_of_five_words_and_four_fifths(spark, tiny):
    pick, texts = random.Random(5), []
    for _ in range(30):
        words = [f"w{pick.randrange(5000)}" for _ in range(100)]
        texts.append(" ".join(words))
        more = [f"w{pick.randrange(5000)}" for _ in range(pick.choice([5, 15, 20, 22, 23, 24, 25, 40]))]
        texts.append(" ".join(words + more))
    sets = five_word_sets(texts)
    like = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2], strict=True)]
    assert any(0.8 <= x < 0.85 for x in like) and any(x < 0.8 for x in like)
    want = [*range(0, 60, 2), *(2 * i + 1 for i, x in enumerate(like) if x < 0.8)]
    kept = corpus_pipeline.keep_one_of_each(spark, frame(spark, [(i, t, "a") for i, t in enumerate(texts)]), tiny)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)


def test_two_texts_under_one_key(spark, tiny):
    words = lambda name: " ".join(f"{name}{i}" for i in range(60))
    a, b, c = words("a"), words("b"), words("c")
    rows = [(3, a, "x"), (5, a + " z", "x"), (5, b, "x"), (9, b + " z", "x"), (7, c, "x"), (7, c + " z", "x"), (8, "", "x"), (8, c.upper(), "x")]
    kept = corpus_pipeline.keep_one_of_each(spark, frame(spark, rows), tiny).collect()
    got = sorted((r.doc_id, r.text) for r in kept)
    assert got in [sorted([(3, a), (5, b), (7, x), (8, "")]) for x in (c, c + " z")]


def test_columns_with_the_names_that_stages_use(spark, tiny):
    rows = [(1, "a b c d e f", "s", 1, 2, 3, 4, 5), (2, "a b c d e f", "s", 1, 2, 3, 4, 5)]
    names = "doc_id BIGINT, text STRING, source STRING, n_chars BIGINT, lead INT, lead_mark INT, row INT, mark INT"
    df = spark.createDataFrame(rows, names)
    kept = corpus_pipeline.keep_one_of_each(spark, df, tiny)
    assert kept.columns == df.columns and [tuple(r) for r in kept.collect()] == rows[:1]
