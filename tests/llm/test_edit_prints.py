import hashlib
import random

import numpy as np

from plotscope.llm import edit_prints
from tests.llm.helpers import AWKWARD, docs, noise

WALK = edit_prints.Walk()


def test_equal_texts_have_equal_prints_in_any_batch():
    texts = ["", "a", "ab" * 40, noise(1, "abcdef gh", 5000), "äöü文\U0001f600" * 30]
    alone = [WALK.fingerprints([t])[0] for t in texts]
    assert WALK.fingerprints(texts + texts[::-1]) == alone + alone[::-1]
    assert alone[0] == "" and len(set(alone)) == len(texts)


def test_likeness_falls_with_edits():
    pick = random.Random(3)
    letters = "etaoin shrdlu cmfwyp"
    for n in (300, 3000, 40_000):
        text = noise(n, letters, n)
        near = []
        for share in (0.0, 0.005, 0.05):
            changed = list(text)
            for _ in range(int(n * share)):
                at = pick.randrange(len(changed))
                changed[at : at + pick.choice([0, 1, 1])] = pick.choice(letters)
            near.append("".join(changed))
        prints = WALK.fingerprints([text, *near, noise(n + 1, letters, n)])
        like = [edit_prints.likeness(prints[0], p) for p in prints[1:]]
        assert like[0] == 1.0 and like[0] >= like[1] > like[3] and like[1] > like[2] >= 0
        assert like[1] > 0.5 and like[3] < 0.35


def test_likeness_bounds():
    assert edit_prints.likeness("", "") == 1.0
    assert edit_prints.likeness("", "ab") == edit_prints.likeness("ab", "") == 0.0
    assert edit_prints.likeness("abc", "abcd") < 1.0


def brute(rows):
    """Rows in descending key order, equal keys by text, null keys last, and their edits."""
    order = sorted(((k, t or "") for k, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    out = []
    for (key, text), (_, after) in zip(order, order[1:] + order[:1], strict=True):
        cut = len(text) // 3
        new = text[: len(text) - cut] + after[:cut]
        out.append((key, len(text), hashlib.sha256(new.encode()).hexdigest(), text, new, after))
    return out


def check(spark, rows, found):
    want = brute(rows)
    assert sorted((repr(r.doc_id), r.n_chars, r.edited_sha256) for r in found) == sorted((repr(w[0]), *w[1:3]) for w in want)
    prints = {t: p for t, p in zip((t for w in want for t in w[3:]), WALK.fingerprints([t for w in want for t in w[3:]]), strict=True)}
    rows = {(r.doc_id, r.edited_sha256, r.fingerprint): r for r in found}
    for key, _, sha, text, new, after in want:
        r = rows[key, sha, prints[text]]
        assert r.edited_fingerprint == prints[new]
        assert r.near_edited == edit_prints.likeness(prints[text], prints[new])
        assert r.near_next == edit_prints.likeness(prints[text], prints[after])


def test_followers_across_ranges(spark, monkeypatch):
    monkeypatch.setattr(edit_prints, "RANGE_ROWS", 3)
    pick = random.Random(4)
    rows = [(k, noise(k, "abc de", pick.randrange(0, 200))) for k in pick.sample(range(-500, 500), 60)]
    check(spark, rows, edit_prints.edit_fingerprints(docs(spark, rows)).collect())


def test_awkward_rows(spark):
    check(spark, AWKWARD, edit_prints.edit_fingerprints(docs(spark, AWKWARD)).collect())
    assert edit_prints.edit_fingerprints(docs(spark, [])).count() == 0
    alone = edit_prints.edit_fingerprints(docs(spark, [(1, "abcabc")])).collect()[0]
    assert (alone.near_next, alone.edited_sha256) == (1.0, hashlib.sha256(b"abcaab").hexdigest())


def test_query_follows_the_whole_table(spark, tiny):
    from plotscope.llm.queries import op7_edit_fingerprints

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()]
    found = op7_edit_fingerprints(spark, tiny).collect()
    check(spark, rows, found)
    assert sum(r.near_edited for r in found) > 0.55 * len(found) > 4 * sum(r.near_next for r in found)


def test_near_classes(spark):
    base, other = noise(1, "etaoin shrdlu", 3000), noise(2, "etaoin shrdlu", 3000)
    rows = [(1, base), (2, other), (3, base), (4, base[:2500] + "x" + base[2501:]), (5, ""), (6, ""), (None, base)]
    prints = WALK.fingerprints([t for _, t in rows])
    df = spark.createDataFrame([(k, p) for (k, _), p in zip(rows, prints, strict=True)], "doc_id BIGINT, fingerprint STRING")
    got = {r.doc_id: r.class_id for r in edit_prints.near_classes(df, least=0.7).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 1, 5: 5, 6: 5}


def shared_bands(print_):
    """End, number and symbols of the bands of one print, by the rule."""
    bands = edit_prints.Bands()
    ends = [e for e in bands.ends.tolist() if e <= len(print_)][-edit_prints.ENDS :]
    return {(e, i, *(print_[x] for x in places)) for e in ends for i, places in enumerate(bands.places(e))}


def test_keys_are_the_bands():
    prints = [noise(i, "0123456789abcdef", n) for i, n in enumerate([0, 1, 2, 7, 8, 15, 63, 64, 65, 200, 1344, 200])]
    prints[-1] = changed(prints[9], {3, 80, 150})
    keys, owners = edit_prints.Bands().keys(prints)
    for i, a in enumerate(prints):
        assert len(set(keys[owners == i])) == len(shared_bands(a))
        for j, b in enumerate(prints):
            assert len(set(keys[owners == i]) & set(keys[owners == j])) == len(shared_bands(a) & shared_bands(b))
    assert edit_prints.Bands().keys([])[0].size == 0


def test_recall_of_bands():
    """Of pairs of texts with a likeness of 0.8 or more, nine in ten share a band at least."""
    pick, met, pairs, close = random.Random(11), 0, 0, 0
    for trial in range(400):
        text = list(noise(trial, "etaoin shrdlu cmfwyp", pick.choice([40, 300, 1500, 6000])))
        other = text[:]
        for _ in range(pick.randint(1, 6)):
            at = pick.randrange(len(other) // 2, len(other))
            other[at : at + pick.choice([0, 1, 2])] = noise(pick.random(), "xyz", pick.choice([0, 1, 3]))
        other = other[: len(other) - pick.choice([0, 0, len(other) // 20, len(other) // 8])]
        a, b = WALK.fingerprints(["".join(text), "".join(other)])
        like = edit_prints.likeness(a, b)
        if 0.8 <= like < 1:
            pairs += 1
            close += like < 0.9
            met += bool(shared_bands(a) & shared_bands(b))
    assert pairs > 100 and close > 30 and met >= 0.9 * pairs


def test_a_common_beginning_fills_no_band():
    """Bands that texts with one beginning share grow with the texts, not with their pairs."""
    opening = noise(1, "etaoin shrdlu", 200)
    prints = WALK.fingerprints([opening + noise(i + 2, "etaoin shrdlu", 1800) for i in range(400)])
    for n in (100, 400):
        _, size = np.unique(edit_prints.Bands().keys(prints[:n])[0], return_counts=True)
        assert (size * (size - 1) // 2).sum() <= n


def test_clashing_columns(spark):
    rows = [(1, "ab" * 20, "x", 7, "y"), (2, "ab" * 20, None, None, "z"), (None, "ab" * 20, "w", 9, None)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, fingerprint STRING, print_name STRING, class_id INT, `row.name` STRING")
    got = edit_prints.with_classes(df)
    assert got.columns == ["doc_id", "fingerprint", "print_name", "row.name", "class_id"]
    found = sorted(((r[0], r[2], r[3], r[4]) for r in got.collect()), key=repr)
    assert found == sorted([(1, "x", "y", 1), (2, None, "z", 1), (None, "w", None, None)], key=repr)


def linked(rows, least=0.8):
    """Components of the rows (key, print) that share a band and are alike, by brute force."""
    label = {k: k for k, _ in rows}
    bands = [shared_bands(p) for _, p in rows]
    for i, (k, p) in enumerate(rows):
        for j, (m, q) in enumerate(rows[:i]):
            if p == q or (bands[i] & bands[j] and edit_prints.likeness(p, q) >= least):
                a, b = sorted((label[k], label[m]))
                label = {x: a if y == b else y for x, y in label.items()}
    return label


def classes(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id BIGINT, fingerprint STRING")
    return {r.doc_id: r.class_id for r in edit_prints.with_classes(df, **options).collect()}


def changed(print_, places):
    return "".join(f"{15 - int(c, 16):x}" if i in places else c for i, c in enumerate(print_))


def test_chain_whose_ends_are_not_alike(spark):
    """The middle one links two that are strangers to each other, beside a stranger to all."""
    first = noise(5, "0123456789abcdef", 64)
    middle = changed(first, {0, 1, 2, 6, 7, 8, 12, 13, 14})
    last = changed(middle, {3, 4, 5, 9, 10, 11, 15, 16, 17})
    assert edit_prints.likeness(first, last) < 0.8 <= min(edit_prints.likeness(middle, x) for x in (first, last))
    stranger = first[:24] + noise(6, "0123456789abcdef", 40)
    rows = [(1, stranger), (2, first), (3, middle), (4, last)]
    df = spark.createDataFrame(rows, "doc_id BIGINT, fingerprint STRING")
    got = {r.doc_id: r.class_id for r in edit_prints.near_classes(df).collect()}
    assert got == linked(rows) == {1: 1, 2: 2, 3: 2, 4: 2}


def test_classes_follow_brute_force(spark):
    pick, rows = random.Random(7), []
    for _ in range(30):
        print_ = noise(pick.random(), "0123456789abcdef", pick.choice([3, 20, 40, 70, 110, 200, 300]))
        for _ in range(pick.randint(1, 6)):
            print_ = changed(print_, set(pick.sample(range(len(print_)), len(print_) * pick.randint(0, 20) // 100)))
            print_ = print_[: len(print_) - pick.randint(0, 2)]
            rows.append((pick.randrange(10**6), print_))
    pick.shuffle(rows)
    for least in (0.8, 0.6):
        assert classes(spark, rows, least=least, tile=3) == linked(rows, least)


def test_query_has_the_classes(spark, tiny):
    from plotscope.llm.queries import op7_edit_fingerprints

    found = op7_edit_fingerprints(spark, tiny).collect()
    assert {r.doc_id: r.class_id for r in found} == linked([(r.doc_id, r.fingerprint) for r in found])
    assert len({r.class_id for r in found}) < len(found)
