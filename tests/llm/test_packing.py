import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plotscope.llm import packing
from tests.llm.helpers import AWKWARD, LONG, docs, noise

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
WORDS = packing.WordTokenizer(PATH)


def ids(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


TEXTS = [
    "",
    " \n\t\x0b\x0c ",
    "It's we'LL don't 'S 12.5 ½ ²x ªº __a__ -- ... a\x1cb c\x85d e\xa0f g h",
    "<|startoftext|> a<|endoftext|>b < | x <|ENDOFTEXT|>",
    "ÄÖÜ ẞß éÉ éÉ İI ıi ΑΣ ΣΑΣ Ǆ ŉ ﬁ K ſ",
    "文字 한국어 \U0001f600\U0001f468‍\U0001f469 ̀ à",
    "\x00\x01\x7f\x80\xad",
]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(WORDS.ids(text), "<u4").tolist() == ids(text)


@pytest.mark.parametrize("seed", range(60))
def test_ids_on_noise(seed):
    alphabet = ["abcTHE 's.,!?\n12", "äöüßÄÉç ́'ſKİ", "".join(map(chr, range(1, 0x180)))][seed % 3]
    text = noise(seed, alphabet, 400)
    assert np.frombuffer(WORDS.ids(text), "<u4").tolist() == ids(text)


def brute(lengths, capacity, most):
    """The same rule with a plain list of open bins."""
    out, bins, made = [], [], 0
    for n in lengths:
        fit = [b for b in bins if b[0] >= n]
        if fit:
            b = min(fit, key=lambda x: x[0])
            bins.remove(b)
        else:
            if len(bins) == most:
                bins.remove(min(bins, key=lambda x: x[0]))
            b, made = [capacity, made], made + 1
        out.append(capacity - b[0])
        if b[0] > n:
            bins.append([b[0] - n, b[1]])
    return out, made


@pytest.mark.parametrize("seed", range(20))
def test_bitset_bins_follow_the_plain_rule(seed):
    pick = random.Random(seed)
    lengths = [pick.randint(1, 64) for _ in range(500)]
    placed = list(packing.pack(lengths, 64, 1 + seed))
    offsets, made = brute(lengths, 64, 1 + seed)
    assert [o for _, o in placed] == offsets
    assert len({b for b, _ in placed}) == made


def check_sequences(rows, capacity=packing.CAPACITY):
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


def test_awkward_rows(spark):
    rows = packing.best_fit(packing.token_pieces(docs(spark, AWKWARD), PATH), lane_pieces=3).collect()
    check_sequences(rows)
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert got[1] == got[2] == got[3] == [(0, [1])]
    assert len(got[5]) == 2 and len(got[None]) == 2
    whole = [i for _, part in sorted(got[6]) for i in part]
    assert whole == [*ids(LONG), 1]
    assert all(len(part) == packing.CAPACITY for _, part in sorted(got[6])[:-1])
    assert packing.best_fit(packing.token_pieces(docs(spark, []), PATH)).count() == 0


def test_columns_with_clashing_names_are_kept(spark):
    df = spark.createDataFrame([(5, "a", 1)], "length INT, lane STRING, deal INT")
    row = packing.best_fit(df, capacity=8).collect()[0]
    assert (row.length, row.lane, row.deal, row.offset) == (5, "a", 1, 0)


def test_query_matches_whole_encodings_and_packs_tightly(spark, tiny):
    from plotscope.llm.queries import op5_best_fit

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = op5_best_fit(spark, tiny).collect()
    want = set()
    for key, text in texts.items():
        all_ids = [*ids(text), 1]
        for i in range(0, len(all_ids), 4096):
            part = np.array(all_ids[i : i + 4096], "<u4")
            want.add((key, i // 4096, i, len(part), zlib.crc32(part.tobytes())))
    assert {(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows} == want
    assert len(rows) == len(want)
    tokens = sum(r.length for r in rows)
    assert check_sequences(rows) <= 1.03 * tokens / 4096 + 1
