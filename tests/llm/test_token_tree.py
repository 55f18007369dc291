import random

import public_tokenizers
import pytest

from plotscope.llm import token_tree
from tests.llm.helpers import AWKWARD, docs, noise

VOCABULARY, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
ENCODING = token_tree.load_encoding(VOCABULARY, PATTERN)


def count(text):
    return len(ENCODING.encode_ordinary(text))


@pytest.mark.parametrize("seed", range(60))
def test_edits_keep_counts_exact(seed):
    pick = random.Random(seed)
    alphabet = ["ab 'st\n", "a  \t\x1c\x85 b", "word  's 're 12 ,.äß文"][seed % 3]
    text = noise(seed, alphabet, 600)
    tree = token_tree.TokenTree(text, count, leaf_chars=8)
    assert tree.n_tokens == count(text)
    for _ in range(25):
        at, cut = pick.randrange(-2, len(text) + 3), pick.randrange(0, 40)
        put = noise(pick.random(), alphabet, pick.choice([0, 1, 2, 30]))
        tree.edit(at, cut, put)
        at = min(max(at, 0), len(text))
        text = text[:at] + put + text[at + cut :]
        assert tree.text() == text
        assert (tree.n_tokens, tree.n_chars) == (count(text), len(text))


def test_only_the_touched_region_is_encoded_again():
    tree = token_tree.TokenTree("some words stand here " * 5_000, count)
    before = tree.encoded
    tree.edit(50_000, 3, "other")
    assert 0 < tree.encoded - before < 4 * token_tree.LEAF_CHARS


def test_awkward_rows(spark):
    rows = docs(spark, AWKWARD).selectExpr(
        "*", "CASE WHEN key = 1 THEN array(NULL, named_struct('at', 1L, 'cut', 1L, 'put', CAST(NULL AS STRING))) END edits"
    )
    found = token_tree.edited_token_counts(rows, VOCABULARY, PATTERN).collect()
    want = sorted((count(t or ""), count((t or "")[:1] + (t or "")[2:])) for _, t in AWKWARD)
    assert sorted((r.n_tokens, r.n_tokens_edited) for r in found) == want
    assert {r.n_edits for r in found} == {1}
    assert token_tree.edited_token_counts(rows.filter("false"), VOCABULARY, PATTERN).count() == 0


def test_query_matches_whole_encodings(spark, tiny):
    from plotscope.llm.queries import op1_edit_token_counts

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = op1_edit_token_counts(spark, tiny).collect()
    assert len(rows) == len(texts)
    for r in rows:
        t = texts[r.doc_id]
        n = len(t)
        e = t[: n // 3] + t[:12][::-1] + t[n // 3 + 12 :]
        at = min(2 * n // 3, len(e))
        e = e[:at] + " " + t[:64].split(" ")[0] + " " + e[at:]
        at = max(n - 5, 0)
        e = e[:at] + e[at + 5 :]
        assert (r.n_chars, r.n_tokens, r.n_edits) == (n, count(t), 3)
        assert (r.n_chars_edited, r.n_tokens_edited) == (len(e), count(e))
