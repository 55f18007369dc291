import re

import pytest

from plotscope.llm import pii
from plotscope.llm.common import sha256_hex
from tests.llm.helpers import AWKWARD, docs, noise

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return [int(c) for c in s if c in "0123456789"]


def luhn(ds):
    total = 0
    for i, d in enumerate(reversed(ds)):
        d = d * 2 if i % 2 else d
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if max(map(int, m.group().split("."))) <= 255]
    for m in CARD.finditer(text):
        ds = digits(m.group())
        if 13 <= len(ds) <= 19 and luhn(ds):
            out.append(("card", m.start(), m.end()))
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m.group())) <= 15]
    return out


TEXTS = [
    "mail a.b+c@x-y.example.com, or a@b and @c.d.e x@y.z.",
    "a@b.c@d.e f@@g.h .@-.-",
    "1.2.3.4.5.6.7.8 999.1.1.1 0255.1.1.1 1..2.3.4 12.34.56.78.",
    "4111 1111 1111 1111 and 4111-1111-1111-1112 4111 1111 1111 1111 0",
    "+1 (225) 555-4536 +49 30 1234567890123456 +1 +12-",
    "ä@b.de 文字@x.y +1 225 555 4536文",
]


@pytest.mark.parametrize("text", TEXTS)
def test_base_spans_match_whole_text_expressions(text):
    find = pii.start_finder()
    assert [s for s in find(text) if s[0] in pii.BASE_KINDS] == brute(text)


@pytest.mark.parametrize("seed", range(300))
def test_base_spans_on_noise(seed):
    text = noise(seed, "0123456789.@+ -()ab%ä" if seed % 2 else "127.0 -@+a", 250)
    find = pii.start_finder()
    assert [s for s in find(text) if s[0] in pii.BASE_KINDS] == brute(text)


def test_added_kinds():
    find = pii.start_finder()
    text = "pay IBAN: DE89 3704 0044 0532 0130 00 now, see ftp://joe:pw@host.example/x and http://host.example/"
    added = [(k, text[a:b]) for k, a, b in find(text) if k in pii.EXTRA_KINDS]
    assert added == [("iban", "DE89 3704 0044 0532 0130 00"), ("login", "ftp://joe:pw@host.example")]
    assert not [s for s in find("IBAN DE89 3704 0044 0532 0130 01") if s[0] == "iban"]


def test_awkward_rows(spark):
    found = pii.personal_data_digest(docs(spark, AWKWARD)).collect()
    assert len(found) == len(AWKWARD)
    assert {(r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans, r.base_sha256) for r in found} == {
        (0, 0, 0, 0, "", sha256_hex(""))
    }
    assert pii.personal_data_digest(docs(spark, [])).count() == 0


def test_query_matches_brute_force(spark, tiny):
    from plotscope.llm.queries import op2_pii

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    rows = op2_pii(spark, tiny).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = brute(texts[r.doc_id])
        assert r.base_sha256 == sha256_hex(",".join(f"{k}:{a}:{b}" for k, a, b in spans))
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[0] == k for s in spans) for k in pii.BASE_KINDS)
