"""Personal data by anchor expansion.

One Aho-Corasick pass per text finds anchors: at-signs, plus signs, digits, URL schemes
and account cues. At each anchor a deterministic local parser expands to both sides and
validates what it found. Nothing scans the text a second time, and an anchor inside a
span that the same parser already took is skipped, so a text costs its length.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import ahocorasick
from pyspark.sql import DataFrame

from plotscope.llm.common import Span, map_texts, sha256_hex, spans_text

BASE_KINDS = ("email", "ip", "card", "phone")
EXTRA_KINDS = ("iban", "login")
KINDS = BASE_KINDS + EXTRA_KINDS
# What an account number is announced by.
ACCOUNT_CUES = ("IBAN", "Iban", "iban")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_SCHEME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+.-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"[:#\x20]{0,3}([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30})")
_USER = re.compile(r"[^\x00-\x20/@:?#]+(?::[^\x00-\x20/@?#]*)?@[A-Za-z0-9.-]+")
_DIGIT = frozenset("0123456789")


def digits_of(text: str) -> str:
    return "".join(c for c in text if c in _DIGIT)


def luhn(digits: str) -> bool:
    """Check digit of payment cards: every second digit from the right counts double."""
    doubled = sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])
    return (doubled + sum(int(c) for c in digits[::-2])) % 10 == 0


def iban_valid(text: str) -> bool:
    """ISO 7064 remainder of an account number: 1 when country and check digits move last."""
    plain = text.replace(" ", "")
    if not 15 <= len(plain) <= 34:
        return False
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


def _ip_valid(parts: tuple[str, ...]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def anchors() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for sign, kind in [("@", "@"), ("+", "+"), ("://", "/"), *((d, "0") for d in "0123456789")]:
        automaton.add_word(sign, (kind, len(sign)))
    for cue in ACCOUNT_CUES:
        automaton.add_word(cue, ("#", len(cue)))
    automaton.make_automaton()
    return automaton


def start_finder() -> Callable[[str], list[Span]]:
    """Build the automaton once and return the function text -> spans, ordered by kind
    as listed in ``KINDS``, then by start."""
    automaton = anchors()

    def find(text: str) -> list[Span]:
        found: dict[str, list[Span]] = {kind: [] for kind in KINDS}
        email_end = ip_end = card_end = phone_end = account_end = login_end = 0
        for last, (sign, length) in automaton.iter(text):
            at = last + 1 - length
            if sign == "0":
                if at >= card_end and (m := _CARD.match(text, at)):
                    card_end = m.end()
                    digits = digits_of(m.group())
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(("card", at, card_end))
                first = at == ip_end or at == 0 or text[at - 1] not in _DIGIT
                if at >= ip_end and first and (m := _IP.match(text, at)):
                    ip_end = m.end()
                    if _ip_valid(m.groups()):
                        found["ip"].append(("ip", at, ip_end))
            elif sign == "@":
                begin = at
                while begin > email_end and text[begin - 1] in _LOCAL:
                    begin -= 1
                if begin < at and (m := _DOMAIN.match(text, at + 1)):
                    email_end = m.end()
                    found["email"].append(("email", begin, email_end))
            elif sign == "+":
                if at >= phone_end and (m := _PHONE.match(text, at)):
                    phone_end = m.end()
                    if 9 <= len(digits_of(m.group())) <= 15:
                        found["phone"].append(("phone", at, phone_end))
            elif sign == "/":
                begin = at
                while begin > login_end and text[begin - 1] in _SCHEME:
                    begin -= 1
                if begin < at and (m := _USER.match(text, last + 1)):
                    login_end = m.end()
                    found["login"].append(("login", begin, login_end))
            elif at >= account_end and (m := _IBAN.match(text, last + 1)):
                account_end = m.end(1)
                account = _valid_iban(m.group(1))
                if account:
                    found["iban"].append(("iban", m.start(1), m.start(1) + len(account)))
        return [span for kind in KINDS for span in found[kind]]

    return find


def _valid_iban(text: str) -> str:
    """The longest valid start of ``text``, which may run on into the next word."""
    ends = [i for i in range(len(text), 14, -1) if text[i - 1] != " "]
    return next((text[:i] for i in ends if iban_valid(text[:i])), "")


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and ``found``, an array of (kind, start, end) in code points, end exclusive.

    Base kinds: leftmost, non-overlapping matches per kind of email, IPv4 address, card
    (13 to 19 digits, Luhn) and phone (9 to 15 digits). Added kinds: ``iban`` after an
    account cue, and ``login``, a URL with user information. A null text counts as empty;
    an empty text has no spans; repeated rows and null keys are kept as they come.
    """

    def start():
        find = start_finder()
        return lambda value: ([dict(zip(("kind", "start", "end"), s, strict=True)) for s in find(value or "")],)

    return map_texts(docs, key, [text], "found ARRAY<STRUCT<kind: STRING, start: BIGINT, end: BIGINT>>", start)


def personal_data_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per base kind and the digests of the spans, as text: see ``find_personal_data``."""

    def start():
        find = start_finder()

        def answer(value: str | None) -> tuple:
            spans = find(value or "")
            base = [s for s in spans if s[0] in BASE_KINDS]
            counts = [sum(s[0] == kind for s in base) for kind in BASE_KINDS]
            return (*counts, sha256_hex(spans_text(base)), spans_text(spans))

        return answer

    fields = ", ".join(f"n_{kind} BIGINT" for kind in BASE_KINDS) + ", base_sha256 STRING, spans STRING"
    return map_texts(docs, key, [text], fields, start)
