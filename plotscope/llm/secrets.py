"""Secret scans: Aho-Corasick keyword prefilter, anchored expressions only near hits,
then embedded checksums.

The automaton holds every spelling of the keywords, so it runs on the text as it is and
its positions are code points. An expression is only tried where a keyword ends in a hit.
A long hexadecimal run has no keyword; it is found by one linear search.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from itertools import product

import ahocorasick
from pyspark.sql import DataFrame

from plotscope.llm.common import Span, map_texts, sha256_hex, small_slices, spans_text

BASE_KINDS = ("assign", "access", "hex")
EXTRA_KINDS = ("forge", "package")
KINDS = BASE_KINDS + EXTRA_KINDS
# Names of secrets, the access key prefix, and prefixes of tokens that
# carry the checksum of their own body.
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS_PREFIX = "AKIA"
FORGE_PREFIXES = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")
PACKAGE_PREFIX = "npm_"
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_BODY = re.compile(r"([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
_ORDER = {kind: i for i, kind in enumerate(KINDS)}


def base62(number: int, width: int = 6) -> str:
    digits = ""
    for _ in range(width):
        number, rest = divmod(number, 62)
        digits = BASE62[rest] + digits
    return digits


def checksum_valid(body: str, check: str) -> bool:
    """The last six characters are the CRC-32 of the body in base 62."""
    return base62(zlib.crc32(body.encode("ascii"))) == check


def keywords() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for name in NAMES:
        for letters in product(*({c, c.upper()} for c in name)):
            automaton.add_word("".join(letters), ("assign", len(name)))
    automaton.add_word(ACCESS_PREFIX, ("access", len(ACCESS_PREFIX)))
    for prefix in FORGE_PREFIXES:
        automaton.add_word(prefix, ("forge", len(prefix)))
    automaton.add_word(PACKAGE_PREFIX, ("package", len(PACKAGE_PREFIX)))
    automaton.make_automaton()
    return automaton


def start_scanner() -> Callable[[str], list[Span]]:
    """Build the automaton once and return the function text -> spans, ordered by start,
    then by kind as listed in ``KINDS``."""
    automaton = keywords()

    def scan(text: str) -> list[Span]:
        spans = [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
        hits = [(last + 1 - length, last + 1, kind) for last, (kind, length) in automaton.iter(text)]
        ends = dict.fromkeys(KINDS, 0)
        for at, after, kind in sorted(hits):
            if at < ends[kind]:
                continue
            if kind == "assign":
                if m := _ASSIGN.match(text, at):
                    ends[kind] = m.end()
                    if len(m.group(2)) >= 12:
                        spans.append((kind, at, m.end()))
            elif kind == "access":
                if m := _ACCESS.match(text, at):
                    ends[kind] = m.end()
                    if m.end() - at >= 18:
                        spans.append((kind, at, m.end()))
            elif (m := _BODY.match(text, after)) and checksum_valid(*m.groups()):
                ends[kind] = m.end()
                spans.append((kind, at, m.end()))
        return sorted(spans, key=lambda s: (s[1], _ORDER[s[0]]))

    return scan


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and ``found``, an array of (kind, start, end) in code points, end exclusive.

    Base kinds: ``assign`` (a named value of 12 or more characters), ``access`` (key ids
    of 18 or more), ``hex`` (runs of 16 or more); leftmost, non-overlapping per kind.
    Added kinds: ``forge`` and ``package`` tokens whose checksum holds. A null text counts
    as empty; an empty text has no spans; repeated rows and null keys are kept.
    """

    def start():
        scan = start_scanner()
        return lambda value: ([dict(zip(("kind", "start", "end"), s, strict=True)) for s in scan(value or "")],)

    return map_texts(docs, key, [text], "found ARRAY<STRUCT<kind: STRING, start: BIGINT, end: BIGINT>>", start)


def secrets_digest(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per base kind and the digests of the spans, as text: see ``find_secrets``."""

    def start():
        scan = start_scanner()

        def answer(value: str | None) -> tuple:
            spans = scan(value or "")
            base = [s for s in spans if s[0] in BASE_KINDS]
            counts = [sum(s[0] == kind for s in base) for kind in BASE_KINDS]
            return (*counts, sha256_hex(spans_text(base)), spans_text(spans))

        return answer

    fields = ", ".join(f"n_{kind} BIGINT" for kind in BASE_KINDS) + ", base_sha256 STRING, spans STRING"
    return map_texts(docs, key, [text], fields, start)


def redact_secrets(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every found span replaced by ``mark``; overlapping
    spans are replaced together. A null text stays null."""
    names = docs.columns
    place = names.index(text)
    schema = docs.schema

    def run(batches):
        import pyarrow as pa

        scan = start_scanner()
        for batch in small_slices(batches):
            clean = [None if v is None else replace_spans(v, scan(v), mark) for v in batch.column(place).to_pylist()]
            columns = list(batch.columns)
            columns[place] = pa.array(clean, columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(run, schema)


def replace_spans(text: str, spans: list[Span], mark: str) -> str:
    out, end = [], 0
    for _, start, stop in spans:
        if start >= end:
            out += [text[end:start], mark]
        end = max(end, stop)
    return "".join([*out, text[end:]])
