"""Words of whole texts as bytes, in lists of bounded size.

Words are runs of ASCII letters, digits and characters beyond ASCII; A to Z are lower-cased.
In UTF-8 all bytes of a character beyond ASCII are 0x80 or more, so bytes decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-z\x80-\xff]")

#: Bytes of a text whose words a task holds at a time; one word may have more.
PIECE_BYTES = 1 << 20


def word_lists(raw: bytes | None) -> Iterator[list[bytes]]:
    """The words of a text (UTF-8) in their order; null has none."""
    raw = (raw or b"").lower()
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > PIECE_BYTES:
            gap = _GAP.search(raw, at + PIECE_BYTES)
            end = gap.start() if gap else end
        yield _WORD.findall(raw, at, end)
        at = end


def raw_texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()
