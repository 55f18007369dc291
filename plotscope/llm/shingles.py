"""Word shingles of many texts at once, as sorted arrays of 64-bit hashes.

Words are hashed with prefix sums of a polynomial over the bytes of a whole block of
texts, so the cost per character is a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

#: Characters handled together: bounds the memory of a task.
BLOCK_BYTES = 1 << 20

_U = np.uint64
# Odd multipliers; any fixed ones do.
_BASE = 0x9E3779B97F4A7C15
_PLACES = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=_U)
_LOWER[0x41:0x5B] += _U(0x20)
_LOWER += _U(1)


def wrapped(number: int) -> np.uint64:
    """A whole number modulo 2^64."""
    return _U(number & 0xFFFFFFFFFFFFFFFF)


def mix(h: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all of them."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


class Powers:
    """Powers of the base and of its inverse, extended as longer blocks come."""

    def __init__(self):
        self.up = self.down = np.ones(1, _U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            inverse = pow(_BASE, -1, 1 << 64)
            self.up, self.down = (
                np.cumprod(np.concatenate([np.ones(1, _U), np.full(n, b, _U)])) for b in (_BASE, inverse)
            )
        return self.up[:n], self.down[:n]


def _blocks(texts: Sequence[str | None]) -> Iterator[list[bytes]]:
    block, size = [], 0
    for text in texts:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if block and size + len(raw) > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append(raw)
        size += len(raw) + 1
    if block:
        yield block


def shingle_sets(texts: Sequence[str | None], width: int, powers: Powers) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its ``width``-word shingles.

    A to Z are lower-cased, words end at ASCII white space. With fewer words the whole
    sequence is one shingle; without any the array is empty.
    """
    for block in _blocks(texts):
        raw = np.frombuffer(b" " + b" ".join(block) + b" ", np.uint8)
        up, down = powers.upto(len(raw))
        sums = np.cumsum(_LOWER[raw] * up)
        space = _SPACE[raw]
        # A word starts after a space and ends before one.
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        words = mix((sums[ends - 1] - sums[starts - 1]) * down[starts] + (ends - starts).astype(_U))
        first = np.cumsum([1, *(len(b) + 1 for b in block)])
        at = np.searchsorted(starts, first)
        n = len(words) - width + 1
        if n > 0:
            runs = mix(sum((words[i : i + n] * _PLACES[i % 4] ** _U(1 + i // 4) for i in range(width)), _U(0)))
        for lo, hi in zip(at[:-1], at[1:], strict=True):
            if hi - lo >= width:
                yield np.unique(runs[lo : hi - width + 1])
            elif hi > lo:
                short = words[lo:hi] * _PLACES[np.arange(hi - lo) % 4] ** (1 + np.arange(hi - lo) // 4).astype(_U)
                yield mix(np.array([wrapped(int(short.sum(dtype=_U)) + int(hi - lo) * _BASE)], _U))
            else:
                yield np.empty(0, _U)
