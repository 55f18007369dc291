"""Token counts that follow edits.

A text is cut into leaves of whole pre-tokens. A segment tree over the leaves keeps
characters and tokens of every subtree. An edit descends the tree to the leaves it
touches, plus the context that their boundaries depend on, encodes that region again
and updates the sums above it; nothing else of the document is read.

A cut is made only before a single space that has non-space on both sides: the
pre-token pattern starts a new pre-token there whatever stands further left or right,
so leaves may be encoded on their own and their counts add up.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable
from functools import lru_cache

import tiktoken
from pyspark.sql import DataFrame

from plotscope.llm.common import map_texts

#: Characters per leaf: the least that an edit encodes again.
LEAF_CHARS = 512
#: A boundary depends on the character before it and the two from it on.
CONTEXT = 2

_SURE_CUT = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def load_encoding(vocabulary: str, pattern: str) -> tiktoken.Encoding:
    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def leaves_of(text: str, leaf_chars: int = LEAF_CHARS) -> list[str]:
    """Cut at the first sure boundary after every ``leaf_chars`` characters."""
    leaves, start = [], 0
    while len(text) - start > leaf_chars and (m := _SURE_CUT.search(text, start + leaf_chars)):
        leaves.append(text[start : m.start()])
        start = m.start()
    return [*leaves, text[start:]]


class TokenTree:
    """Segment tree of one document; ``encoded`` counts the characters encoded so far."""

    def __init__(self, text: str, count: Callable[[str], int], leaf_chars: int = LEAF_CHARS):
        self.count, self.leaf_chars, self.encoded = count, leaf_chars, 0
        self.leaves = leaves_of(text, leaf_chars)
        self._stack([self._count(leaf) for leaf in self.leaves])

    def _count(self, leaf: str) -> int:
        self.encoded += len(leaf)
        return self.count(leaf)

    def _stack(self, tokens: list[int]) -> None:
        self.width = 1 << (len(tokens) - 1).bit_length()
        pad = self.width - len(tokens)
        self.tokens = [0] * self.width + tokens + [0] * pad
        self.chars = [0] * self.width + [len(leaf) for leaf in self.leaves] + [0] * pad
        for node in range(self.width - 1, 0, -1):
            self._sum(node)

    def _sum(self, node: int) -> None:
        self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
        self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    def text(self) -> str:
        return "".join(self.leaves)

    def leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one past the end) and its start."""
        if at >= self.n_chars:
            last = len(self.leaves) - 1
            return last, self.n_chars - len(self.leaves[last])
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at >= start + self.chars[node]:
                start += self.chars[node]
                node += 1
        return node - self.width, start

    def edit(self, at: int, cut: int, put: str) -> None:
        """Replace ``cut`` characters from ``at`` on by ``put``; both are held to the text."""
        at = min(max(at, 0), self.n_chars)
        cut = min(max(cut, 0), self.n_chars - at)
        first, start = self.leaf_at(max(at - CONTEXT, 0))
        last, _ = self.leaf_at(at + cut)
        last = max(first, last)
        old = "".join(self.leaves[first : last + 1])
        new = leaves_of(old[: at - start] + put + old[at - start + cut :], self.leaf_chars)
        room = last + 1 - first
        if len(new) > room:
            tokens = self.tokens[self.width : self.width + len(self.leaves)]
            tokens[first : last + 1] = [self._count(leaf) for leaf in new]
            self.leaves[first : last + 1] = new
            self._stack(tokens)
            return
        for i, leaf in enumerate(new + [""] * (room - len(new)), first):
            self.leaves[i] = leaf
            self.tokens[self.width + i] = self._count(leaf) if leaf else 0
            self.chars[self.width + i] = len(leaf)
        nodes = range(self.width + first, self.width + last + 1)
        while (nodes := range(nodes[0] // 2, nodes[-1] // 2 + 1))[0] > 0:
            for node in nodes:
                self._sum(node)


def edited_token_counts(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    key: str = "doc_id",
    text: str = "text",
    edits: str = "edits",
    leaf_chars: int = LEAF_CHARS,
) -> DataFrame:
    """Token counts of every document before and after its edits.

    ``edits`` is an array of (at, cut, put): from code point ``at`` on, ``cut`` code points
    are replaced by ``put``; each edit refers to the text as the one before left it.
    Returns the key, n_chars, n_tokens, n_edits, n_chars_edited, n_tokens_edited and
    n_encoded_again, the characters that the edits made it encode. A null text counts as
    empty, null edits as none, null fields of an edit as 0 or the empty text, a null edit
    does nothing; positions outside the text are held to it. Repeated rows are kept.
    """

    def start():
        encode = load_encoding(vocabulary, pattern).encode_ordinary

        def answer(value: str | None, changes: list[dict | None] | None) -> tuple:
            tree = TokenTree(value or "", lambda leaf: len(encode(leaf)), leaf_chars)
            before = (tree.n_chars, tree.n_tokens)
            done, first = 0, tree.encoded
            for change in changes or []:
                if change is not None:
                    tree.edit(change["at"] or 0, change["cut"] or 0, change["put"] or "")
                    done += 1
            return (*before, done, tree.n_chars, tree.n_tokens, tree.encoded - first)

        return answer

    fields = (
        "n_chars BIGINT, n_tokens BIGINT, n_edits BIGINT,"
        " n_chars_edited BIGINT, n_tokens_edited BIGINT, n_encoded_again BIGINT"
    )
    return map_texts(docs, key, [text, edits], fields, start)
