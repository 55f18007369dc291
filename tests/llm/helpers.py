"""Awkward rows that every operator must take."""

import random

LONG = "word " * 40_000

AWKWARD = [
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "ä ß é 文字 \U0001f600 ends"),
    (5, "plain words of a plain text"),
    (5, "plain words of a plain text"),
    (None, "a row without a key"),
    (None, None),
    (6, LONG),
]


def docs(spark, rows, extra=True):
    """Documents with columns whose names the operators use themselves."""
    if not extra:
        return spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    names = "doc_id BIGINT, text STRING, spans STRING, key INT, n BIGINT, found STRING, size STRING, edits_ STRING"
    return spark.createDataFrame([(*r, "x", 1, 2, "y", "z", None) for r in rows], names)


def noise(seed, alphabet, length):
    pick = random.Random(seed)
    return "".join(pick.choice(alphabet) for _ in range(length))
