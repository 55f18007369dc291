"""Cleaning of raw roll text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text accepted as a number: optional sign, digits, optional fraction and exponent.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def strip(c: Column) -> Column:
    """Remove white space of every kind at both ends (``trim`` only removes blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Stripped text, with empty text as null. The reader of zips does the same in Arrow
    (``sources.zips.cleaned``)."""
    return F.nullif(strip(c), F.lit(""))


def to_number(c: Column) -> Column:
    """Text to double; anything that is not a plain finite number becomes null."""
    return F.when(c.rlike(_NUMBER), c.try_cast("double"))


def zip5(c: Column) -> Column:
    """First five characters of a ZIP, left-padded with zeros; null gives 00000."""
    return F.lpad(F.substring(strip(F.coalesce(c, F.lit(""))), 1, 5), 5, "0")


def normalize_address(c: Column) -> Column:
    """Upper case, stripped, punctuation deleted, then runs of white space collapsed."""
    text = strip(F.upper(F.coalesce(c, F.lit(""))))
    text = F.regexp_replace(text, r"(?U)[^\w\s]", "")
    return F.regexp_replace(text, r"(?U)\s+", " ")


def is_absentee(own_addr: Column, situs_addr: Column, mail_zip: Column, situs_zip: Column) -> Column:
    """Owner mail goes elsewhere: another address or ZIP, given that a mail ZIP is known."""
    elsewhere = (normalize_address(own_addr) != normalize_address(situs_addr)) | (mail_zip != situs_zip)
    return elsewhere & ~mail_zip.isin("00000", "")


def is_out_of_state(state: Column, home: tuple[str, ...]) -> Column:
    code = F.upper(strip(F.coalesce(state, F.lit(""))))
    return ~code.isin(*home) & (code != "")


def recording_ref(book: Column, page: Column, clerk: Column) -> Column:
    """``book-page`` where a book is given, else ``CLERK:number``, else null."""
    has_book = book.isNotNull() & (book != "")
    has_clerk = clerk.isNotNull() & (clerk != "")
    return F.when(has_book, F.concat(book, F.lit("-"), F.coalesce(page, F.lit("")))).when(
        has_clerk, F.concat(F.lit("CLERK:"), clerk)
    )
