"""Expressions on text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The text patterns the counts use.
TOKEN = r"[\p{L}\p{N}]+"
URL = r"https?://[^ \t\r\n\"'<>]+"
BASE64_LIKE = r"[A-Za-z0-9+/]{24,}={0,2}"
SYMBOL = r"[^\p{L}\p{N} \t\r\n]"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def pattern_key(text: Column) -> Column:
    """Key of a text with case, digits, punctuation and spacing taken out."""
    plain = F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")
    return F.md5(F.trim(plain))


def template(message: Column) -> Column:
    """Log message with each digit masked."""
    return F.regexp_replace(message, "[0-9]", "#")


def view_starts(length: Column, n: int) -> Column:
    """0-based starts of n windows, even from 0 to floor(length / 2)."""
    half = F.floor(length / 2)
    if n == 1:
        return F.array(F.lit(0).cast("bigint"))
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda v: F.floor(half * v / F.lit(n - 1)),
    )


def view_text(text: Column, start: Column) -> Column:
    """Window of ceil(length / 2) characters."""
    return F.substring(text, start + 1, F.ceil(F.length(text) / 2))
