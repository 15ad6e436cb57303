"""Text cleaning and multi-valued text columns.

Dirty inputs carry missing values as text stand-ins, measures with units glued
on, timestamps and money as text, and lists as delimited strings. Each helper is
a single Column expression, so it runs map-side with no shuffle and composes
with any projection or filter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: text stand-ins treated as a missing value ----
NULL_TOKENS = ("", "null", "NaN")


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def null_if_token(col, tokens: Iterable[str] = NULL_TOKENS, trim: bool = False) -> Column:
    """NULL when the text equals one of `tokens` (exact, case-sensitive), else the text."""
    c = _c(col)
    probe = F.trim(c) if trim else c
    return F.when(probe.isin(list(tokens)), F.lit(None).cast("string")).otherwise(c)


def measure(col, dtype: str = "decimal(10,2)") -> Column:
    """Number inside text such as '23.4 km' or '15 minute'.

    Every character but digits and '.' is removed and the rest converted with
    `try_cast`; text with no number ('null', '') gives NULL instead of 0 or an error.
    """
    digits = F.regexp_replace(_c(col), r"[^0-9.]", "")
    return F.nullif(digits, F.lit("")).try_cast(dtype)


def ts_text(col, tokens: Iterable[str] = NULL_TOKENS) -> Column:
    """Timestamp held as text; stand-ins and unparsable text give NULL."""
    return null_if_token(col, tokens).try_cast("timestamp_ntz")


def money_amount(col, dtype: str = "decimal(20,0)") -> Column:
    """Amount of a money text such as '$ 91000350' or 'INR 5000'."""
    return measure(col, dtype)


def money_currency(col) -> Column:
    """Currency marker in front of the amount ('$', 'INR'), NULL if absent."""
    code = F.regexp_extract(_c(col), r"^\s*([^0-9\s.]+)", 1)
    return F.nullif(code, F.lit(""))


def split_list(col, sep: str = ",", dtype: str | None = "int") -> Column:
    """Delimited text -> array of trimmed tokens (converted to `dtype`), empty tokens dropped.

    `sep` is a literal separator. NULL text gives NULL (no tokens). No cap on
    the number of tokens.
    """
    parts = F.split(_c(col), re.escape(sep))
    trimmed = F.transform(parts, lambda t: F.trim(t))
    kept = F.filter(trimmed, lambda t: t != F.lit(""))
    if dtype is None or dtype == "string":
        return kept
    return F.transform(kept, lambda t: t.try_cast(dtype))


def list_size(col, sep: str = ",") -> Column:
    """Number of tokens in a delimited text (NULL text -> NULL)."""
    return F.when(_c(col).isNotNull(), F.size(split_list(col, sep, None)))


def has_many(col, sep: str = ",") -> Column:
    """True when the text holds more than one token (a separator occurs)."""
    return F.instr(_c(col), sep) > 0


def has_token(col, token: str, sep: str = ",") -> Column:
    """Case-insensitive membership of `token` in a delimited list."""
    lowered = split_list(F.lower(_c(col)), sep, None)
    return F.array_contains(lowered, token.lower())


def contains_ci(col, needle: str) -> Column:
    """Case-insensitive substring test (LIKE '%needle%' under a case-insensitive collation)."""
    escaped = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return _c(col).ilike(f"%{escaped}%")


def matches_ci(col, pattern: str) -> Column:
    """Case-insensitive regular-expression search."""
    return _c(col).rlike(f"(?i){pattern}")


def in_ci(col, values: Iterable[str]) -> Column:
    """Case-insensitive IN list."""
    return F.lower(_c(col)).isin([v.lower() for v in values])
