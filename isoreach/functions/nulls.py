"""Column expressions whose NULL rules differ from plain SQL. Each says which rule it keeps."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def any_of(words: Iterable[str], ignore_case: bool = True) -> str:
    """One pattern matching any of ``words``, which are patterns themselves."""
    return ("(?i)" if ignore_case else "") + "(" + "|".join(words) + ")"


def matches(column: Column | str, pattern: str) -> Column:
    """False, not NULL, where the text is missing."""
    return F.coalesce(_col(column).rlike(pattern), F.lit(False))


def lacks(column: Column | str, pattern: str) -> Column:
    """True where the text is missing: a deny-list keeps rows without a name."""
    return ~matches(column, pattern)


def is_in(column: Column | str, values: Iterable) -> Column:
    """False, not NULL, for a missing value."""
    return F.coalesce(_col(column).isin(list(values)), F.lit(False))


def is_blank(column: Column | str) -> Column:
    """Missing, empty or only spaces."""
    return F.coalesce(F.trim(_col(column)), F.lit("")) == ""


def paste(separator: str, *columns: Column | str, na_text: str | None = "NA") -> Column:
    """Joined text; a missing part is written as ``na_text`` (None leaves it out)."""
    parts = [_col(c).cast("string") for c in columns]
    if na_text is not None:
        parts = [F.coalesce(p, F.lit(na_text)) for p in parts]
    return F.concat_ws(separator, *parts)


def ratio(a: Column | str, b: Column | str) -> Column:
    """NULL for a zero divisor."""
    return F.try_divide(_col(a).cast("double"), _col(b).cast("double"))


def to_int(column: Column | str) -> Column:
    """NULL where the text is no whole number."""
    return _col(column).try_cast("int")


def blank_to_null(column: Column | str, sentinel: str) -> Column:
    return F.nullif(_col(column), F.lit(sentinel))


def has_letter(column: Column | str) -> Column:
    return matches(column, "[A-Za-z]")


def typed_null(kind: str) -> Column:
    """NULL of a type, so that it can be compared with ``<=>``."""
    return F.lit(None).cast(kind)
