"""Text and number formatting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squish(column: Column | str) -> Column:
    """Without outer spaces, inner runs of white space as one space."""
    return F.trim(F.regexp_replace(_col(column), r"\s+", " "))


def sentence_case(column: Column | str) -> Column:
    column = _col(column)
    return F.concat(F.upper(F.substring(column, 1, 1)), F.lower(column.substr(F.lit(2), F.length(column))))


def service_label(column: Column | str) -> Column:
    """Label of a service: a line break before each word, other underscores as spaces, sentence case."""
    broken = F.regexp_replace(_col(column), "_(?=[a-z])", "\n")
    return sentence_case(F.regexp_replace(broken, "_", " "))


def first_letter(column: Column | str) -> Column:
    """The nation letter of a zone code."""
    return F.substring(_col(column), 1, 1)


def spaced_thousands(column: Column | str, digits: int = 0) -> Column:
    return F.replace(F.format_number(_col(column), digits), F.lit(","), F.lit(" "))


def fixed_point(column: Column | str, digits: int) -> Column:
    """Number as text without exponent; trailing zeros dropped as in plain output."""
    text = _col(column).cast(f"decimal(38,{digits})").cast("string")
    return F.when(F.instr(text, ".") > 0, F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", "")).otherwise(text)


def with_labels(column: Column | str, labels: dict[str, str]) -> Column:
    """Label of a code; NULL for a code without one."""
    result = None
    for code, label in labels.items():
        test = _col(column) == code
        result = F.when(test, label) if result is None else result.when(test, label)
    return result


def elapsed_minutes(start: Column | str, end: Column | str) -> Column:
    return (F.unix_micros(_col(end)) - F.unix_micros(_col(start))) / F.lit(60e6)
