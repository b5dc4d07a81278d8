"""Column naming: normalised names, name patterns and the names of the published measures."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

from pyspark.sql import DataFrame


def access_name(service: str, cut: int) -> str:
    return f"access_{service}_{cut}"


def pct_name(service: str, cut: int) -> str:
    return f"access_{service}_{cut}_pct"


def nearest_name(service: str) -> str:
    return f"nearest_{service}"


def split_access_name(name: str) -> tuple[str, int]:
    """``access_<service>_<cut>`` with an optional ``_pct``; the cut follows the last underscore."""
    found = re.fullmatch(r"access_(.*)_(\d+)(?:_pct)?", name)
    if not found:
        raise ValueError(f"not a measure column: {name}")
    return found.group(1), int(found.group(2))


def snake_case(name: str) -> str:
    """Lower-case words joined by underscores; ``%`` and ``#`` are spelled out."""
    text = name.replace("'", "").replace('"', "").replace("%", "_percent_").replace("#", "_number_")
    text = unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()
    text = re.sub(r"(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])", "_", text)
    text = re.sub(r"[^A-Za-z0-9]+", "_", text).strip("_").lower()
    if not text or text[0].isdigit():
        text = "x" + text
    return text


def unique_names(names: list[str]) -> list[str]:
    """Repeats get ``_2``, ``_3`` ... in order of appearance."""
    seen: dict[str, int] = {}
    result = []
    for name in names:
        seen[name] = seen.get(name, 0) + 1
        result.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return result


def clean_names(df: DataFrame) -> DataFrame:
    return df.toDF(*unique_names([snake_case(c) for c in df.columns]))


def lower_names(df: DataFrame) -> DataFrame:
    """Lower case with spaces as underscores, nothing else changed."""
    return df.toDF(*[c.lower().replace(" ", "_") for c in df.columns])


def rename_where(df: DataFrame, test: Callable[[str], bool], rename: Callable[[str], str]) -> DataFrame:
    return df.toDF(*[rename(c) if test(c) else c for c in df.columns])


def starts_with(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.lower().startswith(prefix.lower())]


def containing(df: DataFrame, part: str) -> list[str]:
    return [c for c in df.columns if part.lower() in c.lower()]


def matching(df: DataFrame, pattern: str) -> list[str]:
    return [c for c in df.columns if re.search(pattern, c, re.IGNORECASE)]


def without(df: DataFrame, dropped: list[str]) -> list[str]:
    return [c for c in df.columns if c not in set(dropped)]


def column_range(df: DataFrame, first: str, last: str) -> list[str]:
    """Columns from ``first`` to ``last``, both included, in either direction."""
    a, b = df.columns.index(first), df.columns.index(last)
    return df.columns[a : b + 1] if a <= b else df.columns[b : a + 1][::-1]


def by_position(df: DataFrame, positions: list[int]) -> list[str]:
    """Columns by 1-based position."""
    return [df.columns[p - 1] for p in positions]


def sector_names(headers: list[str]) -> list[str]:
    """``employment_<word>_<n>``, the word being the second part of a snake-case header."""
    result = []
    for position, header in enumerate(headers, start=1):
        parts = header.split("_")
        word = parts[1] if len(parts) > 2 and parts[1] else header
        result.append(f"employment_{word}_{position}")
    return result
