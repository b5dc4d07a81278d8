"""Wide to long, long to wide, stacking tables and pruning empty columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.functions import naming
from isoreach.session import materialise


def access_to_long(df: DataFrame, ids: list[str], value: str = "accessibility", pct: bool = False) -> DataFrame:
    """One row per measure column, its name split into ``service`` and ``time_cut``.

    Names are split once for the column, not for every row.
    """
    columns = naming.matching(df, r"^access_.*_\d+_pct$" if pct else r"^access_.*_\d+$")
    parts = []
    for column in columns:
        service, cut = naming.split_access_name(column)
        parts += [F.lit(service), F.lit(cut), F.col(column)]
    return df.select(*ids, F.stack(F.lit(len(columns)), *parts).alias("service", "time_cut", value))


def nearest_to_long(df: DataFrame, ids: list[str], value: str = "tt_minutes") -> DataFrame:
    """One row per ``nearest_<service>`` column, the prefix left out."""
    columns = naming.starts_with(df, "nearest_")
    parts = [part for c in columns for part in (F.lit(c.removeprefix("nearest_")), F.col(c))]
    return df.select(*ids, F.stack(F.lit(len(columns)), *parts).alias("service", value))


def totals_to_long(totals: DataFrame, name: str, value: str) -> DataFrame:
    """One row of totals as (name, value) rows: exactly one row per column."""
    return totals.select([F.col(c).cast("double") for c in totals.columns]).unpivot([], totals.columns, name, value)


def to_wide(df: DataFrame, keys: list[str], names: str, wanted: list[str], value: str) -> DataFrame:
    """One column per wanted name. The list is given, so no job looks for the values."""
    return df.groupBy(*keys).pivot(names, wanted).agg(F.first(value))


def stack(*frames: DataFrame) -> DataFrame:
    """All rows by column name; a column absent from a frame is NULL there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_labelled(frames: dict[str, DataFrame], label: str) -> DataFrame:
    return stack(*[df.withColumn(label, F.lit(key)) for key, df in frames.items()])


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Without the columns that are NULL in every row; one aggregate decides for all of them.

    The input is stored first, so it is computed once.
    """
    df = materialise(df, "sparse")
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).first()
    return df.select(*[c for c in df.columns if counts[c] > 0])
