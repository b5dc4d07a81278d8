"""Counts, totals, profiles and distribution statistics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.operators.joins import null_safe_join
from isoreach.operators.ordering import exact_quantiles
from isoreach.operators.reshape import totals_to_long
from isoreach.session import materialise

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def count_by(df: DataFrame, keys: str | Sequence[str], name: str = "n") -> DataFrame:
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def column_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row of sums; the sum of nothing is 0."""
    return df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])


def totals_long(df: DataFrame, columns: Sequence[str], name: str, value: str) -> DataFrame:
    return totals_to_long(column_totals(df, columns), name, value)


def share_of_total(df: DataFrame, key: Column, key_name: str, value: str, total_name: str, share_name: str) -> DataFrame:
    """Sum per key and its part of the grand total.

    The grouped rows are stored, so the input is read once; their total, one row, is broadcast to them.
    """
    grouped = materialise(df.groupBy(key.alias(key_name)).agg(F.sum(value).alias(total_name)), "totals")
    grand = grouped.agg(F.sum(total_name).cast("double").alias("__grand"))
    share = F.try_divide(F.col(total_name).cast("double"), F.col("__grand"))
    return grouped.crossJoin(F.broadcast(grand)).select(key_name, total_name, share.alias(share_name))


def most_frequent(df: DataFrame, column: str, k: int, name: str = "n") -> DataFrame:
    """The ``k`` most frequent values; missing values are not counted, ties go by value."""
    counts = count_by(df.filter(F.col(column).isNotNull()), column, name)
    return counts.orderBy(F.desc(name), F.asc(column)).limit(k)


def null_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    aggregates = [F.count_if(F.col(c).isNull()).alias(c) for c in columns]
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


def distribution(df: DataFrame, keys: Sequence[str], value: str, prefix: str) -> DataFrame:
    """Mean, standard deviation, median and quartiles per key. Missing values are skipped and counted."""
    moments = df.groupBy(*keys).agg(
        F.avg(value).alias(f"{prefix}_mean"),
        F.stddev_samp(value).alias(f"{prefix}_sd"),
        F.count_if(F.col(value).isNull()).alias(f"{prefix}_n_null"),
    )
    quartiles = exact_quantiles(df, keys, value, {f"{prefix}_{n}": p for n, p in QUARTILES.items()})
    return null_safe_join(moments, quartiles, list(keys), "left")


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Minimum, quartiles, mean, maximum and missing count, one row per numeric column."""
    long = df.select([F.col(c).cast("double") for c in columns]).unpivot([], list(columns), "column", "value")
    basic = long.groupBy("column").agg(
        F.min("value").alias("min"),
        F.avg("value").alias("mean"),
        F.max("value").alias("max"),
        F.count_if(F.col("value").isNull()).alias("n_null"),
    )
    return basic.join(exact_quantiles(long, ["column"], "value", QUARTILES), "column", "left")


def box_statistics(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Quartiles, whisker ends within 1.5 times the quartile range, and how many values lie outside."""
    present = df.filter(F.col(value).isNotNull())
    quartiles = exact_quantiles(present, keys, value, QUARTILES)
    spread = F.col("q3") - F.col("q1")
    fenced = materialise(quartiles.withColumns({"_low": F.col("q1") - 1.5 * spread, "_high": F.col("q3") + 1.5 * spread}), "fences")
    # One row per (value, key) with its count is all the whiskers need.
    counted = present.groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    joined = null_safe_join(counted, fenced, list(keys), "inner", lookup=True)
    inside = F.col("_v").between(F.col("_low"), F.col("_high"))
    return joined.groupBy(*keys).agg(
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.min(F.when(inside, F.col("_v"))).cast("double").alias("whisker_low"),
        F.max(F.when(inside, F.col("_v"))).cast("double").alias("whisker_high"),
        F.coalesce(F.sum(F.when(~inside, F.col("_n"))), F.lit(0)).alias("n_outside"),
    )


def hex_bins(df: DataFrame, x: str, y: str, bins: tuple[int, int]) -> DataFrame:
    """Counts on a hexagonal grid of ``bins`` cells across and up the extent of the points.

    A hexagon is the area nearest to one centre of two interleaved lattices, so the cell of a point
    is the closer of its two lattice candidates. ``cx``, ``cy`` are the centre in lattice units.
    """
    extent = df.agg(F.min(x), F.max(x), F.min(y), F.max(y)).first()
    if extent[0] is None:
        return df.select(F.lit(0.0).alias("cx"), F.lit(0.0).alias("cy"), F.lit(0).cast("bigint").alias("n")).limit(0)
    x0, x1, y0, y1 = map(float, extent)
    width = (x1 - x0) / bins[0] or 1.0
    height = (y1 - y0) / bins[1] or 1.0
    x0, y0 = math.floor(x0 / width) * width, math.floor(y0 / height) * height
    u, v = (F.col(x) - x0) / width, (F.col(y) - y0) / (height * math.sqrt(3.0))
    i1, j1 = F.floor(u + 0.5), F.floor(v + 0.5)
    i2, j2 = F.floor(u), F.floor(v)
    d1 = (u - i1) * (u - i1) + 3 * (v - j1) * (v - j1)
    d2 = (u - i2 - 0.5) * (u - i2 - 0.5) + 3 * (v - j2 - 0.5) * (v - j2 - 0.5)
    near = d1 <= d2
    cx = F.when(near, i1.cast("double")).otherwise(i2 + 0.5)
    cy = F.when(near, j1.cast("double")).otherwise(j2 + 0.5)
    return (
        df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
        .groupBy(cx.alias("cx"), cy.alias("cy"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def run_log_summary(log: DataFrame, step: str, status: str, minutes: str) -> DataFrame:
    """Steps by outcome, and the shortest, longest and mean duration with the steps they belong to."""
    shortest = F.struct(F.col(minutes), F.col(step))
    longest = F.struct(-F.col(minutes), F.col(step))
    return log.agg(
        F.count(F.lit(1)).alias("steps"),
        F.count_if(F.col(status) == "SUCCESS").alias("succeeded"),
        F.count_if(F.col(status) == "FAILED").alias("failed"),
        F.min(minutes).alias("min_minutes"),
        F.max(minutes).alias("max_minutes"),
        F.avg(minutes).alias("mean_minutes"),
        F.sum(minutes).alias("total_minutes"),
        F.min_by(step, shortest).alias("fastest_step"),
        F.min_by(step, longest).alias("slowest_step"),
    )
