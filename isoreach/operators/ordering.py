"""Ranks and exact quantiles over data that no single task could hold.

``sorted_slices`` range-partitions rows into ordered slices and stores them; ranks then come from
a running number inside a slice plus the row counts of the slices before it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoreach.session import materialise


def sorted_slices(df: DataFrame, order: Sequence[Column | str], slices: int | None = None) -> DataFrame:
    """``df`` plus ``_slice``: every row of a slice sorts before every row of the next one.

    Without a number of slices, adaptive execution joins neighbouring small ones.
    """
    ranged = df.repartitionByRange(slices, *order) if slices else df.repartitionByRange(*order)
    return materialise(ranged.withColumn("_slice", F.spark_partition_id()), "slices")


def global_row_number(
    df: DataFrame, order: Sequence[Column], name: str, slices: int | None = None
) -> DataFrame:
    """Position of each row in the whole order. ``order`` must end in a unique key."""
    sliced = sorted_slices(df, order, slices)
    # One row per slice, so this window and the broadcast are bounded by the slice count.
    sizes = sliced.groupBy("_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(*order))
    return (
        sliced.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "_slice")
        .withColumn(name, (F.col("_before") + F.col("_inside")).cast("bigint"))
        .drop("_slice", "_inside", "_before")
    )


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: dict[str, float],
    slices: int | None = None,
) -> DataFrame:
    """Linear-interpolated quantiles per key, exact, without collecting a group.

    Equal values are counted before the shuffle. The counted values are stored in ordered slices;
    a wanted position is found from the totals of the slices and a running count inside one.
    NULL values are left out. A key with no value at all does not appear.
    """
    keys = list(keys)
    counted = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    sliced = sorted_slices(counted, [*keys, "_v"], slices)

    # At most one row per slice and key boundary.
    parts = sliced.groupBy(*keys, "_slice").agg(F.sum("_n").alias("_part"))
    of_key = [F.col(k) for k in keys]
    ahead = Window.partitionBy(*of_key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *[F.col(k).alias(f"_k_{k}") for k in keys],
        F.col("_slice").alias("_s"),
        F.coalesce(F.sum("_part").over(ahead), F.lit(0)).alias("_before"),
        F.sum("_part").over(Window.partitionBy(*of_key)).alias("_total"),
    )
    match = F.col("_slice") == F.col("_s")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    running = Window.partitionBy(*of_key, "_slice").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = (
        sliced.join(parts, match)
        .withColumn("_last", F.col("_before") + F.sum("_n").over(running))
        .withColumn("_first", F.col("_last") - F.col("_n") + 1)
    )

    columns = []
    for name, p in probabilities.items():
        h = (F.col("_total") - 1) * F.lit(float(p))
        low = F.floor(h) + 1
        high = F.ceil(h) + 1
        columns.append(F.max(F.when((F.col("_first") <= low) & (low <= F.col("_last")), F.col("_v"))).alias(f"_lo_{name}"))
        columns.append(F.max(F.when((F.col("_first") <= high) & (high <= F.col("_last")), F.col("_v"))).alias(f"_hi_{name}"))
    found = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *columns)
    result = []
    for name, p in probabilities.items():
        h = (F.col("_total") - 1) * F.lit(float(p))
        weight = h - F.floor(h)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        result.append((lo + weight * (hi - lo)).alias(name))
    return found.select(*keys, *result)
