"""Code lookup with a preferred and a fallback tier, and keyed manual overrides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.operators.joins import lookup_join


def best_per_key(directory: DataFrame, key: str, preferred: Column, detect: str, order: str) -> DataFrame:
    """One row per key: preferred rows that have ``detect`` first, then any row that has it.

    The aggregate combines before the shuffle, so a key repeated many times is no hot group.
    """
    rest = [c for c in directory.columns if c != key]
    has = F.col(detect).isNotNull()
    rank = F.when(F.coalesce(preferred, F.lit(False)) & has, 0).when(has, 1).otherwise(2)
    return (
        directory.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.struct(rank.alias("r"), F.col(order).alias("o"))).alias("_best"))
        .select(key, "_best.*")
    )


def fill_from_lookup(
    facts: DataFrame,
    directory: DataFrame,
    fact_key: str,
    directory_key: str,
    columns: list[str],
    preferred: Column | None = None,
    detect: str = "lat",
    order: str | None = None,
) -> DataFrame:
    """Adds ``columns`` of the directory to every fact row, in one join.

    With ``preferred`` given, preferred entries win and other entries only fill what they leave
    open. Without it, entries are expected to be unique by key and are joined as they are.
    """
    source = directory
    if preferred is not None:
        needed = list(dict.fromkeys([directory_key, *columns, detect, order or detect]))
        flagged = directory.withColumn("_preferred", preferred).select(*needed, "_preferred")
        source = best_per_key(flagged, directory_key, F.col("_preferred"), detect, order or detect)
    source = source.select(F.col(directory_key).alias(fact_key), *columns)
    return lookup_join(facts, source, fact_key, "left")


def override_missing(df: DataFrame, overrides: DataFrame, key: str, detect: str) -> DataFrame:
    """Fills rows whose ``detect`` is NULL from a table keyed like ``df``; other rows stay as they are."""
    columns = [c for c in overrides.columns if c != key]
    renamed = overrides.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    joined = lookup_join(df, renamed, key, "left")
    missing = F.col(detect).isNull()
    filled = {c: F.when(missing, F.coalesce(f"_o_{c}", c)).otherwise(F.col(c)) for c in columns}
    return joined.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in df.columns])
