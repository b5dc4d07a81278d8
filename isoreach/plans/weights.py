"""Zone weights: how many services of each kind every zone holds."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.operators.reshape import stack


def service_counts(points: DataFrame, zone: str, service: str, services: list[str]) -> DataFrame:
    """Counts of long (zone, service) rows as one column per service. Rows without a zone are left out."""
    counts = points.filter(F.col(zone).isNotNull()).groupBy(zone)
    return counts.agg(*[F.count_if(F.col(service) == s).alias(s) for s in services])


def labelled_points(tables: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """One (zone, service) row per point from ``service -> (table, zone column)``."""
    return stack(
        *[df.select(F.col(zone).cast("string").alias("zone"), F.lit(service).alias("service")) for service, (df, zone) in tables.items()]
    )


def zone_weights(spine: DataFrame, counts: DataFrame, counts_zone: str, id_column: str = "id") -> DataFrame:
    """Every zone of the spine with its counts; what is missing is 0, zones off the spine are dropped."""
    joined = spine.join(counts.withColumnRenamed(counts_zone, id_column), id_column, "left")
    numbers = [c for c in joined.columns if c != id_column]
    return joined.select(id_column, *[F.coalesce(c, F.lit(0).cast(joined.schema[c].dataType)).alias(c) for c in numbers])


def land_use(
    employment: DataFrame,
    practices: DataFrame,
    supermarkets: DataFrame,
    schools: DataFrame,
    hospitals: DataFrame,
    pharmacies: DataFrame,
    main_centres: DataFrame,
    sub_centres: DataFrame,
    green: DataFrame,
) -> DataFrame:
    """Zone weights from the prepared lists. All counts come from one aggregate over their points."""
    tables = {
        "gp_practices": (practices, "lsoa11"),
        "supermarkets": (supermarkets, "lsoa11cd"),
        "primary_schools": (schools.filter("type_primary"), "lsoa11"),
        "secondary_schools": (schools.filter("type_secondary"), "lsoa11"),
        "hospitals": (hospitals, "lsoa"),
        "pharmacies": (pharmacies, "lsoa11"),
        "main_bua": (main_centres, "geo_code"),
        "sub_bua": (sub_centres, "geo_code"),
    }
    counts = service_counts(labelled_points(tables), "zone", "service", list(tables))
    spine = employment.withColumnRenamed("lsoa11cd", "id")
    spine = spine.join(green.filter(F.col("geo_code").isNotNull()).withColumnRenamed("geo_code", "id"), "id", "left")
    ordered = [c for c in employment.columns if c != "lsoa11cd"] + list(tables) + [c for c in green.columns if c != "geo_code"]
    return zone_weights(spine, counts, "zone").select("id", *ordered)
