"""Reports on the measures: mode comparison, distributions, nearest facilities, totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.functions import nulls, text
from isoreach.operators import spatial as sp
from isoreach.operators import stats
from isoreach.operators.joins import lookup_join
from isoreach.operators.ordering import exact_quantiles, global_row_number
from isoreach.operators.reshape import to_wide

# Modes, and the rank that ends the large cities.
MODES = ("bicycle", "pt", "walk")
LARGE_CITIES = 25


def known_modes(df: DataFrame, modes: Sequence[str]) -> DataFrame:
    """The same rows; a mode that is not among ``modes`` is an error when it is met, not a lost row."""
    unknown = F.raise_error(F.concat(F.lit("unknown mode: "), F.coalesce("mode", F.lit("NULL")))).cast("string")
    return df.withColumn("mode", F.when(F.col("mode").isin(*modes), F.col("mode")).otherwise(unknown))


def morning_only(df: DataFrame) -> DataFrame:
    """Rows of the morning, and all rows of modes without a time of day."""
    if "time_of_day" not in df.columns:
        return df
    return df.filter(F.col("time_of_day").isNull() | (F.col("time_of_day") == "am"))


def access_statistics(relative: DataFrame) -> DataFrame:
    """Mean, spread and quartiles of the morning's relative access by mode, service and cut."""
    return stats.distribution(morning_only(relative), ["mode", "service", "time_cut"], "accessibility", "access")


def mode_ratio(relative: DataFrame, zone: str = "geo_code", modes: Sequence[str] = MODES) -> DataFrame:
    """Modes side by side, bicycle as a ratio of public transport, and which reaches more.

    The ratio is NULL where public transport reaches nothing. ``modes`` are the columns; the table may have no other.
    """
    rows = known_modes(morning_only(relative), modes)
    wide = to_wide(rows, [zone, "service", "time_cut"], "mode", list(modes), "accessibility")
    winner = F.when(F.col("bicycle") > F.col("pt"), "bike").when(F.col("bicycle") <= F.col("pt"), "pt")
    return wide.withColumns({"pt_bike_diff": nulls.ratio("bicycle", "pt"), "bike": winner})


def area_comparison(
    relative: DataFrame, region_lookup: DataFrame, area_lookup: DataFrame, region: str, service: str, cuts: Sequence[int]
) -> DataFrame:
    """Mode comparison of one region, service and some cuts, with region and city columns."""
    ratio = mode_ratio(relative.filter((F.col("service") == service) & F.col("time_cut").isin(*cuts)))
    located = lookup_join(ratio, region_lookup, "geo_code", "left")
    return lookup_join(located, area_lookup, "geo_code", "left").filter(F.col("rgn11nm") == region)


def region_lookup(area_lookup: DataFrame) -> DataFrame:
    """Distinct (zone, district, region) of the output-area lookup."""
    return area_lookup.select(F.col("lsoa11cd").alias("geo_code"), "lad17nm", "rgn11nm").distinct()


def ranked_cities(areas: DataFrame, key: str, population: str) -> DataFrame:
    """Areas by population, largest first, ties by key; the first 24 are cities."""
    ranked = global_row_number(areas, [F.desc_nulls_last(population), F.asc(key)], "pop_ranking")
    return ranked.withColumn("city_large", F.when(F.col("pop_ranking") < LARGE_CITIES, "city").otherwise("other"))


def zone_areas(centroids: DataFrame, area_edges: DataFrame | sp.PolygonLayer, cities: DataFrame, key: str) -> DataFrame:
    """Travel-to-work area of every zone centroid (``id, x, y``) with its rank and size class."""
    pairs = sp.points_in_polygons(centroids, area_edges)
    placed = sp.join_zone(centroids.select("id", "x", "y"), pairs, key).drop("x", "y")
    return lookup_join(placed, cities, key, "left")


def nearest_statistics(nearest: DataFrame) -> DataFrame:
    """Box-plot statistics of the morning's minutes by service and mode, with the plot label."""
    box = stats.box_statistics(morning_only(nearest), ["service", "mode"], "tt_minutes")
    return box.withColumn("label", text.service_label("service"))


def unreachable(nearest: DataFrame, modes: Sequence[str] = MODES) -> DataFrame:
    """Origins without any reachable place, per service, one column for each of ``modes``; no other mode may occur."""
    lost = morning_only(nearest).filter(F.col("tt_minutes").isNull())
    counts = known_modes(stats.count_by(lost, ["service", "mode"]), modes)
    return to_wide(counts, ["service"], "mode", list(modes), "n")


def order_by_median(df: DataFrame, key: str, value: str) -> DataFrame:
    """Categories by their median, largest first, numbered from 1."""
    medians = exact_quantiles(df, [key], value, {"median": 0.5})
    return global_row_number(medians, [F.desc("median"), F.asc(key)], "position")


def park_view(
    access: DataFrame, lookup: DataFrame, zone_edges: DataFrame, centre: DataFrame, radius: float = 10_000.0
) -> DataFrame:
    """Park access by bicycle and by morning public transport around a centre point."""
    known = access.withColumn("time_of_day", F.coalesce("time_of_day", F.lit("am")))
    chosen = known.filter((F.col("mode") == "bicycle") | ((F.col("mode") == "pt") & (F.col("time_of_day") == "am")))
    near = sp.polygons_within(zone_edges, centre, radius).withColumnRenamed("poly_id", "geo_code")
    return lookup_join(lookup_join(chosen, near, "geo_code", "left_semi"), lookup, "geo_code", "left")


def destination_totals(current: DataFrame, previous: DataFrame, services: Sequence[str]) -> DataFrame:
    """Totals of this release beside the previous one.

    ``previous`` has ``destination_cd, destination, total_22``. Jobs by sector are left out;
    services missing on one side keep a NULL there.
    """
    totals = stats.totals_long(current, list(services), "destination_cd", "total_23")
    totals = totals.filter(~F.col("destination_cd").rlike("[0-9]$"))
    joined = previous.join(totals, "destination_cd", "full")
    name = (
        F.when(F.col("destination_cd") == "pharmacies", "Pharmacies")
        .when(F.col("destination_cd") == "park_ha", "Parks and gardens (ha)")
        .otherwise(F.col("destination"))
    )
    named = joined.withColumn("destination", F.regexp_replace(name, "Education: ", ""))
    return named.select("destination", "destination_cd", "total_22", "total_23").orderBy(F.asc_nulls_last("destination"))


def sector_totals(current: DataFrame, groups: DataFrame, services: Sequence[str]) -> DataFrame:
    """Jobs by industrial group; ``groups`` has ``abbreviation, broad_group``."""
    totals = stats.totals_long(current, list(services), "destination", "total_23").filter(F.col("destination").rlike("[0-9]$"))
    clean = groups.select(F.regexp_replace("abbreviation", "^\ufeff", "").alias("destination"), "broad_group")
    return totals.join(clean, "destination", "left").select("destination", "broad_group", "total_23")
