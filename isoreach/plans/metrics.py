"""Accessibility measures from a travel-time matrix and zone weights.

Input matrix: one row per origin, destination, mode and departure time (NULL where a mode has
none) with ``travel_time`` in minutes. A destination counts for a cut when its time is at most
the cut. The matrix is read once for the cumulative and the nearest measures together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.functions import naming
from isoreach.operators.joins import lookup_join
from isoreach.operators.reshape import access_to_long, totals_to_long

# Time limits in minutes.
CUTS = tuple(range(15, 121, 15))
KEYS = ("mode", "time_of_day", "from_id")


def cumulative_services(land_use: DataFrame, id_column: str = "id") -> dict[str, str]:
    """Service name to weight column; access points are no destination, hectares count as parks."""
    kept = [c for c in land_use.columns if c != id_column and "accesspoints" not in c]
    return {"parks" if c == "park_ha" else c: c for c in kept}


def nearest_services(land_use: DataFrame, id_column: str = "id") -> dict[str, str]:
    """Jobs and hectares have no nearest place; parks are reached at their access points."""
    left_out = {id_column, "park_ha", "park_accesspoints_original"}
    kept = [c for c in land_use.columns if c not in left_out and not c.startswith("employment")]
    return {"parks" if c == "park_accesspoints" else c: c for c in kept}


def normalise_matrix(slices: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """One matrix for all modes from ``mode -> (table, name of its cost column)``."""
    frames = []
    for mode, (df, cost) in slices.items():
        time_of_day = F.col("time_of_day") if "time_of_day" in df.columns else F.lit(None)
        frames.append(
            df.select(
                F.lit(mode).alias("mode"),
                time_of_day.cast("string").alias("time_of_day"),
                "from_id",
                "to_id",
                F.col(cost).alias("travel_time"),
            )
        )
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame)
    return result


def _first_cut(time: Column, cuts: Sequence[int]) -> Column:
    """Smallest cut not below ``time``; NULL beyond the last one."""
    bucket = F.when(time <= cuts[0], F.lit(cuts[0]))
    for cut in cuts[1:]:
        bucket = bucket.when(time <= cut, F.lit(cut))
    return bucket


def measures(
    matrix: DataFrame,
    land_use: DataFrame,
    cumulative: Mapping[str, str] | None = None,
    nearest: Mapping[str, str] | None = None,
    cuts: Sequence[int] = CUTS,
    id_column: str = "id",
    complete: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """``access_<service>_<cut>`` and ``nearest_<service>`` for every origin of every slice.

    An origin appears when it has a pair, even if ``land_use`` knows none of its destinations. Say
    ``complete`` when it knows all of them: the join then produces no missing weights.
    Weights are added up as floating numbers (exact for whole numbers up to 2^53) and returned in
    their own type.

    The first aggregate keeps at most one row per origin and cut, so partial aggregation removes
    nearly all of the matrix before the shuffle, however many rows one origin has. The second
    one spreads these few rows over the cuts.
    """
    cumulative = cumulative_services(land_use, id_column) if cumulative is None else cumulative
    nearest = nearest_services(land_use, id_column) if nearest is None else nearest
    columns = list(dict.fromkeys([*cumulative.values(), *nearest.values()]))
    weights = land_use.select(
        F.col(id_column).alias("to_id"), *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in columns]
    )

    pairs = matrix.filter(F.col("travel_time").isNotNull()).select(*KEYS, "to_id", "travel_time")
    joined = lookup_join(pairs, weights, "to_id", "inner" if complete else "left", limit)

    per_cut = joined.groupBy(*KEYS, _first_cut(F.col("travel_time"), cuts).alias("_cut")).agg(
        *[F.sum(column).alias(f"_s_{service}") for service, column in cumulative.items()],
        *[
            F.min(F.when(F.col(column) > 0, F.col("travel_time"))).alias(f"_n_{service}")
            for service, column in nearest.items()
        ],
    )
    own_type = {service: land_use.schema[column].dataType for service, column in cumulative.items()}
    return per_cut.groupBy(*KEYS).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("_cut") <= cut, F.col(f"_s_{service}"))), F.lit(0.0))
            .cast(own_type[service])
            .alias(naming.access_name(service, cut))
            for service in cumulative
            for cut in cuts
        ],
        *[F.min(f"_n_{service}").alias(naming.nearest_name(service)) for service in nearest],
    )


def service_totals(land_use: DataFrame, services: Mapping[str, str]) -> DataFrame:
    """One row: the whole weight of every service."""
    return land_use.agg(
        *[F.coalesce(F.sum(column).cast("double"), F.lit(0.0)).alias(service) for service, column in services.items()]
    )


def with_relative(
    access: DataFrame, land_use: DataFrame, services: Mapping[str, str], cuts: Sequence[int] = CUTS
) -> DataFrame:
    """Adds ``access_<service>_<cut>_pct``: percent of the whole weight, 4 places, half to even.

    Totals are matched by service name. A service without any weight has a NULL share.
    """
    totals = service_totals(land_use, services).first()
    shares = {}
    for service in services:
        for cut in cuts:
            reached = F.col(naming.access_name(service, cut)).cast("double")
            share = F.try_divide(reached, F.lit(float(totals[service]))) * 100
            shares[naming.pct_name(service, cut)] = F.bround(share, 4)
    return access.withColumns(shares)


def relative_long(
    access: DataFrame, land_use: DataFrame, services: Mapping[str, str], cuts: Sequence[int] | None = None
) -> DataFrame:
    """(keys, service, time_cut, accessibility) with the relative measure.

    All cuts that the table has, or those asked for; a cut asked for that it lacks is an error.
    The wide measures become rows first and find their total by service name: one row per service,
    so few that they are broadcast.
    """
    ids = [k for k in ("geo_code", *KEYS) if k in access.columns]
    if cuts is None:
        absolute = [c for c in naming.matching(access, r"^access_.*_\d+$") if naming.split_access_name(c)[0] in services]
    else:
        absolute = [naming.access_name(s, c) for s in services for c in cuts]
    missing = [s for s in services if not any(naming.split_access_name(c)[0] == s for c in absolute)]
    if missing or not set(absolute) <= set(access.columns):
        raise ValueError(f"the table lacks measures: {missing or sorted(set(absolute) - set(access.columns))}")
    doubles = access.select(*ids, *[F.col(c).cast("double").alias(c) for c in absolute])
    totals = totals_to_long(service_totals(land_use, services), "service", "_total")
    long = access_to_long(doubles, ids).join(F.broadcast(totals), "service")
    share = F.bround(F.try_divide("accessibility", F.col("_total")) * 100, 4)
    return long.select(*ids, "service", "time_cut", share.alias("accessibility"))


def access_table(
    matrix: DataFrame,
    land_use: DataFrame,
    cumulative: Mapping[str, str] | None = None,
    nearest: Mapping[str, str] | None = None,
    cuts: Sequence[int] = CUTS,
) -> DataFrame:
    """The published wide table: absolute, relative and nearest measures per zone, mode and time."""
    cumulative = cumulative_services(land_use) if cumulative is None else cumulative
    nearest = nearest_services(land_use) if nearest is None else nearest
    wide = with_relative(measures(matrix, land_use, cumulative, nearest, cuts), land_use, cumulative, cuts)
    wide = wide.withColumnRenamed("from_id", "geo_code")
    ordered = ["geo_code", "mode", "time_of_day"]
    ordered += [naming.access_name(s, c) for s in cumulative for c in cuts]
    ordered += [naming.pct_name(s, c) for s in cumulative for c in cuts]
    ordered += [naming.nearest_name(s) for s in nearest]
    return wide.select(*ordered)


def service_slice(access: DataFrame, service: str, cuts: Sequence[int] = CUTS) -> DataFrame:
    """Columns of one service, by exact name; not every service has a nearest place."""
    names = [naming.access_name(service, c) for c in cuts] + [naming.pct_name(service, c) for c in cuts]
    if not set(names) <= set(access.columns):
        raise ValueError(f"the table lacks measures: {sorted(set(names) - set(access.columns))}")
    nearest = [n for n in (naming.nearest_name(service),) if n in access.columns]
    return access.select("geo_code", "mode", "time_of_day", *names, *nearest)
