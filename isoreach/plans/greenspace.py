"""Green space per zone: hectares of park, entrances, and entrances as listed in the source."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.operators import geometry as g
from isoreach.operators import spatial as sp
from isoreach.operators.joins import lookup_join, null_safe_join
from isoreach.operators.stats import count_by
from isoreach.session import materialise

# Kind of site, metres between outline points, metres of tolerance at borders.
PARK = "Public Park Or Garden"
MAX_GAP = 50.0
TOLERANCE = 10.0


def park_entrances(site_edges: DataFrame, access: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(all entrances, listed entrances) of the given sites as ``id, x, y``.

    A site that no access point touches is taken to be open along its whole outline.
    """
    park_ids = site_edges.select(F.col("poly_id").alias("ref_to_greenspace_site")).distinct()
    listed = lookup_join(access, park_ids, "ref_to_greenspace_site", "left_semi").select(
        F.concat(F.lit("a"), F.col("access_id")).alias("id"), "x", "y"
    )
    entered = materialise(sp.polygons_met(access, site_edges), "entered")
    closed = lookup_join(site_edges, entered, "poly_id", "left_anti")
    outline = g.boundary_points(closed, MAX_GAP).select(
        F.concat_ws("-", F.lit("b"), "poly_id", "ring_id", "seq", "step").alias("id"), "x", "y"
    )
    return listed.unionByName(outline), listed


def summary(sites: DataFrame, site_edges: DataFrame, access: DataFrame, zone_edges: DataFrame) -> DataFrame:
    """``geo_code, park_ha, park_accesspoints, park_accesspoints_original``.

    An entrance near a border counts in every zone within the tolerance; entrances in no zone are
    counted under a NULL code.
    """
    parks = sites.filter(F.col("function_") == PARK).select(F.col("id").alias("poly_id"))
    park_edges = lookup_join(site_edges, parks, "poly_id", "left_semi")

    shared = sp.overlay_areas(park_edges, zone_edges)
    hectares = shared.groupBy(F.col("q").alias("geo_code")).agg((F.sum("area") / 10_000).alias("park_ha"))

    every, listed = park_entrances(park_edges, access)
    every = materialise(every, "entrances")
    zones = sp.polygon_layer(zone_edges)
    near = sp.join_zone(every, sp.points_within(every, zones, TOLERANCE), "geo_code")
    inside = sp.join_zone(listed, sp.points_in_polygons(listed, zones), "geo_code")
    result = null_safe_join(hectares, count_by(near, "geo_code", "park_accesspoints"), ["geo_code"], "full")
    return null_safe_join(result, count_by(inside, "geo_code", "park_accesspoints_original"), ["geo_code"], "full")
