"""Spatial operators over rectangles, whose answers plain arithmetic can give as well."""

from __future__ import annotations

from pyspark.sql import functions as F

from isoreach import fixtures as fx
from isoreach.operators import arrangement as ar
from isoreach.operators import geometry as g
from isoreach.operators import spatial as sp
from isoreach.plans import greenspace
from isoreach.registry import REGISTRY

INSIDE = "p.x BETWEEN z.xa AND z.xb AND p.y BETWEEN z.ya AND z.yb"
DX = "GREATEST(z.xa - p.x, 0, p.x - z.xb)"
DY = "GREATEST(z.ya - p.y, 0, p.y - z.yb)"
DIST = f"SQRT({DX} * {DX} + {DY} * {DY})"


def zones(spark, sf_dir):
    return g.rectangle_edges(fx.view(spark, sf_dir, "f_zonepoly"), "zone_id")


def sites(spark, sf_dir):
    return g.rectangle_edges(fx.view(spark, sf_dir, "f_site"), "id")


def points(spark, sf_dir):
    return fx.view(spark, sf_dir, "f_point")


@REGISTRY.add(
    "K01_point_in_zone",
    fx.duck_sql(f"SELECT p.id, z.zone_id FROM f_point p LEFT JOIN f_zonepoly z ON {INSIDE}"),
)
def k01(spark, sf_dir):
    pts = points(spark, sf_dir)
    pairs = sp.points_in_polygons(pts, zones(spark, sf_dir))
    return sp.join_zone(pts, pairs, "zone_id").select("id", "zone_id")


@REGISTRY.add(
    "K02_nearest_zone",
    fx.duck_sql(
        f"""SELECT id, zone_id, ROUND(d, 6) AS distance FROM (
              SELECT p.id, z.zone_id, {DIST} AS d, ROW_NUMBER() OVER (PARTITION BY p.id ORDER BY {DIST}, z.zone_id) AS rn
              FROM f_point p, f_zonepoly z) t WHERE rn = 1 AND d > 0"""
    ),
)
def k02(spark, sf_dir):
    """Nearest zone of the points in no zone."""
    pts, edges = points(spark, sf_dir), zones(spark, sf_dir)
    lost = pts.join(sp.points_in_polygons(pts, edges).select("id"), "id", "left_anti")
    found = sp.nearest_polygon(lost, edges)
    return found.select("id", F.col("poly_id").alias("zone_id"), F.round("distance", 6).alias("distance"))


@REGISTRY.add(
    "K02_far_points",
    fx.duck_sql(
        f"""SELECT id, zone_id, ROUND(d, 3) AS distance FROM (
              SELECT p.id, z.zone_id, {DIST} AS d, ROW_NUMBER() OVER (PARTITION BY p.id ORDER BY {DIST}, z.zone_id) AS rn
              FROM (SELECT id, x + 200000000 + id AS x, y * 1000 - 70000000 AS y FROM f_point) p, f_zonepoly z) t WHERE rn = 1"""
    ),
)
def k02_far(spark, sf_dir):
    """Points far beyond all zones."""
    far = points(spark, sf_dir).select("id", (F.col("x") + 200_000_000 + F.col("id")).alias("x"), (F.col("y") * 1000 - 70_000_000).alias("y"))
    found = sp.nearest_polygon(far, zones(spark, sf_dir))
    return found.select("id", F.col("poly_id").alias("zone_id"), F.round("distance", 3).alias("distance"))


@REGISTRY.add(
    "K02_zone_or_nearest",
    fx.duck_sql(
        f"""SELECT id, zone_id FROM (
              SELECT p.id, z.zone_id, {DIST} AS d, MIN({DIST}) OVER (PARTITION BY p.id) AS best,
                     ROW_NUMBER() OVER (PARTITION BY p.id ORDER BY {DIST}, z.zone_id) AS rn
              FROM f_point p, f_zonepoly z) t WHERE (best = 0 AND d = 0) OR (best > 0 AND rn = 1)"""
    ),
)
def k02_repair(spark, sf_dir):
    return sp.zone_or_nearest(points(spark, sf_dir), zones(spark, sf_dir), "zone_id").select("id", "zone_id")


@REGISTRY.add(
    "K03_mask",
    fx.duck_sql(f"SELECT p.* FROM f_point p WHERE EXISTS (SELECT 1 FROM f_zonepoly z WHERE z.zone_id < 7 AND {INSIDE})"),
)
def k03(spark, sf_dir):
    mask = zones(spark, sf_dir).filter(F.col("poly_id") < 7)
    return sp.keep_inside(points(spark, sf_dir), mask)


@REGISTRY.add(
    "K03_outline",
    fx.duck_sql(
        """SELECT 1 AS ring_id, CAST(i AS INTEGER) AS seq, CASE WHEN i IN (1, 4) THEN xa ELSE xb END AS x1, CASE WHEN i < 3 THEN ya ELSE yb END AS y1,
                  CASE WHEN i IN (3, 4) THEN xa ELSE xb END AS x2, CASE WHEN i IN (1, 4) THEN ya ELSE yb END AS y2
           FROM (SELECT MIN(xa) AS xa, MIN(ya) AS ya, MAX(xb) AS xb, MAX(yb) AS yb FROM f_zonepoly) t, range(1, 5) r(i)"""
    ),
)
def k03_outline(spark, sf_dir):
    """The country's outline, dissolved from its zones."""
    return ar.outlines(zones(spark, sf_dir)).select("ring_id", "seq", "x1", "y1", "x2", "y2")


# Between neighbouring sides of sites, what is covered is a set of intervals.
SLABS = {
    "cuts": "SELECT function_, xa AS x FROM f_site UNION SELECT function_, xb FROM f_site",
    "slabs": "SELECT function_, x, LEAD(x) OVER (PARTITION BY function_ ORDER BY x) AS to_x FROM cuts",
    "spans": """SELECT c.function_, c.x, c.to_x, s.ya, s.yb,
                       MAX(s.yb) OVER (PARTITION BY c.function_, c.x ORDER BY s.ya, s.yb ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
                FROM slabs c JOIN f_site s ON s.function_ = c.function_ AND s.xa <= c.x AND s.xb >= c.to_x""",
}


@REGISTRY.add(
    "K03_union_area",
    fx.duck_sql(
        "SELECT function_, ROUND(SUM((to_x - x) * GREATEST(yb - GREATEST(ya, COALESCE(reached, ya)), 0)), 2) AS area FROM spans GROUP BY 1",
        SLABS,
    ),
)
def k03_union(spark, sf_dir):
    """Land covered by the sites of a kind, where sites overlap."""
    kinds = fx.view(spark, sf_dir, "f_site").select(F.col("id").alias("poly_id"), "function_")
    outline = ar.outlines(sites(spark, sf_dir).join(kinds, "poly_id"), "function_")
    found = g.areas(outline.withColumnRenamed("function_", "poly_id"))
    return found.select(F.col("poly_id").alias("function_"), F.round("area", 2).alias("area"))


@REGISTRY.add(
    "K04_buffer",
    fx.duck_sql("SELECT id, ROUND((xb - xa) * (xb - xa) + 40 * (xb - xa) + 6000 * SIN(PI() / 60), 4) AS area FROM f_site"),
)
def k04_buffer(spark, sf_dir):
    """Areas of the sites grown by 10 m, 30 pieces to a quarter circle."""
    grown = g.areas(ar.buffers(sites(spark, sf_dir), 10.0))
    return grown.select(F.col("poly_id").alias("id"), F.round("area", 4).alias("area"))


TOLERANT = f"""SELECT p.id, z.zone_id FROM (SELECT id, x + (id % 5 - 2) * 5 AS x, y + (id % 3) * 5 AS y FROM f_point) p
            LEFT JOIN f_zonepoly z ON {DX} * {DX} + {DY} * {DY} <= 100"""


@REGISTRY.add("K04_buffer_join", fx.duck_sql(TOLERANT))
def k04_buffer_join(spark, sf_dir):
    """As K04_within_10m, by containment in the grown zones."""
    moved = points(spark, sf_dir).select(
        "id", (F.col("x") + (F.col("id") % 5 - 2) * 5).alias("x"), (F.col("y") + F.col("id") % 3 * 5).alias("y")
    )
    pairs = sp.points_in_polygons(moved, ar.buffers(zones(spark, sf_dir), 10.0))
    return sp.join_zone(moved, pairs, "zone_id").select("id", "zone_id")


@REGISTRY.add(
    "K04_within_10m",
    fx.duck_sql(TOLERANT),
)
def k04(spark, sf_dir):
    """Points a few metres off the borders, joined with a tolerance of 10 m."""
    moved = points(spark, sf_dir).select(
        "id", (F.col("x") + (F.col("id") % 5 - 2) * 5).alias("x"), (F.col("y") + F.col("id") % 3 * 5).alias("y")
    )
    pairs = sp.points_within(moved, zones(spark, sf_dir), 10.0)
    return sp.join_zone(moved, pairs, "zone_id").select("id", "zone_id")


@REGISTRY.add(
    "K05_within_10km",
    fx.duck_sql(
        f"""SELECT z.id FROM f_site z WHERE EXISTS (SELECT 1 FROM f_point p WHERE p.id % 100 = 7
            AND {DX} * {DX} + {DY} * {DY} <= 100000000)"""
    ),
)
def k05(spark, sf_dir):
    """Sites at most 10 km from any of a set of centres."""
    centres = points(spark, sf_dir).filter(F.col("id") % 100 == 7)
    near = sp.polygons_within(sites(spark, sf_dir), centres, 10_000.0)
    return fx.view(spark, sf_dir, "f_site").select("id").join(near.select(F.col("poly_id").alias("id")), "id", "left_semi")


SHARED = (
    "(LEAST(s.xb, z.xb) - GREATEST(s.xa, z.xa)) * (LEAST(s.yb, z.yb) - GREATEST(s.ya, z.ya))"
)
OVERLAP = "LEAST(s.xb, z.xb) > GREATEST(s.xa, z.xa) AND LEAST(s.yb, z.yb) > GREATEST(s.ya, z.ya)"


@REGISTRY.add(
    "K06_overlay_area",
    fx.duck_sql(f"SELECT s.id, z.zone_id, ROUND({SHARED}, 4) AS area FROM f_site s JOIN f_zonepoly z ON {OVERLAP}"),
)
def k06(spark, sf_dir):
    shared = sp.overlay_areas(sites(spark, sf_dir), zones(spark, sf_dir))
    return shared.select(F.col("p").alias("id"), F.col("q").alias("zone_id"), F.round("area", 4).alias("area"))


@REGISTRY.add(
    "K06_area_by_zone",
    fx.duck_sql(f"SELECT z.zone_id, ROUND(SUM({SHARED}) / 10000, 6) AS hectares FROM f_site s JOIN f_zonepoly z ON {OVERLAP} GROUP BY 1"),
)
def k06_by_zone(spark, sf_dir):
    shared = sp.overlay_areas(sites(spark, sf_dir), zones(spark, sf_dir))
    return shared.groupBy(F.col("q").alias("zone_id")).agg(F.round(F.sum("area") / 10_000, 6).alias("hectares"))


CORNERS = "x{0} AS x1, y{0} AS y1, x{1} AS x2, y{1} AS y2"
SHARED_BOX = f"""SELECT s.id, z.zone_id, GREATEST(s.xa, z.xa) AS x1, GREATEST(s.ya, z.ya) AS y1, LEAST(s.xb, z.xb) AS x2, GREATEST(s.ya, z.ya) AS y2,
    LEAST(s.xb, z.xb) AS x3, LEAST(s.yb, z.yb) AS y3, GREATEST(s.xa, z.xa) AS x4, LEAST(s.yb, z.yb) AS y4 FROM f_site s JOIN f_zonepoly z ON {OVERLAP}"""


@REGISTRY.add(
    "K06_fragments",
    fx.duck_sql(
        " UNION ALL ".join(f"SELECT id, zone_id, 1 AS ring_id, {k} AS seq, {CORNERS.format(k, k % 4 + 1)} FROM ({SHARED_BOX}) t" for k in (1, 2, 3, 4))
    ),
)
def k06_fragments(spark, sf_dir):
    """The parts of the sites in each zone, as shapes."""
    found = ar.fragments(sites(spark, sf_dir), zones(spark, sf_dir))
    return found.select(F.col("p").alias("id"), F.col("q").alias("zone_id"), "ring_id", "seq", "x1", "y1", "x2", "y2")


def lozenges(spark, sf_dir):
    """Slanted shapes: |x - xc| / a + |y - yc| / b <= 1."""
    c = {n: F.col(n) for n in ("xc", "yc", "a", "b")}
    corners = [(c["xc"] + c["a"], c["yc"]), (c["xc"], c["yc"] + c["b"]), (c["xc"] - c["a"], c["yc"]), (c["xc"], c["yc"] - c["b"])]
    sides = [
        F.struct(F.lit(1).alias("ring_id"), F.lit(k + 1).alias("seq"), *[v.alias(n) for v, n in zip((*corners[k], *corners[(k + 1) % 4]), ("x1", "y1", "x2", "y2"), strict=True)])
        for k in range(4)
    ]
    return fx.view(spark, sf_dir, "f_lozenge").select(F.col("id").alias("poly_id"), F.inline(F.array(*sides)))


# Between neighbouring places where the shared height bends it is linear, so the trapezoids are exact.
BENDS = ", ".join(
    f"xc {sign} {d}"
    for sign in "+-"
    for d in ("0", "a", "a * (1 - (yb - yc) / b)", "a * (1 - (yc - ya) / b)", "a * (1 - (ya - yc) / b)", "a * (1 - (yc - yb) / b)")
)
HEIGHT = "GREATEST(0, LEAST(yb, yc + b * (1 - ABS({0} - xc) / a)) - GREATEST(ya, yc - b * (1 - ABS({0} - xc) / a)))"

SLANTED = {
    "met": "SELECT * FROM f_lozenge s JOIN f_zonepoly z ON xc + a > xa AND xc - a < xb AND yc + b > ya AND yc - b < yb",
    "bends": f"""SELECT DISTINCT id, zone_id, xa, ya, xb, yb, xc, yc, a, b, GREATEST(xa, xc - a, LEAST(xb, xc + a, x)) AS x
                 FROM (SELECT *, UNNEST([{BENDS}, xa, xb]) AS x FROM met) t""",
    "steps": "SELECT *, LEAD(x) OVER (PARTITION BY id, zone_id ORDER BY x) AS to_x FROM bends",
}


@REGISTRY.add(
    "K06_slanted_area",
    fx.duck_sql(
        f"""SELECT id, zone_id, ROUND(SUM((to_x - x) * ({HEIGHT.format("x")} + {HEIGHT.format("to_x")}) / 2), 1) AS area
            FROM steps GROUP BY 1, 2 HAVING SUM((to_x - x) * ({HEIGHT.format("x")} + {HEIGHT.format("to_x")})) > 0""",
        SLANTED,
    ),
)
def k06_slanted(spark, sf_dir):
    """Areas of the fragments of slanted shapes, from the fragments themselves."""
    found = ar.fragments(lozenges(spark, sf_dir), zones(spark, sf_dir))
    named = found.withColumn("poly_id", F.struct("p", "q"))
    return g.areas(named).select(F.col("poly_id.p").alias("id"), F.col("poly_id.q").alias("zone_id"), F.round("area", 1).alias("area"))


@REGISTRY.add("K07_area", fx.duck_sql("SELECT id, ROUND((xb - xa) * (yb - ya), 4) AS area FROM f_site"))
def k07(spark, sf_dir):
    return g.areas(sites(spark, sf_dir)).select(F.col("poly_id").alias("id"), F.round("area", 4).alias("area"))


@REGISTRY.add("K08_centroid", fx.duck_sql("SELECT id, ROUND((xa + xb) / 2, 4) AS x, ROUND((ya + yb) / 2, 4) AS y FROM f_site"))
def k08(spark, sf_dir):
    centres = g.centroids(sites(spark, sf_dir))
    return centres.select(F.col("poly_id").alias("id"), F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@REGISTRY.add(
    "K09_boundary_points",
    fx.duck_sql(
        """SELECT id, CAST(4 * GREATEST(CEIL((xb - xa) / 50), 1) AS BIGINT) AS n_points,
                  ROUND(2 * (xa + xb) * GREATEST(CEIL((xb - xa) / 50), 1), 3) AS sum_x,
                  ROUND(2 * (ya + yb) * GREATEST(CEIL((xb - xa) / 50), 1), 3) AS sum_y FROM f_site"""
    ),
)
def k09(spark, sf_dir):
    found = g.boundary_points(sites(spark, sf_dir), 50.0)
    return found.groupBy(F.col("poly_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_points"), F.round(F.sum("x"), 3).alias("sum_x"), F.round(F.sum("y"), 3).alias("sum_y")
    )


@REGISTRY.add("K11_coordinates", fx.duck_sql("SELECT id, x, y, lat, long FROM f_point p JOIN f_postcode c ON c.pcds = CONCAT('PC', CAST(p.id AS STRING))"))
def k11(spark, sf_dir):
    """Coordinates are plain columns on every point table."""
    located = fx.view(spark, sf_dir, "f_postcode").select("pcds", "lat", "long")
    return points(spark, sf_dir).withColumn("pcds", F.concat(F.lit("PC"), "id")).join(located, "pcds").drop("pcds")


@REGISTRY.add("K12_bbox", fx.duck_sql("SELECT MIN(xa) AS xmin, MIN(ya) AS ymin, MAX(xb) AS xmax, MAX(yb) AS ymax FROM f_site WHERE function_ = 'Public Park Or Garden'"))
def k12(spark, sf_dir):
    parks = fx.view(spark, sf_dir, "f_site").filter(F.col("function_") == "Public Park Or Garden")
    corners = g.rectangle_edges(parks, "id")
    return g.extent(corners, "x1", "y1")


BOUNDARY_SIDES = " UNION ALL ".join(
    f"SELECT id, {x} AS x, {y} AS y FROM no_access, range(0, 1000) r(i) WHERE i < GREATEST(CEIL((xb - xa) / 50), 1)"
    for x, y in (
        ("xa + (xb - xa) * (i / GREATEST(CEIL((xb - xa) / 50), 1))", "ya"),
        ("xb", "ya + (yb - ya) * (i / GREATEST(CEIL((yb - ya) / 50), 1))"),
        ("xb + (xa - xb) * (i / GREATEST(CEIL((xb - xa) / 50), 1))", "yb"),
        ("xa", "yb + (ya - yb) * (i / GREATEST(CEIL((yb - ya) / 50), 1))"),
    )
)
GREEN = {
    "parks": "SELECT * FROM f_site WHERE function_ = 'Public Park Or Garden'",
    "entries": "SELECT a.x, a.y FROM f_access a WHERE a.ref_to_greenspace_site IN (SELECT id FROM parks)",
    "no_access": "SELECT k.* FROM parks k WHERE NOT EXISTS (SELECT 1 FROM f_access a WHERE a.x BETWEEN k.xa AND k.xb AND a.y BETWEEN k.ya AND k.yb)",
    "all_entries": f"SELECT x, y FROM entries UNION ALL SELECT x, y FROM ({BOUNDARY_SIDES}) b",
    "green_ha": f"SELECT z.zone_id, SUM({SHARED}) / 10000 AS park_ha FROM parks s JOIN f_zonepoly z ON {OVERLAP} GROUP BY 1",
    "green_all": f"SELECT z.zone_id, COUNT(*) AS park_accesspoints FROM all_entries p LEFT JOIN f_zonepoly z ON {DX} * {DX} + {DY} * {DY} <= 100 GROUP BY 1",
    "green_own": f"SELECT z.zone_id, COUNT(*) AS park_accesspoints_original FROM entries p LEFT JOIN f_zonepoly z ON {INSIDE} GROUP BY 1",
}


@REGISTRY.add(
    "K13_greenspace",
    fx.duck_sql(
        """SELECT geo_code, ROUND(h.park_ha, 6) AS park_ha, a.park_accesspoints, o.park_accesspoints_original
           FROM (SELECT zone_id AS geo_code FROM green_ha UNION SELECT zone_id FROM green_all UNION SELECT zone_id FROM green_own) k
           LEFT JOIN green_ha h ON h.zone_id IS NOT DISTINCT FROM k.geo_code
           LEFT JOIN green_all a ON a.zone_id IS NOT DISTINCT FROM k.geo_code
           LEFT JOIN green_own o ON o.zone_id IS NOT DISTINCT FROM k.geo_code""",
        GREEN,
    ),
)
def k13(spark, sf_dir):
    site_table = fx.view(spark, sf_dir, "f_site").select("id", "function_")
    access = fx.view(spark, sf_dir, "f_access")
    summary = greenspace.summary(site_table, sites(spark, sf_dir), access, zones(spark, sf_dir))
    return summary.withColumn("park_ha", F.round("park_ha", 6))
