"""Spatial joins as equi-joins on grid cells. All predicates include the boundary.

Points come as ``id, x, y`` with a unique ``id``; polygons as edge tables. Results are
(``id``, ``poly_id``) pairs; a point on a shared border belongs to every polygon it touches.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.functions.predicates import side
from isoreach.operators import geometry as g
from isoreach.operators.joins import lookup_join
from isoreach.session import materialise


def _crosses(x: Column, y: Column) -> Column:
    """Whether a ray to the right of (x, y) passes the edge; a vertex counts for one of its edges. Exact."""
    spans = (F.col("y1") > y) != (F.col("y2") > y)
    left = F.when(F.col("y1") < F.col("y2"), 1).otherwise(-1)
    return F.coalesce(spans & (F.col("_side") == left), F.lit(False))


def _touches(x: Column, y: Column) -> Column:
    within_x = x.between(F.least("x1", "x2"), F.greatest("x1", "x2"))
    within_y = y.between(F.least("y1", "y2"), F.greatest("y1", "y2"))
    return F.coalesce((F.col("_side") == 0) & within_x & within_y, F.lit(False))


def _inside(candidates: DataFrame, strips: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of the candidates (``x, y, poly_id, strip``) that lie in their polygon.

    A NULL ``strip`` marks a candidate already known to be inside. Only the edges of the
    candidate's own strip are looked at; they are folded into one row per candidate before the
    shuffle.
    """
    tested = lookup_join(candidates, strips, ["poly_id", "strip"], "left")
    x, y = F.col("x"), F.col("y")
    tested = tested.withColumn("_side", side(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), x, y))
    verdict = tested.groupBy(*keys, "poly_id").agg(
        F.bool_or(F.col("strip").isNull()).alias("_known"),
        (F.count_if(_crosses(x, y)) % 2 == 1).alias("_odd"),
        F.bool_or(_touches(x, y)).alias("_edge"),
    )
    return verdict.filter(F.col("_known") | F.col("_odd") | F.col("_edge")).select(*keys, "poly_id")


@dataclass(frozen=True)
class PolygonLayer:
    """Polygons prepared for repeated joins.

    ``index`` holds the grid cells of every polygon, on a grid that suits its size: ``whole`` cells
    lie inside, the others hold a piece of its border. ``strips`` holds the edges by horizontal
    strips, narrower for polygons with many edges. Both are stored tables.
    """

    edges: DataFrame
    size: float
    levels: tuple[int, ...]
    index: DataFrame
    strips: DataFrame


def polygon_layer(edges: DataFrame, size: float | None = None) -> PolygonLayer:
    boxes = materialise(g.bounds(edges), "boxes")
    size = size or g.typical_cell(boxes)
    boxes = g.with_level(boxes, size).withColumns({"y0": F.col("ymin"), "h": g.strip_width("ymin", "ymax")})
    # One number per grid in use.
    levels = tuple(sorted(r[0] for r in boxes.select("level").distinct().collect()))

    sided = lookup_join(edges, boxes.select("poly_id", "level", "y0", "h"), "poly_id", "inner")

    def strip(y: Column) -> Column:
        return F.floor((y - F.col("y0")) / F.col("h"))

    passed = F.sequence(strip(F.least("y1", "y2")), strip(F.greatest("y1", "y2")))
    strips = materialise(sided.select("poly_id", F.explode(passed).alias("strip"), "x1", "y1", "x2", "y2"), "strips")

    # A cell no edge comes near is inside or outside as a whole, so its centre decides.
    cell = ["poly_id", "level", "cx", "cy"]
    border = g.edge_cells(sided, g.level_size(size)).select(*cell, "y0", "h").distinct()
    free = g.box_cells(boxes, g.level_size(size)).select(*cell, "y0", "h").join(border.select(*cell), cell, "left_anti")
    centres = free.withColumns({"x": (F.col("cx") + 0.5) * g.level_size(size), "y": (F.col("cy") + 0.5) * g.level_size(size)})
    centres = centres.select(*cell, "x", "y", strip(F.col("y")).alias("strip"))
    whole = _inside(centres, strips, ["level", "cx", "cy"])
    index = border.withColumn("whole", F.lit(False)).unionByName(whole.withColumn("whole", F.lit(True)), allowMissingColumns=True)
    return PolygonLayer(edges, size, levels, materialise(index, "index"), strips)


def _layer(polygons: DataFrame | PolygonLayer) -> PolygonLayer:
    return polygons if isinstance(polygons, PolygonLayer) else polygon_layer(polygons)


def points_in_polygons(points: DataFrame, polygons: DataFrame | PolygonLayer) -> DataFrame:
    """Pairs of a point and a polygon it intersects."""
    layer = _layer(polygons)
    placed = points.select("id", "x", "y", F.explode(F.lit(list(layer.levels)).cast("array<int>")).alias("level"))
    placed = g.with_cell(placed, g.level_size(layer.size))
    near = lookup_join(placed, layer.index, ["level", "cx", "cy"], "inner")
    strip = F.when(~F.col("whole"), F.floor((F.col("y") - F.col("y0")) / F.col("h")))
    return _inside(near.select("id", "x", "y", "poly_id", strip.alias("strip")), layer.strips, ["id"])


def join_zone(points: DataFrame, pairs: DataFrame, zone: str) -> DataFrame:
    """All points with the zone of their pair; unmatched points keep a NULL zone, others may repeat."""
    return points.join(pairs.withColumnRenamed("poly_id", zone), "id", "left")


def keep_inside(points: DataFrame, mask: DataFrame | PolygonLayer) -> DataFrame:
    """Points that intersect any polygon of the mask."""
    return points.join(points_in_polygons(points, mask).select("id"), "id", "left_semi")


def points_within(points: DataFrame, polygons: DataFrame | PolygonLayer, radius: float) -> DataFrame:
    """Pairs of a point and a polygon at most ``radius`` away from it, inside included."""
    layer = _layer(polygons)
    # Cells not much wider than the radius keep a dense place from pairing points with far edges.
    size = max(2 * radius, layer.size / 16)
    inside = points_in_polygons(points, layer)
    reach = g.edge_cells(layer.edges, size, radius).select("poly_id", "x1", "y1", "x2", "y2", "cx", "cy")
    near = lookup_join(g.with_cell(points.select("id", "x", "y"), size), reach, ["cx", "cy"], "inner")
    close = g.segment_distance_squared(F.col("x"), F.col("y")) <= radius * radius
    return inside.unionByName(near.filter(close).select("id", "poly_id")).distinct()


def _places(points: DataFrame) -> DataFrame:
    """Where points lie, each place once, as ``id, x, y``."""
    return materialise(points.select("x", "y").distinct().withColumn("id", F.monotonically_increasing_id()), "places")


def polygons_met(points: DataFrame, polygons: DataFrame | PolygonLayer) -> DataFrame:
    """Ids of the polygons that any of the points intersects.

    A point in a whole cell decides its polygon, so only the polygons left undecided meet points one by one.
    """
    layer = _layer(polygons)
    cell = ["level", "cx", "cy"]
    placed = _places(points).select("id", "x", "y", F.explode(F.lit(list(layer.levels)).cast("array<int>")).alias("level"))
    placed = g.with_cell(placed, g.level_size(layer.size))
    occupied = materialise(placed.select(*cell).distinct(), "occupied")
    reached = lookup_join(layer.index.select("poly_id", "whole", "y0", "h", *cell), occupied, cell, "left_semi")
    reached = materialise(reached, "reached")
    known = materialise(reached.filter("whole").select("poly_id").distinct(), "known")
    near = lookup_join(lookup_join(reached.filter("NOT whole"), known, "poly_id", "left_anti"), placed, cell, "inner")
    strip = F.floor((F.col("y") - F.col("y0")) / F.col("h"))
    tested = _inside(near.select("id", "x", "y", "poly_id", strip.alias("strip")), layer.strips, ["id"])
    return known.unionByName(tested.select("poly_id")).distinct()


def _outlines_near(edges: DataFrame, places: DataFrame, radius: float, size: float) -> DataFrame:
    """Ids of the polygons with an edge at most ``radius`` away from a place."""
    reach = g.edge_cells(edges.select("poly_id", "x1", "y1", "x2", "y2"), size, radius)
    near = lookup_join(reach, g.with_cell(places.select("x", "y"), size), ["cx", "cy"], "inner")
    close = g.segment_distance_squared(F.col("x"), F.col("y")) <= radius * radius
    return near.filter(close).select("poly_id").distinct()


def polygons_within(polygons: DataFrame | PolygonLayer, points: DataFrame, radius: float) -> DataFrame:
    """Ids of the polygons at most ``radius`` away from any of the points.

    One place of each cell half as wide as the radius decides most polygons in a dense spot; only the others meet all
    places. A place inside that is further than ``radius`` from every edge has a polygon at least twice as wide around it,
    so no other polygons are asked what lies inside them.
    """
    edges = polygons.edges if isinstance(polygons, PolygonLayer) else polygons
    places = _places(points)
    boxes = materialise(g.bounds(edges), "boxes")
    size = max(2 * radius, g.typical_cell(boxes) / 16)
    some = places
    if radius > 0:
        some = places.groupBy(g.cell_of("x", radius / 2), g.cell_of("y", radius / 2)).agg(F.min(F.struct("x", "y")).alias("at")).select("at.*")
    found = materialise(_outlines_near(edges, materialise(some.select("x", "y"), "some-places"), radius, size), "near-outlines")
    if radius > 0:
        rest = lookup_join(edges, found, "poly_id", "left_anti")
        found = found.unionByName(materialise(_outlines_near(rest, places, radius, size), "near-outlines"))
    least = 2 * radius * (1 - 1e-9)
    wide = boxes.filter((F.col("xmax") - F.col("xmin") >= least) & (F.col("ymax") - F.col("ymin") >= least)).select("poly_id")
    wide = materialise(lookup_join(wide, found, "poly_id", "left_anti"), "wide")
    if not wide.limit(1).count():
        return found.distinct()
    layer = polygons if isinstance(polygons, PolygonLayer) else polygon_layer(lookup_join(edges, wide, "poly_id", "left_semi"))
    return found.unionByName(polygons_met(places, layer)).distinct()


def nearest_polygon(points: DataFrame, edges: DataFrame, size: float | None = None) -> DataFrame:
    """The closest polygon of every point outside all of them, ties to the smaller id, with the distance.

    Grids of doubling size first give each point the distance of some vertex near it, which no
    closer polygon can exceed. Every edge within that distance then lies in the nine cells around
    the point on the grid whose cells are at least that large. Nothing is searched in rounds.
    """
    size = size or g.typical_cell(g.bounds(edges))
    # The coarsest grid spans points and edges together, so every point finds a vertex on it.
    places = points.select("x", "y").unionByName(edges.select(F.col("x1").alias("x"), F.col("y1").alias("y")))
    far = places.agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
    top = max(1, math.ceil(math.log2(max(far["w"] or 0, far["h"] or 0, size) / size)))
    width = g.level_size(size)
    nine = F.array(*[F.struct(F.lit(i).cast("bigint").alias("dx"), F.lit(j).cast("bigint").alias("dy")) for i in (-1, 0, 1) for j in (-1, 0, 1)])

    def around(df: DataFrame) -> DataFrame:
        cells = df.withColumns({"cx": g.cell_of("x", width), "cy": g.cell_of("y", width)})
        return cells.select(*df.columns, "cx", "cy", F.inline(nine)).withColumns(
            {"cx": F.col("cx") + F.col("dx"), "cy": F.col("cy") + F.col("dy")}
        ).drop("dx", "dy")

    # Some vertex of every occupied cell on every grid.
    finest = edges.select(F.col("x1").alias("vx"), F.col("y1").alias("vy"))
    finest = finest.groupBy(g.cell_of("vx", size).alias("cx0"), g.cell_of("vy", size).alias("cy0")).agg(
        F.min(F.struct("vx", "vy")).alias("v")
    )
    levels = F.explode(F.sequence(F.lit(0), F.lit(top)))
    occupied = finest.select("v.vx", "v.vy", levels.alias("level"))
    occupied = occupied.groupBy("level", g.cell_of("vx", width).alias("cx"), g.cell_of("vy", width).alias("cy")).agg(
        F.min(F.struct("vx", "vy")).alias("v")
    )
    seen = lookup_join(around(points.select("id", "x", "y", levels.alias("level"))), occupied, ["level", "cx", "cy"], "inner")
    dx, dy = F.col("v.vx") - F.col("x"), F.col("v.vy") - F.col("y")
    reach = seen.groupBy("id", "x", "y").agg(F.sqrt(F.min(dx * dx + dy * dy)).alias("reach"))
    grid = F.ceil(F.log2(F.greatest(F.col("reach") * (1 + 1e-9), F.lit(float(size))) / size))
    reach = materialise(reach.withColumn("level", F.greatest(grid, F.lit(0).cast("bigint")).cast("int")), "nearest-reach")

    # Edges only on the grids some point needs: at most one number per grid.
    used = sorted(r[0] for r in reach.select("level").distinct().collect())
    if not used:
        kind = edges.schema["poly_id"].dataType
        return reach.select("id", F.lit(None).cast(kind).alias("poly_id"), F.col("reach").alias("distance"))
    levelled = edges.select("poly_id", "x1", "y1", "x2", "y2", F.explode(F.lit(used)).alias("level"))
    indexed = g.edge_cells(levelled, width).select("poly_id", "x1", "y1", "x2", "y2", "level", "cx", "cy")
    pairs = lookup_join(around(reach.drop("reach")), indexed, ["level", "cx", "cy"], "inner")
    squared = g.segment_distance_squared(F.col("x"), F.col("y"))
    best = pairs.withColumn("_d2", squared).groupBy("id").agg(F.min(F.struct("_d2", "poly_id")).alias("_best"))
    return best.select("id", "_best.poly_id", F.sqrt("_best._d2").alias("distance"))


def zone_or_nearest(points: DataFrame, polygons: DataFrame | PolygonLayer, zone: str) -> DataFrame:
    """Zone by containment, and by distance for the points in no zone."""
    layer = _layer(polygons)
    pairs = materialise(points_in_polygons(points, layer), "zone-pairs")
    lost = points.select("id", "x", "y").join(pairs.select("id"), "id", "left_anti")
    nearest = nearest_polygon(lost, layer.edges, layer.size).select("id", "poly_id")
    return join_zone(points, pairs.unionByName(nearest), zone)


def box_pairs(left: DataFrame, right: DataFrame, size: float) -> DataFrame:
    """Overlapping boxes: the columns of both sides (``p_...``, ``q_...``) and the overlap's corners.

    A box is listed on the grid that suits its size and on all coarser ones in use; two boxes meet on
    the grid of the larger one. A pair that shares several cells there is kept in the one that holds
    the low corner of its overlap, so no distinct is needed.
    """
    left, right = g.with_level(left, size), g.with_level(right, size)
    found = left.select("level").unionByName(right.select("level")).distinct().collect()
    levels = F.lit(sorted(r[0] for r in found)).cast("array<int>")

    def listed(boxes: DataFrame, tag: str) -> DataFrame:
        own = boxes.withColumn("own", F.col("level")).withColumn("level", F.explode(levels)).filter(F.col("level") >= F.col("own"))
        cells = g.box_cells(own, g.level_size(size))
        return cells.select("level", "cx", "cy", *[F.col(c).alias(f"{tag}_{c}") for c in own.columns if c != "level"])

    x0, y0 = F.greatest("p_xmin", "q_xmin"), F.greatest("p_ymin", "q_ymin")
    x1, y1 = F.least("p_xmax", "q_xmax"), F.least("p_ymax", "q_ymax")
    cell = g.level_size(size)
    pairs = lookup_join(listed(left, "p"), listed(right, "q"), ["level", "cx", "cy"], "inner").filter(
        (F.col("level") == F.greatest("p_own", "q_own"))
        & (x0 < x1) & (y0 < y1)
        & (g.cell_of(x0, cell) == F.col("cx")) & (g.cell_of(y0, cell) == F.col("cy"))
    )
    return pairs.withColumns({"ox0": x0, "oy0": y0, "ox1": x1, "oy1": y1})


def _pieces(edges: DataFrame, boxes: DataFrame, tag: str) -> DataFrame:
    """Non-vertical edges cut at the borders of their polygon's vertical strips.

    Each piece is a line with a sign: the upper side of a counter-clockwise ring runs to the left
    and counts +1, the lower one -1.
    """
    left = F.col("x1") < F.col("x2")
    sided = lookup_join(edges.filter(F.col("x1") != F.col("x2")), boxes.select("poly_id", "x0", "w"), "poly_id", "inner")
    cut = sided.select(
        "poly_id", "x0", "w",
        F.when(left, -1.0).otherwise(1.0).alias("s"),
        F.least("x1", "x2").alias("xa"),
        F.greatest("x1", "x2").alias("xb"),
        F.when(left, F.col("y1")).otherwise(F.col("y2")).alias("ya"),
        ((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))).alias("m"),
        F.greatest("y1", "y2").alias("hi"),
    )
    strips = F.sequence(F.floor((F.col("xa") - F.col("x0")) / F.col("w")), F.floor((F.col("xb") - F.col("x0")) / F.col("w")))
    cut = cut.withColumn("strip", F.explode(strips))
    start, end = F.col("x0") + F.col("strip") * F.col("w"), F.col("x0") + (F.col("strip") + 1) * F.col("w")
    cut = cut.withColumns({"from_x": F.greatest(F.col("xa"), start), "to_x": F.least(F.col("xb"), end)})
    kept = cut.filter(F.col("from_x") < F.col("to_x"))
    return kept.select(
        F.col("poly_id").alias(f"{tag}_poly_id"), F.col("strip").alias(f"{tag}_strip"),
        *[F.col(c).alias(f"{tag}_{c}") for c in ("s", "xa", "ya", "m", "from_x", "to_x", "hi")],
    )


def _strips_between(low: Column, high: Column, tag: str) -> Column:
    x0, w = F.col(f"{tag}_x0"), F.col(f"{tag}_w")
    return F.explode(F.sequence(F.floor((low - x0) / w), F.floor((high - x0) / w)))


def overlay_areas(left: DataFrame, right: DataFrame, size: float | None = None, tolerance: float = 1.5e-14) -> DataFrame:
    """Area shared by each overlapping pair (``p`` of left, ``q`` of right).

    Over every x, the length two sets of intervals share is a signed sum of minima over pairs of
    their ends. Summed over pairs of edge pieces above the same stretch of x and integrated in closed
    form, this gives the area without building the shape of the overlap. Heights are taken from
    the bottom of the overlap; edges wholly below it cancel out and are left aside. Strips follow
    the number of edges, so a polygon with very many edges meets others a few edges at a time.

    Polygons that only touch share no area, up to the rounding of the sum: a pair counts as touching
    when its area is at most ``tolerance`` (some sixty roundings) of the sizes that were added up.
    """
    strips = {"x0": F.col("xmin"), "w": g.strip_width("xmin", "xmax")}
    p_boxes = materialise(g.bounds(left).withColumns(strips), "boxes")
    q_boxes = materialise(g.bounds(right).withColumns(strips), "boxes")
    pairs = box_pairs(p_boxes, q_boxes, size or g.typical_cell(q_boxes))
    kept = ["p_poly_id", "q_poly_id", "ox0", "oy0", "ox1", "oy1"]

    across = pairs.select(*kept, "q_x0", "q_w", _strips_between(F.col("ox0"), F.col("ox1"), "p").alias("p_strip"))
    p = lookup_join(across, _pieces(left, p_boxes, "p"), ["p_poly_id", "p_strip"], "inner")
    p = p.withColumns({"p_from_x": F.greatest("p_from_x", "ox0"), "p_to_x": F.least("p_to_x", "ox1")})
    p = p.filter((F.col("p_hi") >= F.col("oy0")) & (F.col("p_from_x") < F.col("p_to_x"))).drop("p_strip")
    p = p.select("*", _strips_between(F.col("p_from_x"), F.col("p_to_x"), "q").alias("q_strip"))
    both = lookup_join(p, _pieces(right, q_boxes, "q"), ["q_poly_id", "q_strip"], "inner")
    both = both.withColumns({"lo": F.greatest("p_from_x", "q_from_x"), "hi": F.least("p_to_x", "q_to_x")})
    both = both.filter((F.col("lo") < F.col("hi")) & (F.col("q_hi") >= F.col("oy0")))

    def height(tag: str, x: str) -> Column:
        return F.col(f"{tag}_ya") + (F.col(x) - F.col(f"{tag}_xa")) * F.col(f"{tag}_m") - F.col("oy0")

    both = both.withColumns(
        {"e0": height("p", "lo"), "e1": height("p", "hi"), "f0": height("q", "lo"), "f1": height("q", "hi"), "width": F.col("hi") - F.col("lo")}
    )
    e0, e1, f0, f1, w = (F.col(c) for c in ("e0", "e1", "f0", "f1", "width"))
    t = F.try_divide(f0 - e0, (f0 - e0) - (f1 - e1))
    meet = e0 + t * (e1 - e0)
    integral = (
        F.when((e0 <= f0) & (e1 <= f1), (e0 + e1) * w / 2)
        .when((f0 <= e0) & (f1 <= e1), (f0 + f1) * w / 2)
        .when(e0 < f0, (e0 + meet) * w * t / 2 + (meet + f1) * w * (1 - t) / 2)
        .otherwise((f0 + meet) * w * t / 2 + (meet + e1) * w * (1 - t) / 2)
    )
    largest = F.greatest(F.abs("oy0"), F.abs("oy1"), F.abs("p_ya"), F.abs("q_ya"))
    rounding = F.sum(F.abs(integral) + w * largest) * tolerance
    summed = both.groupBy(F.col("p_poly_id").alias("p"), F.col("q_poly_id").alias("q")).agg(
        F.sum(F.col("p_s") * F.col("q_s") * integral).alias("area"), rounding.alias("_rounding")
    )
    return summed.filter(F.col("area") > F.col("_rounding")).select("p", "q", "area")
