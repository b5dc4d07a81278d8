"""Spatial operators on shapes beyond rectangles, against plain arithmetic."""

import math
import random

import pytest
from pyspark.sql import functions as F

from isoreach.functions import geodesy
from isoreach.operators import geometry as g
from isoreach.operators import spatial as sp
from isoreach.plans import greenspace

EDGE = "poly_id long, ring_id int, seq int, x1 double, y1 double, x2 double, y2 double"


def ring(poly, points, number=1):
    pairs = zip(points, points[1:] + points[:1])
    return [(poly, number, i, *map(float, a), *map(float, b)) for i, (a, b) in enumerate(pairs, start=1)]


def star(rng, cx, cy, n, low, high):
    angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(cx + r * math.cos(t), cy + r * math.sin(t)) for t in angles for r in [rng.uniform(low, high)]]


def inside(points, x, y):
    odd = False
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
            odd = not odd
    return odd


def distance(points, x, y):
    best = math.inf
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        dx, dy = x2 - x1, y2 - y1
        t = max(0, min(1, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
        best = min(best, math.hypot(x1 + t * dx - x, y1 + t * dy - y))
    return best


NOTCH = [(0, 0), (10, 0), (10, 10), (6, 10), (6, 4), (4, 4), (4, 10), (0, 10)]
OUTER = [(0, 0), (10, 0), (10, 10), (0, 10)]
HOLE = [(3, 3), (3, 7), (7, 7), (7, 3)]


@pytest.fixture(scope="module")
def stars():
    rng = random.Random(5)
    shapes = {i: star(rng, rng.uniform(0, 1000), rng.uniform(0, 1000), rng.randint(5, 90), 30, 120) for i in range(30)}
    shapes[99] = star(rng, 500, 500, 700, 2000, 9000)
    return shapes


@pytest.fixture(scope="module")
def star_edges(spark, stars):
    return spark.createDataFrame([e for i, p in stars.items() for e in ring(i, p)], EDGE)


def test_area_and_centroid(spark):
    edges = spark.createDataFrame(ring(1, NOTCH) + ring(2, OUTER) + ring(2, HOLE, 2), EDGE)
    assert {r["poly_id"]: r["area"] for r in g.areas(edges).collect()} == {1: 88.0, 2: 84.0}
    centre = {r["poly_id"]: (r["x"], r["y"]) for r in g.centroids(edges).collect()}
    assert centre[2] == pytest.approx((5, 5)) and centre[1][0] == pytest.approx(5)


def test_points_in_shapes_with_notch_hole_and_border(spark):
    edges = spark.createDataFrame(ring(1, NOTCH) + ring(2, OUTER) + ring(2, HOLE, 2), EDGE)
    spots = [(1, 5.0, 8.0), (2, 5.0, 5.0), (3, 0.0, 0.0), (4, 3.0, 5.0), (5, 11.0, 5.0), (6, 10.0, 10.0), (7, 6.0, 7.0), (8, 1.0, 1.0)]
    points = spark.createDataFrame(spots, "id long, x double, y double")
    for size in (None, 0.7, 3.0, 50.0):
        layer = sp.polygon_layer(edges, size)
        got = {(r["id"], r["poly_id"]) for r in sp.points_in_polygons(points, layer).collect()}
        assert got == {(1, 2), (3, 1), (3, 2), (4, 1), (4, 2), (6, 1), (6, 2), (7, 1), (7, 2), (8, 1), (8, 2)}


def test_points_in_stars(spark, stars, star_edges):
    rng = random.Random(9)
    spots = [(i, rng.uniform(-300, 1300), rng.uniform(-300, 1300)) for i in range(2000)]
    points = spark.createDataFrame(spots, "id long, x double, y double")
    got = {(r["id"], r["poly_id"]) for r in sp.points_in_polygons(points, star_edges).collect()}
    assert got == {(i, p) for i, x, y in spots for p, shape in stars.items() if inside(shape, x, y)}


def test_layer_uses_several_grids(star_edges):
    layer = sp.polygon_layer(star_edges)
    assert len(layer.levels) > 1
    cells = layer.index.groupBy("poly_id").count().agg(F.max("count")).first()[0]
    assert cells < 2000


def test_unmatched_and_repeated_points(spark):
    edges = spark.createDataFrame(ring(1, OUTER) + ring(2, [(10, 0), (20, 0), (20, 10), (10, 10)]), EDGE)
    points = spark.createDataFrame([(1, 10.0, 5.0, "a"), (2, 50.0, 5.0, "b"), (3, None, None, "c")], "id long, x double, y double, t string")
    rows = sp.join_zone(points, sp.points_in_polygons(points, edges), "zone").select("t", "zone").collect()
    assert sorted([tuple(r) for r in rows], key=str) == [("a", 1), ("a", 2), ("b", None), ("c", None)]


def test_within_and_nearest_of_stars(spark, stars, star_edges):
    few = {i: stars[i] for i in list(stars)[:30]}
    edges = star_edges.filter("poly_id < 30")
    rng = random.Random(3)
    spots = [(i, rng.uniform(-300, 1300), rng.uniform(-300, 1300)) for i in range(400)] + [(500, 90_000.0, -7_000.0)]
    points = spark.createDataFrame(spots, "id long, x double, y double")
    got = {(r["id"], r["poly_id"]) for r in sp.points_within(points, edges, 25.0).collect()}
    assert got == {(i, p) for i, x, y in spots for p, s in few.items() if inside(s, x, y) or distance(s, x, y) <= 25}

    outside = [(i, x, y) for i, x, y in spots if not any(inside(s, x, y) for s in few.values())]
    lost = spark.createDataFrame(outside, "id long, x double, y double")
    for size in (None, 5.0, 4000.0):
        near = {r["id"]: (r["poly_id"], r["distance"]) for r in sp.nearest_polygon(lost, edges, size).collect()}
        assert len(near) == len(outside)
        for i, x, y in outside:
            best = min((distance(s, x, y), p) for p, s in few.items())
            assert near[i] == (best[1], pytest.approx(best[0]))


def test_polygons_met_by_any_point(spark, stars, star_edges):
    few = {i: stars[i] for i in list(stars)[:30]}
    edges = star_edges.filter("poly_id < 30")
    wide = spark.createDataFrame(ring(200, [(400, 400), (900, 400), (900, 900), (400, 900)]), EDGE)
    few[200] = [(400, 400), (900, 400), (900, 900), (400, 900)]
    edges = edges.unionByName(wide)
    rng = random.Random(4)
    spots = [(rng.uniform(-300, 1300), rng.uniform(-300, 1300)) for _ in range(25)] + [(650.0, 650.0)]
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(spots * 40)] + [(-1, None, None)], "id long, x double, y double")
    met = [r["poly_id"] for r in sp.polygons_met(points, edges).collect()]
    assert sorted(met) == sorted(p for p, s in few.items() if any(inside(s, x, y) for x, y in spots))
    for radius in (0.0, 5.0, 60.0):
        near = [r["poly_id"] for r in sp.polygons_within(edges, points, radius).collect()]
        assert sorted(near) == sorted(p for p, s in few.items() if any(inside(s, x, y) or distance(s, x, y) <= radius for x, y in spots))
        layer = sp.polygon_layer(edges)
        assert sorted(r["poly_id"] for r in sp.polygons_within(layer, points, radius).collect()) == sorted(near)
    # Copies of a point are one place, so they do not multiply what each polygon meets.
    assert sp._places(points.filter("id >= 0")).count() == len(spots)


def test_entrances_of_parks_in_one_place_do_not_multiply(spark, monkeypatch):
    seen, plain = [], sp._inside
    monkeypatch.setattr(sp, "_inside", lambda c, strips, keys: (seen.append(c.count()) if keys == ["id"] else None, plain(c, strips, keys))[1])
    edges = spark.createDataFrame([e for i in range(60) for e in ring(i, [(0, 0), (8, 0), (8, 8), (0, 8)])] + ring(99, [(50, 50), (58, 50), (58, 58), (50, 58)]), EDGE)
    access = spark.createDataFrame([(i, i % 60, 0.0, 4.0) for i in range(600)], "access_id long, ref_to_greenspace_site long, x double, y double")
    every, listed = greenspace.park_entrances(edges, access)
    assert listed.count() == 600 and every.count() == 604
    assert sum(seen) <= 2 * 60


def test_nearest_of_no_points(spark, star_edges):
    none = spark.createDataFrame([], "id long, x double, y double")
    assert sp.nearest_polygon(none, star_edges).count() == 0


def overlay(spark, a, b, size=None):
    return {(r["p"], r["q"]): r["area"] for r in sp.overlay_areas(spark.createDataFrame(a, EDGE), spark.createDataFrame(b, EDGE), size).collect()}


def test_overlay_of_known_shapes(spark):
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    left = ring(1, square(0, 0, 2)) + ring(2, NOTCH) + ring(3, OUTER) + ring(3, HOLE, 2) + ring(4, [(0, 0), (10, 5), (0, 10)])
    right = ring(1, square(1, 1, 2)) + ring(2, [(3, 5), (7, 5), (7, 10), (3, 10)]) + ring(3, square(100, 100, 1)) + ring(4, square(2, 2, 6)) + ring(5, square(10, 0, 5))
    got = overlay(spark, left, right)
    assert got[1, 1] == pytest.approx(1)
    assert got[2, 2] == pytest.approx(10)
    assert got[3, 4] == pytest.approx(36 - 16)
    assert got[4, 4] == pytest.approx(24.0, abs=6)
    assert not any(q in (3, 5) for _, q in got)


def test_overlay_of_stars_sums_to_the_area_over_a_tiling(spark, star_edges):
    tiles = []
    for i in range(25):
        for j in range(25):
            x, y = -10_000 + i * 800, -10_000 + j * 800
            tiles += ring(1000 + i * 25 + j, [(x, y), (x + 800, y), (x + 800, y + 800), (x, y + 800)])
    whole = {r["poly_id"]: r["area"] for r in g.areas(star_edges).collect()}
    shared = sp.overlay_areas(star_edges, spark.createDataFrame(tiles, EDGE))
    summed = {r["p"]: r["a"] for r in shared.groupBy("p").agg(F.sum("area").alias("a")).collect()}
    for p, area in whole.items():
        assert summed[p] == pytest.approx(area, rel=1e-7)


def test_overlay_is_symmetric(spark, star_edges):
    a, b = star_edges.filter("poly_id < 15"), star_edges.filter("poly_id >= 15")
    forth = {(r["p"], r["q"]): r["area"] for r in sp.overlay_areas(a, b).collect()}
    back = {(r["q"], r["p"]): r["area"] for r in sp.overlay_areas(b, a).collect()}
    assert set(forth) == set(back)
    assert all(forth[k] == pytest.approx(back[k], rel=1e-6, abs=1e-6) for k in forth)


def test_boundary_gaps(spark, star_edges, stars):
    points = g.boundary_points(star_edges.filter("poly_id = 3"), 5.0).orderBy("seq", "step").collect()
    line = [(r["x"], r["y"]) for r in points]
    assert max(math.dist(a, b) for a, b in zip(line, line[1:] + line[:1])) <= 5.0 + 1e-9
    assert len(set(line)) == len(line)
    assert set((pytest.approx(x), pytest.approx(y)) == (x, y) for x, y in stars[3]) == {True}


def test_projection_of_the_published_worked_example(spark):
    """Ordnance Survey's example on the grid's own datum: 52 39 27.2531 N, 1 43 4.5177 E."""
    lat, lon = math.radians(52 + 39 / 60 + 27.2531 / 3600), math.radians(1 + 43 / 60 + 4.5177 / 3600)
    start = F.struct(F.lit(lat).alias("lat"), F.lit(lon).alias("lon"))
    there = geodesy._chain(start, geodesy._radii("lat lon"), geodesy._project)
    row = spark.range(1).select(there.alias("g")).select("g.*").first()
    assert (row["e"], row["n"]) == (pytest.approx(651409.903, abs=2e-3), pytest.approx(313177.270, abs=2e-3))


def test_no_nested_loops(spark, star_edges):
    points = spark.createDataFrame([(1, 5.0, 5.0)], "id long, x double, y double")
    for df in (sp.points_in_polygons(points, star_edges), sp.points_within(points, star_edges, 3.0), sp.overlay_areas(star_edges, star_edges)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
