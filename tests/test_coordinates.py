"""Conversions against published worked examples, round trips, and polygons on the sphere."""

import math
import random

import pytest
from pyspark.sql import functions as F

from isoreach import fixtures as fx
from isoreach.functions import geodesy
from isoreach.operators import gridshift, sphere
from tests.test_spatial import EDGE, ring


def test_grid_round_trip(spark, sf_dir):
    points = fx.view(spark, sf_dir, "f_point")
    back = geodesy.wgs84_to_grid(geodesy.grid_to_wgs84(points), x="x_back", y="y_back")
    apart = F.greatest(F.abs(F.col("x") - F.col("x_back")), F.abs(F.col("y") - F.col("y_back")))
    assert back.agg(F.max(apart)).first()[0] < 0.005


def test_equal_area_grid_of_the_published_worked_example(spark):
    """50 N, 5 E is 3962799.45 east, 2999718.85 north."""
    there = geodesy.wgs84_to_europe(spark.createDataFrame([(50.0, 5.0), (52.0, 10.0)], "lat double, long double")).orderBy("lat").collect()
    assert (there[0]["x"], there[0]["y"]) == (pytest.approx(3962799.45, abs=5e-3), pytest.approx(2999718.85, abs=5e-3))
    assert (there[1]["x"], there[1]["y"]) == (pytest.approx(4321000.0, abs=1e-6), pytest.approx(3210000.0, abs=1e-6))


def test_equal_area_grid_and_back(spark):
    places = spark.createDataFrame([(35.0 + i, -25.0 + 2.5 * j) for i in range(36) for j in range(25)] + [(52.0, 10.0), (None, 1.0)], "a double, b double")
    there = geodesy.wgs84_to_europe(places, "a", "b")
    back = geodesy.europe_to_wgs84(there)
    worst = back.agg(F.max(F.abs(F.col("lat") - F.col("a"))), F.max(F.abs(F.col("long") - F.col("b"))), F.count("lat")).first()
    assert max(worst[0], worst[1]) < 1e-11 and worst[2] == 901


def test_shift_between_outside_and_back(spark):
    rng = random.Random(2)
    nodes = [(i, j, 90 + 0.3 * i - 0.2 * j + rng.random() * 0.01, -80 + 0.1 * i * j) for i in range(12) for j in range(9) if (i, j) != (5, 5)]
    table = {(i, j): (e, n) for i, j, e, n in nodes}
    cells = gridshift.shift_cells(spark.createDataFrame(nodes, "i int, j int, se double, sn double"))
    spots = [(k, rng.uniform(-1000, 12_000), rng.uniform(-1000, 9_000)) for k in range(500)] + [(900, 0.0, 0.0), (901, None, 5.0)]
    given = spark.createDataFrame(spots, "id long, x double, y double")
    got = {r["id"]: (r["x"], r["y"]) for r in gridshift.shifted(given, cells, 1000.0).collect()}
    known = 0
    for k, x, y in spots:
        i, j = (math.floor(v / 1000) for v in (x, y)) if x is not None else (-9, -9)
        four = [table.get((i + a, j + b)) for a, b in ((0, 0), (1, 0), (0, 1), (1, 1))]
        if None in four:
            assert got[k] == (None, None)
            continue
        u, v, known = x / 1000 - i, y / 1000 - j, known + 1
        mixed = [((p * (1 - u) + q * u) * (1 - v) + (r * (1 - u) + s * u) * v) for p, q, r, s in zip(*four, strict=True)]
        assert got[k] == (pytest.approx(x + mixed[0], abs=1e-9), pytest.approx(y + mixed[1], abs=1e-9))
    assert known > 200
    inside = given.filter("id < 500 AND x BETWEEN 200 AND 4500 AND y BETWEEN 1000 AND 3500")
    back = gridshift.unshifted(gridshift.shifted(inside, cells, 1000.0), cells, 1000.0, rounds=8).withColumnsRenamed({"x": "u", "y": "v"})
    worst = inside.join(back, "id").agg(F.max(F.hypot(F.col("x") - F.col("u"), F.col("y") - F.col("v"))), F.count("u"), F.count("x")).first()
    assert worst[0] < 1e-6 and worst[1] == worst[2] > 20


def test_octants_and_small_shapes_on_the_sphere(spark):
    octant = [(0, 0), (90, 0), (0, 90)]  # a pole is any longitude
    square = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    shapes = ring(1, octant) + ring(2, square(10, 50, 1e-4)) + ring(3, square(-20, -0.5, 1)) + ring(3, square(-19.75, -0.25, 0.5)[::-1], 2) + ring(4, [(5, 5), (5, 6)])
    edges = spark.createDataFrame(shapes, EDGE)
    area = {r["poly_id"]: r["area"] for r in sphere.areas(edges, 1.0).collect()}
    assert area[1] == pytest.approx(math.pi / 2)
    assert area[2] == pytest.approx(math.radians(1e-4) ** 2 * math.cos(math.radians(50.00005)), rel=1e-9)
    assert area[3] == pytest.approx(math.radians(1) ** 2 * 0.75, rel=1e-4) and area[4] == pytest.approx(0, abs=1e-20)
    centre = {r["poly_id"]: (r["x"], r["y"]) for r in sphere.centroids(edges).collect()}
    assert centre[1] == (pytest.approx(45), pytest.approx(math.degrees(math.atan(1 / math.sqrt(2)))))
    assert centre[2] == (pytest.approx(10.00005, abs=1e-8), pytest.approx(50.00005, abs=1e-8))
    assert centre[3] == (pytest.approx(-19.5, abs=1e-9), pytest.approx(0, abs=1e-9))


def test_error_of_planar_areas(spark):
    """A 2 km square at 54 degrees: degrees scaled at its middle are off by less than 2e-7, degrees as they are by more than 40 %."""
    side = 2000 / 111_195
    shape = [(0, 54), (side, 54), (side, 54 + side), (0, 54 + side)]
    area = sphere.areas(spark.createDataFrame(ring(1, shape), EDGE), 6371010.0).first()["area"]
    planar = (math.radians(side) * 6371010.0) ** 2
    assert area == pytest.approx(planar * math.cos(math.radians(54 + side / 2)), rel=2e-7)
    assert planar / area > 1.4
