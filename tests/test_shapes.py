"""Fragments, outlines and buffers of slanted and holed shapes, and the exact side test."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from isoreach.functions.predicates import side
from isoreach.operators import arrangement as ar
from isoreach.operators import geometry as g
from isoreach.operators import rings
from isoreach.operators import spatial as sp
from tests.test_spatial import EDGE, HOLE, NOTCH, OUTER, distance, inside, ring, star

POINT = "id long, x double, y double"


def square(x, y, s):
    return [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]


def corners(df, *keys):
    """Rings as lists of corners, by key."""
    out = {}
    for r in df.orderBy(*keys, "ring_id", "seq").collect():
        out.setdefault(tuple(r[k] for k in keys), {}).setdefault(r["ring_id"], []).append((r["x1"], r["y1"]))
    return {k: list(v.values()) for k, v in out.items()}


@pytest.fixture(scope="module")
def stars():
    rng = random.Random(5)
    shapes = {i: star(rng, rng.uniform(0, 1000), rng.uniform(0, 1000), rng.randint(15, 60), 30, 120) for i in range(24)}
    shapes[99] = star(rng, 500, 500, 300, 2000, 9000)
    return shapes


@pytest.fixture(scope="module")
def star_edges(spark, stars):
    return spark.createDataFrame([e for i, p in stars.items() for e in ring(i, p)], EDGE)


def spots(n=1500):
    rng = random.Random(11)
    return [(i, rng.uniform(-300, 1300), rng.uniform(-300, 1300)) for i in range(n)]


def test_side_is_exact(spark):
    rng = random.Random(1)
    near = lambda v, k: v if not k else math.nextafter(v, math.inf * k)
    rows = []
    for i in range(1500):
        s = 10.0 ** rng.choice([-6, 0, 3, 6])
        a, b = (rng.uniform(-s, s), rng.uniform(-1e6, 1e6)), (rng.uniform(-1e6, 1e6), rng.uniform(-s, s))
        if i % 5 == 0:
            a = float(rng.randint(-9, 9)), float(rng.randint(-9, 9))
            b = a[0] + 3 * rng.randint(-9, 9), a[1] + 3 * rng.randint(-9, 9)
        t = rng.random() if i % 5 else 1 / 3
        p = [near(u + t * (v - u), rng.randint(-1, 1) if i % 10 else 0) for u, v in zip(a, b, strict=True)]
        rows.append((i, *a, *b, *p))
    rows.append((-1, 0.0, 0.0, 1.0, 1.0, None, 1.0))
    df = spark.createDataFrame(rows, "id long, ax double, ay double, bx double, by double, x double, y double")
    found = df.select("id", side(*[F.col(c) for c in df.columns[1:]]).alias("s"))
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
    got, plain_wrong = {r["id"]: r["s"] for r in found.collect()}, 0
    assert got.pop(-1) is None
    for i, *v in rows[:-1]:
        ax, ay, bx, by, x, y = map(Fraction, v)
        exact = (ax - x) * (by - y) - (ay - y) * (bx - x)
        want = (exact > 0) - (exact < 0)
        assert got[i] == want
        ax, ay, bx, by, x, y = v
        plain = (ax - x) * (by - y) - (ay - y) * (bx - x)
        plain_wrong += (plain > 0) - (plain < 0) != want
    assert plain_wrong > 50


def test_fragments_of_holes_and_notches(spark):
    left = spark.createDataFrame(ring(1, square(0, 0, 4)) + ring(2, NOTCH) + ring(3, OUTER) + ring(3, HOLE, 2) + ring(4, square(3, 3, 4)), EDGE)
    right = spark.createDataFrame(ring(1, square(2, 2, 4)) + ring(2, square(2, 5, 6)) + ring(3, square(10, 0, 3)) + ring(4, square(2, 2, 6)), EDGE)
    got = corners(ar.fragments(left, right), "p", "q")
    assert got[1, 1] == [[(2, 2), (4, 2), (4, 4), (2, 4)]]
    assert got[2, 2] == [square(2, 5, 2)[:1] + [(4, 5), (4, 10), (2, 10)], [(6, 5), (8, 5), (8, 10), (6, 10)]]
    assert got[3, 4] == [square(2, 2, 6), [(3, 3), (3, 7), (7, 7), (7, 3)]]  # a hole runs clockwise
    assert got[3, 1] == [[(2, 2), (6, 2), (6, 3), (3, 3), (3, 6), (2, 6)]]
    assert not any(q == 3 for _, q in got) and (4, 3) not in got
    assert got[4, 4] == [square(3, 3, 4)]


def test_fragments_of_stars(spark, star_edges):
    a, b = star_edges.filter("poly_id < 12 OR poly_id = 99"), star_edges.filter("poly_id >= 12")
    found = ar.fragments(a, b).withColumn("poly_id", F.concat_ws("-", "p", "q"))
    got = {r["poly_id"]: r["area"] for r in g.areas(found).collect()}
    want = {f"{r['p']}-{r['q']}": r["area"] for r in sp.overlay_areas(a, b).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-6, abs=1e-3) for k in want)
    assert rings.open_ends(found, ["poly_id"]).count() == 0


def test_outline_of_a_tiling_with_holes_islands_and_half_borders(spark):
    tiles = [square(x, y, 10) for x in (0, 10, 20) for y in (0, 10, 20) if (x, y) != (10, 10)]
    tiles += [[(30, 0), (40, 0), (40, 15), (30, 15)], square(13, 13, 4), square(50, 50, 3), square(40, 15, 5)]
    edges = spark.createDataFrame([e for i, t in enumerate(tiles) for e in ring(i, t)], EDGE)
    got = corners(ar.outlines(edges), "poly_id")[1,]
    outer = [(0, 0), (40, 0), (40, 15), (30, 15), (30, 30), (0, 30)]
    assert got == [outer, [(10, 10), (10, 20), (20, 20), (20, 10)], square(13, 13, 4), square(40, 15, 5), square(50, 50, 3)]


def test_outline_by_group_and_of_one_hole(spark):
    edges = spark.createDataFrame(ring(1, OUTER) + ring(1, HOLE, 2) + ring(2, square(3, 3, 4)) + ring(3, square(0, 0, 1)), EDGE)
    grouped = edges.withColumn("kind", F.when(F.col("poly_id") < 3, "a").otherwise("b"))
    got = corners(ar.outlines(grouped, "kind"), "kind")
    assert got == {("a",): [OUTER], ("b",): [square(0, 0, 1)]}
    assert ar.outlines(edges.limit(0)).count() == 0


def test_outline_of_copies_meets_each_edge_once(spark, monkeypatch):
    seen, plain = [], ar._meetings
    monkeypatch.setattr(ar, "_meetings", lambda e, keys: (seen.append(e.count()), plain(e, keys))[1])
    shapes = [(i, square(0, 0, 4)) for i in range(30)] + [(i, square(2, 2, 4)) for i in range(30, 50)]
    edges = spark.createDataFrame([e for i, p in shapes for e in ring(i, p)], EDGE)
    got = corners(ar.outlines(edges), "poly_id")
    assert got == {(1,): [[(0, 0), (4, 0), (4, 2), (6, 2), (6, 6), (2, 6), (2, 4), (0, 4)]]}
    assert seen == [8]


def test_outline_of_overlapping_stars(spark, stars, star_edges):
    few = {i: p for i, p in stars.items() if i < 24}
    outline = ar.outlines(star_edges.filter("poly_id < 24"))
    assert rings.open_ends(outline, ["poly_id"]).count() == 0
    got = {r["id"] for r in sp.points_in_polygons(spark.createDataFrame(spots(), POINT), outline).collect()}
    assert got == {i for i, x, y in spots() if any(inside(p, x, y) for p in few.values())}


def test_buffers_of_convex_shapes_are_not_cut(spark, monkeypatch):
    met, plain = [], ar._border
    monkeypatch.setattr(ar, "_border", lambda e, *rest: (met.extend(r[0] for r in e.select("poly_id").distinct().collect()), plain(e, *rest))[1])
    tall, kite, notch = [(0, 0), (3, 0), (3, 9), (0, 9)], [(20, 0), (26, 3), (21, 8), (17, 4)], [(40, 0), (50, 0), (50, 10), (45, 3), (40, 10)]
    edges = spark.createDataFrame([e for i, p in ((1, tall), (2, kite), (3, notch), (4, tall), (4, tall)) for e in ring(i, p)], EDGE)
    grown = ar.buffers(edges, 2.0).cache()
    assert sorted(met) == [3, 4]
    assert rings.open_ends(grown, ["poly_id"]).count() == 0
    assert {r["poly_id"]: r["n"] for r in grown.groupBy("poly_id").agg(F.max("seq").alias("n")).collect()}[1] == 4 * ar.QUARTER + 4
    found = corners(grown, "poly_id")
    for poly, shape in ((1, tall), (2, kite)):
        (outline,) = found[(poly,)]
        assert outline[0] == min(outline)
        around = sum(math.hypot(x - a, y - b) for (a, b), (x, y) in zip(shape, shape[1:] + shape[:1], strict=True))
        own = sum(a * y - x * b for (a, b), (x, y) in zip(shape, shape[1:] + shape[:1], strict=True)) / 2
        size = sum(a * y - x * b for (a, b), (x, y) in zip(outline, outline[1:] + outline[:1], strict=True)) / 2
        assert size == pytest.approx(own + 2 * around + math.pi * 4, rel=1e-3)


def test_buffers_of_stars_and_holes(spark, stars, star_edges):
    few = {i: p for i, p in stars.items() if i < 5}
    grown = ar.buffers(star_edges.filter("poly_id < 5"), 25.0)
    assert rings.open_ends(grown, ["poly_id"]).count() == 0
    got = {(r["id"], r["poly_id"]) for r in sp.points_in_polygons(spark.createDataFrame(spots(), POINT), grown).collect()}
    for i, x, y in spots():
        for k, p in few.items():
            away = 0 if inside(p, x, y) else distance(p, x, y)
            if abs(away - 25) > 25 * 0.00035:
                assert ((i, k) in got) == (away <= 25)

    holed = spark.createDataFrame(ring(1, OUTER) + ring(1, HOLE, 2) + ring(2, square(20, 0, 1)), EDGE)
    area = {r["poly_id"]: r["area"] for r in g.areas(ar.buffers(holed, 1.0)).collect()}
    round_ = 4 * ar.QUARTER / 2 * math.sin(math.pi / 2 / ar.QUARTER)
    assert area == {1: pytest.approx(100 + 40 + round_ - 4), 2: pytest.approx(1 + 4 + round_)}
    gone = {r["poly_id"]: r["area"] for r in g.areas(ar.buffers(holed, 2.5)).collect()}  # the hole closes
    assert gone[1] == pytest.approx(100 + 100 + round_ * 2.5**2)
    with pytest.raises(ValueError):
        ar.buffers(holed, 0.0)


def test_no_nested_loops(spark, star_edges):
    for df in (ar.fragments(star_edges, star_edges.filter("poly_id < 3")), ar.outlines(star_edges.filter("poly_id < 5"))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
