"""Conversions between coordinate systems, with SQL texts written from the published formulas step by step."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from isoreach import fixtures as fx
from isoreach.functions import geodesy
from isoreach.operators import geometry as g
from isoreach.operators import gridshift, sphere
from isoreach.registry import REGISTRY

# Fixed values of the grid, written out a second time so that the SQL texts stand on their own.
A, B, F0 = 6377563.396, 6356256.909, 0.9996012717
E2, N = (A * A - B * B) / (A * A), (A - B) / (A + B)
LAT0, LON0, E0, N0 = math.radians(49), math.radians(-2), 400000, -100000
WA, WB = 6378137.0, 6356752.3141
WE2 = (WA * WA - WB * WB) / (WA * WA)


def chained(base: str, *steps: dict[str, str]) -> str:
    """Nested selects; each step adds or replaces columns."""
    text, known = f"({base}) t", []
    for step in steps:
        kept = f"* EXCLUDE ({', '.join(n for n in step if n in known)})" if any(n in known for n in step) else "*"
        text = f"(SELECT {kept}, {', '.join(f'{v} AS {k}' for k, v in step.items())} FROM {text}) t"
        known += step
    return text


def meridian(lat: str) -> str:
    return (
        f"{B * F0} * ({1 + N + 5 / 4 * N**2 + 5 / 4 * N**3} * ({lat} - {LAT0}) - {3 * N + 3 * N**2 + 21 / 8 * N**3} * SIN({lat} - {LAT0}) * COS({lat} + {LAT0})"
        f" + {15 / 8 * N**2 + 15 / 8 * N**3} * SIN(2 * ({lat} - {LAT0})) * COS(2 * ({lat} + {LAT0})) - {35 / 24 * N**3} * SIN(3 * ({lat} - {LAT0})) * COS(3 * ({lat} + {LAT0})))"
    )


RADII = [
    {"nu": f"{A * F0} / SQRT(1 - {E2} * SIN(phi) * SIN(phi))", "rho": f"{A * F0 * (1 - E2)} * POW(1 - {E2} * SIN(phi) * SIN(phi), -1.5)"},
    {"eta2": "nu / rho - 1", "t": "TAN(phi)"},
]


def cartesian(a: float, e2: float) -> list[dict[str, str]]:
    return [
        {"v": f"{a} / SQRT(1 - {e2} * SIN(phi) * SIN(phi))"},
        {"cx": "v * COS(phi) * COS(lam)", "cy": "v * COS(phi) * SIN(lam)", "cz": f"{1 - e2} * v * SIN(phi)"},
    ]


def moved(sign: int) -> dict[str, str]:
    """Seven parameters: metres, seconds, parts per million."""
    s = 1 + sign * 20.4894e-6
    rx, ry, rz = (sign * math.radians(r / 3600) for r in (-0.1502, -0.2470, -0.8421))
    return {
        "dx": f"{sign * -446.448} + {s} * cx + {-rz} * cy + {ry} * cz",
        "dy": f"{sign * 125.157} + {rz} * cx + {s} * cy + {-rx} * cz",
        "dz": f"{sign * -542.060} + {-ry} * cx + {rx} * cy + {s} * cz",
    }


def geographic(a: float, e2: float) -> list[dict[str, str]]:
    first = {"p": "SQRT(dx * dx + dy * dy)", "lam": "ATAN2(dy, dx)"}
    again = {"phi": f"ATAN2(dz + {e2} * {a} / SQRT(1 - {e2} * SIN(phi) * SIN(phi)) * SIN(phi), p)"}
    return [first, {"phi": f"ATAN2(dz, p * {1 - e2})"}, again, again, again, again]


TO_AIRY = [
    {"phi": f"(y - {N0}) / {A * F0} + {LAT0}"},
    *[{"phi": f"(y - {N0} - {meridian('phi')}) / {A * F0} + phi"}] * 5,
    *RADII,
    {"d": f"x - {E0}"},
    {
        "phi": "phi - d * d * t / (2 * rho * nu) + POW(d, 4) * t / (24 * rho * POW(nu, 3)) * (5 + 3 * t * t + eta2 - 9 * t * t * eta2)"
        " - POW(d, 6) * t / (720 * rho * POW(nu, 5)) * (61 + 90 * t * t + 45 * POW(t, 4))",
        "lam": f"{LON0} + d / (COS(phi) * nu) - POW(d, 3) / (COS(phi) * 6 * POW(nu, 3)) * (nu / rho + 2 * t * t)"
        " + POW(d, 5) / (COS(phi) * 120 * POW(nu, 5)) * (5 + 28 * t * t + 24 * POW(t, 4))"
        " - POW(d, 7) / (COS(phi) * 5040 * POW(nu, 7)) * (61 + 662 * t * t + 1320 * POW(t, 4) + 720 * POW(t, 6))",
    },
]
TO_WGS84 = [*TO_AIRY, *cartesian(A, E2), moved(-1), *geographic(WA, WE2)]
TO_GRID = [
    {"phi": "RADIANS(lat)", "lam": "RADIANS(long)"}, *cartesian(WA, WE2), moved(1), *geographic(A, E2), *RADII, {"d": f"lam - {LON0}"},
    {
        "n": f"{N0} + {meridian('phi')} + d * d * nu / 2 * SIN(phi) * COS(phi) + POW(d, 4) * nu / 24 * SIN(phi) * POW(COS(phi), 3) * (5 - t * t + 9 * eta2)"
        " + POW(d, 6) * nu / 720 * SIN(phi) * POW(COS(phi), 5) * (61 - 58 * t * t + POW(t, 4))",
        "e": f"{E0} + d * nu * COS(phi) + POW(d, 3) * nu / 6 * POW(COS(phi), 3) * (nu / rho - t * t)"
        " + POW(d, 5) * nu / 120 * POW(COS(phi), 5) * (5 - 18 * t * t + POW(t, 4) + 14 * eta2 - 58 * t * t * eta2)",
    },
]

GE2 = 2 / 298.257222101 - 1 / 298.257222101**2
GE = math.sqrt(GE2)


def authalic(s: float) -> float:
    return (1 - GE2) * (s / (1 - GE2 * s * s) - math.log((1 - GE * s) / (1 + GE * s)) / (2 * GE))


QP, S1 = authalic(1.0), math.sin(math.radians(52))
BETA1, RQ = math.asin(authalic(S1) / QP), 6378137.0 * math.sqrt(QP / 2)
D = 6378137.0 * math.cos(math.radians(52)) / math.sqrt(1 - GE2 * S1 * S1) / (RQ * math.cos(BETA1))
TO_EUROPE = [
    {"q": f"{1 - GE2} * (SIN(phi) / (1 - {GE2} * SIN(phi) * SIN(phi)) - LN((1 - {GE} * SIN(phi)) / (1 + {GE} * SIN(phi))) / {2 * GE})", "l": f"lam - {math.radians(10)}"},
    {"beta": f"ASIN(q / {QP})"},
    {"size": f"{RQ} * SQRT(2 / (1 + {math.sin(BETA1)} * SIN(beta) + {math.cos(BETA1)} * COS(beta) * COS(l)))"},
    {
        "east": f"4321000 + size * {D} * COS(beta) * SIN(l)",
        "north": f"3210000 + size / {D} * ({math.cos(BETA1)} * SIN(beta) - {math.sin(BETA1)} * COS(beta) * COS(l))",
    },
]
POINTS = "SELECT id, x, y FROM f_point"


def points(spark, sf_dir):
    return fx.view(spark, sf_dir, "f_point")


@REGISTRY.add("K10_to_wgs84", fx.duck_sql(f"SELECT id, ROUND(DEGREES(phi), 8) AS lat, ROUND(DEGREES(lam), 8) AS long FROM {chained(POINTS, *TO_WGS84)}"))
def k10(spark, sf_dir):
    """National grid to degrees."""
    placed = geodesy.grid_to_wgs84(points(spark, sf_dir))
    return placed.select("id", F.round("lat", 8).alias("lat"), F.round("long", 8).alias("long"))


@REGISTRY.add(
    "K10_from_wgs84",
    fx.duck_sql(f"SELECT pcds, ROUND(e, 3) AS x, ROUND(n, 3) AS y FROM {chained('SELECT pcds, lat, long FROM f_postcode', *TO_GRID)}"),
)
def k10_back(spark, sf_dir):
    """Degrees to the national grid."""
    placed = geodesy.wgs84_to_grid(fx.view(spark, sf_dir, "f_postcode"))
    return placed.select("pcds", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@REGISTRY.add(
    "K10_to_3035",
    fx.duck_sql(f"SELECT id, ROUND(east, 3) AS east, ROUND(north, 3) AS north FROM {chained(POINTS, *TO_WGS84, *TO_EUROPE)}"),
)
def k10_europe(spark, sf_dir):
    """National grid to the European equal-area grid."""
    placed = geodesy.wgs84_to_europe(geodesy.grid_to_wgs84(points(spark, sf_dir)), x="east", y="north")
    return placed.select("id", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"))


@REGISTRY.add("K10_from_3035", fx.duck_sql("SELECT pcds, lat, long FROM f_postcode"))
def k10_europe_back(spark, sf_dir):
    """Degrees to the equal-area grid and back."""
    there = geodesy.wgs84_to_europe(fx.view(spark, sf_dir, "f_postcode").select("pcds", "lat", "long"))
    back = geodesy.europe_to_wgs84(there.select("pcds", "x", "y"))
    return back.select("pcds", F.round("lat", 8).alias("lat"), F.round("long", 8).alias("long"))


CELL = 10_000.0
CORNER = "(SELECT * FROM f_shift) {0} ON {0}.i = FLOOR(p.xc / 10000) + {1} AND {0}.j = FLOOR(p.yc / 10000) + {2}"
MIX = "(a.{0} * (1 - u) + b.{0} * u) * (1 - v) + (c.{0} * (1 - u) + d.{0} * u) * v"


def centres(spark, sf_dir):
    return fx.view(spark, sf_dir, "f_lozenge").select("id", F.col("xc").alias("x"), F.col("yc").alias("y"))


@REGISTRY.add(
    "K10_grid_shift",
    fx.duck_sql(
        f"""SELECT p.id, ROUND(p.xc + {MIX.format("se")}, 6) AS x, ROUND(p.yc + {MIX.format("sn")}, 6) AS y
            FROM (SELECT *, xc / 10000 - FLOOR(xc / 10000) AS u, yc / 10000 - FLOOR(yc / 10000) AS v FROM f_lozenge) p
            LEFT JOIN {CORNER.format("a", 0, 0)} LEFT JOIN {CORNER.format("b", 1, 0)} LEFT JOIN {CORNER.format("c", 0, 1)} LEFT JOIN {CORNER.format("d", 1, 1)}"""
    ),
)
def k10_shift(spark, sf_dir):
    cells = gridshift.shift_cells(fx.view(spark, sf_dir, "f_shift"))
    found = gridshift.shifted(centres(spark, sf_dir), cells, CELL)
    return found.select("id", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


@REGISTRY.add("K10_grid_unshift", fx.duck_sql("SELECT id, xc AS x, yc AS y FROM f_lozenge"))
def k10_unshift(spark, sf_dir):
    """Shifted and brought back by fixed-point steps."""
    cells = gridshift.shift_cells(fx.view(spark, sf_dir, "f_shift"))
    back = gridshift.unshifted(gridshift.shifted(centres(spark, sf_dir), cells, CELL), cells, CELL)
    return back.select("id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


def degrees(spark, sf_dir):
    """The sites as if a hundred kilometres were a degree."""
    sites = g.rectangle_edges(fx.view(spark, sf_dir, "f_site"), "id")
    lon, lat = lambda c: F.col(c) / 100_000 - 6, lambda c: F.col(c) / 100_000 + 50
    return sites.select("poly_id", "ring_id", "seq", lon("x1").alias("x1"), lat("y1").alias("y1"), lon("x2").alias("x2"), lat("y2").alias("y2"))


def vector(tag: str, x: str, y: str) -> dict[str, str]:
    lon, lat = f"RADIANS({x} / 100000 - 6)", f"RADIANS({y} / 100000 + 50)"
    return {f"{tag}0": f"COS({lat}) * COS({lon})", f"{tag}1": f"COS({lat}) * SIN({lon})", f"{tag}2": f"SIN({lat})"}


def dot(a: str, b: str) -> str:
    return f"({a}0 * {b}0 + {a}1 * {b}1 + {a}2 * {b}2)"


def angle(a: str, b: str, c: str) -> str:
    """Angle at ``a`` of a triangle on the sphere."""
    normal = [f"({a}{(k + 1) % 3} * ({b}{(k + 2) % 3}) - {a}{(k + 2) % 3} * ({b}{(k + 1) % 3}))" for k in range(3)]
    other = [f"({a}{(k + 1) % 3} * ({c}{(k + 2) % 3}) - {a}{(k + 2) % 3} * ({c}{(k + 1) % 3}))" for k in range(3)]
    product = " + ".join(f"{n} * {o}" for n, o in zip(normal, other, strict=True))
    size = " * ".join(f"SQRT({' + '.join(f'{n} * {n}' for n in v)})" for v in (normal, other))
    return f"ACOS(GREATEST(-1, LEAST(1, ({product}) / ({size}))))"


FOUR = [{**vector("p", "xa", "ya"), **vector("q", "xb", "ya"), **vector("r", "xb", "yb"), **vector("s", "xa", "yb")}]
ANGLES = " + ".join(angle(a, b, c) for a, b, c in (("p", "s", "q"), ("q", "p", "r"), ("r", "q", "s"), ("s", "r", "p")))


@REGISTRY.add("K07_sphere_area", fx.duck_sql(f"SELECT id, ROUND(({ANGLES} - 2 * PI()) * 6371010.0 * 6371010.0 / 1000000, 2) AS km2 FROM {chained('SELECT * FROM f_site', *FOUR)}"))
def k07_sphere(spark, sf_dir):
    """Areas of sites given in degrees; the SQL text adds up their angles."""
    found = sphere.areas(degrees(spark, sf_dir))
    return found.select(F.col("poly_id").alias("id"), F.round(F.col("area") / 1e6, 2).alias("km2"))


def middle(k: int) -> str:
    """Centre of the two triangles pqr and prs, weighted by plane area: for small shapes the sphere's own."""
    return f"((p{k} + q{k} + r{k}) * w1 + (p{k} + r{k} + s{k}) * w2)"


def half(a: str, b: str, c: str) -> str:
    cross = [f"(({b}{(k + 1) % 3} - {a}{(k + 1) % 3}) * ({c}{(k + 2) % 3} - {a}{(k + 2) % 3}) - ({b}{(k + 2) % 3} - {a}{(k + 2) % 3}) * ({c}{(k + 1) % 3} - {a}{(k + 1) % 3}))" for k in range(3)]
    return f"SQRT({' + '.join(f'{c} * {c}' for c in cross)})"


CENTRE = [*FOUR, {"w1": half("p", "q", "r"), "w2": half("p", "r", "s")}, {f"m{k}": middle(k) for k in range(3)}]


@REGISTRY.add(
    "K08_sphere_centroid",
    fx.duck_sql(f"SELECT id, ROUND(DEGREES(ATAN2(m1, m0)), 5) AS long, ROUND(DEGREES(ATAN2(m2, SQRT(m0 * m0 + m1 * m1))), 5) AS lat FROM {chained('SELECT * FROM f_site', *CENTRE)}"),
)
def k08_sphere(spark, sf_dir):
    """Centres of sites given in degrees."""
    found = sphere.centroids(degrees(spark, sf_dir))
    return found.select(F.col("poly_id").alias("id"), F.round("x", 5).alias("long"), F.round("y", 5).alias("lat"))
