"""Areas and centres of polygons in degrees, on a sphere, from their edges as great-circle arcs.

Edge tables as in ``geometry`` with longitude as x and latitude as y. Both sums run over triangles of an edge and the
polygon's first vertex, whose parts outside the polygon cancel; a polygon must lie within a hemisphere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.operators.joins import lookup_join

#: Fixed value: mean radius in metres.
RADIUS = 6371010.0

Vector = tuple[Column, Column, Column]


def _unit(x: str, y: str) -> Vector:
    lon, lat = F.radians(x), F.radians(y)
    return F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)


def _dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def _cross(a: Vector, b: Vector) -> Vector:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _vectors(edges: DataFrame) -> tuple[DataFrame, Vector, Vector]:
    """Edges with the unit vectors of their ends as columns."""
    named = {f"{t}{k}": v for t, x, y in (("a", "x1", "y1"), ("b", "x2", "y2")) for k, v in zip("xyz", _unit(x, y), strict=True)}
    placed = edges.withColumns(named)
    return placed, tuple(F.col(f"a{k}") for k in "xyz"), tuple(F.col(f"b{k}") for k in "xyz")


def _from_first(edges: DataFrame) -> tuple[DataFrame, Vector, Vector, Vector]:
    """Edges with unit vectors: the polygon's first vertex c, and the differences of the edge's ends from it.

    Differences of neighbouring vectors are exact, which keeps the digits of small polygons.
    """
    firsts = edges.groupBy("poly_id").agg(F.min(F.struct("x1", "y1")).alias("o")).select("poly_id", F.col("o.x1").alias("ox"), F.col("o.y1").alias("oy"))
    placed, a, b = _vectors(lookup_join(edges, firsts, "poly_id", "inner"))
    placed = placed.withColumns(dict(zip(("cx", "cy", "cz"), _unit("ox", "oy"), strict=True)))
    c = F.col("cx"), F.col("cy"), F.col("cz")
    apart = {f"{t}{k}": p - q for t, v in (("u", a), ("v", b)) for k, p, q in zip("xyz", v, c, strict=True)}
    return placed.withColumns(apart), c, tuple(F.col(f"u{k}") for k in "xyz"), tuple(F.col(f"v{k}") for k in "xyz")


def areas(edges: DataFrame, radius: float = RADIUS) -> DataFrame:
    """(poly_id, area) in square metres; holes count negative by their direction."""
    placed, c, u, v = _from_first(edges)
    a, b = (tuple(F.col(f"{t}{k}") for k in "xyz") for t in "ab")
    excess = 2 * F.atan2(_dot(c, _cross(u, v)), 1 + _dot(a, b) + _dot(b, c) + _dot(c, a))
    return placed.groupBy("poly_id").agg((F.sum(excess) * (radius * radius)).alias("area"))


def centroids(edges: DataFrame) -> DataFrame:
    """(poly_id, x, y): the centre of mass, brought back to the sphere, in degrees; NULL without area.

    The sum of position over a polygon is half the sum of (a x b) * w over its edges from a to b, where w is the arc's
    length by its sine. With a = c + u and b = c + v this is (w - 1) * c x (v - u) + w * u x v, since the rest cancels around
    a ring.
    """
    placed, c, u, v = _from_first(edges)
    along = tuple(q - p for p, q in zip(u, v, strict=True))
    chord = F.sqrt(_dot(along, along))
    arc = 2 * F.asin(F.least(chord / 2, F.lit(1.0)))
    squared = arc * arc
    more = F.when(arc < 0.05, squared * (1 / 6 + squared * (7 / 360 + squared * (31 / 15120 + squared * 127 / 604800)))).otherwise(F.coalesce(F.try_divide(arc, F.sin(arc)) - 1, F.lit(0.0)))
    placed = placed.withColumn("more", more)
    parts = [F.col("more") * p + (1 + F.col("more")) * q for p, q in zip(_cross(c, along), _cross(u, v), strict=True)]
    sums = placed.groupBy("poly_id").agg(*[F.sum(p).alias(f"s{k}") for k, p in zip("xyz", parts, strict=True)])
    some = F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2 + F.col("sz") ** 2) > 0
    lat = F.degrees(F.atan2("sz", F.sqrt(F.col("sx") ** 2 + F.col("sy") ** 2)))
    return sums.select("poly_id", F.when(some, F.degrees(F.atan2("sy", "sx"))).alias("x"), F.when(some, lat).alias("y"))
