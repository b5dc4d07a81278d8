"""Polygons as tables of directed edges, and what follows from the edges alone.

An edge table has ``poly_id, x1, y1, x2, y2`` (and ``ring_id, seq`` where the order matters).
Outer rings run counter-clockwise, holes clockwise; a multipolygon is several rings under one id.
Coordinates are metres in a plane.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.operators.joins import lookup_join

_PAD = 1e-6


def rectangle_edges(df: DataFrame, poly_id: str, xa: str = "xa", ya: str = "ya", xb: str = "xb", yb: str = "yb") -> DataFrame:
    """Four counter-clockwise edges for every rectangle."""
    xa, ya, xb, yb = (F.col(c).cast("double") for c in (xa, ya, xb, yb))

    def edge(seq: int, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
        return F.struct(
            F.lit(1).alias("ring_id"), F.lit(seq).alias("seq"),
            x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"),
        )

    sides = F.array(edge(1, xa, ya, xb, ya), edge(2, xb, ya, xb, yb), edge(3, xb, yb, xa, yb), edge(4, xa, yb, xa, ya))
    return df.select(F.col(poly_id).alias("poly_id"), F.inline(sides))


def bounds(edges: DataFrame) -> DataFrame:
    """Box and edge count of every polygon."""
    return edges.groupBy("poly_id").agg(
        F.min(F.least("x1", "x2")).alias("xmin"),
        F.min(F.least("y1", "y2")).alias("ymin"),
        F.max(F.greatest("x1", "x2")).alias("xmax"),
        F.max(F.greatest("y1", "y2")).alias("ymax"),
        F.count(F.lit(1)).alias("n_edges"),
    )


def extent(df: DataFrame, x: str, y: str) -> DataFrame:
    """Box of a whole selection of points."""
    return df.agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def areas(edges: DataFrame) -> DataFrame:
    """Area in square metres; holes count negative by their direction."""
    strip = (F.col("x1") - F.col("x2")) * (F.col("y1") + F.col("y2"))
    return edges.groupBy("poly_id").agg((F.sum(strip) / 2).alias("area"))


def centroids(edges: DataFrame) -> DataFrame:
    """Area-weighted centre. Sums are taken from the polygon's own corner, which keeps their precision."""
    local = lookup_join(edges, bounds(edges).select("poly_id", "xmin", "ymin"), "poly_id", "inner")
    u1, v1 = F.col("x1") - F.col("xmin"), F.col("y1") - F.col("ymin")
    u2, v2 = F.col("x2") - F.col("xmin"), F.col("y2") - F.col("ymin")
    cross = u1 * v2 - u2 * v1
    sums = local.groupBy("poly_id").agg(
        F.first("xmin").alias("x0"),
        F.first("ymin").alias("y0"),
        F.sum(cross).alias("c"),
        F.sum((u1 + u2) * cross).alias("mx"),
        F.sum((v1 + v2) * cross).alias("my"),
    )
    return sums.select(
        "poly_id",
        (F.col("x0") + F.try_divide("mx", 3 * F.col("c"))).alias("x"),
        (F.col("y0") + F.try_divide("my", 3 * F.col("c"))).alias("y"),
    )


def boundary_points(edges: DataFrame, max_gap: float) -> DataFrame:
    """Points along the outline, every vertex once, neighbours at most ``max_gap`` apart."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    pieces = F.greatest(F.ceil(F.sqrt(dx * dx + dy * dy) / max_gap), F.lit(1).cast("bigint"))
    steps = edges.withColumn("_n", pieces).withColumn("_i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n") - 1)))
    share = F.col("_i") / F.col("_n")
    return steps.select(
        "poly_id", "ring_id", "seq", F.col("_i").alias("step"),
        (F.col("x1") + dx * share).alias("x"), (F.col("y1") + dy * share).alias("y"),
    )


def cell_of(value: Column | str, size: Column | float) -> Column:
    """Number of the grid column (or row) a coordinate falls in."""
    value = F.col(value) if isinstance(value, str) else value
    return F.floor(value / size)


def with_cell(points: DataFrame, size: float) -> DataFrame:
    return points.withColumns({"cx": cell_of("x", size), "cy": cell_of("y", size)})


def box_cells(boxes: DataFrame, size: Column | float) -> DataFrame:
    """One row per grid cell the box touches."""

    def span(low: str, high: str) -> Column:
        return F.sequence(cell_of(low, size), cell_of(high, size))

    columns = boxes.withColumn("cx", F.explode(span("xmin", "xmax")))
    return columns.withColumn("cy", F.explode(span("ymin", "ymax")))


def edge_cells(edges: DataFrame, size: Column | float, grow: Column | float = 0.0) -> DataFrame:
    """One row per grid cell within ``grow`` of an edge (a few more cells may be included).

    An edge is followed row by row of the grid, so a long slanted edge yields as many cells as it
    is long, not as many as its box is large.
    """
    size = F.lit(size) if not isinstance(size, Column) else size
    reach = (F.lit(grow) if not isinstance(grow, Column) else grow) + _PAD
    low_y, high_y = F.least("y1", "y2"), F.greatest("y1", "y2")
    rows = edges.withColumn("cy", F.explode(F.sequence(cell_of(low_y - reach, size), cell_of(high_y + reach, size))))

    # The part of the edge whose distance from this row of cells can be within reach.
    from_y = F.greatest(low_y, F.col("cy") * size - reach)
    to_y = F.least(high_y, (F.col("cy") + 1) * size + reach)
    slope = F.try_divide(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    xa = F.col("x1") + (from_y - F.col("y1")) * slope
    xb = F.col("x1") + (to_y - F.col("y1")) * slope
    level = (high_y - low_y) <= _PAD
    low_x = F.when(level, F.least("x1", "x2")).otherwise(F.greatest(F.least("x1", "x2"), F.least(xa, xb)))
    high_x = F.when(level, F.greatest("x1", "x2")).otherwise(F.least(F.greatest("x1", "x2"), F.greatest(xa, xb)))
    span = F.sequence(cell_of(low_x - reach, size), cell_of(high_x + reach, size))
    return rows.withColumn("cx", F.explode(span))


def segment_distance_squared(x: Column, y: Column) -> Column:
    """Squared distance of (x, y) from the edge in ``x1, y1, x2, y2``."""
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = F.try_divide((x - F.col("x1")) * dx + (y - F.col("y1")) * dy, dx * dx + dy * dy)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(along, F.lit(0.0))))
    ex, ey = F.col("x1") + t * dx - x, F.col("y1") + t * dy - y
    return ex * ex + ey * ey


EDGES_PER_STRIP = 16
CELLS_ACROSS = 8


def longest_side() -> Column:
    return F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"))


def typical_cell(boxes: DataFrame) -> float:
    """Finest grid size for a layer: a part of the middle box side.

    The value only tunes the work, so an approximate middle is enough.
    """
    middle = boxes.agg(F.percentile_approx(longest_side(), 0.5, 1000)).first()[0]
    return max(float(middle or 1.0) / (CELLS_ACROSS / 2), 1e-3)


def level_size(size: float) -> Column:
    """Cell size of the grid named in ``level``; each level doubles it."""
    return F.lit(float(size)) * F.pow(F.lit(2.0), F.col("level"))


def with_level(boxes: DataFrame, size: float) -> DataFrame:
    """The grid on which a box is at most ``CELLS_ACROSS`` cells wide, so that a large box among
    small ones does not fall into a vast number of cells."""
    wanted = F.ceil(F.log2(F.greatest(longest_side() / (size * CELLS_ACROSS), F.lit(1.0))))
    return boxes.withColumn("level", wanted.cast("int"))


def strip_width(low: str, high: str) -> Column:
    """Width of strips that cut a polygon so that each holds some ``EDGES_PER_STRIP`` edges."""
    strips = F.greatest(F.ceil(F.col("n_edges") / EDGES_PER_STRIP), F.lit(1))
    return F.greatest((F.col(high) - F.col(low)) / strips, F.lit(1e-9))
