"""Shapes from other shapes: fragments of an overlay, outlines of a union, buffers.

All three are one computation on edge tables. The edges of a group are cut where they meet, equal pieces are counted with
their directions, and for every piece the winding numbers to its left and right are taken per layer. A piece whose two
sides differ in a rule (inside both layers, inside any) is part of the result's border and is directed so that the
interior lies to its left; ``rings.stitched`` closes them.

Edges meet by an equi-join on grid cells of a size that suits them, and a piece counts the edges to its right within its
own horizontal strip of the group, so no group is gathered anywhere. Pieces that cancel (the common border of two zones)
are dropped before winding is counted, so a dissolved tiling costs what its outline costs.

On which side of an edge a point lies is decided exactly. Points where edges cross are rounded to ``SNAP`` metres.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from isoreach.functions.predicates import side
from isoreach.operators import geometry as g
from isoreach.operators import spatial
from isoreach.operators.joins import lookup_join, shuffled
from isoreach.operators.rings import in_order, stitched
from isoreach.session import materialise

#: Crossings are rounded to this many metres: 2^-20, about a micrometre.
SNAP = 2.0**-20
#: Pieces of a quarter circle in a buffer.
QUARTER = 30
#: Edges and arcs shorter than this many metres are not told apart from rounding without cutting.
SHORT = 1e-4
#: Corners of one task where rings are closed in order.
CORNERS = 20_000


def _boxed(edges: DataFrame) -> DataFrame:
    return edges.withColumns(
        {"xmin": F.least("x1", "x2"), "ymin": F.least("y1", "y2"), "xmax": F.greatest("x1", "x2"), "ymax": F.greatest("y1", "y2")}
    )


def _meetings(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of edges of a group (``p_...``, ``q_...``) of different parts whose boxes meet; each pair once.

    As in ``spatial.box_pairs``, but boxes of no width or height count as well.
    """
    boxed = _boxed(edges)
    size = 8 * g.typical_cell(boxed)  # twice the middle edge, which then lies in one or two cells
    boxed = materialise(g.with_level(boxed, size), "edge-boxes")
    levels = F.lit(sorted(r[0] for r in boxed.select("level").distinct().collect())).cast("array<int>")
    own = boxed.withColumn("own", F.col("level")).withColumn("level", F.explode(levels)).filter(F.col("level") >= F.col("own"))
    cells = g.box_cells(own, g.level_size(size))
    cell = [*keys, "level", "cx", "cy"]
    sides = {t: cells.select(*cell, *[F.col(c).alias(f"{t}_{c}") for c in ("id", "part", "several", "own", "x1", "y1", "x2", "y2", "xmin", "ymin", "xmax", "ymax")]) for t in "pq"}
    low_x, low_y = F.greatest("p_xmin", "q_xmin"), F.greatest("p_ymin", "q_ymin")
    strange = (F.col("p_part") != F.col("q_part")) | F.col("p_several") | F.col("q_several")
    return lookup_join(sides["p"], sides["q"], cell, "inner").filter(
        (F.col("p_id") < F.col("q_id")) & strange & (F.col("level") == F.greatest("p_own", "q_own"))
        & (low_x <= F.least("p_xmax", "q_xmax")) & (low_y <= F.least("p_ymax", "q_ymax"))
        & (g.cell_of(low_x, g.level_size(size)) == F.col("cx")) & (g.cell_of(low_y, g.level_size(size)) == F.col("cy"))
    )


def _nodes(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(id, x, y): points inside an edge where it has to be cut."""
    p1, p2, q1, q2 = ((F.col(f"{t}_x{k}"), F.col(f"{t}_y{k}")) for t, k in (("p", 1), ("p", 2), ("q", 1), ("q", 2)))
    # Edges that share an end and are not parallel meet nowhere else; neighbours along a ring are most of all pairs.
    share = (p1[0] == q1[0]) & (p1[1] == q1[1])
    for a, b in ((p1, q2), (p2, q1), (p2, q2)):
        share = share | (a[0] == b[0]) & (a[1] == b[1])
    straight, across = (p2[0] - p1[0]) * (q2[1] - q1[1]), (p2[1] - p1[1]) * (q2[0] - q1[0])
    apart = F.abs(straight - across) > 1e-14 * (F.abs(straight) + F.abs(across))
    pairs = _meetings(edges, keys).filter(~(share & apart))
    sides = {"a": side(*q1, *q2, *p1), "b": side(*q1, *q2, *p2), "c": side(*p1, *p2, *q1), "d": side(*p1, *p2, *q2)}
    met = materialise(pairs.select("p_id", "q_id", *[F.col(f"{t}_{c}{k}") for t in "pq" for k in (1, 2) for c in "xy"], *[s.alias(n) for n, s in sides.items()]), "edge-meetings")

    ux, uy, vx, vy = p2[0] - p1[0], p2[1] - p1[1], q2[0] - q1[0], q2[1] - q1[1]
    along = ((q1[0] - p1[0]) * vy - (q1[1] - p1[1]) * vx) / (ux * vy - uy * vx)
    snapped = F.struct(*[(F.rint((a + along * u) / SNAP) * SNAP).alias(n) for n, a, u in (("x", p1[0], ux), ("y", p1[1], uy))])
    crossing = met.filter((F.col("a") * F.col("b") < 0) & (F.col("c") * F.col("d") < 0)).withColumn("at", snapped)
    # A crossing that rounding puts next to an end of either edge is that end.
    place = F.col("at")
    for end in (q2, q1, p2, p1):
        near = F.greatest(F.abs(F.col("at.x") - end[0]), F.abs(F.col("at.y") - end[1])) <= 2 * SNAP
        place = F.when(near, F.struct(end[0].alias("x"), end[1].alias("y"))).otherwise(place)
    crossed = crossing.withColumn("at", place).select(F.explode(F.array("p_id", "q_id")).alias("id"), "at.x", "at.y")

    def touches(zero: str, tag: str, point: tuple[Column, Column]) -> Column:
        """Whether an end of one edge lies on the other edge, and not at its end."""
        ends = [(F.col(f"{tag}_x{k}"), F.col(f"{tag}_y{k}")) for k in (1, 2)]
        boxed = [point[i].between(F.least(ends[0][i], ends[1][i]), F.greatest(ends[0][i], ends[1][i])) for i in (0, 1)]
        apart = [(point[0] != x) | (point[1] != y) for x, y in ends]
        return (F.col(zero) == 0) & boxed[0] & boxed[1] & apart[0] & apart[1]

    cases = [("a", "q", p1), ("b", "q", p2), ("c", "p", q1), ("d", "p", q2)]
    found = F.array(*[F.when(touches(z, t, e), F.struct(F.col(f"{t}_id").alias("id"), e[0].alias("x"), e[1].alias("y"))) for z, t, e in cases])
    touched = met.filter("a = 0 OR b = 0 OR c = 0 OR d = 0").select(F.inline(F.filter(found, lambda f: f.isNotNull())))
    return crossed.unionByName(touched).distinct()


def _pieces(edges: DataFrame, keys: list[str], layers: int) -> DataFrame:
    """Cut pieces, each once and upwards (level ones to the right), with the net number of copies per layer."""
    counts = [f"n{k}" for k in range(layers)]
    nodes = materialise(_nodes(edges, keys), "edge-nodes")
    cut = materialise(nodes.select("id").distinct(), "cut-edges")
    line = ["id", *keys, *counts, "x1", "y1", "x2", "y2"]
    whole = edges.select(*line).join(shuffled(cut), "id", "left_anti")
    ends = edges.select(*line).join(shuffled(cut), "id", "left_semi")
    points = ends.select(*line, F.col("x1").alias("x"), F.col("y1").alias("y")).unionByName(ends.select(*line, F.col("x2").alias("x"), F.col("y2").alias("y")))
    points = points.unionByName(ends.join(shuffled(nodes), "id").select(*line, "x", "y")).distinct()
    ux, uy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    along = Window.partitionBy("id").orderBy((F.col("x") - F.col("x1")) * ux + (F.col("y") - F.col("y1")) * uy)
    parts = points.select(*keys, *counts, "x", "y", F.lead("x").over(along).alias("to_x"), F.lead("y").over(along).alias("to_y")).filter("to_x IS NOT NULL")
    parts = parts.select(*keys, *counts, F.col("x").alias("x1"), F.col("y").alias("y1"), F.col("to_x").alias("x2"), F.col("to_y").alias("y2"))
    parts = parts.unionByName(whole.drop("id"))
    up = (F.col("y1") < F.col("y2")) | ((F.col("y1") == F.col("y2")) & (F.col("x1") < F.col("x2")))
    corner = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    directed = parts.select(
        *keys, *[F.when(up, F.col(n)).otherwise(-F.col(n)).alias(n) for n in counts],
        corner("x1", "x2").alias("x1"), corner("y1", "y2").alias("y1"), corner("x2", "x1").alias("x2"), corner("y2", "y1").alias("y2"),
    )
    pieces = directed.groupBy(*keys, "x1", "y1", "x2", "y2").agg(*[F.sum(n).alias(n) for n in counts])
    some = " OR ".join(f"{n} <> 0" for n in counts)
    return materialise(pieces.filter(some).withColumn("id", F.monotonically_increasing_id()), "edge-pieces")


def _windings(pieces: DataFrame, keys: list[str], layers: int) -> DataFrame:
    """(id, w0, w1, ...): winding numbers that the other pieces give just right of a piece (just above a level one)."""
    bounds = pieces.groupBy(*keys).agg(F.min("y1").alias("y0"), F.max("y2").alias("ymax"), F.count(F.lit(1)).alias("n_edges"))
    bounds = materialise(bounds.select(*keys, "y0", g.strip_width("y0", "ymax").alias("h")), "strips")
    placed = lookup_join(pieces, bounds, keys, "inner")
    strip = lambda y: F.floor((y - F.col("y0")) / F.col("h"))
    rays = placed.select(F.col("id").alias("ray"), *keys, ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"), strip((F.col("y1") + F.col("y2")) / 2).alias("strip"))
    rising = placed.filter("y1 < y2").select(*keys, "id", "x1", "y1", "x2", "y2", *[f"n{k}" for k in range(layers)], F.explode(F.sequence(strip(F.col("y1")), strip(F.col("y2")))).alias("strip"))
    met = lookup_join(rays, rising, [*keys, "strip"], "inner")
    met = met.filter((F.col("id") != F.col("ray")) & (F.col("y1") <= F.col("y")) & (F.col("y") < F.col("y2")))
    met = met.filter(side(*[F.col(c) for c in ("x1", "y1", "x2", "y2", "x", "y")]) > 0)
    return met.groupBy(F.col("ray").alias("id")).agg(*[F.sum(f"n{k}").alias(f"w{k}") for k in range(layers)])


def _border(edges: DataFrame, keys: list[str], layers: int, within) -> DataFrame:
    """Directed pieces with the inside of ``within`` (of winding numbers by layer) to their left and not to their right.

    ``edges`` has ``part``, whether an edge is of ``several`` parts, and ``n0, n1, ...``, the copies of the edge per layer.
    """
    numbered = materialise(edges.withColumn("id", F.monotonically_increasing_id()), "arranged-edges")
    pieces = _pieces(numbered, keys, layers)
    seen = pieces.join(shuffled(_windings(pieces, keys, layers)), "id", "left")
    # A rising piece has the ray's side to its right, a level one to its left.
    level = F.col("y1") == F.col("y2")
    met = [F.coalesce(F.col(f"w{k}"), F.lit(0)) for k in range(layers)]
    left = within([m + F.when(level, 0).otherwise(F.col(f"n{k}")) for k, m in enumerate(met)])
    right = within([m - F.when(level, F.col(f"n{k}")).otherwise(0) for k, m in enumerate(met)])
    border = seen.withColumns({"_left": left, "_right": right}).filter("_left <> _right")
    turned = lambda a, b: F.when(F.col("_left"), F.col(a)).otherwise(F.col(b))
    return border.select(*keys, turned("x1", "x2").alias("x1"), turned("y1", "y2").alias("y1"), turned("x2", "x1").alias("x2"), turned("y2", "y1").alias("y2"))


def _in_both(w: list[Column]) -> Column:
    return (w[0] != 0) & (w[1] != 0)


def _in_first_only(w: list[Column]) -> Column:
    return (w[0] != 0) & (w[1] == 0)


def _in_any(w: list[Column]) -> Column:
    return w[0] > 0


def fragments(left: DataFrame, right: DataFrame, size: float | None = None) -> DataFrame:
    """The shapes that overlapping polygons share: edge rows ``p, q, ring_id, seq, x1, y1, x2, y2`` for each pair.

    Of both polygons only edges that can bound the pair's overlap, or lie right of it at its height, are looked at.
    Pairs that only touch have no rows.
    """
    p_boxes, q_boxes = (materialise(g.bounds(e), "boxes") for e in (left, right))
    pairs = spatial.box_pairs(p_boxes, q_boxes, size or g.typical_cell(q_boxes))
    pairs = materialise(pairs.select(F.col("p_poly_id").alias("p"), F.col("q_poly_id").alias("q"), "ox0", "oy0", "ox1", "oy1"), "overlay-pairs")

    def of(edges: DataFrame, tag: str, layer: int) -> DataFrame:
        found = lookup_join(pairs.withColumn("poly_id", F.col(tag)), edges.select("poly_id", "x1", "y1", "x2", "y2"), "poly_id", "inner")
        near = (F.greatest("y1", "y2") >= F.col("oy0")) & (F.least("y1", "y2") <= F.col("oy1")) & (F.greatest("x1", "x2") >= F.col("ox0"))
        copies = [F.lit(int(k == layer)).alias(f"n{k}") for k in (0, 1)]
        return found.filter(near).select("p", "q", *copies, F.lit(layer).alias("part"), F.lit(False).alias("several"), "x1", "y1", "x2", "y2")

    both = of(left, "p", 0).unionByName(of(right, "q", 1))
    # Beyond the overlap's right side edges only count for winding, which a piece cut there would not change.
    return stitched(_border(both, ["p", "q"], 2, _in_both), ["p", "q"])


def outlines(edges: DataFrame, by: str | None = None) -> DataFrame:
    """The outline of all polygons together, or of those with the same value of ``by``: ``by, ring_id, seq, x1, ...``.

    Polygons may share borders, in whole or part, overlap, and lie in each other's holes. Without ``by`` the outline is
    that of one group, named 1 in the column ``poly_id``.
    """
    group = F.lit(1).alias("poly_id") if by is None else F.col(by)
    name = "poly_id" if by is None else by
    up = (F.col("y1") < F.col("y2")) | ((F.col("y1") == F.col("y2")) & (F.col("x1") < F.col("x2")))
    corner = lambda a, b: F.when(up, F.col(a)).otherwise(F.col(b))
    parted = edges.select(
        group, F.col("poly_id").alias("part"), F.when(up, 1).otherwise(-1).alias("n0"),
        corner("x1", "x2").alias("x1"), corner("y1", "y2").alias("y1"), corner("x2", "x1").alias("x2"), corner("y2", "y1").alias("y2"),
    )
    # Equal edges are one with their number, as each would otherwise meet all the others.
    several = F.coalesce(F.min("part") != F.max("part"), F.lit(False)).alias("several")
    parted = parted.groupBy(name, "x1", "y1", "x2", "y2").agg(F.min("part").alias("part"), several, F.sum("n0").alias("n0"))
    return stitched(_border(parted, [name], 1, _in_any), [name])


def buffers(edges: DataFrame, radius: float, quarter: int = QUARTER) -> DataFrame:
    """Every polygon grown by ``radius``, as edge rows ``poly_id, ring_id, seq, x1, y1, x2, y2``.

    Each edge is moved outwards; corners that turn left are rounded by an arc of ``quarter`` pieces per right angle, at
    the others the moved edges are tied to the vertex. Of this curve, which may run through itself, the places it winds
    around are the buffer. ``edges`` needs ``ring_id`` and ``seq``.

    The curve of a polygon that is one closed ring, turns left at every corner and turns around once never meets itself:
    it is the buffer as it stands. Only the other curves are cut and stitched.
    """
    if radius <= 0:
        raise ValueError("the radius of a buffer must be positive")
    kept = edges.filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))
    ring = Window.partitionBy("poly_id", "ring_id").orderBy("seq")
    whole = ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    follows = {c: F.coalesce(F.lead(c).over(ring), F.first(c).over(whole)) for c in ("x1", "y1", "x2", "y2")}
    corner = kept.select(
        "poly_id", F.row_number().over(ring).alias("place"), "ring_id", "x1", "y1", "x2", "y2",
        (follows["x2"] - follows["x1"]).alias("wx"), (follows["y2"] - follows["y1"]).alias("wy"),
        ((follows["x1"] == F.col("x2")) & (follows["y1"] == F.col("y2"))).alias("joined"),
    )
    corner = materialise(corner, "buffer-corners")

    def outwards(dx: Column, dy: Column) -> tuple[Column, Column]:
        length = F.sqrt(dx * dx + dy * dy)
        return radius * dy / length, -radius * dx / length

    vx, vy, wx, wy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("wx"), F.col("wy")
    (mx, my), (nx, ny) = outwards(vx, vy), outwards(wx, wy)
    point = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    end, begin = point(F.col("x2") + mx, F.col("y2") + my), point(F.col("x2") + nx, F.col("y2") + ny)
    cross = vx * wy - vy * wx
    turn = F.atan2(cross, vx * wx + vy * wy)
    steps = F.ceil(turn / (math.pi / 2 / quarter) - 1e-9).cast("int")
    angle = lambda i: F.atan2(my, mx) + turn * i / steps
    arc = F.transform(F.sequence(F.lit(1), steps - 1), lambda i: point(F.col("x2") + radius * F.cos(angle(i)), F.col("y2") + radius * F.sin(angle(i))))
    arc = F.when(steps > 1, arc).otherwise(F.array().cast("array<struct<x:double,y:double>>"))
    round_ = F.concat(F.array(end), arc, F.array(begin))
    tied = F.array(end, point(F.col("x2"), F.col("y2")), begin)
    way = F.concat(F.array(point(F.col("x1") + mx, F.col("y1") + my)), F.when(turn > 0, round_).otherwise(tied))
    steps_of = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.struct(F.element_at(w, i).alias("a"), F.element_at(w, i + 1).alias("b")))
    # Within a function the way is worked out once, not for each of its steps.
    pairs = F.element_at(F.transform(F.array(way), steps_of), 1)

    def pieces(of: DataFrame) -> DataFrame:
        moved = of.select("poly_id", "ring_id", "place", F.posexplode(pairs))
        ends = [F.col(f"col.{p}.{c}").alias(f"{c}{k}") for k, p in ((1, "a"), (2, "b")) for c in "xy"]
        return moved.select("poly_id", "ring_id", "place", "pos", *ends).filter((F.col("x1") != F.col("x2")) | (F.col("y1") != F.col("y2")))

    sound = F.col("joined") & (F.sqrt(vx * vx + vy * vy) >= SHORT) & (radius * turn >= SHORT)
    convex = corner.groupBy("poly_id").agg(
        F.bool_and(F.coalesce(sound, F.lit(False))).alias("sound"), (F.min("ring_id") == F.max("ring_id")).alias("one"),
        F.sum(turn).alias("turned"), F.count(F.lit(1)).alias("n"),
    )
    convex = materialise(convex.filter(F.col("sound") & F.col("one") & (F.abs(F.col("turned") - 2 * math.pi) < 1)).select("poly_id", "n"), "convex")
    tasks = 1 + (convex.agg(F.sum("n")).first()[0] or 0) // CORNERS
    simple = lookup_join(corner, convex.select("poly_id"), "poly_id", "left_semi").repartition(tasks, "poly_id")
    simple = in_order(pieces(simple), ["poly_id"], ["place", "pos"])
    others = materialise(lookup_join(corner, convex.select("poly_id"), "poly_id", "left_anti"), "other-corners")
    if not others.limit(1).count():
        return simple
    part = F.concat_ws("-", "ring_id", "place", "pos").alias("part")
    curves = pieces(others).select("poly_id", part, F.lit(False).alias("several"), F.lit(1).alias("n0"), "x1", "y1", "x2", "y2")
    return simple.unionByName(stitched(_border(curves, ["poly_id"], 1, _in_any), ["poly_id"]))
