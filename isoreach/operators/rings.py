"""From a loose set of directed edges to closed rings.

Interior lies left of every edge. Edges come with key columns that keep separate outlines apart; all steps are joins and
windows over nodes and edges, none gathers an outline in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from isoreach.operators.joins import shuffled
from isoreach.session import materialise


def _successors(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(id, next): at each node, the first outgoing edge clockwise from the way one came.

    Outlines that touch in a node are thereby parted: every ring goes around its own piece of the interior.
    """
    arriving = edges.select(*keys, F.col("x2").alias("x"), F.col("y2").alias("y"), F.atan2(F.col("y1") - F.col("y2"), F.col("x1") - F.col("x2")).alias("turn"), "id", F.lit(None).cast("long").alias("out"))
    leaving = edges.select(*keys, F.col("x1").alias("x"), F.col("y1").alias("y"), F.atan2(F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")).alias("turn"), F.lit(None).cast("long").alias("id"), F.col("id").alias("out"))
    node = Window.partitionBy(*keys, "x", "y")
    below = node.orderBy("turn", F.col("out").isNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = arriving.unionByName(leaving).select(
        "id", F.coalesce(F.last("out", ignorenulls=True).over(below), F.max_by("out", F.when(F.col("out").isNotNull(), F.col("turn"))).over(node)).alias("next")
    )
    return seen.filter("id IS NOT NULL AND next IS NOT NULL")


def _ranked(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(id, leader, ahead): the ring's edge with the least start, and how many steps it is ahead.

    Pointer doubling: after round k every edge knows the least of the 2^k edges from it on. A ring of a million edges
    takes some twenty rounds, each a join on the edge.
    """
    own = F.struct("x1", "y1", "id")
    state = edges.join(shuffled(_successors(edges, keys)), "id").select(
        "id", F.col("next").alias("to"), F.struct(own.alias("edge"), F.lit(0).cast("long").alias("ahead")).alias("least"), F.lit(False).alias("moved")
    )
    state, reach = materialise(state, "ring-steps"), 1
    while True:
        there = state.select(F.col("id").alias("to"), F.col("to").alias("further"), F.col("least").alias("other"))
        better = F.col("other.edge") < F.col("least.edge")
        least = F.when(better, F.struct(F.col("other.edge").alias("edge"), (F.col("other.ahead") + reach).alias("ahead"))).otherwise(F.col("least"))
        state = materialise(state.join(shuffled(there), "to").select("id", F.col("further").alias("to"), least.alias("least"), better.alias("moved")), "ring-steps")
        reach *= 2
        if not state.filter("moved").limit(1).count():
            return state.select("id", F.col("least.edge.id").alias("leader"), F.col("least.ahead").alias("ahead"))


def stitched(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The edges (``keys, x1, y1, x2, y2``) with ``ring_id`` and ``seq``, both from 1, and corners only.

    A ring starts at its least vertex (x, then y); the rings of one outline are numbered by these. Edges that run straight
    on become one. Edges that close no ring, which only rounding leaves behind, are left out.
    """
    kept = edges.select(*keys, "x1", "y1", "x2", "y2").withColumn("id", F.monotonically_increasing_id())
    kept = materialise(kept, "loose-edges")
    placed = materialise(kept.join(shuffled(_ranked(kept, keys)), "id"), "ring-edges")
    corners = _without_straight(placed, keys, ["leader"])
    firsts = corners.filter("first").select("leader", F.dense_rank().over(Window.partitionBy(*keys).orderBy("x1", "y1", "leader")).cast("int").alias("ring_id"))
    numbered = corners.join(shuffled(firsts), "leader")
    return numbered.select(*keys, "ring_id", "seq", "x1", "y1", "x2", "y2")


def in_order(edges: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """As ``stitched``, for edges that close one ring for each key and follow each other in the order of some columns."""
    ring = Window.partitionBy(*keys)
    place = F.row_number().over(ring.orderBy(*order)).alias("place")
    placed = edges.select(*keys, "x1", "y1", "x2", "y2", place, F.count(F.lit(1)).over(ring).alias("n"))
    least = F.min(F.struct("x1", "y1", "place")).over(ring)["place"]
    placed = placed.select(*keys, "x1", "y1", "x2", "y2", F.pmod(least - F.col("place"), "n").alias("ahead"))
    return _without_straight(placed, keys, keys).select(*keys, F.lit(1).alias("ring_id"), "seq", "x1", "y1", "x2", "y2")


def _without_straight(placed: DataFrame, keys: list[str], ring: list[str]) -> DataFrame:
    """Drops the vertices at which a ring (the rows with equal ``ring``) runs straight on."""
    forward = Window.partitionBy(*ring).orderBy(F.desc("ahead"))
    # The leader is 0 ahead of itself and comes first; of the others the one furthest behind it comes next.
    turn = F.when(F.col("ahead") == 0, F.lit(1 << 62)).otherwise(F.col("ahead"))
    ordered = placed.withColumn("ahead", turn)
    before = [F.lag(c).over(forward) for c in ("x1", "y1")]
    last = Window.partitionBy(*ring).orderBy("ahead").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wrap = [F.first(c).over(last) for c in ("x1", "y1")]
    ux, uy = F.col("x1") - F.coalesce(before[0], wrap[0]), F.col("y1") - F.coalesce(before[1], wrap[1])
    vx, vy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    straight = (ux * vy == uy * vx) & (ux * vx + uy * vy > 0)
    corner = ordered.withColumn("corner", ~straight)
    corner = corner.filter("corner")
    after = [F.lead(c).over(forward) for c in ("x1", "y1")]
    start = [F.first(c).over(forward.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in ("x1", "y1")]
    seq = F.row_number().over(forward)
    return corner.select(
        *dict.fromkeys([*keys, *ring]), seq.alias("seq"), (seq == 1).alias("first"), "x1", "y1", F.coalesce(after[0], start[0]).alias("x2"), F.coalesce(after[1], start[1]).alias("y2")
    )


def open_ends(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes where more edges arrive than leave or the reverse; closed outlines have none."""
    ends = edges.select(*keys, F.col("x2").alias("x"), F.col("y2").alias("y"), F.lit(1).alias("n"))
    starts = edges.select(*keys, F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(-1).alias("n"))
    return ends.unionByName(starts).groupBy(*keys, "x", "y").agg(F.sum("n").alias("n")).filter("n <> 0")


