"""Coordinates corrected by a table of shifts on a regular grid, as national mapping agencies publish them.

The table has one row per grid point: column ``i`` and row ``j`` (place divided by ``cell`` metres) and the shifts ``se``
and ``sn`` there. Between grid points shifts are bilinear. The four corners of a cell are brought into one row first, so a
point meets the table in one equi-join, measured before it is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from isoreach.operators.joins import lookup_join
from isoreach.session import materialise

_CORNERS = ((0, 0), (1, 0), (0, 1), (1, 1))


def shift_cells(grid: DataFrame) -> DataFrame:
    """(ci, cj, e00, n00, e10, ...): cells of which all four corners are in the table; a stored table."""
    corner = F.inline(F.array(*[F.struct((F.col("i") - a).cast("long").alias("ci"), (F.col("j") - b).cast("long").alias("cj"), F.lit(f"{a}{b}").alias("corner")) for a, b in _CORNERS]))
    listed = grid.select("se", "sn", corner)
    picked = [F.max(F.when(F.col("corner") == f"{a}{b}", F.col(f"s{s}"))).alias(f"{s}{a}{b}") for a, b in _CORNERS for s in "en"]
    return materialise(listed.groupBy("ci", "cj").agg(*picked).dropna(), "shift-cells")


def _between(name: str, u: Column, v: Column) -> Column:
    low = F.col(f"{name}00") * (1 - u) + F.col(f"{name}10") * u
    high = F.col(f"{name}01") * (1 - u) + F.col(f"{name}11") * u
    return low * (1 - v) + high * v


def _shift_at(df: DataFrame, cells: DataFrame, cell: float, x: Column, y: Column) -> DataFrame:
    """Adds ``_se`` and ``_sn``, the shifts at a place; NULL outside the table."""
    placed = df.withColumns({"_u": x / cell, "_v": y / cell}).withColumns({"ci": F.floor("_u"), "cj": F.floor("_v")})
    met = lookup_join(placed, cells, ["ci", "cj"], "left")
    u, v = F.col("_u") - F.col("ci"), F.col("_v") - F.col("cj")
    return met.withColumns({"_se": _between("e", u, v), "_sn": _between("n", u, v)}).select(*df.columns, "_se", "_sn")


def shifted(df: DataFrame, cells: DataFrame, cell: float, x: str = "x", y: str = "y") -> DataFrame:
    """``x`` and ``y`` with the shifts at their place added; NULL outside the table."""
    moved = _shift_at(df, cells, cell, F.col(x), F.col(y))
    return moved.withColumns({x: F.col(x) + F.col("_se"), y: F.col(y) + F.col("_sn")}).select(*df.columns)


def unshifted(df: DataFrame, cells: DataFrame, cell: float, x: str = "x", y: str = "y", rounds: int = 4) -> DataFrame:
    """The places that ``shifted`` takes to ``x`` and ``y``.

    By fixed-point steps from the given place: each leaves an error smaller by the change of the shift over a metre, some
    1e-5 in published tables, so four steps are below a micrometre. NULL where a step leaves the table.
    """
    kept = df.columns
    moved = df.withColumns({"_x": F.col(x), "_y": F.col(y)})
    for _ in range(rounds):
        at = _shift_at(moved, cells, cell, F.col("_x"), F.col("_y"))
        moved = at.withColumns({"_x": F.col(x) - F.col("_se"), "_y": F.col(y) - F.col("_sn")}).drop("_se", "_sn")
    return moved.withColumns({x: F.col("_x"), y: F.col("_y")}).select(*kept)
