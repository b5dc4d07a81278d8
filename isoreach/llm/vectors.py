"""Vectors as whole numbers, so that sums, centres and distances over any number of rows are exact."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Whole components beyond this are refused, so that squares fit in 64 bits.
LARGEST = 1 << 27


@dataclass(frozen=True)
class Whole:
    """``rows`` has vec_id, label and x (array of long, all of ``dim`` components, none beyond ``largest``)."""

    rows: DataFrame
    dim: int
    largest: int


def whole(embeddings: DataFrame, scale: int, multiple: int = 1) -> Whole | None:
    """floor(scale * component) of the usable vectors, or None if there are none.

    Left out are vectors that are null, empty or hold null or non-finite components. Vectors must have one length; if
    there are several, the commonest multiple of ``multiple`` (of equal ones the shortest) is taken and the others are
    left out. Only vec_id, label and embedding are read. Components beyond ``LARGEST`` raise an OverflowError.
    """
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    usable = embeddings.select("vec_id", "label", "embedding").filter(F.col("embedding").isNotNull() & ~bad)
    usable = usable.filter((F.size("embedding") > 0) & (F.size("embedding") % multiple == 0))
    size = usable.groupBy(F.size("embedding").alias("dim")).agg(
        F.count("*").alias("n"), F.max(F.array_max(F.transform("embedding", lambda v: F.abs(v.cast("double"))))).alias("most")
    )
    most = size.orderBy(F.desc("n"), "dim").first()
    if most is None:
        return None
    largest = int(most["most"] * scale) + 1
    if largest > LARGEST:
        raise OverflowError(f"components up to {most['most']} are too large for exact sums of squares")
    x = F.transform("embedding", lambda v: F.floor(v.cast("double") * scale).cast("long"))
    return Whole(usable.filter(F.size("embedding") == most["dim"]).select("vec_id", "label", x.alias("x")), most["dim"], largest)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows of a list column as a matrix of 64-bit whole numbers."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
