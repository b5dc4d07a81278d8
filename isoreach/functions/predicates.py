"""On which side of a line a point lies, decided exactly, as column arithmetic.

The plain determinant decides nearly all rows: beyond a bound on its rounding its sign is right. The others are decided
by the exact determinant as a sum of doubles that do not overlap, built from error-free sums and products. The result is
right for all coordinates whose products neither overflow nor vanish.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Relative rounding bound of the plain determinant, and the factor that halves a double's digits.
_BOUND = (3.0 + 16.0 * 2.0**-53) * 2.0**-53
_HALVES = 2.0**27 + 1.0


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _sum(a: Column, b: Column) -> tuple[Column, Column]:
    """a + b as rounded sum and the exact rest."""
    s = a + b
    other = s - a
    return s, (a - (s - other)) + (b - other)


def _halves(a: Column) -> tuple[Column, Column]:
    c = _HALVES * a
    high = c - (c - a)
    return high, a - high


def _product(a: Column, b: Column) -> Column:
    """a * b exactly, as an array of two doubles, the smaller first."""
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    p = a * b
    return F.array(al * bl - (((p - ah * bh) - al * bh) - ah * bl), p)


def _grow(total: Column, b: Column) -> Column:
    """The sum of doubles that do not overlap, ascending, and one more double, in the same form."""
    start = F.struct(b.alias("q"), F.array().cast("array<double>").alias("done"))

    def step(state: Column, e: Column) -> Column:
        s, rest = _sum(state["q"], e)
        return F.struct(s.alias("q"), F.concat(state["done"], F.array(rest)).alias("done"))

    return F.aggregate(total, start, step, lambda state: F.concat(state["done"], F.array(state["q"])))


def _exact(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    """Sign of (a - p) x (b - p) from exact differences and products."""

    def difference(a: Column, b: Column) -> tuple[Column, Column]:
        return _sum(a, -b)

    parts = F.array(*[F.struct(h.alias("h"), t.alias("t")) for h, t in (difference(ax, x), difference(by, y), difference(ay, y), difference(bx, x))])

    def products(d: Column) -> Column:
        terms = []
        for sign, i, j in ((1.0, 0, 1), (-1.0, 2, 3)):
            terms += [_product(F.lit(sign) * d[i][p], d[j][q]) for p in ("h", "t") for q in ("h", "t")]
        return F.concat(*terms)

    terms = _once(parts, products)
    total = F.aggregate(terms, F.array(F.lit(0.0)), _grow)
    # The last one that is not zero is larger than all before it together.
    return F.aggregate(total, F.lit(0), lambda sign, e: F.when(e == 0, sign).otherwise(F.signum(e).cast("int")))


def side(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    """1 where (x, y) lies left of the line from a to b, -1 right of it, 0 on it; NULL if a coordinate is."""
    left, right = (ax - x) * (by - y), (ay - y) * (bx - x)
    plain = left - right
    safe = F.abs(plain) > _BOUND * (F.abs(left) + F.abs(right))
    # Both products vanish only where one of their factors does: an end of the line, or a level or upright line.
    on = (left == 0) & (right == 0)
    known = ax.isNotNull() & ay.isNotNull() & bx.isNotNull() & by.isNotNull() & x.isNotNull() & y.isNotNull()
    return F.when(safe, F.signum(plain).cast("int")).when(on, 0).when(known, _exact(ax, ay, bx, by, x, y))
