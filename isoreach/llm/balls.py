"""Metric trees by the anchors hierarchy, and nearest entries found by balls that one entry owns.

Middle-out: about sqrt(n) anchors are spread over the points, each new one the farthest point of the widest anchor's
list; it takes over points nearer to it, and points within half the distance of the two anchors need not be looked at.
Each anchor's points get a tree of their own in the same way. Then the anchors are merged upwards, at each step the two
whose common ball is smallest. Every ball keeps the sum, the number, the centre and the radius of its points.

Search: a ball inherits the list of entries that may be nearest to some of its points. Entry c leaves the list if, for
the entry b nearest to the centre m, |m - c|^2 - |m - b|^2 > 2 * radius * |c - b|: then b is nearer than c for every point
of the ball. A ball whose list has one entry is wholly owned and counts by its sum; a leaf compares its points with its
list. The test is made with a margin for rounding, and points are compared in whole numbers, ties to the lower index.
"""

from __future__ import annotations

import io
import math
from dataclasses import dataclass

import numpy as np

LEAF = 32


@dataclass
class Tree:
    """Balls as arrays, the root first; ball i holds ``points[first[i]:last[i]]``, children -1 for a leaf."""

    points: np.ndarray
    order: np.ndarray
    first: np.ndarray
    last: np.ndarray
    children: np.ndarray
    sums: np.ndarray
    radius: np.ndarray

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **vars(self))
        return out.getvalue()


def load(data: bytes) -> Tree:
    with np.load(io.BytesIO(data)) as held:
        return Tree(**held)


class _Ball:
    def __init__(self, rows: np.ndarray | None, n: int, center: np.ndarray, radius: float, children: tuple = ()) -> None:
        self.rows, self.n, self.center, self.radius, self.children = rows, n, center, radius, children


def _distance(points: np.ndarray, one: np.ndarray) -> np.ndarray:
    gap = points - one
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def _anchor_lists(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Row numbers of each anchor's points."""
    pivots = [points[0]]
    away, owner = _distance(points, points[0]), np.zeros(len(points), np.int64)
    while len(pivots) < most:
        radius = np.zeros(len(pivots))
        np.maximum.at(radius, owner, away)
        widest = int(radius.argmax())
        if radius[widest] == 0:
            break
        own = np.flatnonzero(owner == widest)
        new = points[own[away[own].argmax()]]
        half = _distance(np.array(pivots), new) / 2
        near = np.flatnonzero(away > half[owner])
        gap = _distance(points[near], new)
        moved = near[gap < away[near]]
        away[moved], owner[moved] = gap[gap < away[near]], len(pivots)
        pivots.append(new)
    lists = [np.flatnonzero(owner == k) for k in range(len(pivots))]
    return [rows for rows in lists if len(rows)]


def _merge(balls: list[_Ball]) -> _Ball:
    """One ball over all, joining the two with the smallest common ball again and again."""
    count = len(balls)
    n = np.array([b.n for b in balls], float)
    center, radius = np.array([b.center for b in balls]), np.array([b.radius for b in balls])

    def common(k: int) -> np.ndarray:
        gap = _distance(center, center[k])
        return np.maximum(gap * n / (n + n[k]) + radius[k], gap * n[k] / (n + n[k]) + radius)

    alive = np.ones(count, bool)
    cost = np.full((count, count), np.inf)
    for k in range(count):
        cost[k, :k] = common(k)[:k]
    b = 0
    for _ in range(count - 1):
        a, b = divmod(int(cost.argmin()), count)
        wide, center[b] = cost[a, b], (center[a] * n[a] + center[b] * n[b]) / (n[a] + n[b])
        balls[b] = _Ball(None, int(n[a] + n[b]), center[b], wide, (balls[b], balls[a]))
        n[b], radius[b] = balls[b].n, wide
        alive[a] = False
        cost[a, :] = cost[:, a] = np.inf
        new = np.where(alive, common(b), np.inf)
        cost[b, :b], cost[b + 1 :, b] = new[:b], new[b + 1 :]
    return balls[b]


def _grow(points: np.ndarray, rows: np.ndarray, leaf: int) -> _Ball:
    own = points[rows]
    if len(rows) > leaf:
        most = max(2, min(math.ceil(math.sqrt(len(rows))), math.ceil(2 * len(rows) / leaf)))
        lists = _anchor_lists(own, most)
        if len(lists) > 1:
            return _merge([_grow(points, rows[part], leaf) for part in lists])
    center = own.mean(axis=0)
    return _Ball(rows, len(rows), center, float(_distance(own, center).max()))


def build(points: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree over the rows of a matrix of whole numbers; equal points share a leaf whatever their number."""
    root = _grow(points.astype(np.float64), np.arange(len(points)), leaf)
    order, first, last, children, stack = [], [], [], [], [(root, -1, 0)]
    at = 0
    while stack:  # parents before children, the points of a ball in a row
        ball, parent, side = stack.pop()
        if parent >= 0:
            children[parent][side] = len(first)
        children.append([-1, -1])
        first.append(at)
        last.append(at + ball.n)
        if ball.children:
            number = len(first) - 1
            stack += [(ball.children[1], number, 1), (ball.children[0], number, 0)]
        else:
            order.append(ball.rows)
            at += ball.n
    order, first, last = np.concatenate(order), np.array(first), np.array(last)
    laid = points[order]
    sums = np.zeros((len(first), points.shape[1]), np.int64)
    radius = np.zeros(len(first))
    for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        own = laid[a:b].astype(np.int64)
        sums[k] = own.sum(axis=0)
        radius[k] = _distance(own.astype(np.float64), sums[k] / (b - a)).max()
    bound = int(np.abs(points).max(initial=0))
    return Tree(laid.astype(np.min_scalar_type(-bound - 1)), order, first, last, np.array(children), sums, radius)


@dataclass
class Owned:
    """Balls with the entry that owns each, and for every other point (by place) its nearest entry."""

    balls: np.ndarray
    owners: np.ndarray
    places: np.ndarray
    entries: np.ndarray


def nearest(tree: Tree, entries: np.ndarray) -> Owned:
    """The nearest entry (squared Euclidean distance, ties to the lower index) of every point."""
    wide = entries.astype(np.float64)
    squares = np.einsum("ij,ij->i", wide, wide)
    apart = np.sqrt(np.maximum(0, squares[:, None] - 2 * wide @ wide.T + squares[None, :])) * (1 + 1e-12) + 1e-6
    largest = max(int(np.abs(entries).max()), int(np.abs(tree.points).max(initial=0)))
    # Products of whole numbers are exact in double precision up to 2^53, beyond that in 64-bit numbers.
    kind = np.float64 if 4 * entries.shape[1] * largest**2 < 1 << 53 else np.int64
    exact = entries.astype(kind)
    exact_squares = np.einsum("ij,ij->i", exact, exact)
    margin = 1e-12 * (2.0 * largest) ** 2 * entries.shape[1] + 1e-6
    firsts = np.zeros(len(entries), bool)  # of equal entries only the first can be nearest
    firsts[np.unique(entries, axis=0, return_index=True)[1]] = True

    level, lists = np.zeros(1, np.int64), firsts[None, :]
    balls, owners, places, found = [], [], [], []
    while len(level):
        center = tree.sums[level] / (tree.last[level] - tree.first[level])[:, None]
        gap = np.where(lists, squares[None, :] - 2 * center @ wide.T, np.inf)
        best = gap.argmin(axis=1)
        gap -= gap[np.arange(len(level)), best][:, None]
        lists = lists & (gap <= 2 * tree.radius[level][:, None] * (1 + 1e-12) * apart[best] + margin)
        single = lists.sum(axis=1) == 1
        balls.append(level[single])
        owners.append(best[single])
        leaf = ~single & (tree.children[level, 0] < 0)
        for ball, own in zip(level[leaf].tolist(), lists[leaf], strict=True):
            a, b = int(tree.first[ball]), int(tree.last[ball])
            listed = np.flatnonzero(own)
            distance = exact_squares[listed] - 2 * (tree.points[a:b].astype(kind) @ exact[listed].T)
            places.append(np.arange(a, b))
            found.append(listed[distance.argmin(axis=1)])
        inner = ~single & ~leaf
        level, lists = tree.children[level[inner]].ravel(), np.repeat(lists[inner], 2, axis=0)
    none = [np.zeros(0, np.int64)]
    return Owned(*(np.concatenate(part + none) for part in (balls, owners, places, found)))


def totals(tree: Tree, owned: Owned, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and sums of the points nearest to each of ``size`` entries."""
    n = np.bincount(owned.entries, minlength=size)
    np.add.at(n, owned.owners, tree.last[owned.balls] - tree.first[owned.balls])
    sums = np.zeros((size, tree.points.shape[1]), np.int64)
    np.add.at(sums, owned.owners, tree.sums[owned.balls])
    np.add.at(sums, owned.entries, tree.points[owned.places].astype(np.int64))
    return n, sums


def codes(tree: Tree, owned: Owned, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entry and squared distance of every point, in the order of the rows the tree was built from."""
    laid = np.zeros(len(tree.points), np.int64)
    laid[owned.places] = owned.entries
    for ball, entry in zip(owned.balls.tolist(), owned.owners.tolist(), strict=True):
        laid[tree.first[ball] : tree.last[ball]] = entry
    gap = tree.points.astype(np.int64) - entries[laid]
    code, distance = np.empty_like(laid), np.empty_like(laid)
    code[tree.order], distance[tree.order] = laid, np.einsum("ij,ij->i", gap, gap)
    return code, distance
