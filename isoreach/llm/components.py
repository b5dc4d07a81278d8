"""Connected components of an edge table, in rounds of two joins each.

Alternating stars: in turn every node's larger neighbours, then its smaller ones, are hung on the least node it knows.
Long chains shrink by halves and a hub's edges are hung on one node at once. Each round is written to the shared folder,
so that lost executors cost one round. Minima are taken before rows are joined back to them, both sides shuffled by the
node, so a hub's rows can be split by adaptive execution.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.session import materialise


def _hang(edges: DataFrame, smaller: bool) -> DataFrame:
    """(u, v) pairs, u > v, after one star step."""
    if smaller:
        least = materialise(edges.groupBy("u").agg(F.min("v").alias("m")), "least")
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    else:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "least")
        out = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); the component is its least node."""
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = materialise(pairs, "edges")

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        return row["n"], row["h"]

    before = mark(pairs)
    while before[0]:
        pairs = materialise(_hang(_hang(pairs, False), True), "stars")
        now = mark(pairs)
        if now == before:
            break
        before = now
    roots = pairs.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("component"))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1, the least node of each one's component; edges as arrays."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new
