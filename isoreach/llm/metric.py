"""Exact metric range join of vectors: all pairs of one label whose cosine reaches a threshold.

On unit vectors, cosine >= c means distance <= r = sqrt(2 - 2c). Labels with more than ``cell`` vectors get pivots (at
most ``MOST_PIVOTS`` for all labels together, shared in proportion to their vectors; other labels are one cell). A vector
is at home in the cell of its nearest pivot h. By the triangle inequality a vector within r of it can be at home in the
cell of pivot j only if d(j) <= d(h) + 2r, and in Euclidean space only if the plane between the pivots is within r; the
vector is sent as a guest to those cells. Each cell then compares its home vectors with all its vectors by one matrix
product in double precision, and no other cell is needed for them.

A cell of any size is cut into blocks of home vectors and blocks of all vectors, and each pair of blocks is a group of
its own, so a label, a source or a copied vector that holds a third of all rows is spread out. No pairs leave a block:
each home vector reports its number of links there, and every vector that is linked there, guests included, the least
vector it is connected with, so that the stars of all blocks hold each link's connection.

Defined results: a vector that is null, empty, zero or has null or non-finite components links with nothing, nor does
one without a label; vectors of different lengths never link; a repeated vec_id counts once, by its least label and
vector; rows without vec_id are left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm.components import connected, local_roots
from isoreach.session import materialise

MOST_PIVOTS = 4096


def _unit(values: list) -> np.ndarray | None:
    """The unit vector in double precision, or None where a vector links with nothing."""
    if not values or None in values:
        return None
    v = np.array(values, np.float64)
    size = np.abs(v).max()
    if not np.isfinite(size) or size == 0:
        return None
    v = v / size
    return v / np.sqrt(v @ v)


def _pivots(vectors: DataFrame, cell: int) -> dict[tuple, np.ndarray]:
    """Unit vectors of the pivots of large labels."""
    sizes = vectors.groupBy("label", F.size("embedding").alias("dim")).agg(F.count("*").alias("n"))
    large = sizes.filter((F.col("n") > cell) & (F.col("dim") > 0)).orderBy(F.desc("n"), "label", "dim").limit(MOST_PIVOTS // 2).collect()
    total = sum(r["n"] for r in large)
    out = {}
    if not large:
        return out
    wanted = {(r["label"], r["dim"]): max(2, min(math.ceil(r["n"] / cell), int(MOST_PIVOTS * r["n"] / total))) for r in large}
    # About three times the pivots of each label by a hash of the id; the least hashes among them are taken.
    share = F.lit(None).cast("double")
    for r in large:
        fits = F.col("label").eqNullSafe(r["label"]) & (F.size("embedding") == r["dim"])
        share = F.when(fits, F.lit(min(1.0, (3.0 * wanted[r["label"], r["dim"]] + 20) / r["n"]))).otherwise(share)
    rank = F.pmod(F.xxhash64("vec_id", F.lit(11)), F.lit(1 << 30))
    near = vectors.withColumn("rank", rank).filter(F.col("rank") < share * (1 << 30))
    for row in sorted(near.collect(), key=lambda r: (r["rank"], r["vec_id"])):
        key = row["label"], len(row["embedding"])
        unit = _unit(row["embedding"])
        if unit is not None and len(out.setdefault(key, [])) < wanted[key]:
            out[key].append(unit)
    return {k: np.array(v) for k, v in out.items() if len(v) > 1}


def neighbours(embeddings: DataFrame, cosine: float = 0.93, cell: int = 4000, block: int = 2048) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    spark = embeddings.sparkSession
    radius = math.sqrt(2 - 2 * cosine) + 1e-9
    vectors = embeddings.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v"))
    vectors = materialise(vectors.select(F.col("vec_id").cast("long"), "v.label", "v.embedding"), "vectors")
    labelled = vectors.filter("label IS NOT NULL AND embedding IS NOT NULL")
    shared = spark.sparkContext.broadcast(_pivots(labelled, cell))
    kind = labelled.schema["label"].dataType.simpleString()

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for the home cell and for each cell visited as a guest."""
        pivots = shared.value
        apart = {k: np.sqrt(np.maximum(0, 2 - 2 * (p @ p.T))) for k, p in pivots.items()}
        for batch in batches:
            ids, labels, dims, cells, home, data = [], [], [], [], [], []
            for row in batch.to_pylist():
                unit = _unit(row["embedding"])
                if unit is None:
                    continue
                key = row["label"], len(unit)
                at = [0]
                if key in pivots:
                    d = np.sqrt(np.maximum(0, 2 - 2 * (pivots[key] @ unit)))
                    own = int(d.argmin())
                    gap = np.maximum(apart[key][own], 1e-12)
                    guest = (d <= d[own] + 2 * radius) & ((d**2 - d[own] ** 2) / (2 * gap) <= radius)
                    guest[own] = False
                    at = [own, *np.flatnonzero(guest).tolist()]
                for k, c in enumerate(at):
                    ids.append(row["vec_id"])
                    labels.append(row["label"])
                    dims.append(len(unit))
                    cells.append(c)
                    home.append(k == 0)
                    data.append(unit.tobytes())
            arrays = [pa.array(ids, pa.int64()), pa.array(labels, batch.schema.field("label").type), pa.array(dims, pa.int32()), pa.array(cells, pa.int32()), pa.array(home, pa.bool_()), pa.array(data, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "label", "dim", "cell", "home", "unit"])

    placed = labelled.mapInArrow(place, f"vec_id long, label {kind}, dim int, cell int, home boolean, unit binary")
    placed = materialise(placed, "cells")
    key = ["label", "dim", "cell"]
    sizes = placed.groupBy(*key).agg(F.count("*").alias("n"), F.sum(F.col("home").cast("long")).alias("n_home"))
    sized = placed.join(materialise(sizes, "cell-sizes"), key)
    homes, alls = (F.greatest(F.lit(1), F.ceil(F.col(c) / block)).cast("int") for c in ("n_home", "n"))
    spread = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 30))
    span = lambda n: F.sequence(F.lit(0), n - 1)
    named = [*key, "vec_id", "unit"]
    rows = sized.filter("home").select(*named, F.lit(True).alias("home"), (spread % homes).cast("int").alias("i"), F.explode(span(alls)).alias("j"))
    met = sized.select(*named, F.lit(False).alias("home"), F.explode(span(homes)).alias("i"), (spread % alls).cast("int").alias("j"))

    def compare(table: pa.Table) -> pa.Table:
        home = table.column("home").to_numpy(zero_copy_only=False)
        ids = table.column("vec_id").to_numpy()
        unit = np.frombuffer(b"".join(table.column("unit").to_pylist()), np.float64).reshape(len(ids), -1)
        a_ids, a = ids[home], unit[home]
        b_ids, b = ids[~home], unit[~home]
        names = np.unique(ids)
        n = np.zeros(len(a_ids), np.int64)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        b_at = np.searchsorted(names, b_ids)
        a_at = np.searchsorted(names, a_ids)
        for k in range(0, len(a_ids), 512):
            linked = a[k : k + 512] @ b.T >= cosine
            linked &= a_ids[k : k + 512, None] != b_ids[None, :]
            n[k : k + 512] = linked.sum(axis=1)
            x, y = np.nonzero(linked)
            left.append(a_at[x + k])
            right.append(b_at[y])
        root = local_roots(len(names), np.concatenate(left), np.concatenate(right))
        moved = np.flatnonzero(root != np.arange(len(names)))
        n = np.concatenate([n, np.zeros(len(moved), np.int64)])
        return pa.table({"vec_id": np.concatenate([a_ids, names[moved]]), "n": n, "root": np.concatenate([names[root[a_at]], names[root[moved]]])})

    out = rows.unionByName(met).groupBy(*key, "i", "j").applyInArrow(compare, "vec_id long, n long, root long")
    out = materialise(out, "vector-links")
    counts = out.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    joined = connected(out.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    joined = joined.withColumnRenamed("node", "vec_id")
    every = vectors.select("vec_id").join(counts, "vec_id", "left").join(joined, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return every.select(
        "vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), (component == F.col("vec_id")).alias("kept")
    )
