"""Product codes of vectors: equal parts, one codebook a part, fitted by exact rounds over metric trees.

Components become floor(scale * x). Each task turns the rows it reads into blocks, with one anchors-hierarchy tree a part
(``balls``); the blocks are written once. A round reads the trees, finds for every ball the entries that may be nearest,
adds cached sums where one entry owns a ball, and sends one row per part and entry and task to be added up. All sums are
whole numbers, so neither the cut into blocks nor the order of adding changes a result. What reaches the driver are the
codebooks: ``parts`` x ``entries`` rows.

Nothing is shuffled by label or id but sums by label, which are added up before the shuffle and joined back by a lookup
whose size is measured, so a hot label does not become one task.

Defined results: see ``vectors.whole`` for the vectors left out (here also those whose length is no multiple of
``parts``); a null vec_id sorts last, repeated ids by their vectors, and every row has its own code; null labels are one
label; extra columns are not read; an empty table gives no rows. With fewer rows than ``entries`` the codebooks are that
much smaller.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from isoreach.llm import balls, vectors
from isoreach.operators.joins import lookup_join
from isoreach.session import materialise

CODES = "vec_id {id}, label {label}, code string, error long"
#: Numbers in a block, at most, and its vectors.
_BLOCK_NUMBERS, _BLOCK_ROWS = 1 << 21, 8192


def blocks(kept: vectors.Whole, parts: int) -> DataFrame:
    """The written table of blocks: vec_ids, labels and a tree for each part."""
    dim, size = kept.dim, max(256, min(_BLOCK_ROWS, _BLOCK_NUMBERS // kept.dim))
    ids, labels = (kept.rows.schema[c].dataType.simpleString() for c in ("vec_id", "label"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def row() -> pa.RecordBatch:
            table = pa.Table.from_batches(held).combine_chunks()
            x = np.concatenate([vectors.matrix(b.column("x"), dim) for b in held])
            trees = [balls.build(part).dump() for part in np.split(x, parts, axis=1)]
            lists = [pa.array([table.column(c).to_pylist()], pa.list_(table.schema.field(c).type)) for c in ("vec_id", "label")]
            return pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(pa.binary()))], names=["vec_ids", "labels", "trees"])

        rows = 0
        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, size - rows))
                batch = batch.slice(size - rows)
                rows += held[-1].num_rows
                if rows == size:
                    yield row()
                    held, rows = [], 0
        if rows:
            yield row()

    return materialise(kept.rows.mapInArrow(cut, f"vec_ids array<{ids}>, labels array<{labels}>, trees array<binary>"), "vector-blocks")


def _round(trees: DataFrame, codebooks: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floors of the means of the parts nearest to each entry."""
    spark = trees.sparkSession
    shared = spark.sparkContext.broadcast(codebooks)
    count, size, width = codebooks.shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        n, sums = np.zeros((count, size), np.int64), np.zeros((count, size, width), np.int64)
        for batch in batches:
            for row in batch.column("trees"):
                for k, data in enumerate(row):
                    tree = balls.load(data.as_py())
                    more = balls.totals(tree, balls.nearest(tree, books[k]), size)
                    n[k] += more[0]
                    sums[k] += more[1]
        part, entry = np.nonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    partial = trees.select("trees").mapInArrow(add, "part int, entry int, n long, sums array<long>")
    whole = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    out = codebooks.copy()
    for row in whole.collect():  # at most count * size rows
        out[row["part"], row["entry"]] = [row[f"s{i}"] // row["n"] for i in range(width)]
    shared.destroy()
    return out


def fit(kept: vectors.Whole, trees: DataFrame, parts: int, entries: int, rounds: int) -> np.ndarray:
    """Codebooks as whole numbers, part x entry x component, from the vectors with the least ids."""
    least = kept.rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    codebooks = np.array([r["x"] for r in least], np.int64).reshape(len(least), parts, kept.dim // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        codebooks = _round(trees, codebooks)
    return codebooks


def encode(trees: DataFrame, codebooks: np.ndarray) -> DataFrame:
    """One row per vector: vec_id, label, code (two hexadecimal digits a part) and error (squared distance)."""
    shared = trees.sparkSession.sparkContext.broadcast(codebooks)
    ids, labels = (trees.schema[c].dataType.elementType for c in ("vec_ids", "labels"))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                digits, error = [], 0
                for book, data in zip(shared.value, batch.column("trees")[k], strict=True):
                    tree = balls.load(data.as_py())
                    code, distance = balls.codes(tree, balls.nearest(tree, book), book)
                    digits.append(code.astype(np.uint8))
                    error = error + distance
                code = [bytes(row).hex() for row in np.column_stack(digits)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_ids")[k].values, batch.column("labels")[k].values, pa.array(code), pa.array(error)],
                    names=["vec_id", "label", "code", "error"],
                )

    return trees.mapInArrow(assign, CODES.format(id=ids.simpleString(), label=labels.simpleString()))


def digest(codebooks: np.ndarray) -> str:
    """Hash of all components as decimal numbers with commas, by part, entry and place."""
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(embeddings: DataFrame, scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """One row per usable vector: vec_id, code, error, label_error, codebooks_sha256."""
    if entries > 256:
        raise ValueError("a code has two hexadecimal digits a part: at most 256 entries")
    kept = vectors.whole(embeddings, scale, parts)
    names = {c: embeddings.schema[c].dataType.simpleString() for c in ("vec_id", "label")}
    if kept is None:
        schema = f"vec_id {names['vec_id']}, code string, error long, label_error long, codebooks_sha256 string"
        return embeddings.sparkSession.createDataFrame([], schema)
    if kept.dim // parts * (2 * kept.largest) ** 2 >= 1 << 62:
        raise OverflowError("components are too large for exact distances")
    trees = blocks(kept, parts)
    codebooks = fit(kept, trees, parts, entries, rounds)
    coded = materialise(encode(trees, codebooks), "vector-codes")
    # Labels as text with a mark, so that null labels are one key and match each other.
    key = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit(""))
    keyed = coded.select(key.alias("key"), "vec_id", "code", "error")
    sums = keyed.groupBy("key").agg(F.sum("error").alias("label_error"))
    out = lookup_join(keyed, materialise(sums, "label-errors"), "key")
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def compress_sql(scale: int = 1024, parts: int = 4, entries: int = 256, rounds: int = 4) -> str:
    """The same by comparing every part with every entry, for vectors of one length and distinct ids."""
    steps = [
        f"""kept AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor(CAST(v AS DOUBLE) * {scale}) AS BIGINT)) AS x
  FROM embeddings WHERE len(list_filter(embedding, lambda v: v IS NULL OR isnan(v) OR isinf(v))) = 0
), pieces AS MATERIALIZED (
  SELECT vec_id, label, p, CAST(x[p * (len(x) // {parts}) + 1 : (p + 1) * (len(x) // {parts})] AS DOUBLE[]) AS v
  FROM kept, range({parts}) AS t(p)
), book0 AS MATERIALIZED (
  SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM pieces
  QUALIFY e < {entries}
)"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""near{k} AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, p, any_value(a.v) AS v,
    min({{'d': list_inner_product(a.v, a.v) - 2 * list_inner_product(a.v, b.v) + list_inner_product(b.v, b.v), 'e': b.e}}) AS best
  FROM pieces AS a JOIN book{k} AS b USING (p) GROUP BY vec_id, p
)""")
        if k < rounds:
            steps.append(f"""sum{k} AS (
  SELECT p, best.e AS e, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM near{k}, range(1, 100000) AS t(i) WHERE i <= len(v) GROUP BY ALL
), mean{k} AS (
  SELECT p, e, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY i) AS v FROM sum{k} GROUP BY p, e
), book{k + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.v, b.v) AS v FROM book{k} AS b LEFT JOIN mean{k} AS m USING (p, e)
)""")
    return f"""
WITH {", ".join(steps)}, coded AS (
  SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code,
    CAST(sum(best.d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY vec_id
), named AS (
  SELECT sha256(string_agg(CAST(CAST(v[i] AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS h
  FROM book{rounds}, range(1, 100000) AS t(i) WHERE i <= len(v)
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM coded, named
"""
