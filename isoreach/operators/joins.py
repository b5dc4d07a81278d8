"""Joins between a large side and a lookup side.

``lookup_join`` measures the lookup before it broadcasts it. Beyond the limit the big side is
shuffled, except for its hot keys: these are few by construction, so only their lookup rows are
broadcast and no task receives all rows of a hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isoreach.session import materialise

#: A hash table takes several times what ``measured_bytes`` says, and the driver builds and holds several at once.
BROADCAST_BYTES = 16 << 20
HOT_SHARE = 1 / 200
SAMPLE_SHARE = 0.01
#: Rows that one task of a shuffled lookup join gets, on average, so that its memory does not follow the input.
TASK_ROWS = 250_000

_VARIABLE = (T.StringType, T.BinaryType)
_NESTED = (T.ArrayType, T.MapType, T.StructType)


def measured_bytes(df: DataFrame) -> int:
    """Size of the rows of ``df``, from one aggregate over it."""
    fixed = 0
    variable = F.lit(0)
    for field in df.schema.fields:
        fixed += 8
        if isinstance(field.dataType, _VARIABLE):
            variable = variable + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(field.dataType, _NESTED):
            variable = variable + F.octet_length(F.to_json(F.struct(field.name)))
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(variable.cast("bigint")).alias("v")).first()
    return row["n"] * fixed + (row["v"] or 0)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that grows with the input: it is shuffled, never broadcast.

    Spark guesses sizes from files. Compressed columns and rows that an explode has added take many times that in the
    driver, which builds what is broadcast.
    """
    return df.hint("merge")


def _sampled_keys(df: DataFrame, on: list[str], sample: float | None) -> tuple[DataFrame | None, int]:
    """The hot keys, and about how many rows have a key. ``df`` is read once."""
    sample = SAMPLE_SHARE if sample is None else sample
    counts = materialise(df.select(*on).dropna().sample(sample, seed=7).groupBy(*on).count(), "key-counts")
    total = counts.agg(F.sum("count")).first()[0]
    if not total:
        return None, 0
    hot = (
        counts.filter(F.col("count") >= max(2, total * HOT_SHARE))
        .select(*on)
        .collect()
    )
    return df.sparkSession.createDataFrame(hot, df.select(*on).schema) if hot else None, round(total / sample)


def hot_keys(df: DataFrame, on: list[str], sample: float | None = None) -> DataFrame | None:
    """Keys holding at least ``HOT_SHARE`` of the sampled rows: at most ``1 / HOT_SHARE`` of them."""
    return _sampled_keys(df, on, sample)[0]


def lookup_join(
    big: DataFrame,
    lookup: DataFrame,
    on: str | list[str],
    how: str = "left",
    limit: int | None = None,
    sample: float | None = None,
) -> DataFrame:
    """Equi-join of ``big`` with ``lookup``; ``how`` is left, inner, left_semi or left_anti.

    Beyond the limit ``big`` is read twice, for its hot and its other rows, so it should be cheap to
    read there. A hot key whose own lookup rows exceed the limit is left to the skew handling of
    adaptive execution.
    """
    keys = [on] if isinstance(on, str) else list(on)
    limit = BROADCAST_BYTES if limit is None else limit
    if measured_bytes(lookup) <= limit:
        return big.join(F.broadcast(lookup), keys, how)

    no_key = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    hot, rows = _sampled_keys(big, keys, sample)

    def joined(side: DataFrame) -> DataFrame:
        tasks = rows // TASK_ROWS
        if tasks <= int(big.sparkSession.conf.get("spark.sql.shuffle.partitions")):
            return side.join(shuffled(lookup), keys, how)
        return side.repartition(tasks, *keys).join(shuffled(lookup.repartition(tasks, *keys)), keys, how)

    hot_rows = None if hot is None else lookup.join(F.broadcast(hot), keys, "left_semi")
    if hot_rows is not None and measured_bytes(hot_rows) <= limit:
        # Rows without a key match nothing, so they stay with the rows that are not shuffled.
        marked = big.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left")
        stays = F.coalesce("_hot", no_key)
        parts = [
            joined(marked.filter(~stays).drop("_hot")),
            marked.filter(stays).drop("_hot").join(F.broadcast(hot_rows), keys, how),
        ]
    else:
        parts = [joined(big.filter(~no_key))]
        if how in ("left", "left_anti"):
            parts.append(big.filter(no_key))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).select(*parts[0].columns)


def null_safe_join(
    left: DataFrame, right: DataFrame, keys: list[str], how: str = "left", lookup: bool = False
) -> DataFrame:
    """Join where NULL keys match each other; keeps one copy of every key.

    ``lookup`` says that many rows of ``left`` share a key: ``right`` is then measured and broadcast
    where its size allows, so that no task receives all rows of a key.
    """
    if lookup and measured_bytes(right) <= BROADCAST_BYTES:
        right = F.broadcast(right)
    tagged = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    match = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys])
    joined = left.join(tagged, match, how)
    kept = [F.coalesce(k, f"_r_{k}").alias(k) if how in ("full", "right") else F.col(k) for k in keys]
    rest = [c for c in left.columns if c not in keys] + [c for c in right.columns if c not in keys]
    return joined.select(*kept, *rest)
