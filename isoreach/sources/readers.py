"""Readers for delimited text, directories of files and tagged features."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isoreach.operators.joins import lookup_join

_TEXT_RULES = {"nullValue": "NA", "ignoreLeadingWhiteSpace": True, "ignoreTrailingWhiteSpace": True}


def _empty_as_null(df: DataFrame) -> DataFrame:
    """A quoted empty cell is missing too."""
    text = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in text})


def _by_name(
    spark: SparkSession, path: str | list[str], schema: T.StructType, absent: bool = False, rules: dict | None = None
) -> DataFrame:
    """The columns of ``schema`` by their names in the header, with the path of their file.

    Files may have other columns too and any order. All files of one call share a header; one that differs is an error
    while reading. A column that the header lacks is an error, or with ``absent`` NULL.
    """
    rules = _TEXT_RULES if rules is None else rules
    header = spark.read.csv(path, header=True, **rules).columns
    missing = [n for n in schema.names if n not in header]
    if missing and not absent:
        raise ValueError(f"{path} has no column {', '.join(missing)}; its header is {header}")
    typed = T.StructType([schema[n] if n in schema.names else T.StructField(n, T.StringType()) for n in header])
    df = spark.read.csv(path, schema=typed, header=True, enforceSchema=False, **rules)
    wanted = [F.lit(None).cast(f.dataType).alias(f.name) if f.name in missing else F.col(f"`{f.name}`") for f in schema.fields]
    return df.select(*wanted, F.col("_metadata.file_path").alias("file_path"))


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """Delimited text with a header; columns by name. Cells are trimmed; ``NA`` and empty cells are NULL."""
    return _empty_as_null(_by_name(spark, path, schema).select(*schema.names))


def read_headerless(spark: SparkSession, path: str, width: int) -> DataFrame:
    """Delimited text without a header: text columns ``X1`` to ``Xn``."""
    schema = T.StructType([T.StructField(f"X{i}", T.StringType()) for i in range(1, width + 1)])
    return _empty_as_null(spark.read.csv(path, schema=schema, header=False, **_TEXT_RULES))


def read_keeping_blanks(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """As ``read_csv``, but an empty text cell stays an empty text; empty numbers are NULL.

    Written text loses the difference between nothing and an empty text, so every missing text
    cell reads as empty here, as the fast reader does.
    """
    df = _by_name(spark, path, schema).select(*schema.names)
    text = [f.name for f in schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.coalesce(c, F.lit("")) for c in text})


def read_after_preamble(
    spark: SparkSession, path: str, skip: int, schema: T.StructType, required: str | None = None
) -> DataFrame:
    """Delimited text whose header follows ``skip`` other lines and whose end may hold notes.

    The preamble and the header are the first lines of the first block of each file; a line
    number inside that block tells them apart. ``required`` names a column that is filled in every
    data row, which removes footer lines.
    """
    lines = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )
    starts = lines.filter(F.col("_block") == 0).groupBy("_file").agg(F.min("_line").alias("_start"))
    starts = starts.withColumnRenamed("_file", "_f")
    # One row per file; left to the optimiser, since nothing bounds the number of files.
    numbered = lines.join(starts, F.col("_file") == F.col("_f"))
    body = numbered.filter((F.col("_block") > 0) | (F.col("_line") - F.col("_start") > skip))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    options = {"nullValue": "NA", "mode": "PERMISSIVE", "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}
    parsed = body.filter(F.trim("value") != "").select(F.from_csv("value", ddl, options).alias("r"))
    rows = parsed.select("r.*")
    return rows.filter(F.col(required).isNotNull()) if required else rows


def read_tree(spark: SparkSession, path: str, pattern: str, schema: T.StructType, absent: bool = False) -> DataFrame:
    """All delimited files under ``path`` whose name fits the glob, with the file they came from.

    Columns are taken by name, so files of different services may have different columns in different orders. The files
    of one folder share a header; each folder's header is read once. With ``absent``, a column that a folder's files lack
    is NULL there; otherwise it is an error.
    """
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(path).inputFiles()
    folders: dict[str, list[str]] = {}
    for name in sorted(found):
        folders.setdefault(name.rsplit("/", 1)[0], []).append(name)
    if not folders:
        empty = T.StructType([*schema.fields, T.StructField("file_path", T.StringType())])
        return spark.createDataFrame([], empty)
    frames = [_by_name(spark, files, schema, absent) for files in folders.values()]
    return reduce(DataFrame.unionByName, frames)


def read_directory(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A directory as one dataset; partition folders become columns."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def files_matching(df: DataFrame, pattern: str, invert: bool = False) -> DataFrame:
    """Rows whose ``file_path`` fits the pattern, or does not."""
    test = F.col("file_path").rlike(pattern)
    return df.filter(~test if invert else test)


def select_features(tags: Column, key: str, values: str | Sequence[str]) -> Column:
    """Whether the tag ``key`` has one of ``values``; a feature without the tag has not."""
    wanted = [values] if isinstance(values, str) else list(values)
    return F.coalesce(F.try_element_at(tags, F.lit(key)).isin(wanted), F.lit(False))


def as_of(df: DataFrame, key: str, ts: str, instant: str, tie: str) -> DataFrame:
    """Latest version of every feature not after ``instant``."""
    rest = [c for c in df.columns if c != key]
    return (
        df.filter(F.col(ts) <= F.lit(instant).cast("timestamp"))
        .groupBy(key)
        .agg(F.max_by(F.struct(*rest), F.struct(F.col(ts), F.col(tie))).alias("_v"))
        .select(key, "_v.*")
    )


def valid_times(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Every version with ``valid_from`` and ``valid_to`` (NULL for the last): the time in which it was the latest."""
    versions = Window.partitionBy(key).orderBy(ts, tie)
    return df.withColumns({"valid_from": F.col(ts), "valid_to": F.lead(ts).over(versions)})


def as_of_many(df: DataFrame, key: str, ts: str, instants: DataFrame, tie: str) -> DataFrame:
    """The latest version of every feature at each of many instants (column ``instant``), in one pass.

    Versions are valid for a stretch of time. Time is cut into as many buckets as there are instants; a version is listed
    in the buckets its stretch meets between the first and the last instant, and meets the instants of those buckets.
    """
    known = instants.select(F.col("instant").cast("timestamp").alias("instant")).dropna().distinct()
    seconds = lambda t: F.col(t).cast("double")
    span = known.agg(F.count("*").alias("n"), F.min(seconds("instant")).alias("first"), F.max(seconds("instant")).alias("last")).first()
    valid = valid_times(df.withColumn(ts, F.col(ts).cast("timestamp")), key, ts, tie)
    if not span["n"]:
        return valid.drop("valid_from", "valid_to").withColumn("instant", F.lit(None).cast("timestamp")).limit(0)
    width = max((span["last"] - span["first"]) / span["n"], 1e-6)
    bucket = lambda t: F.floor((t - span["first"]) / width)
    low = F.greatest(seconds("valid_from"), F.lit(span["first"]))
    high = F.least(F.coalesce(seconds("valid_to"), F.lit(span["last"])), F.lit(span["last"]))
    listed = valid.filter(low <= high).withColumn("bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    met = lookup_join(listed, known.withColumn("bucket", bucket(seconds("instant"))), "bucket", "inner")
    now = (F.col("valid_from") <= F.col("instant")) & F.coalesce(F.col("instant") < F.col("valid_to"), F.lit(True))
    return met.filter(now).select("instant", *df.columns)
