"""Writers and the inventory of a result tree."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from isoreach.functions.naming import access_name, nearest_name, pct_name
from isoreach.functions.text import fixed_point
from isoreach.session import scratch_path


def plain_numbers(df: DataFrame, digits: int = 12) -> DataFrame:
    """Floating numbers as text without an exponent, for delimited output only."""
    floats = (T.DoubleType, T.FloatType)
    return df.select(
        [fixed_point(f.name, digits).alias(f.name) if isinstance(f.dataType, floats) else F.col(f.name) for f in df.schema.fields]
    )


def write_csv(df: DataFrame, path: str, digits: int = 12) -> None:
    plain_numbers(df, digits).write.option("header", True).option("nullValue", "NA").option("emptyValue", "").csv(path)


def write_snapshot(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_matrix(df: DataFrame, path: str, files: int) -> None:
    """Travel matrix in the layout the measures read best.

    Slices are folders. Inside them rows are ordered by origin, then destination, and cut into
    ranges of equal size: one origin's rows lie together, so partial aggregation shrinks them at
    once, yet an origin with very many rows still spans several files.
    """
    order = ["mode", "time_of_day", "from_id", "to_id"]
    (
        df.repartitionByRange(files, *order)
        .sortWithinPartitions(*order)
        .write.partitionBy("mode", "time_of_day")
        .parquet(path)
    )


def write_long_measures(long: DataFrame, path: str, rows_per_file: int = 5_000_000) -> None:
    """Long measures in one folder per service and mode.

    Rows are first cut into ranges of equal size by service, mode and zone. A folder then gets as
    many files as it has ranges, instead of one from every task, and a folder that holds most of the
    rows is written by many tasks. ``long`` should be a stored table, since it is also counted.
    """
    files = max(1, -(-long.count() // rows_per_file))
    long.repartitionByRange(files, "service", "mode", "geo_code").write.partitionBy("service", "mode").parquet(path)


def _by_mode(access: DataFrame) -> DataFrame:
    """The table stored with a folder per mode, cut into equal ranges of zones."""
    path = scratch_path(access.sparkSession, "access-by-mode")
    files = int(access.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    access.repartitionByRange(files, "mode", "geo_code").write.partitionBy("mode").parquet(path)
    return access.sparkSession.read.schema(access.schema).parquet(path)


def write_service_tables(access: DataFrame, services: Sequence[str], cuts: Sequence[int], path: str) -> None:
    """Public form: one table per service and mode with that service's columns, empty columns left out.

    The table is stored once by mode; each output then reads its own mode and columns, so all outputs together read it
    once. One aggregate tells which columns hold anything in which mode.
    """
    access = _by_mode(access)
    present = access.groupBy("mode").agg(*[F.count(c).alias(c) for c in access.columns if c != "mode"]).collect()
    for service in services:
        names = [access_name(service, c) for c in cuts] + [pct_name(service, c) for c in cuts] + [nearest_name(service)]
        columns = ["geo_code", "mode", "time_of_day", *[n for n in names if n in access.columns]]
        for row in present:
            kept = [c for c in columns if c == "mode" or row[c] > 0]
            one = access.filter(F.col("mode") == row["mode"]).select(*kept)
            write_csv(one, f"{path}/{service}/access_{service}_{row['mode']}.csv")


def inventory(spark: SparkSession, root: str, shown_root: str = ".") -> DataFrame:
    """Path, type and size of every file and folder below ``root``. File contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .load(root)
        .select("path", F.col("length").cast("bigint").alias("size"))
    )
    relative = F.substring_index("path", root.rstrip("/") + "/", -1)
    files = files.select(relative.alias("path"), "size")
    parts = F.split("path", "/")
    # Every folder above a file; paths are short, so these arrays are too.
    depths = F.sequence(F.lit(1), F.size("parts") - 1)
    folders = (
        files.select(parts.alias("parts"))
        .filter(F.size("parts") > 1)
        .select(F.explode(F.transform(depths, lambda d: F.array_join(F.slice("parts", F.lit(1), d), "/"))).alias("path"))
        .distinct()
    )
    listed = files.select("path", F.lit("file").alias("type"), "size").unionByName(
        folders.select("path", F.lit("directory").alias("type"), F.lit(0).cast("bigint").alias("size"))
    )
    return listed.select(F.concat(F.lit(shown_root + "/"), "path").alias("path"), "type", "size")
