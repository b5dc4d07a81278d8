"""Tables of slices that change as a whole: a reader sees one version, entirely old or entirely new.

``root/data`` holds immutable Parquet folders, one for each slice of each write. ``root/manifest/version=n`` holds one
small file that names the folder of every slice of version n. Writing first stores the new folders and then the manifest,
in one file; a writer that stops before leaves folders that no manifest names, which readers never see and ``expire``
removes. Two writers that start from one version both try to store the next: the second one fails.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from isoreach.session import folder_names, remove_folder

MANIFEST = "slice string, folder string"


def versions(spark: SparkSession, root: str) -> list[int]:
    """The versions that are complete, ascending."""
    return sorted(int(name.split("=")[1]) for name in folder_names(spark, f"{root}/manifest") if name.startswith("version="))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> dict[str, str]:
    """Folder of each slice, of the latest version or a given one."""
    known = versions(spark, root)
    if not known or version is not None and version not in known:
        raise ValueError(f"{root} has no version {version if version is not None else ''}; it has {known}")
    rows = spark.read.schema(MANIFEST).parquet(f"{root}/manifest/version={known[-1] if version is None else version}").collect()
    return {r["slice"]: r["folder"] for r in rows}


def _store(df: DataFrame, root: str, name: str) -> str:
    folder = f"data/{name}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{folder}")
    return folder


def write(slices: dict[str, DataFrame], root: str, replace: bool = False) -> int:
    """Stores the slices as the next version and returns its number.

    Slices of the version before that are not named stay as they are, unless ``replace``. One row a slice reaches the driver.
    """
    if not slices:
        raise ValueError("a version needs at least one slice to be written")
    spark = next(iter(slices.values())).sparkSession
    known = versions(spark, root)
    kept = manifest(spark, root) if known and not replace else {}
    named = kept | {name: _store(df, root, name) for name, df in slices.items()}
    version = (known[-1] if known else 0) + 1
    listed = spark.createDataFrame(sorted(named.items()), MANIFEST).coalesce(1)
    try:
        listed.write.mode("errorifexists").parquet(f"{root}/manifest/version={version}")
    except AnalysisException as taken:
        raise RuntimeError(f"another writer has stored version {version} of {root}") from taken
    return version


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """All slices of the latest version, or of a given one, with the slice's name in ``slice``."""
    named = manifest(spark, root, version)
    df = spark.read.parquet(*[f"{root}/{folder}" for folder in named.values()])
    by_folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    names = F.create_map(*[F.lit(x) for name, folder in named.items() for x in (folder.rsplit("/", 1)[1], name)])
    return df.select("*", names[by_folder].alias("slice"))


def expire(spark: SparkSession, root: str, keep: int = 1) -> list[str]:
    """Removes all but the last ``keep`` versions and the folders that only they, or no version, name.

    Only for when no writer is at work: a folder whose manifest is still to come would go as well.
    """
    known = versions(spark, root)
    named = {folder for v in known[-keep:] for folder in manifest(spark, root, v).values()}
    for v in known[:-keep]:
        remove_folder(spark, f"{root}/manifest/version={v}")
    gone = [f"data/{name}" for name in folder_names(spark, f"{root}/data") if f"data/{name}" not in named]
    for folder in gone:
        remove_folder(spark, f"{root}/{folder}")
    return sorted(gone)
