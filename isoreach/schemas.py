"""Schemas are declared, nothing is inferred from the data."""

from __future__ import annotations

from pyspark.sql import types as T

_KINDS = {"string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "long": T.LongType()}


def schema(text: str) -> T.StructType:
    """``"name kind, name kind"`` as a schema of nullable columns."""
    fields = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in fields])
