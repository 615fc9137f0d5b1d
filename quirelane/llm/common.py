"""Arrow helpers shared by the operators of this subpackage."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.types import StructField, StructType, _parse_datatype_string


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 of every value of a string column, without decoding it."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    if pa.types.is_string(column.type):
        return column.cast(pa.binary()).to_pylist()
    return column.to_pylist()


def extended(schema: StructType, more: str) -> StructType:
    """A new schema with the fields of a DDL string added; the given one, which a DataFrame may share, stays."""
    added = _parse_datatype_string(more)
    return StructType([StructField(f.name, f.dataType) for f in [*schema.fields, *added.fields]])


def remove(spark: SparkSession, place: str) -> None:
    """Remove a folder that Spark can open."""
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
