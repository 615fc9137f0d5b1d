"""PDF files as DataFrames, one table at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from quirelane.session import ship
from quirelane.sources.pdf.tables import SCHEMAS

BATCH_ROWS = 4096


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of all files below ``path`` whose names end in .pdf, in any case."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]")
    return reader.load(path).select("path", "content")


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (path, content) of the .pdf files that come into a folder."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return reader.option("pathGlobFilter", "*.[pP][dD][fF]").load(path).select("path", "content")


def table(contents: DataFrame, name: str, *, password: str = "", path: str = "path", content: str = "content") -> DataFrame:
    """Rows of one table of every file. A file that can't be read gives no rows but diagnostics.

    Each file is parsed in one task; rows leave in bounded batches, a page at a time.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    ship(contents.sparkSession)
    own = _parse_datatype_string(SCHEMAS[name])
    schema = StructType([StructField("path", contents.schema[path].dataType), *own.fields])
    arrow = to_arrow_schema(own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quirelane.sources.pdf.tables import File

        for b in batches:
            for i in range(b.num_rows):
                data = b.column(1)[i].as_py()
                rows: list[tuple] = []

                def out(rows: list[tuple], key=b.column(0).slice(i, 1)) -> pa.RecordBatch:
                    columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), arrow.types, strict=True)]
                    return pa.RecordBatch.from_arrays([key.take(pa.array([0] * len(rows))), *columns], names=schema.names)

                try:
                    for row in File(data or b"", password.encode()).rows(name):
                        rows.append(row)
                        if len(rows) >= BATCH_ROWS:
                            yield out(rows)
                            rows = []
                except (ArithmeticError, AttributeError, LookupError, RecursionError, TypeError, ValueError) as error:
                    # what the parser doesn't foresee in one file must not end a job over very many
                    if name == "diagnostics":
                        rows.append(("unreadable", f"{type(error).__name__}: {error}", None))
                if rows:
                    yield out(rows)

    # few files to a batch: their contents are large
    return contents.select(F.col(path).alias("path"), F.col(content).alias("content")).mapInArrow(run, schema)


def read_pdf(spark: SparkSession, path: str, name: str = "glyphs", *, password: str = "") -> DataFrame:
    return table(files(spark, path), name, password=password)
