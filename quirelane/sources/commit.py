"""Several outputs written by one job and shown together: all of them, or none.

A data source whose tasks write into a staging folder beside the target. Each task tells the driver which files it has
finished; only if all tasks succeed are the others' leavings removed and the folder renamed to its final name, which is the
one step that shows anything. Where a job fails, the staging folder goes. Renaming a folder is one step on local disks and
HDFS; on object stores it isn't, and readers should wait for the job's end there.
"""

from __future__ import annotations

import posixpath
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quirelane.session import ship

NAME = "quirelane_outputs"
OUTPUT = "output"


@dataclass
class Written(WriterCommitMessage):
    """Files that a task has finished, below the staging folder, and their rows by output."""

    files: list[str] = field(default_factory=list)
    rows: dict[str, int] = field(default_factory=dict)


class OutputsWriter(DataSourceArrowWriter):
    """Rows of each value of ``output`` go to Parquet files of a folder of that name, without that column."""

    def __init__(self, path: str, names: Sequence[str], overwrite: bool) -> None:
        self.path, self.names, self.overwrite = path.rstrip("/"), list(names), overwrite
        self.staging = f"{posixpath.dirname(self.path)}/.{posixpath.basename(self.path)}-{uuid.uuid4().hex}"

    def prepare(self) -> None:
        """Make the staging folders. Tasks only write into them, so one that outlives its job's end brings nothing back."""
        store, top = fs.FileSystem.from_uri(self.staging)
        for name in self.names:  # an output without rows is an empty folder
            store.create_dir(f"{top}/{name}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, done = {}, Written()
        store, top = fs.FileSystem.from_uri(self.staging)
        try:
            for batch in iterator:
                at = batch.schema.get_field_index(OUTPUT)
                for name in pc.unique(batch.column(at)).to_pylist():
                    if name not in self.names:
                        raise ValueError(f"rows of an output {name!r} that was not named")
                    some = batch.filter(pc.equal(batch.column(at), name)).remove_column(at)
                    if name not in files:
                        file = f"{name}/part-{uuid.uuid4().hex}.parquet"
                        files[name] = pq.ParquetWriter(f"{top}/{file}", some.schema, filesystem=store)
                        done.files.append(file)
                    files[name].write_batch(some)
                    done.rows[name] = done.rows.get(name, 0) + some.num_rows
        finally:
            for f in files.values():
                f.close()
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, top = fs.FileSystem.from_uri(self.staging)
        _, target = fs.FileSystem.from_uri(self.path)
        kept = {f for m in messages if m is not None for f in m.files}
        for info in store.get_file_info(fs.FileSelector(top, recursive=True)):
            if info.is_file and posixpath.relpath(info.path, top) not in kept:
                store.delete_file(info.path)  # of a task that was lost or run twice
        there = store.get_file_info(target).type != fs.FileType.NotFound
        if there and not self.overwrite:
            store.delete_dir(top)
            raise FileExistsError(self.path)
        if there:
            old = f"{top}-old"
            store.move(target, old)
            try:
                store.move(top, target)
            except Exception:
                store.move(old, target)
                raise
            store.delete_dir(old)
        else:
            store.move(top, target)

    def abort(self, messages: list[Written | None]) -> None:  # noqa: ARG002
        store, top = fs.FileSystem.from_uri(self.staging)
        for turn in range(20):
            if store.get_file_info(top).type == fs.FileType.NotFound:
                return
            try:
                store.delete_dir(top)
            except OSError:  # a task that hasn't heard of the end yet has just made a file
                if turn == 19:
                    raise
                time.sleep(0.1)


class Outputs(DataSource):
    """Options: ``path``, and ``names`` of the outputs, comma-joined."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> OutputsWriter:
        if OUTPUT not in schema.names:
            raise ValueError(f"no column {OUTPUT}")
        made = OutputsWriter(self.options["path"], self.options["names"].split(","), overwrite)
        made.prepare()
        return made


def write_together(outputs: dict[str, DataFrame], path: str, *, overwrite: bool = False) -> None:
    """Write frames of one schema to ``path``/name; readers see all of them at once, or, if one fails, none.

    One job runs them all. An existing folder fails the job unless ``overwrite`` is set; it then stays until all is written.
    """
    if not outputs:
        return
    spark = next(iter(outputs.values())).sparkSession
    ship(spark)
    spark.dataSource.register(Outputs)
    named = [df.withColumn(OUTPUT, F.lit(name)) for name, df in outputs.items()]
    rows = named[0]
    for df in named[1:]:
        rows = rows.unionByName(df)
    place = path if "://" in path or path.startswith("file:") else f"file://{path}"
    rows.write.format(NAME).option("path", place).option("names", ",".join(outputs)).mode("overwrite" if overwrite else "append").save()
