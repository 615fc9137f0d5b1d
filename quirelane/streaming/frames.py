"""Streams of document frames: NDJSON frames, pages in order, and incremental work."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle

FRAME = "frame string, doc_id long, page_index int, n_pages int, text string"
#: Errors of refused rows.
DUPLICATE, LATE = "Duplicate page index", "Late event"


def to_frames(pages: DataFrame, key: str = "doc_id", text: str = "page_text") -> DataFrame:
    """(doc_id, ordinal, value): a header, the pages in order and a footer for each document, one JSON text each."""
    page = pages.select(
        key,
        (F.col("page_index") + 1).alias("ordinal"),
        F.to_json(F.struct(F.lit("page").alias("frame"), F.col(key), "page_index", F.col(text).alias("text"))).alias("value"),
    )
    n = pages.groupBy(key).agg(F.count("*").cast("int").alias("n_pages"), F.max("page_index").alias("last"))
    head = n.select(key, F.lit(0).alias("ordinal"), F.to_json(F.struct(F.lit("header").alias("frame"), F.col(key), "n_pages")).alias("value"))
    foot = n.select(key, (F.col("last") + 2).alias("ordinal"), F.to_json(F.struct(F.lit("footer").alias("frame"), F.col(key), "n_pages")).alias("value"))
    return head.unionByName(page).unionByName(foot)


def parse_frames(lines: DataFrame) -> DataFrame:
    """Frames of a column ``value``, batch or stream; lines that are no JSON have a null frame."""
    return lines.select(F.from_json("value", FRAME).alias("f")).select("f.*")


def read_frames(spark: SparkSession, path: str) -> DataFrame:
    """A stream of the frames of all NDJSON files of a folder."""
    return parse_frames(spark.readStream.text(path))


class _PageBuffer(StatefulProcessor):
    """The pages of one document: passed on in order, held back while an earlier one is missing, refused when they repeat.

    State: the next page and how many wait, and one entry a waiting page, so a batch touches the pages that it brings or
    frees and no others. What waits is keyed by page, hence a document of any length is never rewritten.
    """

    def __init__(self, key: str, most: int | None) -> None:
        self.key, self.most = key, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "next int, waiting int")
        self.waiting = handle.getMapState("waiting", "page_index int", "text string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802, ARG002
        nxt, held = self.place.get() if self.place.exists() else (0, 0)
        fresh: dict[int, str | None] = {}
        out: list[tuple] = []
        for pdf in rows:
            for p, text in zip(pdf["page_index"].tolist(), pdf["text"].tolist(), strict=True):
                if p < nxt or p in fresh or held and self.waiting.containsKey((p,)):
                    out.append((key[0], p, text, f"{DUPLICATE}: {p}"))
                else:
                    fresh[p] = text
        while True:
            if nxt in fresh:
                text = fresh.pop(nxt)
            elif held and self.waiting.containsKey((nxt,)):
                text = self.waiting.getValue((nxt,))[0]
                self.waiting.removeKey((nxt,))
                held -= 1
            else:
                break
            out.append((key[0], nxt, text, None))
            nxt += 1
        for p, text in fresh.items():
            self.waiting.updateValue((p,), (text,))
        held += len(fresh)
        if self.most is not None and held > self.most:
            raise BufferError(f"{held} pages of {key[0]} wait for page {nxt}, over {self.most}")
        self.place.update((nxt, held))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "page_index", "text", "error"])

    def close(self) -> None:
        pass


def ordered(pages: DataFrame, key: str = "doc_id", most: int | None = None) -> DataFrame:
    """(key, page_index, text, error) of a stream of pages: the pages in order per document, and an error row per refused page.

    Pages wait in the state until those before them came; none is lost. A page that waits or was passed on already is
    refused, with the error ``Duplicate page index: n`` and its own text. If ``most`` is given and more pages of one
    document wait, the stream fails, and its source has to hold back or send the missing page before it is started again.
    """
    schema = f"{key} {dict(pages.dtypes)[key]}, page_index int, text string, error string"
    return pages.select(key, "page_index", "text").groupBy(key).transformWithStateInPandas(_PageBuffer(key, most), schema, "Append", "None")


def in_order(pages: DataFrame, key: str = "doc_id", most: int | None = None) -> DataFrame:
    """The pages that ``ordered`` passes on, without the refused ones."""
    return ordered(pages, key, most).where(F.col("error").isNull()).drop("error")


class _LateWindows(StatefulProcessor):
    """Counts of one key's events in windows of ``width`` seconds, each given out once its time has passed.

    A window's time has passed when the key's newest event is ``patience`` seconds beyond its end. Events of such windows
    are late: they are counted apart, with an error, as the window's count stands already.
    """

    def __init__(self, key: str, width: int, patience: int) -> None:
        self.key, self.width, self.patience = key, width, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.newest = handle.getValueState("newest", "at long")
        self.open = handle.getMapState("open", "start long", "n long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:  # noqa: N802, ARG002
        limit = self.newest.get()[0] - self.patience if self.newest.exists() else None
        newest, fresh, out = None, Counter(), []
        for pdf in rows:
            at = pdf["at"].to_numpy(np.int64)
            newest = max(int(at.max()), newest) if newest is not None else int(at.max())
            starts, n = np.unique(at // self.width * self.width, return_counts=True)
            fresh.update(dict(zip(starts.tolist(), n.tolist(), strict=True)))
        for start, n in sorted(fresh.items()):
            if limit is not None and start + self.width <= limit:
                out.append((key[0], start, n, LATE))
            else:
                before = self.open.getValue((start,))[0] if self.open.containsKey((start,)) else 0
                self.open.updateValue((start,), (before + n,))
        if newest is not None:
            newest = max(newest, limit + self.patience) if limit is not None else newest
            self.newest.update((newest,))
            for (start,) in sorted(self.open.keys()):
                if start + self.width <= newest - self.patience:
                    out.append((key[0], start, self.open.getValue((start,))[0], None))
                    self.open.removeKey((start,))
        if out:
            yield pd.DataFrame(out, columns=[self.key, "start", "n", "error"])

    def close(self) -> None:
        pass


def closed_windows(events: DataFrame, time: str, key: str, width: int, patience: int) -> DataFrame:
    """(key, start, n, error) of a stream: the count of each window that has closed, in seconds since 1970, and late events.

    Unlike a watermarked aggregation, which drops late rows without a word, this returns them. Null times and keys are left out.
    """
    rows = events.where(F.col(time).isNotNull() & F.col(key).isNotNull()).select(key, F.col(time).cast("timestamp").cast("long").alias("at"))
    schema = f"{key} {dict(rows.dtypes)[key]}, start long, n long, error string"
    return rows.groupBy(key).transformWithStateInPandas(_LateWindows(key, width, patience), schema, "Append", "None")


def windowed_counts(events: DataFrame, time: str, width: str, late: str, *keys: str) -> DataFrame:
    """Events per window of ``width`` and key; later than ``late`` behind the newest they are dropped."""
    w = F.window(F.col(time), width)
    return events.withWatermark(time, late).groupBy(w, *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def _start(writer: DataStreamWriter, spark: SparkSession) -> None:
    """Run a stream over what there is now. Keyed state with entries of its own needs the RocksDB store; it outgrows memory."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = writer.trigger(availableNow=True).start()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    query.awaitTermination()


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what there is now into a Parquet table, and stop; a later call goes on from the checkpoint."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode)
    _start(writer, stream.sparkSession)


def run_split(stream: DataFrame, path: str, errors: str, checkpoint: str) -> None:
    """Process what there is now into two Parquet tables: rows without an error, and refused rows with theirs.

    Both hold one folder a batch, written over when a batch is repeated after a failure, so no row comes twice.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        df.where(F.col("error").isNull()).drop("error").write.mode("overwrite").parquet(f"{path}/batch={number}")
        df.where(F.col("error").isNotNull()).write.mode("overwrite").parquet(f"{errors}/batch={number}")
        df.unpersist()

    _start(stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint), stream.sparkSession)


def run_complete(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what there is now and leave the whole result of an aggregation as a Parquet table."""
    put = lambda df, number: df.write.mode("overwrite").parquet(path)
    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start().awaitTermination()


def incremental(stream: DataFrame, results: str, checkpoint: str, work: Callable[[DataFrame], DataFrame], key: str = "doc_id") -> None:
    """Apply ``work`` to rows whose key the results lack, batch by batch; a repeated batch adds nothing twice."""

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        place = spark._jvm.org.apache.hadoop.fs.Path(results)
        fresh = df.dropDuplicates([key])
        if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):  # not before the first batch has ended
            fresh = fresh.join(spark.read.parquet(results).select(key), key, "left_anti")
        work(fresh).write.mode("append").parquet(results)

    q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def progress(column: Column) -> Column:
    """Kind of a progress event's JSON text."""
    return F.get_json_object(column, "$.event")
