"""Streams that are run until their input is used up; results equal the batch's."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelane.plans.registry import register
from quirelane.plans.sqlparts import LINES
from quirelane.session import shared_folder, spread, table
from quirelane.sources import virtual_pages
from quirelane.streaming import frames


def _stream(spark, sf_dir, name):
    """A stream over one table of a folder."""
    schema = table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{sf_dir}/{name}.parquet*")


@register(
    "ndjson_frames",
    f"""WITH {LINES}, p AS (SELECT doc_id, page_index, count(*) AS n FROM lines GROUP BY ALL), d AS (SELECT doc_id, count(*) AS n_pages FROM p GROUP BY doc_id)
    SELECT 'header' AS frame, count(*) AS n, sum(n_pages)::BIGINT AS pages FROM d UNION ALL SELECT 'page', count(*), NULL FROM p UNION ALL SELECT 'footer', count(*), sum(n_pages)::BIGINT FROM d""",
)
def ndjson_frames(spark, sf_dir):
    """Frames are written as NDJSON, read as a stream and counted."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pages = virtual_pages.page_texts(docs, "page_text")
    place, out = shared_folder(spark, "ndjson"), shared_folder(spark, "frames")
    frames.to_frames(pages).select("value").write.text(place)
    frames.run_once(frames.read_frames(spark, place), out, shared_folder(spark, "state"))
    got = spark.read.parquet(out)
    return got.groupBy("frame").agg(F.count("*").alias("n"), F.sum("n_pages").cast("long").alias("pages"))


@register(
    "stream_in_order",
    f"WITH {LINES} SELECT doc_id, count(DISTINCT page_index) AS n, max(page_index) AS last FROM lines GROUP BY doc_id",
)
def stream_in_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pages = virtual_pages.page_texts(docs)
    place, out = shared_folder(spark, "pages"), shared_folder(spark, "ordered")
    pages.repartition("doc_id").sortWithinPartitions(F.desc("page_index")).write.parquet(place)  # each document's last page first
    stream = spark.readStream.schema(pages.schema).parquet(place)
    frames.run_once(frames.in_order(stream), out, shared_folder(spark, "state"))
    got = spark.read.parquet(out)
    return got.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("page_index").alias("last"))


@register(
    "stream_duplicates",
    f"""WITH {LINES}, p AS (SELECT DISTINCT doc_id, page_index FROM lines)
    SELECT doc_id, count(*) AS n_pages, sum((page_index % 3 = 0)::INT + (doc_id % 5 = 0)::INT)::BIGINT AS n_errors,
      count(DISTINCT CASE WHEN page_index % 3 = 0 OR doc_id % 5 = 0 THEN page_index END) AS n_repeated FROM p GROUP BY doc_id""",
)
def stream_duplicates(spark, sf_dir):
    """Every third page comes again in the same batch, and the pages of every fifth document in a later one: all are refused with an error."""
    pages = virtual_pages.page_texts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    place, out, errors, state = (shared_folder(spark, n) for n in ("pages", "ordered", "refused", "state"))
    for again, part in ((F.col("page_index") % 3 == 0, F.lit(True)), (F.lit(False), F.col("doc_id") % 5 == 0)):
        some = pages.where(part)
        some.unionByName(some.where(again)).repartition("doc_id").sortWithinPartitions(F.desc("page_index")).write.mode("append").parquet(place)
        frames.run_split(frames.ordered(spark.readStream.schema(pages.schema).parquet(place)), out, errors, state)
    good = spark.read.parquet(out).groupBy("doc_id").agg(F.count("*").alias("n_pages"))
    bad = spark.read.parquet(errors).where(F.col("error") == F.concat(F.lit(f"{frames.DUPLICATE}: "), "page_index"))
    bad = bad.groupBy("doc_id").agg(F.count("*").alias("n_errors"), F.count_distinct("page_index").alias("n_repeated"))
    return good.join(bad, "doc_id", "left").na.fill(0, ["n_errors", "n_repeated"])


@register(
    "late_events",
    """WITH e AS (SELECT event_type, floor(epoch(ts))::BIGINT AS sec, event_id % 10 = 9 AS second FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL),
    w AS (SELECT *, sec // 3600 * 3600 AS start FROM e), top AS (SELECT event_type, max(sec) FILTER (NOT second) AS first_newest, max(sec) AS newest FROM e GROUP BY event_type),
    j AS (SELECT w.*, newest, coalesce(second AND start + 3600 <= first_newest - 3600, false) AS late FROM w JOIN top USING (event_type))
    SELECT event_type, start, count(*) AS n, late FROM j WHERE late OR start + 3600 <= newest - 3600 GROUP BY ALL""",
)
def late_events(spark, sf_dir):
    """Hourly counts with an hour's patience; every tenth event comes in a second batch, mostly too late, and is reported as such."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    place, out, errors, state = (shared_folder(spark, n) for n in ("events", "windows", "late", "state"))
    for part in (F.col("event_id") % 10 != 9, F.col("event_id") % 10 == 9):
        events.where(part).write.mode("append").parquet(place)
        frames.run_split(frames.closed_windows(spark.readStream.schema(events.schema).parquet(place), "ts", "event_type", 3600, 3600), out, errors, state)
    closed = spark.read.parquet(out).select("event_type", "start", "n", F.lit(False).alias("late"))
    late = spark.read.parquet(errors).groupBy("event_type", "start").agg(F.sum("n").alias("n")).select("event_type", "start", "n", F.lit(True).alias("late"))
    return closed.unionByName(late)


@register("event_windows", "SELECT event_type, sum(1)::BIGINT AS n, count(DISTINCT time_bucket(INTERVAL '1 hour', ts)) AS n_windows FROM events GROUP BY event_type")
def event_windows(spark, sf_dir):
    """Hourly counts of events by a watermarked stream, in complete mode, summed per type."""
    out = shared_folder(spark, "windows")
    events = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    frames.run_complete(frames.windowed_counts(events, "ts", "1 hour", "1000 days", "event_type"), out, shared_folder(spark, "state"))
    return spark.read.parquet(out).groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("n_windows"))


@register("incremental_documents", "SELECT doc_id, length(text) AS n FROM documents")
def incremental_documents(spark, sf_dir):
    """Documents come in two batches that overlap; each is measured once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    place, out, state = (shared_folder(spark, n) for n in ("in", "out", "state"))
    work = lambda df: df.select("doc_id", F.char_length("text").alias("n"))
    for part in ("doc_id % 3 < 2", "doc_id % 3 > 0"):
        docs.where(part).write.mode("append").parquet(place)
        frames.incremental(spark.readStream.schema(docs.schema).parquet(place), out, state, work)
    return spark.read.parquet(out)
