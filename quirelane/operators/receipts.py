"""Fingerprints, receipts and the result cache."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelane.functions import scalars
from quirelane.functions.geometry import Box
from quirelane.operators import trees


#: Height of the bands of a page in which receipts meet spans.
BAND = 24.0


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), "\\s+", " ")


def canonical_number(x: Column) -> Column:
    """Four decimals as a whole number."""
    return F.round(x * 10000).cast("long")


def page_hashes(pages: DataFrame) -> DataFrame:
    """Hashes of each page's words and of its box, from rows (doc_id, page_index, text, x0..y1)."""
    box = F.concat_ws(",", *(canonical_number(F.col(c)).cast("string") for c in ("x0", "y0", "x1", "y1")))
    return pages.select("doc_id", "page_index", F.sha2(normalised(F.col("text")), 256).alias("content_hash"), F.sha2(box, 256).alias("geometry_hash"))


def fingerprints(hashes: DataFrame, key: str = "doc_id") -> DataFrame:
    """SHA-256 over a document's page count and its pages' hashes in order."""
    rows = F.array_sort(F.collect_list(F.struct("page_index", "content_hash", "geometry_hash")))
    body = F.array_join(F.transform(rows, lambda r: F.concat(r["content_hash"], r["geometry_hash"])), "")
    return hashes.groupBy(key).agg(F.sha2(F.concat(F.count("*").cast("string"), F.lit(":"), body), 256).alias("fingerprint"))


#: Leads every document fingerprint, and changes when its rule does.
FINGERPRINT_VERSION = "quirelane-v1"
#: Bits of the catalog's flags, in order.
FLAGS = ("is_encrypted", "contains_javascript", "contains_xfa", "has_layers")
_UNTAGGED = "0" * 64


def resource_hashes(resources: DataFrame, key: str = "doc_id") -> DataFrame:
    """A hash per page of its resolved resources (key, page_index, category, name, body): by category, and by name within it."""
    entry = F.struct("category", "name", F.sha2("body", 256).alias("h"))
    rows = F.array_sort(F.collect_list(entry))  # of one page
    text = F.array_join(F.transform(rows, lambda r: F.concat(r["category"], F.lit("/"), r["name"], F.lit("="), r["h"])), ";")
    return resources.groupBy(key, "page_index").agg(F.sha2(text, 256).alias("resource_hash"))


def geometry_hash(media: Sequence[Column], crop: Sequence[Column], rotate: Column) -> Column:
    """Of a page's media box, its crop box where it has one (null numbers: none), and its rotation."""
    number = lambda c: canonical_number(c).cast("string")
    return F.sha2(F.concat_ws(",", *map(number, media), F.lit("crop"), *map(number, crop), F.lit("rotate"), F.coalesce(rotate, F.lit(0)).cast("string")), 256)


def document_fingerprints(pages: DataFrame, structure: DataFrame, catalog: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint): a tree of hashes over all that shows in a document, whatever wrote its file.

    ``pages``: (key, page_index, content_hash, resource_hash, geometry_hash); ``structure``: (key, hash) of the structure
    tree's root, for tagged documents; ``catalog``: (key and the ``FLAGS``). Pages are hashed one by one, then in blocks,
    so a page that changes is found by its own hash. A document without structure has zeros there, without flags a 0.
    """
    page = F.sha2(F.concat("content_hash", F.coalesce("resource_hash", F.lit(_UNTAGGED)), "geometry_hash"), 256)
    rows = pages.select(key, "page_index", page.alias("page_hash"))
    number = rows.groupBy(key).agg(F.count("*").cast("string").alias("n_pages"))
    joined = trees._joined(rows, [key], "page_index", "page_hash")
    byte = sum((F.coalesce(F.col(f).cast("int"), F.lit(0)) * (1 << i) for i, f in enumerate(FLAGS)), F.lit(0))
    flags = catalog.select(key, byte.cast("string").alias("flags"))
    all_of = number.join(joined, key).join(structure.select(key, F.col("hash").alias("tree")), key, "left").join(flags, key, "left")
    text = F.concat_ws("|", "n_pages", "page_hash", F.coalesce("tree", F.lit(_UNTAGGED)), F.coalesce("flags", F.lit("0")))
    return all_of.select(key, F.concat(F.lit(f"{FINGERPRINT_VERSION}:"), F.sha2(text, 256)).alias("fingerprint"))


def create(spans: DataFrame, prints: DataFrame, version: str = "1.0", key: str = "doc_id") -> DataFrame:
    """A receipt per span: fingerprint, page, box, hash of the text and version."""
    return spans.join(prints, key).select(
        key, "fingerprint", "page_index", "x0", "y0", "x1", "y1", F.sha2(F.col("text"), 256).alias("content_hash"), F.lit(version).alias("version")
    )


def verify(receipts: DataFrame, prints: DataFrame, spans: DataFrame, key: str = "doc_id", least: float = 0.9) -> DataFrame:
    """Adds code: 0 verified, 10 other document, 11 no span in its place, 12 other text.

    A receipt meets the spans of its page that touch the band of its centre, which a span with an overlap of ``least``
    (over one half) holds; the best overlap decides.
    """
    assert least >= 0.5
    band = lambda c: F.floor(c / BAND).cast("long")
    # a receipt is told by all that it says: hashes of it would meet by chance among very many
    names = [key, "page_index", "x0", "y0", "x1", "y1", "content_hash"]
    r = receipts.withColumn("__id", F.struct(*names))
    s = spans.select(F.col(key).alias("s_key"), F.col("page_index").alias("s_page"), F.col("text").alias("s_text"), *(F.col(c).alias(f"s_{c}") for c in ("x0", "y0", "x1", "y1")))
    s = s.withColumn("s_band", F.explode(F.sequence(band(F.col("s_y0")), band(F.col("s_y1")))))
    iou = Box.of().iou(Box.of("s_"))
    here = (F.col(key) == F.col("s_key")) & (F.col("page_index") == F.col("s_page")) & (band((F.col("y0") + F.col("y1")) / 2) == F.col("s_band"))
    j = r.join(s, here & (iou >= least), "left")
    best = j.groupBy("__id").agg(F.max_by(F.sha2("s_text", 256), F.struct(iou, "s_text")).alias("__found"))
    p = prints.select(F.col(key).alias("p_key"), F.col("fingerprint").alias("__now"))
    out = r.join(best, "__id", "left").join(p, F.col(key) == F.col("p_key"), "left")
    code = F.when(~F.col("fingerprint").eqNullSafe(F.col("__now")), 10).when(F.col("__found").isNull(), 11).when(F.col("__found") != F.col("content_hash"), 12).otherwise(0)
    return out.withColumn("code", code).select(*receipts.columns, "code")


def version_accepted(made: Column, running: Column) -> Column:
    return scalars.version_compatible(made, running)


def cache_key(fingerprint: Column, options: Mapping) -> Column:
    """SHA-256 of the fingerprint and of all options, as JSON with sorted keys."""
    return F.sha2(F.concat(fingerprint, F.lit(":" + json.dumps(dict(options), sort_keys=True, separators=(",", ":")))), 256)


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no white space, numbers in their shortest form; null for what isn't JSON."""
    return F.to_json(F.try_parse_json(text))


def read_through(requests: DataFrame, cache: DataFrame, compute, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(results, rows to add): requests that the cache holds are read there, the others are computed."""
    missing = requests.join(cache.select(key), key, "left_anti")
    made = compute(missing)
    held = requests.select(key).join(cache, key)
    return held.withColumn("status", F.lit("hit")).unionByName(made.withColumn("status", F.lit("miss")), allowMissingColumns=True), made


def evictions(entries: DataFrame, limit: int, keep: float = 0.8, most: int = 1000) -> DataFrame:
    """Entries to delete, oldest touched first, until ``keep`` of the limit is left; at most ``most`` at a time.

    Sizes are summed by day first, so the running sum orders days, not entries, and only the last day is cut within.
    """
    day = F.to_date("last_touch")
    per_day = entries.groupBy(day.alias("__day")).agg(F.sum("bytes").alias("__bytes"))
    total = per_day.agg(F.sum("__bytes")).first()[0] or 0
    if total <= limit:
        return entries.limit(0)
    excess = total - int(limit * keep)
    before = F.sum("__bytes").over(Window.orderBy("__day").rowsBetween(Window.unboundedPreceding, -1))
    days = per_day.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") < excess)
    e = entries.withColumn("__day", day).join(days, "__day")
    within = F.sum("bytes").over(Window.partitionBy("__day").orderBy("last_touch", "cache_key").rowsBetween(Window.unboundedPreceding, -1))
    gone = e.where("true").withColumn("__run", F.col("__before") + F.coalesce(within, F.lit(0))).where(F.col("__run") < excess)
    return gone.orderBy("last_touch", "cache_key").limit(most).select(*entries.columns)


def age_bucket(seconds: Column) -> Column:
    return F.when(seconds < 3600, "<1h").when(seconds < 86400, "<1d").when(seconds < 7 * 86400, "<7d").when(seconds < 30 * 86400, "<30d").otherwise("older")


def cache_stats(entries: DataFrame, now: Column, keys: Sequence[str] = ()) -> DataFrame:
    age = F.unix_timestamp(now) - F.unix_timestamp("last_touch")
    e = entries.withColumn("__b", age_bucket(age))
    return e.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.sum("bytes").alias("bytes"),
        F.min("last_touch").alias("oldest"),
        F.max("last_touch").alias("newest"),
        *(F.count_if(F.col("__b") == b).alias(n) for b, n in (("<1h", "n_1h"), ("<1d", "n_1d"), ("<7d", "n_7d"), ("<30d", "n_30d"), ("older", "n_older"))),
    )


def purge(entries: DataFrame, now: Column, older_than_seconds: int) -> DataFrame:
    return entries.where(F.unix_timestamp(now) - F.unix_timestamp("last_touch") <= older_than_seconds)
