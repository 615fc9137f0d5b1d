"""Queries of single rules: geometry tests, text tests, sort orders, policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelane.functions import scalars
from quirelane.functions.geometry import Box
from quirelane.operators import blocks, checks, compare, documents, layout, page_class, quality, reading, receipts, tables
from quirelane.plans.registry import register
from quirelane.plans.sqlparts import LINES
from quirelane.session import table
from quirelane.sources import virtual_pages


def _lineitem(spark, sf_dir):
    return table(spark, sf_dir, "lineitem")


_BOXES = """boxes AS (SELECT l_orderkey, l_linenumber, (l_linenumber * 10)::DOUBLE AS ax0, 0.0::DOUBLE AS ay0, (l_linenumber * 10 + 20)::DOUBLE AS ax1, 10.0::DOUBLE AS ay1,
  (l_orderkey % 40)::DOUBLE AS bx0, (l_orderkey % 7)::DOUBLE AS by0, (l_orderkey % 40 + 25)::DOUBLE AS bx1, (l_orderkey % 7 + 10)::DOUBLE AS by1 FROM lineitem)"""


def _boxes(spark, sf_dir):
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    d = lambda c: c.cast("double")
    return _lineitem(spark, sf_dir).select(
        "l_orderkey", "l_linenumber", d(n * 10).alias("ax0"), F.lit(0.0).alias("ay0"), d(n * 10 + 20).alias("ax1"), F.lit(10.0).alias("ay1"),
        d(k % 40).alias("bx0"), d(k % 7).alias("by0"), d(k % 40 + 25).alias("bx1"), d(k % 7 + 10).alias("by1"),
    )


_OVERLAP = "greatest(0, least(ax1, bx1) - greatest(ax0, bx0)) * greatest(0, least(ay1, by1) - greatest(ay0, by0))"


@register("box_iou", f"WITH {_BOXES} SELECT l_orderkey, l_linenumber, round({_OVERLAP} / (200 + 250 - {_OVERLAP}), 9) AS iou FROM boxes")
def box_iou(spark, sf_dir):
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", F.round(Box.of("a").iou(Box.of("b")), 9).alias("iou"))


@register(
    "same_position",
    f"WITH {_BOXES} SELECT l_orderkey, l_linenumber, (abs(ay0 - by0) < 5 OR abs(ay1 - by1) < 5) AND abs(ax0 - bx0) < 10 AND abs(ax1 - bx1) < 10 AS same FROM boxes",
)
def same_position(spark, sf_dir):
    return _boxes(spark, sf_dir).select("l_orderkey", "l_linenumber", blocks.same_position(Box.of("a"), Box.of("b")).alias("same"))


@register("box_unions", f"WITH {LINES} SELECT doc_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM lines GROUP BY doc_id")
def box_unions(spark, sf_dir):
    from quirelane.functions.geometry import union_box

    return virtual_pages.lines(table(spark, sf_dir, "documents").select("doc_id", "text")).groupBy("doc_id").agg(*union_box())


@register("page_zones", f"WITH {LINES} SELECT CASE WHEN y1 >= 0.93 * 752 THEN 'header' WHEN y0 <= 0.07 * 752 + 200 * 0 THEN 'footer' END AS zone, count(*) AS n FROM lines GROUP BY 1")
def page_zones(spark, sf_dir):
    ln = virtual_pages.lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return ln.groupBy(blocks.zone(F.col("y0"), F.col("y1"), F.lit(752.0)).alias("zone")).agg(F.count("*").alias("n"))


_ASCII = "regexp_replace(text, '[^ -~]', '', 'g')"


@register(
    "text_similarity",
    f"SELECT a.item_id, round(1 - levenshtein(a.t, b.t) / greatest(length(a.t), length(b.t)), 9) AS s, levenshtein(a.t, b.t) <= 0.05 * greatest(length(a.t), length(b.t)) AS near FROM (SELECT item_id, {_ASCII} AS t FROM benchmark) a JOIN (SELECT item_id - 1 AS item_id, {_ASCII} AS t FROM benchmark) b USING (item_id)",
)
def text_similarity(spark, sf_dir):
    t = F.regexp_replace("text", "[^ -~]", "")
    b = table(spark, sf_dir, "benchmark")
    j = b.select("item_id", t.alias("t")).join(b.select((F.col("item_id") - 1).alias("item_id"), t.alias("u")), "item_id")
    return j.select("item_id", F.round(scalars.text_similarity(F.col("t"), F.col("u")), 9).alias("s"), scalars.nearly_equal(F.col("t"), F.col("u")).alias("near"))


@register("printable_share", "SELECT doc_id, 1 - len(regexp_extract_all(text, '[\\x00-\\x1F\\x7F-\\x{009F}\\x{FFFD}]')) / length(text) AS share FROM documents WHERE length(text) > 0")
def printable_share(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.char_length("text") > 0).select("doc_id", scalars.printable_fraction(F.col("text")).alias("share"))


@register(
    "word_coverage",
    """WITH listed AS (SELECT DISTINCT lower(w) AS w FROM (SELECT unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark)), words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM documents)
    SELECT doc_id, sum((lower(words.w) IN (SELECT w FROM listed))::INT)::BIGINT AS n FROM words GROUP BY doc_id HAVING n > 0""",
)
def word_coverage(spark, sf_dir):
    """Words of documents that a list holds, in any case; the list is joined by hash."""
    split = lambda name: table(spark, sf_dir, name).select("*", F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return quality.in_word_list(split("documents").select("doc_id", "word"), split("benchmark").select("word")).groupBy("doc_id").agg(F.count("*").alias("n"))


@register("visual_order", f"WITH {LINES} SELECT doc_id, line_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_index, y0 DESC, x0, line_no) AS rank FROM lines")
def visual_order(spark, sf_dir):
    ln = virtual_pages.lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return documents.visual_rank(ln, "line_no").select("doc_id", "line_no", "rank")


@register(
    "header_rows",
    """WITH c AS (SELECT l_orderkey AS doc_id, l_linenumber - 1 AS row, (l_linenumber <= 1 + l_orderkey % 3) AS bold FROM lineitem), r AS (SELECT doc_id, row, bool_and(bold) AND 2 * count(*) >= 2 AS ok FROM c GROUP BY ALL),
    s AS (SELECT *, min(CASE WHEN NOT ok THEN row END) OVER (PARTITION BY doc_id) AS stop FROM r) SELECT doc_id, 0 AS page_index, row FROM s WHERE stop IS NULL OR row < stop""",
)
def header_rows(spark, sf_dir):
    l = _lineitem(spark, sf_dir)
    row = (F.col("l_linenumber") - 1).alias("row")
    bold = (F.col("l_linenumber") <= 1 + F.col("l_orderkey") % 3).alias("bold")
    c = l.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), row, bold, F.explode(F.array(F.lit("a"), F.lit("b"))).alias("text"))
    return tables.header_rows(c)


@register("column_rmse", "SELECT o_orderkey, round(sqrt((pow(o_orderkey % 5, 2) + pow(o_custkey % 3, 2)) / 2), 9) AS rmse FROM orders")
def column_rmse(spark, sf_dir):
    a = F.array(F.lit(10.0), F.lit(20.0))
    b = F.array(F.lit(10.0) + F.col("o_orderkey") % 5, F.lit(20.0) - F.col("o_custkey") % 3)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(tables.column_rmse(a, b), 9).alias("rmse"))


@register("cell_classes", "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity / 50 >= 0.8 THEN 'scanned' WHEN l_discount * 10 >= 0.6 THEN 'vector' ELSE 'mixed' END AS c FROM lineitem")
def cell_classes(spark, sf_dir):
    c = page_class.cell_class(F.col("l_discount") * 10, F.col("l_quantity") / 50)
    return _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", c.alias("c"))


@register("escalation", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'R' THEN 'scanned' WHEN l_quantity / 50 < 0.5 THEN 'broken_vector' ELSE 'vector' END AS c FROM lineitem")
def escalation(spark, sf_dir):
    c = F.when(F.col("l_returnflag") == "R", "vector").otherwise("scanned")
    return _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", page_class.escalate(c, F.col("l_quantity") / 50).alias("c"))


@register("structure_kinds", "SELECT l_linenumber AS n, CASE l_linenumber % 4 WHEN 0 THEN 'heading' WHEN 1 THEN 'list' WHEN 2 THEN 'table' ELSE 'paragraph' END AS kind, count(*) AS total FROM lineitem GROUP BY ALL")
def structure_kinds(spark, sf_dir):
    n = F.col("l_linenumber")
    role = F.when(n % 4 == 0, "H1").when(n % 4 == 1, "LI").when(n % 4 == 2, "TD").otherwise("Custom")
    return _lineitem(spark, sf_dir).groupBy(n.alias("n"), reading.block_kind(role).alias("kind")).agg(F.count("*").alias("total"))


@register("named_destinations", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN o_orderkey % 4 + 10 END AS target_page FROM orders")
def named_destinations(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    links = o.select("o_orderkey", F.lit(1).alias("doc_id"), F.concat(F.lit("d"), (F.col("o_orderkey") % 4).cast("string")).alias("name"))
    names = spark.createDataFrame([(1, f"d{i}", i + 10) for i in range(3)], "doc_id int, name string, page_index int")
    return documents.named_destinations(links, names).select("o_orderkey", "target_page")


@register("typed_values", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS text, CASE WHEN o_orderkey % 3 = 1 THEN o_orderstatus <> 'O' END AS checked, CASE WHEN o_orderkey % 3 = 2 THEN 2 END AS n FROM orders")
def typed_values(spark, sf_dir):
    k = F.col("o_orderkey") % 3
    kind = F.when(k == 0, "text").when(k == 1, "button").otherwise("choice")
    value = F.when(k == 0, F.col("o_orderstatus")).when(k == 1, F.when(F.col("o_orderstatus") == "O", "Off").otherwise("Yes")).otherwise("a|b")
    v = table(spark, sf_dir, "orders").select("o_orderkey", documents.typed_value(kind, value).alias("v"))
    return v.select("o_orderkey", "v.text", "v.checked", F.when(F.col("v.choices").isNotNull(), F.size("v.choices")).alias("n"))


@register("conformance", "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN (p_size % 3 + 1) || 'B' END AS level FROM part")
def conformance(spark, sf_dir):
    xmp = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("<pdfaid:part>"), (F.col("p_size") % 3 + 1).cast("string"), F.lit("</pdfaid:part><pdfaid:conformance>b</pdfaid:conformance>"))).otherwise("none")
    return table(spark, sf_dir, "part").select("p_partkey", documents.conformance(xmp).alias("level"))


@register("version_compatibility", "SELECT p_partkey, p_partkey % 3 = 1 AND p_size % 4 <= 2 AS ok FROM part")
def version_compatibility(spark, sf_dir):
    made = F.concat((F.col("p_partkey") % 3).cast("string"), F.lit("."), (F.col("p_size") % 4).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", receipts.version_accepted(made, F.lit("1.2")).alias("ok"))


@register("age_buckets", "WITH a AS (SELECT epoch(TIMESTAMP '2024-02-10') - epoch(ts) AS s FROM events) SELECT CASE WHEN s < 3600 THEN '<1h' WHEN s < 86400 THEN '<1d' WHEN s < 604800 THEN '<7d' WHEN s < 2592000 THEN '<30d' ELSE 'older' END AS bucket, count(*) AS n FROM a GROUP BY 1")
def age_buckets(spark, sf_dir):
    s = F.unix_micros(F.lit("2024-02-10").cast("timestamp")) / 1e6 - F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return table(spark, sf_dir, "events").groupBy(receipts.age_bucket(s).alias("bucket")).agg(F.count("*").alias("n"))


@register("cache_purge", "SELECT event_id AS cache_key FROM events WHERE epoch(TIMESTAMP '2024-02-10') - floor(epoch(ts)) <= 604800")
def cache_purge(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("cache_key"), F.col("ts").cast("timestamp").alias("last_touch"))
    return receipts.purge(e, F.lit("2024-02-10").cast("timestamp"), 7 * 86400).select("cache_key")


@register("canonical_numbers", "SELECT l_orderkey, l_linenumber, round(l_extendedprice * 10000)::BIGINT AS n FROM lineitem")
def canonical_numbers(spark, sf_dir):
    return _lineitem(spark, sf_dir).select("l_orderkey", "l_linenumber", receipts.canonical_number(F.col("l_extendedprice")).alias("n"))


@register("content_hashes", "SELECT item_id, sha256(regexp_replace(trim(text, ' '), '\\s+', ' ', 'g')) AS h FROM benchmark")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.sha2(receipts.normalised(F.col("text")), 256).alias("h"))


_PAD = lambda x: f"'{''.join(f'{b ^ x:02x}' for b in b'key'.ljust(64, bytes(1)))}'"


@register("entry_tags", f"SELECT p_partkey, sha256(from_hex({_PAD(0x5C)}) || from_hex(sha256(from_hex({_PAD(0x36)}) || encode(p_name)))) AS tag FROM part")
def entry_tags(spark, sf_dir):
    """HMAC of cache entries; tests hold it against the standard library."""
    return table(spark, sf_dir, "part").select("p_partkey", checks.hmac(b"key", F.encode("p_name", "UTF-8")).alias("tag"))


@register("flattened_values", "SELECT p_partkey AS doc_id, 'brand' AS path, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'size', p_size::VARCHAR FROM part")
def flattened_values(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    return compare.flatten(p, "doc_id", ["brand", "size"])


@register("upper_medians", "SELECT l_orderkey, (list_sort(list(l_quantity)))[len(list(l_quantity)) // 2 + 1]::DOUBLE AS m FROM lineitem GROUP BY l_orderkey")
def upper_medians(spark, sf_dir):
    return _lineitem(spark, sf_dir).groupBy("l_orderkey").agg(layout.upper_median(F.collect_list(F.col("l_quantity").cast("double"))).alias("m"))


@register("json_documents", f"WITH {LINES} SELECT doc_id, count(DISTINCT page_index) AS n FROM lines GROUP BY doc_id")
def json_documents(spark, sf_dir):
    """Documents written as JSON and read again with a schema."""
    from quirelane.operators import serialise
    from quirelane.session import shared_folder

    pages = virtual_pages.page_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), "t")
    place = shared_folder(spark, "json")
    serialise.document_json(pages).select(F.concat(F.lit('{"doc_id":'), F.col("doc_id").cast("string"), F.lit(',"doc":'), "json", F.lit("}")).alias("value")).write.text(place)
    got = spark.read.schema("doc_id long, doc struct<schema_version: string, pages: array<struct<page_index: int>>>").json(place)
    return got.select("doc_id", F.size("doc.pages").cast("long").alias("n"))
