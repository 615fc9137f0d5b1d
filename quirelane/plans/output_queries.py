"""Queries of differences, receipts, cache and serialised output."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelane.operators import cache_store, compare, receipts, serialise
from quirelane.plans.registry import register
from quirelane.plans.sqlparts import LINES
from quirelane.session import shared_folder, spread, table
from quirelane.sources import sinks, virtual_pages


def _lines(spark, sf_dir):
    return virtual_pages.lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _versions(spark, sf_dir):
    """Lines as blocks, and a later version of them: every seventh line changed, every eleventh gone, one added per page."""
    old = _lines(spark, sf_dir).select("doc_id", "page_index", F.col("line_no").alias("block_index"), F.regexp_replace("text", "[^ -~]", "").alias("text"), "x0", "y0", "x1", "y1")
    new = old.where("block_index % 11 <> 10").withColumn("text", F.when(F.col("block_index") % 7 == 6, F.concat(F.lit("zq "), F.reverse("text"))).otherwise(F.col("text")))
    extra = old.select("doc_id", "page_index").distinct().select(
        "doc_id", "page_index", (F.lit(10000000) + F.col("page_index")).alias("block_index"), F.lit("added").alias("text"), F.lit(500.0).alias("x0"), F.lit(5.0).alias("y0"), F.lit(560.0).alias("x1"), F.lit(15.0).alias("y1")
    )
    return old, new.unionByName(extra)


_VERSIONS = f"""{LINES}, old AS (SELECT doc_id, page_index, line_no AS b, regexp_replace(text, '[^ -~]', '', 'g') AS text FROM lines),
  fresh AS (SELECT doc_id, page_index, b, CASE WHEN b % 7 = 6 THEN 'zq ' || reverse(text) ELSE text END AS text FROM old WHERE b % 11 <> 10),
  sims AS (SELECT o.doc_id, o.page_index, o.b, CASE WHEN o.text = n.text THEN 1 ELSE 1 - levenshtein(o.text, n.text) / greatest(length(o.text), length(n.text)) END AS sim FROM old o JOIN fresh n USING (doc_id, page_index, b))"""


@register(
    "page_diff",
    f"""WITH {_VERSIONS} SELECT doc_id, page_index, CASE WHEN sim < 0.9 THEN 'changed' ELSE 'same' END AS kind, count(*) AS n FROM sims GROUP BY ALL
    UNION ALL SELECT doc_id, page_index, 'removed', count(*) FROM old WHERE b % 11 = 10 GROUP BY ALL
    UNION ALL SELECT doc_id, page_index, 'added', 1 FROM (SELECT DISTINCT doc_id, page_index FROM old)""",
)
def page_diff(spark, sf_dir):
    return compare.page_diff(*_versions(spark, sf_dir)).groupBy("doc_id", "page_index", "kind").agg(F.count("*").alias("n"))


@register(
    "diff_summary",
    f"""WITH {_VERSIONS}, k AS (SELECT doc_id, sum((sim < 0.9)::INT)::BIGINT AS changed, sum((sim >= 0.9)::INT)::BIGINT AS same FROM sims GROUP BY doc_id),
    p AS (SELECT doc_id, count(DISTINCT page_index) AS pages, sum((b % 11 = 10)::INT)::BIGINT AS removed FROM old GROUP BY doc_id)
    SELECT p.doc_id, p.pages AS old_pages, p.pages AS new_pages, coalesce(k.changed, 0) AS changed, p.removed, p.pages AS added, coalesce(k.same, 0) AS same FROM p LEFT JOIN k USING (doc_id)""",
)
def diff_summary(spark, sf_dir):
    old, new = _versions(spark, sf_dir)
    return compare.diff_summary(compare.page_diff(old, new), old, new)


@register(
    "tolerant_compare",
    """WITH v AS (SELECT p_partkey AS doc_id, p_retailprice AS a, p_retailprice + CASE WHEN p_partkey % 3 = 0 THEN 0.004 WHEN p_partkey % 3 = 1 THEN 0 ELSE 2 END AS b FROM part)
    SELECT doc_id, 'price' AS path FROM v WHERE abs(a - b) > 0.01""",
)
def tolerant_compare(spark, sf_dir):
    k, p = F.col("p_partkey"), F.col("p_retailprice")
    d = table(spark, sf_dir, "part").select(k.alias("doc_id"), p.cast("double").alias("price"), F.col("p_brand").alias("brand"))
    e = d.withColumn("price", F.col("price") + F.when(F.col("doc_id") % 3 == 0, 0.004).when(F.col("doc_id") % 3 == 1, 0.0).otherwise(2.0))
    got = compare.compare_values(compare.flatten(d, "doc_id", ["price", "brand"]), compare.flatten(e, "doc_id", ["price", "brand"]), tolerances={"price": 0.01})
    return got.select("doc_id", "path")


_PRINTS = f"""{LINES}, pages AS (SELECT doc_id, page_index, string_agg(text, ' ' ORDER BY line_no) AS text, max(x1) AS x1 FROM lines GROUP BY ALL),
  hashes AS (SELECT doc_id, page_index, sha256(regexp_replace(trim(text, ' '), '\\s+', ' ', 'g')) AS c, sha256('720000,0,' || (round(x1 * 10000))::BIGINT || ',7920000') AS g FROM pages),
  prints AS (SELECT doc_id, sha256(count(*) || ':' || string_agg(c || g, '' ORDER BY page_index)) AS fingerprint FROM hashes GROUP BY doc_id)"""


def _prints(spark, sf_dir):
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))
    pages = _lines(spark, sf_dir).groupBy("doc_id", "page_index").agg(F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("text"), F.max("x1").alias("x1"))
    pages = pages.withColumns({"x0": F.lit(72.0), "y0": F.lit(0.0), "y1": F.lit(792.0)})
    return receipts.fingerprints(receipts.page_hashes(pages))


@register("fingerprints", f"WITH {_PRINTS} SELECT * FROM prints")
def fingerprints(spark, sf_dir):
    return _prints(spark, sf_dir)


@register(
    "receipts",
    f"WITH {_PRINTS} SELECT l.doc_id, fingerprint, page_index, x0, y0, x1, y1, sha256(text) AS content_hash, '1.0' AS version FROM lines l JOIN prints USING (doc_id)",
)
def make_receipts(spark, sf_dir):
    return receipts.create(_lines(spark, sf_dir), _prints(spark, sf_dir))


@register(
    "receipt_verification",
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 10 WHEN doc_id % 5 = 1 THEN 11 WHEN doc_id % 5 = 2 THEN 12 ELSE 0 END AS code, count(*) AS n
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE length(line) > 0 GROUP BY ALL""",
)
def receipt_verification(spark, sf_dir):
    lines, prints = _lines(spark, sf_dir), _prints(spark, sf_dir)
    r = receipts.create(lines.where("text <> ''"), prints)
    k = F.col("doc_id") % 5
    # whole boxes go: one whose left edge alone went would still hold most of a very long line
    gone = F.when(k == 1, F.col("x1") - F.col("x0") + 5000).otherwise(0)
    r = r.withColumns(
        {
            "fingerprint": F.when(k == 0, F.lit("other")).otherwise(F.col("fingerprint")),
            "x0": F.col("x0") - gone,
            "x1": F.col("x1") - gone,
            "content_hash": F.when(k == 2, F.lit("other")).otherwise(F.col("content_hash")),
        }
    )
    return receipts.verify(r, prints, lines).groupBy("doc_id", "code").agg(F.count("*").alias("n"))


@register("cache_keys", """SELECT p_partkey, sha256(p_name || ':{"ocr":false,"receipts":"lite","version":1}') AS cache_key FROM part""")
def cache_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", receipts.cache_key(F.col("p_name"), {"version": 1, "receipts": "lite", "ocr": False}).alias("cache_key"))


@register("read_through_cache", "SELECT p_partkey AS cache_key, p_size * 2 AS result, CASE WHEN p_partkey % 3 = 0 THEN 'hit' ELSE 'miss' END AS status FROM part")
def read_through_cache(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cache_key"), "p_size")
    compute = lambda df: df.select("cache_key", (F.col("p_size") * 2).alias("result"))
    return receipts.read_through(p, compute(p.where("cache_key % 3 = 0")), compute)[0]


_ENTRIES = "entries AS (SELECT event_id AS cache_key, ts AS last_touch, 100 + event_id % 50 AS bytes FROM events)"


def _entries(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("cache_key"), F.col("ts").alias("last_touch"), (F.lit(100) + F.col("event_id") % 50).alias("bytes"))


@register("cache_stats", f"""WITH {_ENTRIES}, a AS (SELECT *, epoch(TIMESTAMP '2030-01-01') - epoch(last_touch) AS age FROM entries) SELECT count(*) AS n, sum(bytes)::BIGINT AS bytes, sum((age >= 2592000)::INT)::BIGINT AS n_older FROM a""")
def cache_stats(spark, sf_dir):
    return receipts.cache_stats(_entries(spark, sf_dir), F.lit("2030-01-01").cast("timestamp_ntz").cast("timestamp")).select("n", "bytes", "n_older")


@register(
    "cache_evictions",
    f"""WITH {_ENTRIES}, r AS (SELECT *, sum(bytes) OVER (ORDER BY last_touch, cache_key ROWS UNBOUNDED PRECEDING) - bytes AS before, sum(bytes) OVER () AS total FROM entries)
    SELECT cache_key FROM r WHERE total > 300000 AND before < total - 240000 ORDER BY last_touch, cache_key LIMIT 1000""",
)
def cache_evictions(spark, sf_dir):
    return receipts.evictions(_entries(spark, sf_dir), 300_000).select("cache_key")


# ---- serialised output

_KINDS = """kinds AS (SELECT doc_id, page_index, line_no AS block_index, CASE WHEN row_no = 0 THEN 'heading' WHEN row_no IN (5, 6, 7) THEN 'list' WHEN row_no = 49 THEN 'footer' WHEN row_no = 20 THEN 'code' ELSE 'paragraph' END AS kind, 2 AS level, text, x0, y0, x1, y1 FROM lines)"""


def _kinds(spark, sf_dir):
    r = F.col("row_no")
    kind = F.when(r == 0, "heading").when(r.isin(5, 6, 7), "list").when(r == 49, "footer").when(r == 20, "code").otherwise("paragraph")
    return _lines(spark, sf_dir).select("doc_id", "page_index", F.col("line_no").alias("block_index"), kind.alias("kind"), F.lit(2).alias("level"), "text", "x0", "y0", "x1", "y1")


@register("page_text", f"WITH {LINES}, {_KINDS} SELECT doc_id, page_index, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY block_index) FILTER (kind <> 'footer' AND trim(text, ' ') <> ''), '') AS page_text FROM kinds GROUP BY ALL")
def page_text(spark, sf_dir):
    return serialise.page_text(_kinds(spark, sf_dir))


@register(
    "document_text",
    f"WITH {LINES}, {_KINDS}, p AS (SELECT doc_id, page_index, coalesce(string_agg(text, chr(10) || chr(10) ORDER BY block_index) FILTER (kind <> 'footer' AND trim(text, ' ') <> ''), '') AS t FROM kinds GROUP BY ALL) SELECT doc_id, md5(string_agg(t, chr(12) ORDER BY page_index)) AS h FROM p GROUP BY doc_id",
)
def document_text(spark, sf_dir):
    return serialise.document_text(serialise.page_text(_kinds(spark, sf_dir))).select("doc_id", F.md5("document_text").alias("h"))


_ESC = r"""regexp_replace(text, '([\\`*_{}\[\]()#+!|<>~])', '\\\1', 'g')"""


@register(
    "page_markdown",
    f"""WITH {LINES}, {_KINDS}, md AS (SELECT doc_id, page_index, block_index, CASE kind WHEN 'heading' THEN '## ' || {_ESC} WHEN 'list' THEN '- ' || {_ESC} WHEN 'code' THEN '```' || chr(10) || text || chr(10) || '```' ELSE {_ESC} END AS m,
      CASE WHEN lag(kind) OVER w IS NULL THEN '' WHEN kind = 'list' AND lag(kind) OVER w = 'list' THEN chr(10) ELSE chr(10) || chr(10) END AS sep FROM kinds WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY block_index))
    SELECT doc_id, page_index, md5(string_agg(sep || m, '' ORDER BY block_index)) AS h FROM md GROUP BY ALL""",
)
def page_markdown(spark, sf_dir):
    return serialise.page_markdown(_kinds(spark, sf_dir)).select("doc_id", "page_index", F.md5("markdown").alias("h"))


@register(
    "pipe_tables",
    """SELECT o_orderkey, '| order | status |' || chr(10) || '| --- | --- |' || chr(10) || '| ' || o_orderkey || ' | ' || o_orderstatus || '\\|x |' AS md FROM orders""",
)
def pipe_tables(spark, sf_dir):
    rows = F.array(F.array(F.lit("order"), F.lit("status")), F.array(F.col("o_orderkey").cast("string"), F.concat("o_orderstatus", F.lit("|x"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", serialise.pipe_table(rows).alias("md"))


@register(
    "html_tables",
    """SELECT p_partkey, '<table><tr><th colspan="2">' || replace(p_name, '&', '&amp;') || '</th></tr><tr><td>' || p_brand || '</td><td rowspan="3">a &lt; b</td></tr></table>' AS html FROM part""",
)
def html_tables(spark, sf_dir):
    cell = lambda t, r, c, h: F.struct(t.alias("text"), F.lit(r).alias("rowspan"), F.lit(c).alias("colspan"), F.lit(h).alias("header"))
    rows = F.array(F.array(cell(F.col("p_name"), 1, 2, True)), F.array(cell(F.col("p_brand"), 1, 1, False), cell(F.lit("a < b"), 3, 1, False)))
    return table(spark, sf_dir, "part").select("p_partkey", serialise.html_table(rows).alias("html"))


@register("anchors", f"WITH {LINES}, {_KINDS} SELECT doc_id, block_index, page_index AS page, x0::INT AS x0, y1::INT AS y1, kind FROM kinds")
def anchors(spark, sf_dir):
    k = _kinds(spark, sf_dir)
    c = F.col
    text = F.concat(F.lit("```\nno <!-- anchor --> here\n```\n"), serialise.anchor(c("page_index"), c("block_index"), c("x0"), c("y0"), c("x1"), c("y1"), c("kind")))
    a = k.select("doc_id", F.explode(serialise.parse_anchors(text)).alias("a"))
    return a.select("doc_id", F.col("a.block").alias("block_index"), "a.page", "a.x0", "a.y1", "a.kind")


@register("document_json", f"WITH {LINES} SELECT doc_id, max(page_index) + 1 AS page_count, count(*) AS n_lines FROM lines GROUP BY doc_id")
def document_json(spark, sf_dir):
    pages = _lines(spark, sf_dir).groupBy("doc_id", "page_index").agg(F.count("*").alias("n"))
    j = serialise.document_json(pages)
    body = F.from_json("json", "schema_version string, metadata struct<page_count: int>, pages array<struct<page_index: int, n: long>>")
    b = j.select("doc_id", body.alias("b"))
    return b.select("doc_id", F.col("b.metadata.page_count").alias("page_count"), F.aggregate("b.pages", F.lit(0).cast("long"), lambda s, p: s + p["n"]).alias("n_lines"))


@register("span_markdown", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN '**' ELSE '' END || CASE WHEN l_linenumber % 3 = 0 THEN '*' ELSE '' END || l_returnflag || CASE WHEN l_linenumber % 3 = 0 THEN '*' ELSE '' END || CASE WHEN l_linenumber % 2 = 0 THEN '**' ELSE '' END AS md FROM lineitem")
def span_markdown(spark, sf_dir):
    n = F.col("l_linenumber")
    flags = F.array_compact(F.array(F.when(n % 2 == 0, F.lit("bold")), F.when(n % 3 == 0, F.lit("italic"))))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", serialise.span_markdown(F.col("l_returnflag"), flags).alias("md"))


@register(
    "footer_errors",
    """SELECT o_custkey AS doc_id, 0 AS part, o_orderkey AS ordinal, 'page ' || o_orderkey AS message FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_custkey, 1, o_orderkey, 'note' FROM orders WHERE o_orderstatus = 'P'""",
)
def footer_errors(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    pages = o.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("page_index"), F.concat(F.lit("page "), F.col("o_orderkey").cast("string")).alias("message"))
    notes = o.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ordinal"), F.lit("note").alias("message"))
    return serialise.footer_errors(pages, notes)


# ---- operational aggregates


@register("labelled_counters", "SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS total FROM orders GROUP BY ALL")
def labelled_counters(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("total"))


_BOUNDS = (1, 5, 10, 25, 50, 100, 250, 500, 1000)


@register("duration_histogram", "SELECT " + ", ".join(f"sum((o_totalprice / 1000 <= {b})::INT)::BIGINT AS le_{b}" for b in _BOUNDS) + ", count(*) AS le_inf FROM orders")
def duration_histogram(spark, sf_dir):
    v = F.col("o_totalprice") / 1000
    return table(spark, sf_dir, "orders").agg(*(F.count_if(v <= b).alias(f"le_{b}") for b in _BOUNDS), F.count("*").alias("le_inf"))


@register(
    "committed_outputs",
    f"""WITH {LINES}, p AS (SELECT doc_id, page_index, string_agg(text, chr(10) ORDER BY line_no) AS t FROM lines GROUP BY ALL), d AS (SELECT doc_id, string_agg(t, chr(12) ORDER BY page_index) AS t, string_agg('# ' || t, chr(12) ORDER BY page_index) AS m FROM p GROUP BY doc_id)
    SELECT 'text' AS output, doc_id, md5(t) AS h FROM d UNION ALL SELECT 'markdown', doc_id, md5(m) FROM d""",
)
def committed_outputs(spark, sf_dir):
    """Texts and Markdown of all documents, written by one job, shown by one rename and read back."""
    pages = virtual_pages.page_texts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "page_text")
    folder = shared_folder(spark, "outputs")
    sinks.write_set(pages.withColumn("markdown", F.concat(F.lit("# "), "page_text")), ["text", "markdown"], folder)
    read = lambda name: spark.read.parquet(f"{folder}/{name}").select(F.lit(name).alias("output"), "doc_id", F.md5("value").alias("h"))
    return read("text").unionByName(read("markdown"))


@register(
    "cache_store",
    """WITH p AS (SELECT p_partkey AS cache_key, 100 + p_size AS bytes, CASE WHEN p_partkey % 2 = 0 THEN 2 WHEN p_partkey % 3 = 0 THEN 1 END AS touched FROM part),
    e AS (SELECT *, sum(bytes) OVER (ORDER BY touched, cache_key) - bytes AS before, sum(bytes) OVER () AS total, 60 * (SELECT count(*) FROM part) AS most FROM p WHERE touched IS NOT NULL),
    gone AS (SELECT cache_key FROM e WHERE total > most AND before < total - (most * 4) // 5)
    SELECT cache_key, bytes * 2 AS result, CASE WHEN touched IS NOT NULL AND cache_key NOT IN (SELECT cache_key FROM gone) THEN 'hit' ELSE 'miss' END AS status FROM p""",
)
def stored_cache(spark, sf_dir):
    """Two runs fill a store, an eviction takes what was touched longest ago, and a third run asks for everything."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cache_key"), (F.lit(100) + F.col("p_size")).cast("long").alias("bytes"))
    compute = lambda df: df.select("cache_key", (F.col("bytes") * 2).alias("result"), "bytes")
    store = cache_store.CacheStore(spark, shared_folder(spark, "cache"), "result long", "long")
    at = lambda day: F.lit(f"2030-01-0{day}").cast("timestamp")
    for day, n in ((1, 3), (2, 2)):
        store.read_through(parts.where(F.col("cache_key") % n == 0), compute, at(day))
    store.evict(60 * parts.count())
    return store.read_through(parts, compute, at(3))
