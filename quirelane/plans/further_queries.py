"""Queries of block kinds, fields, diagnostics and small serialised forms that no other module registers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quirelane.functions.geometry import Box
from quirelane.operators import blocks, checks, compare, diagnostics, glyphs, profiles, quality, reading, receipts, repair, serialise
from quirelane.plans.registry import register
from quirelane.plans.sqlparts import LINES
from quirelane.session import spread, table
from quirelane.sources import sinks, virtual_pages
from quirelane.streaming import frames

_PAGE_BLOCKS = """blk AS (SELECT doc_id, page_index, line_no AS b, CASE WHEN line_no % 4 = 0 THEN 'figure' ELSE 'paragraph' END AS kind, (7 + line_no % 5)::DOUBLE AS size, y0 - 10 * (line_no % 3) AS y0, y1 - 10 * (line_no % 3) AS y1 FROM lines)"""


def _docs(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


@register(
    "captions",
    f"""WITH {LINES}, {_PAGE_BLOCKS}, m AS (SELECT *, lag(kind) OVER w AS pk, lag(y0) OVER w AS py, median(size) OVER (PARTITION BY doc_id, page_index) AS mid FROM blk WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY y1 DESC, b))
    SELECT doc_id, page_index, count(*) AS n FROM m WHERE pk = 'figure' AND py - y1 <= 2 * size AND size < mid GROUP BY ALL""",
)
def captions(spark, sf_dir):
    n = F.col("line_no")
    b = virtual_pages.lines(_docs(spark, sf_dir)).select(
        "doc_id", "page_index", n.alias("block_index"), F.when(n % 4 == 0, "figure").otherwise("paragraph").alias("kind"), (7.0 + n % 5).alias("size"), (F.col("y0") - 10 * (n % 3)).alias("y0"), (F.col("y1") - 10 * (n % 3)).alias("y1")
    )
    return blocks.captions(b).where("is_caption").groupBy("doc_id", "page_index").agg(F.count("*").alias("n"))


@register(
    "figures",
    """WITH img AS (SELECT o_orderkey AS doc_id, (o_custkey % 50)::DOUBLE AS x0, 60.0::DOUBLE AS x1 FROM orders), g AS (SELECT l_orderkey AS doc_id, (10 * l_linenumber)::DOUBLE AS x0, (10 * l_linenumber + 9)::DOUBLE AS x1 FROM lineitem),
    c AS (SELECT img.doc_id, any_value(img.x1 - img.x0) * 20 AS area, coalesce(sum(greatest(least(img.x1, g.x1) - greatest(img.x0, g.x0), 0) * 10), 0) AS hit FROM img LEFT JOIN g USING (doc_id) GROUP BY img.doc_id)
    SELECT doc_id, round(hit / area, 6) AS covered FROM c WHERE hit / area < 0.3""",
)
def figures(spark, sf_dir):
    img = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.lit(0).alias("image_index"), (F.col("o_custkey") % 50).cast("double").alias("i_x0"), F.lit(0.0).alias("i_y0"), F.lit(60.0).alias("i_x1"), F.lit(20.0).alias("i_y1")
    )
    x = 10.0 * F.col("l_linenumber")
    g = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), x.alias("x0"), F.lit(5.0).alias("y0"), (x + 9).alias("x1"), F.lit(15.0).alias("y1"))
    return blocks.figures(img, g, 0.3).select("doc_id", F.round("covered", 6).alias("covered"))


@register(
    "span_scores",
    """WITH t AS (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS a FROM benchmark), p AS (SELECT item_id, a, replace(a, 'e', 'o') AS b, (item_id % 8)::DOUBLE AS dx FROM t)
    SELECT item_id, round(0.5 * (100 - dx) / (100 + dx) + 0.5 * CASE WHEN greatest(length(a), length(b)) = 0 THEN 1 ELSE 1 - levenshtein(a, b) / greatest(length(a), length(b)) END, 6) AS score FROM p""",
)
def span_scores(spark, sf_dir):
    t = F.regexp_replace("text", "[^ -~]", "")
    box = lambda p, dx: [F.lit(0.0).alias(f"{p}y0"), F.lit(10.0).alias(f"{p}y1"), dx.alias(f"{p}x0"), (dx + 100).alias(f"{p}x1")]
    p = table(spark, sf_dir, "benchmark").select("item_id", t.alias("a"), F.replace(t, F.lit("e"), F.lit("o")).alias("b"), *box("p_", F.lit(0.0)), *box("q_", (F.col("item_id") % 8).cast("double")))
    return p.select("item_id", F.round(compare.span_score(Box.of("p_"), Box.of("q_"), F.col("a"), F.col("b")), 6).alias("score"))


@register("shown_kinds", "SELECT l_returnflag AS kind, count(*) AS n FROM lineitem WHERE l_returnflag NOT IN ('A', 'R') GROUP BY 1")
def shown_kinds(spark, sf_dir):
    b = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"))
    return reading.shown_kinds(b, ["A", "R"]).groupBy("kind").agg(F.count("*").alias("n"))


@register("progress_events", "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1")
def progress_events(spark, sf_dir):
    sent = table(spark, sf_dir, "events").select(F.to_json(F.struct(F.col("event_type").alias("event"), F.col("ts").cast("string").alias("at"))).alias("value"))
    return sent.groupBy(frames.progress(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


@register("diagnostic_messages", "SELECT o_orderkey, o_orderstatus || ';' || o_orderpriority AS messages FROM orders")
def diagnostic_messages(spark, sf_dir):
    d = F.array(*(F.struct(F.lit(code).alias("code"), F.col(c).alias("message")) for code, c in (("a", "o_orderstatus"), ("b", "o_orderpriority"))))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(diagnostics.messages(d), ";").alias("messages"))


@register("font_kinds", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'type1' WHEN 1 THEN 'type1' WHEN 2 THEN 'truetype' WHEN 3 THEN 'composite' WHEN 4 THEN 'type3' ELSE 'unknown' END AS kind FROM part")
def font_kinds(spark, sf_dir):
    names = F.array(*(F.lit(n) for n in ("Type1", "MMType1", "TrueType", "Type0", "Type3", "CIDFontType9")))
    return table(spark, sf_dir, "part").select("p_partkey", glyphs.font_kind(F.element_at(names, (F.col("p_partkey") % 6).cast("int") + 1)).alias("kind"))


@register(
    "rich_fields",
    """WITH t AS (SELECT p_partkey, 'Part no: ' || p_partkey || ' Total due ' || CASE p_partkey % 3 WHEN 0 THEN '1,234.50' WHEN 1 THEN '77' ELSE 'none' END || ' in stock: ' || CASE p_partkey % 2 WHEN 0 THEN 'yes' ELSE 'no' END AS s FROM part)
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 1234.5 WHEN 1 THEN 77 END::DOUBLE AS total, p_partkey AS number, p_partkey % 2 = 0 AS stock, CASE p_partkey % 3 WHEN 2 THEN 'none' END AS word FROM t""",
)
def rich_fields(spark, sf_dir):
    k = F.col("p_partkey")
    s = F.concat(
        F.lit("Part no: "), k.cast("string"), F.lit(" Total due "), F.when(k % 3 == 0, "1,234.50").when(k % 3 == 1, "77").otherwise("none"), F.lit(" in stock: "), F.when(k % 2 == 0, "yes").otherwise("no")
    )
    t = table(spark, sf_dir, "part").select("p_partkey", s.alias("s"))
    field = lambda anchors, pattern, kind: profiles.rich_field(F.col("s"), anchors, pattern, kind)
    return t.select(
        "p_partkey",
        field(["Amount", "Total due"], "^ [0-9][0-9,.]*", "decimal").cast("double").alias("total"),
        field(["Part no:"], "[0-9]+", "integer").alias("number"),
        field(["in stock:"], "yes|no", "bool").alias("stock"),
        field(["Total due"], "none", "text").alias("word"),
    )


@register(
    "form_tables",
    """SELECT c_custkey AS doc_id, '| field | type | value |' || chr(10) || '| --- | --- | --- |' || chr(10) || '| name | text | ' || c_name || ' |' || chr(10) || '| segment | choice | ' || replace(c_mktsegment, '|', '\\|') || ' |' AS markdown FROM customer""",
)
def form_tables(spark, sf_dir):
    row = lambda n, t, v: F.struct(F.lit(n).alias("name"), F.lit(t).alias("type"), v.alias("value"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(F.array(row("segment", "choice", F.col("c_mktsegment")), row("name", "text", F.col("c_name")))).alias("f"))
    return serialise.form_markdown(c.select("doc_id", "f.*"))


@register(
    "footnote_lists",
    """SELECT o_custkey AS doc_id, string_agg('[^' || n || ']: ' || s, chr(10) ORDER BY n, s) AS markdown FROM (SELECT DISTINCT o_custkey, o_orderkey AS n, o_orderpriority AS s FROM orders) GROUP BY 1""",
)
def footnote_lists(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("number"), F.col("o_orderpriority").alias("text"))
    return serialise.footnotes(o)


@register(
    "thread_lists",
    """WITH t AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS thread, l_linenumber AS position, l_linenumber * 3 AS page FROM lineitem), p AS (SELECT doc_id, thread, string_agg((page + 1)::VARCHAR, ', ' ORDER BY position) AS pages FROM t GROUP BY ALL)
    SELECT doc_id, string_agg('- Thread ' || (thread + 1) || ': pages ' || pages, chr(10) ORDER BY thread) AS markdown FROM p GROUP BY doc_id""",
)
def thread_lists(spark, sf_dir):
    n = F.col("l_linenumber")
    beads = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (n % 2).alias("thread"), n.alias("position"), (n * 3).alias("page_index"))
    return serialise.thread_markdown(beads)


@register(
    "weighted_predicates",
    f"""WITH {LINES}, p AS (SELECT doc_id, page_index, sum(length(text)) AS chars, max(size) AS largest FROM lines GROUP BY ALL), d AS (SELECT doc_id, count(*) AS n_pages, avg(chars) AS density FROM p GROUP BY doc_id)
    SELECT d.doc_id, contains(lower(t.text), 'the') AS words, regexp_matches(t.text, '[0-9]{{4}}') AS years, n_pages >= 2 AS long, density BETWEEN 100 AND 5000 AS dense FROM d JOIN documents t USING (doc_id)""",
)
def weighted_predicates(spark, sf_dir):
    s = profiles.feature_signals(virtual_pages.lines(_docs(spark, sf_dir)))
    p = profiles.weighted_predicate
    return s.select("doc_id", p("contains", "THE").alias("words"), p("regex", "[0-9]{4}").alias("years"), p("pages", (2, None)).alias("long"), p("density", (100, 5000)).alias("dense"))


@register("schema_problems", "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'not_json' WHEN 1 THEN 'version' WHEN 2 THEN 'shape' END AS problem FROM part")
def schema_problems(spark, sf_dir):
    k = F.col("p_partkey")
    text = F.when(k % 4 == 0, F.lit("{no")).when(k % 4 == 1, F.lit('{"schema_version":"2.0","pages":[]}')).when(k % 4 == 2, F.lit('{"schema_version":"1.1"}')).otherwise(F.lit('{"schema_version":"1.1","pages":[]}'))
    d = table(spark, sf_dir, "part").select("p_partkey", text.alias("json"))
    return checks.schema_problems(d, "schema_version string, pages array<struct<page_index: int>>").select("p_partkey", "problem")


@register("audit_records", "SELECT o_orderkey, 'extract' AS action, o_orderpriority AS target, CASE WHEN o_orderstatus = 'F' THEN 'ok' ELSE 'failed' END AS status FROM orders")
def audit_records(spark, sf_dir):
    r = sinks.audit_record(F.lit("extract"), F.col("o_orderpriority"), F.when(F.col("o_orderstatus") == "F", "ok").otherwise("failed"))
    part = lambda n: F.get_json_object("r", f"$.{n}").alias(n)
    return table(spark, sf_dir, "orders").select("o_orderkey", r.alias("r")).select("o_orderkey", part("action"), part("target"), part("status"))


@register("present_versions", "SELECT p_partkey, p_partkey % 3 = 0 AS migrated FROM part")
def present_versions(spark, sf_dir):
    d = table(spark, sf_dir, "part").select("p_partkey", F.format_string('{"schema_version":"1.%d"}', (F.col("p_partkey") % 3).cast("int")).alias("json"))
    return serialise.migrate(d).select("p_partkey", "migrated")


@register(
    "word_starts",
    """SELECT l_orderkey AS doc_id, l_linenumber AS glyph_index, l_linenumber % 3 = 1 OR row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) = 1 AS word_start FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)""",
)
def word_starts(spark, sf_dir):
    """Gaps of 1 or 4 points at a size of 10, on pages of too few gaps for another threshold."""
    n = F.col("l_linenumber")
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    x0 = F.sum(F.when(n % 3 == 1, 9.0).otherwise(6.0)).over(Window.partitionBy("l_orderkey").orderBy(n))
    g = l.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), n.alias("glyph_index"), x0.alias("x0"), F.lit(0.0).alias("y0"), F.lit(10.0).alias("size"))
    return repair.word_gaps(g.withColumn("x1", F.col("x0") + 5)).select("doc_id", "glyph_index", "word_start")


@register(
    "all_weighted_predicates",
    f"""WITH {LINES}, p AS (SELECT doc_id, page_index, sum(length(text)) AS chars, sum(regexp_matches(text, '^\\s*[-*\u2022\u2023\u25e6\u2043]\\s|^\\s*[-*]\\s')::INT) AS bullets,
      sum(regexp_matches(text, '[\u2200-\u22FF=+\u00B1\u00D7\u00F7].*[0-9]')::INT) AS math, max((y0 <= 55.44 AND regexp_matches(text, '[0-9]'))::INT) AS footer FROM lines GROUP BY ALL),
    d AS (SELECT doc_id, count(*) AS n_pages, avg(chars) AS density, sum(bullets) AS bullets, sum(math) AS math, sum(footer) = count(*) AS footers FROM p GROUP BY doc_id),
    f AS (SELECT doc_id, count(DISTINCT font) AS fonts, count(DISTINCT size) AS sizes FROM lines GROUP BY doc_id)
    SELECT d.doc_id, contains(lower(t.text), 'the') AS contains, regexp_matches(t.text, '[0-9]{{4}}') AS regex, d.doc_id % 2 = 0 AS has_table, d.doc_id % 3 = 0 AS has_signature, d.doc_id % 5 = 0 AS has_form,
      math > 0 AS math, bullets >= 1 AS bullets, n_pages BETWEEN 1 AND 2 AS pages, fonts >= 1 AS fonts, sizes >= 2 AS heading_depth, density <= 2000 AS density, footers AS footer_numbers,
      ((contains(lower(t.text), 'the'))::INT * 2 + (sizes >= 2)::INT + (density <= 2000)::INT * 3)::DOUBLE / 6 >= 0.6 AS is_prose
    FROM d JOIN f ON d.doc_id = f.doc_id JOIN documents t ON t.doc_id = d.doc_id""",
)
def all_weighted_predicates(spark, sf_dir):
    """Each of the twelve kinds over documents' own signals, and a class that three of them weigh."""
    s = profiles.feature_signals(virtual_pages.lines(_docs(spark, sf_dir)))
    k = F.col("doc_id")
    s = s.withColumns({"has_table": k % 2 == 0, "has_signature": k % 3 == 0, "has_form": k % 5 == 0})
    values = {"contains": "THE", "regex": "[0-9]{4}", "has_table": True, "has_signature": True, "has_form": True, "math": True, "bullets": 1, "pages": (1, 2), "fonts": (1, None), "heading_depth": (2, None), "density": (None, 2000), "footer_numbers": True}
    p = profiles.weighted_predicate
    prose = (0.6, [(p("contains", "THE"), 2.0), (p("heading_depth", (2, None)), 1.0), (p("density", (None, 2000)), 3.0)])
    got = profiles.weighted_classify(s, {"prose": prose})
    return got.select("doc_id", *(p(name, v).alias(name) for name, v in values.items()), (F.col("class") == "prose").alias("is_prose"))


@register("perceptual_hashes")
def perceptual_hashes(spark, sf_dir):
    """Embeddings as bitmaps of their signs, hashed by low-frequency cosine parts, which SQL lacks."""
    e = table(spark, sf_dir, "embeddings")
    return glyphs.perceptual_hashes(e.select("vec_id", F.transform("embedding", lambda x: F.when(x > 0, 1).otherwise(0)).alias("bitmap")))


@register(
    "canonical_options",
    """SELECT p_partkey, '{"a":{"y":[1,' || p_size || ',null],"z":"' || p_brand || '"},"b":' || p_size || ',"c":true}' AS options FROM part""",
)
def canonical_options(spark, sf_dir):
    """Nested options whose keys stand in one order or the other, with white space, in one form."""
    size, brand = F.col("p_size").cast("string"), F.col("p_brand")
    one = F.concat(F.lit('{ "c": true,\n "b": '), size, F.lit(', "a": {"z": "'), brand, F.lit('", "y": [ 1, '), size, F.lit(", null]}}"))
    other = F.concat(F.lit('{"a":{"y":[1,'), size, F.lit(',null],"z":"'), brand, F.lit('"},"c":true,"b":'), size, F.lit("}"))
    text = F.when(F.col("p_partkey") % 2 == 0, one).otherwise(other)
    return table(spark, sf_dir, "part").select("p_partkey", receipts.canonical_json(text).alias("options"))


@register(
    "listed_words",
    r"""WITH list AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS w FROM benchmark), words AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS word FROM documents)
    SELECT doc_id, count(*) AS n FROM words WHERE lower(word) IN (SELECT w FROM list) GROUP BY doc_id""",
)
def listed_words(spark, sf_dir):
    """How many words of each document stand in a word list, here that of the benchmark's texts."""
    words = lambda name, *keep: table(spark, sf_dir, name).select(*keep, F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0))).alias("word"))
    return quality.in_word_list(words("documents", "doc_id"), words("benchmark")).groupBy("doc_id").agg(F.count("*").alias("n"))
