"""Queries of text repairs, glyph lookups, sinks and diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelane.functions import scalars
from quirelane.operators import cmaps, codespace, diagnostics, glyphs, merged_cells, ocr, repair, tables
from quirelane.plans.registry import register
from quirelane.plans.sqlparts import LINES
from quirelane.session import spread, table
from quirelane.sources import sinks, virtual_pages


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@register("mojibake_repair", "SELECT doc_id, md5(text) AS h FROM documents WHERE contains(text, 'é')")
def mojibake_repair(spark, sf_dir):
    """Texts whose UTF-8 was read as a single-byte code page come back as they were."""
    high = "".join(chr(c) for c in range(0x80, 0xA0))
    broken = F.translate(F.decode(F.encode("text", "UTF-8"), "ISO-8859-1"), high, repair._HIGH)
    return _docs(spark, sf_dir).where(F.col("text").contains("é")).select("doc_id", broken.alias("text")).select("doc_id", F.md5(repair.mojibake_repaired(F.col("text"))).alias("h"))


@register(
    "hyphen_repair",
    f"""WITH {LINES}, cut AS (SELECT doc_id, page_index, line_no, CASE WHEN line_no % 2 = 0 THEN regexp_replace(text, '.$', '') || 'a-' ELSE 'tion' || text END AS text FROM lines),
    m AS (SELECT *, coalesce(regexp_matches(text, '[A-Za-z]-$') AND regexp_matches(lead(text) OVER w, '^[a-z]'), false) AS j, lead(text) OVER w AS below FROM cut WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY line_no)),
    a AS (SELECT *, coalesce(lag(j) OVER (PARTITION BY doc_id, page_index ORDER BY line_no), false) AS above FROM m),
    b AS (SELECT *, CASE WHEN above THEN regexp_replace(text, '^\\S+\\s*', '') ELSE text END AS body FROM a)
    SELECT doc_id, line_no, CASE WHEN j THEN regexp_replace(body, '-$', '') || regexp_extract(below, '^\\S+') ELSE body END AS text FROM b""",
)
def hyphen_repair(spark, sf_dir):
    t = F.when(F.col("line_no") % 2 == 0, F.concat(F.regexp_replace("text", ".$", ""), F.lit("a-"))).otherwise(F.concat(F.lit("tion"), "text"))
    ln = virtual_pages.lines(_docs(spark, sf_dir)).select("doc_id", "page_index", "line_no", t.alias("text"))
    return repair.hyphens_joined(ln).select("doc_id", "line_no", "text")


@register("ligature_repair", "SELECT doc_id, md5(replace(text, 'fi', 'fi')) AS h FROM documents")
def ligature_repair(spark, sf_dir):
    broken = F.replace("text", F.lit("fi"), F.lit("f�i"))
    return _docs(spark, sf_dir).select("doc_id", F.md5(repair.ligatures_joined(broken)).alias("h"))


@register("redacted_errors", "SELECT page_id, 'GET ' || replace(url, '://', '://***@') || ' authorization: ***' AS message FROM pages")
def redacted_errors(spark, sf_dir):
    m = F.concat(F.lit("GET "), F.replace("url", F.lit("://"), F.lit("://user:pw@")), F.lit(" authorization: abc123"))
    return table(spark, sf_dir, "pages").select("page_id", scalars.redact_credentials(m).alias("message"))


@register("code_languages", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'rust' WHEN 2 THEN 'sql' END AS lang FROM orders")
def code_languages(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    code = F.when(k == 0, "#!/usr/bin/env python\nx").when(k == 1, "fn main() { }").when(k == 2, "select a from b").otherwise("words")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.code_language(code).alias("lang"))


# ---- glyphs


@register(
    "unicode_resolution",
    """SELECT p_partkey AS code, CASE WHEN p_partkey % 2 = 0 THEN 'm' WHEN p_partkey % 3 = 0 THEN 'e' WHEN p_partkey % 5 = 0 THEN 'f' ELSE chr(65533) END AS text,
      CASE WHEN p_partkey % 2 = 0 THEN 1.0 WHEN p_partkey % 3 = 0 THEN 0.9 WHEN p_partkey % 5 = 0 THEN 0.85 ELSE 0.0 END::DOUBLE AS confidence FROM part""",
)
def unicode_resolution(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lit(1).alias("font_id"), F.lit("h").alias("font_hash"), F.col("p_partkey").alias("code"), F.col("p_partkey").alias("glyph_id"))
    maps = p.where("code % 2 = 0").select("font_id", "code", F.lit("m").alias("text"))
    enc = p.where("code % 3 = 0").select("font_id", "code", F.lit("g").alias("glyph_name"))
    names = spark.createDataFrame([("g", "e")], "glyph_name string, text string")
    prints = p.where("code % 5 = 0").select("font_hash", "glyph_id", F.lit("f").alias("text"))
    return glyphs.resolve(p, maps, enc, names, prints).select("code", "text", "confidence")


@register(
    "nearest_shapes",
    """WITH s AS (SELECT p_partkey AS shape_id, (p_partkey * 2654435761 % 4294967296)::BIGINT AS hash FROM part), k AS (SELECT hash # (1::BIGINT << (shape_id % 32)::INT) # 5 AS known_hash FROM s WHERE shape_id % 3 = 0)
    SELECT shape_id, min(bit_count(xor(s.hash, k.known_hash)))::INT AS distance FROM s, k WHERE bit_count(xor(s.hash, k.known_hash)) <= 8 GROUP BY shape_id""".replace("hash # (1::BIGINT << (shape_id % 32)::INT) # 5", "xor(xor(hash, 1::BIGINT << (shape_id % 32)::INT), 5)"),
)
def nearest_shapes(spark, sf_dir):
    k = F.col("p_partkey").cast("long")
    s = table(spark, sf_dir, "part").select(k.alias("shape_id"), ((k * F.lit(2654435761)) % F.lit(4294967296)).alias("hash"))
    known = s.where("shape_id % 3 = 0").select(F.expr("hash ^ shiftleft(1L, cast(shape_id % 32 as int)) ^ 5L").alias("hash"), F.lit("x").alias("text"))
    return glyphs.nearest_shape(s, known).select("shape_id", "distance")


@register(
    "colours",
    """SELECT l_orderkey, l_linenumber, '#' || repeat(lower(lpad(to_hex(floor(l_discount * 255 + 0.5)::INT), 2, '0')), 3) AS gray FROM lineitem""",
)
def colours(spark, sf_dir):
    part = F.array(F.col("l_discount").cast("double"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", glyphs.rgb(F.lit("gray"), part).alias("gray"))


@register("font_sources", "SELECT l_linenumber AS n, CASE WHEN l_linenumber % 4 = 0 THEN 'native' WHEN l_linenumber % 4 = 1 THEN 'heuristic' WHEN l_linenumber % 4 = 2 THEN 'heuristic' ELSE 'ocr' END AS source, count(*) AS total FROM lineitem GROUP BY ALL")
def font_sources(spark, sf_dir):
    n = F.col("l_linenumber")
    src = F.when(n % 4 == 0, "map").when(n % 4 == 1, "shape").when(n % 4 == 2, "map").otherwise("engine")
    return table(spark, sf_dir, "lineitem").groupBy(n.alias("n"), glyphs.source_confidence(src, n % 4 == 2).alias("source")).agg(F.count("*").alias("total"))


# ---- merged cells, recognition settings


@register("merged_cells")
def merge_cells(spark, sf_dir):
    """Grids whose middle rule is short; growing rectangles have no SQL form."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(0).alias("page_index"))
    rule = lambda kind, pos, lo, hi: F.struct(F.lit(kind).alias("orientation"), F.lit(float(pos)).alias("pos"), F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"))
    rules = [rule("h", y, 0, 300) for y in (0, 100, 200)] + [rule("v", 0, 0, 200), rule("v", 300, 0, 200), rule("v", 100, 0, 200), rule("v", 200, 0, 95)]
    seg = o.select("doc_id", "page_index", F.explode(F.array(*rules)).alias("r")).select("doc_id", "page_index", "r.*")
    v = seg.where("orientation = 'v'").select("doc_id", "page_index", F.col("pos").alias("x"))
    h = seg.where("orientation = 'h'").select("doc_id", "page_index", F.col("pos").alias("y"))
    # the fold joins two tables of one origin: the rules go by names of their own
    rules_of = seg.select(*(F.col(c).alias(c) for c in seg.columns))
    return merged_cells.merge(tables.cells(tables.grids(v.join(h, ["doc_id", "page_index"]).distinct())), rules_of)


@register("ocr_resolution", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 150 WHEN p_partkey % 2 = 0 THEN 200 WHEN p_size < 7 THEN 400 ELSE 300 END AS dpi FROM part")
def ocr_resolution(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", ocr.resolution(F.when(F.col("p_size") == 1, 150), F.col("p_partkey") % 2 == 0, F.col("p_size")).alias("dpi"))


# ---- sinks and diagnostics


@register("svg_overlays", f"WITH {LINES} SELECT doc_id, page_index, 1 AS n_groups, count(*) AS n_rects FROM lines GROUP BY ALL")
def svg_overlays(spark, sf_dir):
    s = sinks.svg_overlay(virtual_pages.lines(_docs(spark, sf_dir)).withColumn("layer", F.lit("lines")), 612, 792)
    n = lambda tag: F.regexp_count("svg", F.lit(f"<{tag} "))
    return s.select("doc_id", "page_index", n("g").alias("n_groups"), n("rect").cast("long").alias("n_rects"))


@register("open_metrics", """SELECT 'orders_total{status="' || o_orderstatus || '",priority="' || o_orderpriority || '"} ' || count(*) AS value FROM orders GROUP BY o_orderstatus, o_orderpriority""")
def open_metrics(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("total"))
    return sinks.open_metrics(c, "orders", ["status", "priority"])


@register("match_events", f"""WITH {LINES} SELECT '{{"event":"match","doc_id":' || doc_id || ',"line_no":' || line_no || '}}' AS value FROM lines WHERE contains(text, 'token')""")
def match_events(spark, sf_dir):
    return sinks.match_events(virtual_pages.lines(_docs(spark, sf_dir)).where(F.col("text").contains("token")), "doc_id", "line_no")


@register("diagnostic_counts", "SELECT CASE WHEN event_type = 'error' THEN 'error' ELSE 'info' END AS severity, count(*) AS n FROM events GROUP BY 1")
def diagnostic_counts(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "unreadable").otherwise(F.col("event_type")).alias("code"))
    return diagnostics.with_policy(e).groupBy("severity").agg(F.count("*").alias("n"))


@register("unmapped_glyphs", "SELECT l_orderkey, l_linenumber, 'F' || l_linenumber AS font, l_linenumber * 10 AS code, l_suppkey AS page FROM lineitem")
def unmapped_glyphs(spark, sf_dir):
    n = F.col("l_linenumber")
    m = F.concat(F.lit("unmapped glyph font=F"), n.cast("string"), F.lit(" code=0x"), F.hex(n * 10), F.lit(" page="), F.col("l_suppkey").cast("string"))
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", diagnostics.unmapped_glyph(m).alias("g"))
    return d.select("l_orderkey", "l_linenumber", "g.font", "g.code", "g.page")


_FONTS = [("utf8", "00", "7F"), ("utf8", "C280", "DFBF"), ("utf8", "E08080", "EFBFBF"), ("utf8", "F0808080", "F7BFBFBF"), ("plain", "00", "7F"), ("pairs", "0000", "FFFF")]


@register(
    "codespace_codes",
    """WITH d AS (SELECT doc_id, doc_id % 4 AS f, length(text) AS n, strlen(text) AS b, length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS plain FROM documents)
    SELECT doc_id, CASE f WHEN 0 THEN n WHEN 2 THEN (b + 1) // 2 ELSE b END::BIGINT AS n_codes, CASE f WHEN 1 THEN b - plain WHEN 2 THEN b % 2 ELSE 0 END::BIGINT AS n_unknown FROM d""",
)
def codespace_codes(spark, sf_dir):
    """Texts as strings of four fonts: UTF-8's own ranges, ASCII alone, pairs of bytes, and none."""
    kind = F.element_at(F.array(*(F.lit(x) for x in ("utf8", "plain", "pairs", "none"))), (F.col("doc_id") % 4 + 1).cast("int"))
    strings = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", kind.alias("font"), F.encode("text", "UTF-8").alias("bytes"))
    ranges = spark.createDataFrame([(f, bytes.fromhex(lo), bytes.fromhex(hi)) for f, lo, hi in _FONTS], "font string, lo binary, hi binary")
    got = codespace.tokenised(strings, ranges, give=["codes", "unknown"])
    return got.select("doc_id", F.size("codes").cast("long").alias("n_codes"), F.size(F.filter("unknown", lambda u: u)).cast("long").alias("n_unknown"))


@register(
    "cmap_texts",
    """WITH d AS (SELECT doc_id, ('0' || right(source, 1))::INTEGER AS k, text, regexp_replace(text, '[^\\x00-\\x7F]', '', 'g') AS plain FROM documents)
    SELECT doc_id, md5(replace(translate(text, 'abcdefghijklmnopqrstuvwxyz', substr('abcdefghijklmnopqrstuvwxyzabcdefghijklmnopqrstuvwxyz', k + 1, 26)), 'é', 'fi')) AS h
    FROM d WHERE length(plain) = length(replace(text, 'é', ''))""",
)
def cmap_texts(spark, sf_dir):
    """Texts of ASCII and é as strings of their source's font, whose map turns the alphabet and makes é a ligature of two letters."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    k = F.right("source", F.lit(1)).cast("int")
    h = lambda c: F.hex(c.cast("long"))
    program = F.concat(
        F.lit("% a map\n1 begincodespacerange <00> <7F> endcodespacerange\n1 begincodespacerange <8000> <FFFF> endcodespacerange\n3 beginbfrange\n<00> <60> <0000>\n<61> <"),
        h(122 - k), F.lit("> <00"), h(97 + k), F.lit(">\n<7B> <7F> <007B> % rest\nendbfrange\n"),
        F.when(k > 0, F.concat(F.lit("1 beginbfrange <"), h(123 - k), F.lit("> <7A> <0061> endbfrange\n"))).otherwise(F.lit("")),
        F.lit("1 beginbfchar <C3A9> <00660069> endbfchar"),
    )
    fonts = docs.select(F.col("source").alias("font"), program.alias("cmap")).distinct()
    strings = docs.where(F.col("text").rlike("^[\\x00-\\x7Fé]*$")).select("doc_id", F.col("source").alias("font"), F.encode("text", "UTF-8").alias("bytes"))
    tokens = codespace.tokenised(strings, cmaps.codespaces(fonts), give=["parts"])
    got = cmaps.decoded(tokens, cmaps.mappings(fonts), "doc_id").where("unmapped = 0")
    return got.select("doc_id", F.md5("text").alias("h"))
