"""Queries of block kinds, quality, page classes, search, profiles and extractors."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelane.functions import geometry, scalars
from quirelane.operators import blocks, documents, ocr, page_class, profiles, quality, reading, search, tables
from quirelane.plans.registry import register
from quirelane.plans.sqlparts import LINES, WORDS
from quirelane.session import spread, table
from quirelane.sources import virtual_pages


def _docs(spark, sf_dir, *columns):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text", *columns))


def _lines(spark, sf_dir):
    return virtual_pages.lines(_docs(spark, sf_dir))


# ---- block kinds


@register(
    "headings",
    f"""WITH {LINES} SELECT doc_id, page_index, line_no, size, page_size FROM (
      SELECT *, median(size) OVER (PARTITION BY doc_id, page_index) AS page_size FROM lines) WHERE size / page_size > 1.2""",
)
def headings(spark, sf_dir):
    return blocks.headings(_lines(spark, sf_dir).withColumn("n_lines", F.lit(1))).select("doc_id", "page_index", "line_no", "size", "page_size")


@register(
    "list_blocks",
    f"""WITH {LINES}, marked AS (SELECT doc_id, page_index, regexp_matches(CASE WHEN line_no % 3 = doc_id % 3 THEN '- ' || text WHEN doc_id % 2 = 0 THEN '1. ' || text ELSE text END, '^\\s*[-*•‣◦⁃]\\s|^\\s*[0-9]+[.)]\\s') AS hit FROM lines)
    SELECT doc_id, page_index, avg(hit::INT)::DOUBLE AS share, avg(hit::INT) >= 0.8 AS is_list FROM marked GROUP BY ALL""",
)
def list_blocks(spark, sf_dir):
    text = F.when(F.col("line_no") % 3 == F.col("doc_id") % 3, F.concat(F.lit("- "), "text")).when(F.col("doc_id") % 2 == 0, F.concat(F.lit("1. "), "text")).otherwise(F.col("text"))
    return blocks.is_list(_lines(spark, sf_dir).withColumn("text", text), ["doc_id", "page_index"])


@register(
    "code_blocks",
    f"""WITH {WORDS}, moved AS (SELECT * REPLACE (x0 + CASE WHEN line_no % 4 = 1 THEN 24 ELSE 0 END AS x0) FROM words),
    ind AS (SELECT *, x0 - min(x0) OVER (PARTITION BY doc_id, page_index) AS indent FROM moved)
    SELECT doc_id, page_index, line_no, bool_and(regexp_matches(lower(regexp_replace(font, '^[A-Z]{{6}}\\+', '')), 'mono|courier|code|fixed|console')) AND min(indent) >= 2 * min(size) AS is_code
    FROM ind GROUP BY ALL""",
)
def code_blocks(spark, sf_dir):
    w = virtual_pages.words(_docs(spark, sf_dir))
    w = w.withColumn("x0", F.col("x0") + F.when(F.col("line_no") % 4 == 1, 24).otherwise(0))
    return blocks.is_code(w, ["doc_id", "page_index", "line_no"])


_FOOTED = """base AS (SELECT DISTINCT doc_id, page_index FROM lines), zoned AS (
  SELECT doc_id, page_index, 0 AS block_index, 'header' AS zone, 'Annual report of company ' || (doc_id % 7) AS text, 72.0 AS x0, 750.0 AS y0, 540.0 AS x1, 770.0 AS y1 FROM base
  UNION ALL SELECT doc_id, page_index, 1, 'footer', 'Page ' || page_index || ' of the long annual report number ' || (page_index // 3), 72.0, 20.0, 540.0, 34.0 FROM base)"""


def _zone_blocks(spark, sf_dir):
    pages = _lines(spark, sf_dir).select("doc_id", "page_index").distinct()
    box = lambda y0, y1: [F.lit(72.0).alias("x0"), F.lit(y0).alias("y0"), F.lit(540.0).alias("x1"), F.lit(y1).alias("y1")]
    head = F.concat(F.lit("Annual report of company "), (F.col("doc_id") % 7).cast("string"))
    foot = F.concat(F.lit("Page "), F.col("page_index").cast("string"), F.lit(" of the long annual report number "), F.floor(F.col("page_index") / 3).cast("string"))
    top = pages.select("doc_id", "page_index", F.lit(0).alias("block_index"), head.alias("text"), *box(750.0, 770.0))
    return top.unionByName(pages.select("doc_id", "page_index", F.lit(1).alias("block_index"), foot.alias("text"), *box(20.0, 34.0)))


@register(
    "headers_and_footers",
    f"""WITH {LINES}, {_FOOTED}, pairs AS (
      SELECT a.doc_id, a.page_index, a.zone, b.page_index - a.page_index AS step, a.block_index, b.block_index AS other FROM zoned a JOIN zoned b
      ON a.doc_id = b.doc_id AND a.zone = b.zone AND b.page_index - a.page_index BETWEEN 1 AND 3 AND levenshtein(a.text, b.text) <= 0.05 * greatest(length(a.text), length(b.text))
    ), runs AS (
      SELECT doc_id, page_index, zone, block_index, 1 + max((step = 1)::INT) + (bool_or(step = 1) AND bool_or(step = 2))::INT + (bool_or(step = 1) AND bool_or(step = 2) AND bool_or(step = 3))::INT AS len FROM pairs GROUP BY ALL
    )
    SELECT DISTINCT doc_id, (page_index + i)::INT AS page_index, block_index, zone FROM runs, unnest(range(0, len)) AS u(i) WHERE len >= 3""",
)
def headers_and_footers(spark, sf_dir):
    return blocks.headers_and_footers(_zone_blocks(spark, sf_dir))


# ---- text scalars


@register(
    "script_detection",
    """SELECT doc_id, CASE WHEN text = '' THEN 'unknown' WHEN len(regexp_extract_all(text, '[\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}]')) >= 3 THEN 'arabic' ELSE 'latin' END AS script FROM documents""",
)
def script_detection(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", scalars.script_of(F.col("text")).alias("script"))


@register(
    "zero_width",
    "SELECT doc_id, length(replace(replace(text, 'e', chr(8203)), chr(8203), '')) AS n FROM documents",
)
def zero_width(spark, sf_dir):
    t = F.replace(F.col("text"), F.lit("e"), F.lit("​"))
    return _docs(spark, sf_dir).select("doc_id", F.char_length(scalars.zero_width(t)).alias("n"))


@register(
    "mojibake_suspects",
    """SELECT doc_id, len(regexp_extract_all(t, 'Ã[©¨ª®´»¢§±£º\\x{00AD}³¡€]')) + len(regexp_extract_all(t, 'Â[^\\x00-\\x7F]')) AS n
    FROM (SELECT doc_id, replace(replace(text, 'é', 'Ã©'), 'ñ', 'Ã±') AS t FROM documents)""",
)
def mojibake_suspects(spark, sf_dir):
    t = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("Ã©")), F.lit("ñ"), F.lit("Ã±"))
    return _docs(spark, sf_dir).select("doc_id", scalars.mojibake_count(t).alias("n"))


@register("markdown_escape", r"""SELECT doc_id, md5(regexp_replace(text, '([\\`*_{}\[\]()#+!|<>~])', '\\\1', 'g')) AS h FROM documents""")
def markdown_escape(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(scalars.markdown_escape(F.col("text"))).alias("h"))


@register("link_targets", "SELECT page_id, replace(replace(replace(url, ' ', '%20'), '(', '%28'), ')', '%29') AS target FROM pages")
def link_targets(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.link_target(F.col("url")).alias("target"))


_ROMAN = """array_to_string([
  repeat('M', (n // 1000)::INT), ['', 'C', 'CC', 'CCC', 'CD', 'D', 'DC', 'DCC', 'DCCC', 'CM'][(n // 100) % 10 + 1],
  ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][(n // 10) % 10 + 1], ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1]], '')"""


@register(
    "page_labels",
    f"""SELECT n AS o_custkey, CASE n % 5 WHEN 0 THEN n::VARCHAR WHEN 1 THEN {_ROMAN} WHEN 2 THEN lower({_ROMAN})
      WHEN 3 THEN upper(CASE WHEN n > 702 THEN chr(97 + (((n - 703) // 676) % 26)::INT) ELSE '' END || CASE WHEN n > 26 THEN chr(97 + (((n - 27) // 26) % 26)::INT) ELSE '' END || chr(97 + ((n - 1) % 26)::INT)) ELSE '' END AS label
    FROM (SELECT DISTINCT o_custkey AS n FROM orders)""",
)
def page_labels(spark, sf_dir):
    n = F.col("o_custkey")
    style = F.when(n % 5 == 0, "D").when(n % 5 == 1, "R").when(n % 5 == 2, "r").when(n % 5 == 3, "A")
    d = table(spark, sf_dir, "orders").select("o_custkey").distinct()
    return d.select("o_custkey", scalars.page_label(style, F.lit(""), n).alias("label"))


@register(
    "pdf_dates",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || 'T10:20:30+02:00' AS iso FROM orders""",
)
def pdf_dates(spark, sf_dir):
    text = F.concat(F.lit("D:"), F.date_format("o_orderdate", "yyyyMMdd"), F.lit("102030+02'00'"))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.pdf_date_iso(text).alias("iso"))


@register(
    "public_urls",
    r"""SELECT page_id, starts_with(url, 'https://') AND NOT regexp_matches(url, '^https://[^/?#]*\.(local|internal)([/:?#]|$)') AS ok FROM pages""",
)
def public_urls(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.is_public_url(F.col("url")).alias("ok"))


@register("currency_documents", "SELECT count(*) AS n FROM documents WHERE regexp_matches(text, '[$€£¥]\\s?[0-9]')")
def currency_documents(spark, sf_dir):
    return _docs(spark, sf_dir).where(scalars.has_currency(F.col("text"))).agg(F.count("*").alias("n"))


@register(
    "typed_fields",
    """SELECT l_orderkey, l_linenumber, l_extendedprice::DOUBLE AS amount, l_returnflag = 'R' AS returned FROM lineitem""",
)
def typed_fields(spark, sf_dir):
    text = F.concat(F.lit("$ "), F.format_number(F.col("l_extendedprice").cast("decimal(18,2)"), 2))
    flag = F.when(F.col("l_returnflag") == "R", "Yes").otherwise("no")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", scalars.typed_decimal(text).alias("amount"), scalars.typed_bool(flag).alias("returned"))


# ---- readability and quality

_READABLE = """scored AS (SELECT doc_id, page_index, line_no, length(text) AS n_chars, CASE WHEN text = '' THEN 0.0 ELSE round(
   0.35 * (1 - len(regexp_extract_all(text, '[\\x00-\\x1F\\x7F-\\x{009F}\\x{FFFD}]')) / length(text)) + 0.30
   + CASE WHEN len(regexp_extract_all(text, '[ \\t]')) / length(text) BETWEEN 0.05 AND 0.40 THEN 0.15 ELSE 0 END + 0.10
   + 0.10 * least(1.0, confidence / 0.6), 6) END::DOUBLE AS score FROM lines)"""


def _scored(spark, sf_dir):
    s = F.round(scalars.readability(F.col("text"), F.col("confidence")), 6)
    return _lines(spark, sf_dir).select("doc_id", "page_index", "line_no", F.char_length("text").alias("n_chars"), s.alias("score"))


@register("span_readability", f"WITH {LINES}, {_READABLE} SELECT * FROM scored")
def span_readability(spark, sf_dir):
    return _scored(spark, sf_dir)


@register(
    "page_readability",
    f"""WITH {LINES}, {_READABLE}, d AS (SELECT doc_id, page_index, score, sum(n_chars) AS w FROM scored GROUP BY ALL),
    r AS (SELECT *, sum(w) OVER (PARTITION BY doc_id, page_index ORDER BY score) AS run, sum(w) OVER (PARTITION BY doc_id, page_index) AS total FROM d)
    SELECT doc_id, page_index, min(score) AS score FROM r WHERE run > total // 2 GROUP BY ALL""",
)
def page_readability(spark, sf_dir):
    return quality.weighted_median(_scored(spark, sf_dir), ["doc_id", "page_index"])


_SIGNALS = """signals AS (SELECT doc_id, page_index, CASE WHEN (doc_id + page_index) % 9 = 0 THEN 0 ELSE count(*) END AS text_ops,
    CASE WHEN (doc_id + page_index) % 9 = 0 THEN 0 WHEN doc_id % 7 = 0 THEN count(*) ELSE 0 END AS invisible_ops,
    ((doc_id + page_index) % 11) / 10.0::DOUBLE AS image_share, ((doc_id + page_index) % 11) / 10.0 >= 0.95 AS full_page_image,
    CASE WHEN (doc_id + page_index) % 9 = 0 THEN 0 ELSE sum(length(text)) END AS chars, CASE WHEN (doc_id + page_index) % 9 = 0 THEN 0 ELSE sum(length(text)) * (doc_id % 10) // 10 END AS valid_chars,
    (doc_id % 7) / 20.0::DOUBLE AS density_ratio, 484704.0 AS page_area, (doc_id % 20) AS vector_cells, (page_index + doc_id) % 17 AS scanned_cells FROM lines GROUP BY doc_id, page_index)"""


def _signals(spark, sf_dir):
    k = F.col("doc_id") + F.col("page_index")
    empty = k % 9 == 0
    g = _lines(spark, sf_dir).groupBy("doc_id", "page_index").agg(F.count("*").alias("n"), F.sum(F.char_length("text")).alias("c"))
    return g.select(
        "doc_id",
        "page_index",
        F.when(empty, 0).otherwise(F.col("n")).alias("text_ops"),
        F.when(empty, 0).when(F.col("doc_id") % 7 == 0, F.col("n")).otherwise(0).alias("invisible_ops"),
        ((k % 11) / F.lit(10.0)).alias("image_share"),
        ((k % 11) / F.lit(10.0) >= 0.95).alias("full_page_image"),
        F.when(empty, 0).otherwise(F.col("c")).alias("chars"),
        F.when(empty, 0).otherwise(F.floor(F.col("c") * (F.col("doc_id") % 10) / 10)).alias("valid_chars"),
        ((F.col("doc_id") % 7) / F.lit(20.0)).alias("density_ratio"),
        F.lit(484704.0).alias("page_area"),
        (F.col("doc_id") % 20).alias("vector_cells"),
        (k % 17).alias("scanned_cells"),
    )


_CLASSED = _SIGNALS + """, votes AS (SELECT *, chars = 0 AND image_share = 0 AS blank, vector_cells >= 10 AND scanned_cells >= 10 AS hybrid,
     coalesce(text_ops = 0 AND image_share > 0, false) AS s1, coalesce(text_ops > 0 AND invisible_ops = text_ops AND full_page_image, false) AS s2,
     CASE WHEN image_share > 0.85 THEN 0.85 ELSE 0 END::DOUBLE AS s3, coalesce(text_ops > 0 AND density_ratio < 0.03, false) AS s5, CASE WHEN text_ops > 0 AND chars > 0 AND valid_chars / chars < 0.4 THEN 0.8 ELSE 0 END::DOUBLE AS b1,
     CASE WHEN text_ops > 0 AND (chars = 0 OR valid_chars / chars > 0.85) THEN 0.9 ELSE 0 END::DOUBLE AS v1, CASE WHEN NOT (text_ops > 0 AND (chars = 0 OR valid_chars / chars > 0.85)) AND valid_chars / page_area < 0.03 THEN 0.65 ELSE 0 END::DOUBLE AS s4 FROM signals),
  classed AS (SELECT doc_id, page_index, chars, image_share,
     CASE WHEN blank THEN 'vector' WHEN hybrid THEN 'hybrid' WHEN s1 THEN 'scanned' WHEN s2 THEN 'broken_vector' WHEN s5 THEN 'scanned' WHEN s3 + s4 + b1 + v1 = 0 THEN 'vector'
       WHEN v1 >= s3 + s4 AND v1 >= b1 THEN 'vector' WHEN s3 + s4 >= b1 THEN 'scanned' ELSE 'broken_vector' END AS page_class,
     round(CASE WHEN blank THEN 0 WHEN hybrid THEN least(vector_cells, scanned_cells) / 64 WHEN s1 THEN 0.95 WHEN s2 THEN 0.99 WHEN s5 THEN 0.95 WHEN s3 + s4 + b1 + v1 = 0 THEN 0.5
       ELSE greatest(v1, s3 + s4, b1) / (s3 + s4 + b1 + v1) END, 6)::DOUBLE AS class_confidence FROM votes)"""


@register("page_classes", f"WITH {LINES}, {_CLASSED} SELECT doc_id, page_index, page_class, class_confidence FROM classed")
def page_classes(spark, sf_dir):
    c = page_class.classify(_signals(spark, sf_dir))
    return c.select("doc_id", "page_index", "page_class", F.round("class_confidence", 6).alias("class_confidence"))


@register(
    "page_types",
    f"""WITH {LINES}, {_CLASSED} SELECT CASE WHEN chars = 0 AND image_share = 0 THEN 'blank' WHEN chars = 0 AND page_class = 'vector' THEN 'figure_only' WHEN page_class = 'vector' THEN 'text'
      WHEN page_class = 'hybrid' THEN 'mixed' ELSE page_class END AS page_type, count(*) AS n FROM classed GROUP BY 1""",
)
def page_types(spark, sf_dir):
    c = page_class.classify(_signals(spark, sf_dir))
    return c.groupBy(page_class.page_type(F.col("page_class"), F.col("chars"), F.col("image_share")).alias("page_type")).agg(F.count("*").alias("n"))


@register(
    "document_quality",
    f"""WITH {LINES}, {_CLASSED} SELECT doc_id, CASE WHEN sum(chars) = 0 THEN 'none' WHEN avg((page_class = 'scanned')::INT) > 0.5 THEN 'low' WHEN avg((page_class = 'broken_vector')::INT) > 0.3 THEN 'medium' ELSE 'high' END AS overall,
      round(avg((page_class = 'scanned')::INT), 6) AS scanned_share, round(min(class_confidence), 6) AS least_confidence FROM classed GROUP BY doc_id""",
)
def document_quality(spark, sf_dir):
    c = page_class.classify(_signals(spark, sf_dir)).withColumns({"n_chars": F.col("chars"), "confidence": F.round("class_confidence", 6)})
    return quality.roll_up(c).select("doc_id", "overall", F.round("scanned_share", 6).alias("scanned_share"), F.round("least_confidence", 6).alias("least_confidence"))


# ---- search


@register(
    "grep_matches",
    r"""SELECT doc_id, len(regexp_extract_all(text, '[Tt]h[ea]n?')) AS n, list_aggregate(regexp_extract_all(text, '[Tt]h[ea]n?'), 'string_agg', ',') AS found FROM documents WHERE regexp_matches(text, '[Tt]h[ea]n?')""",
)
def grep_matches(spark, sf_dir):
    g = search.grep(_docs(spark, sf_dir), "[Tt]h[ea]n?")
    rows = F.array_sort(F.collect_list(F.struct("start", "match")))
    return g.groupBy("doc_id").agg(F.count("*").cast("long").alias("n"), F.array_join(F.transform(rows, lambda r: r["match"]), ",").alias("found"))


@register("grep_files_with_matches", "SELECT DISTINCT doc_id FROM documents WHERE contains(lower(text), 'token')")
def grep_files_with_matches(spark, sf_dir):
    return _docs(spark, sf_dir).where(F.lower("text").contains("token")).select("doc_id").distinct()


@register("grep_inverted", f"WITH {LINES} SELECT doc_id, page_index, line_no FROM lines WHERE NOT contains(text, 'the')")
def grep_inverted(spark, sf_dir):
    return _lines(spark, sf_dir).where(~F.col("text").contains("the")).select("doc_id", "page_index", "line_no")


@register("grep_whole_word", r"SELECT doc_id, len(regexp_extract_all(' ' || replace(text, ' ', '  ') || ' ', '[^A-Za-z0-9_]the[^A-Za-z0-9_]')) AS n FROM documents")
def grep_whole_word(spark, sf_dir):
    n = F.regexp_count("text", F.lit("(?<![A-Za-z0-9_])the(?![A-Za-z0-9_])")).cast("long")
    return _docs(spark, sf_dir).select("doc_id", n.alias("n"))


@register("grep_by_page", f"WITH {LINES} SELECT doc_id, page_index, sum(len(regexp_extract_all(text, 'tion')))::BIGINT AS n FROM lines WHERE contains(text, 'tion') GROUP BY ALL")
def grep_by_page(spark, sf_dir):
    n = F.sum(F.regexp_count("text", F.lit("tion"))).cast("long")
    return _lines(spark, sf_dir).where(F.col("text").contains("tion")).groupBy("doc_id", "page_index").agg(n.alias("n"))


@register("grep_max_results", f"WITH {LINES} SELECT doc_id, line_no FROM lines WHERE contains(text, 'tion') ORDER BY doc_id, line_no LIMIT 50")
def grep_max_results(spark, sf_dir):
    return _lines(spark, sf_dir).where(F.col("text").contains("tion")).select("doc_id", "line_no").orderBy("doc_id", "line_no").limit(50)


# ---- profiles


_PROFILES = [
    profiles.Profile("secretive", {"all": [{"text_matches": "token ?="}], "none": [{"text_contains": ["License"]}]}, 5),
    profiles.Profile("licensed", {"any": [{"text_contains": ["mit license", "apache license"]}, {"text_matches": "CC BY"}]}, 3),
    profiles.Profile("loud", {"all": [{"text_contains": ["!!"]}]}, 1),
]


@register(
    "profile_selection",
    """SELECT doc_id, CASE WHEN lic >= 0.8 THEN 'licensed' WHEN loud THEN 'loud' WHEN sec AND NOT lic0 THEN 'secretive' WHEN lic > 0 THEN 'licensed' END AS profile FROM (
      SELECT doc_id, regexp_matches(text, 'token ?=') AS sec, contains(lower(text), 'license') AS lic0,
        CASE WHEN contains(lower(text), 'mit license') OR contains(lower(text), 'apache license') THEN 0.8 WHEN contains(text, 'CC BY') THEN 0.7 ELSE 0 END AS lic, contains(text, '!!') AS loud FROM documents)""",
)
def profile_selection(spark, sf_dir):
    # equal confidence of 0.7 for secretive and CC BY texts: the higher priority, secretive, decides
    return profiles.select(_docs(spark, sf_dir), _PROFILES).select("doc_id", "profile")


@register(
    "weighted_classification",
    """SELECT doc_id, CASE WHEN a >= b AND a >= 0.5 THEN 'lines' WHEN b > a AND b >= 0.4 THEN 'marks' ELSE 'unknown' END AS class, greatest(a, b) AS class_score FROM (
      SELECT doc_id, (CASE WHEN n_chars > 1500 THEN 2 ELSE 0 END + CASE WHEN contains(text, chr(10)) THEN 2 ELSE 0 END) / 4.0::DOUBLE AS a,
        (CASE WHEN contains(text, '|') THEN 3 ELSE 0 END + CASE WHEN contains(text, '%') THEN 1 ELSE 0 END) / 4.0::DOUBLE AS b FROM documents)""",
)
def weighted_classification(spark, sf_dir):
    t = F.col("text")
    rules = {
        "lines": (0.5, [(F.col("n_chars") > 1500, 2.0), (t.contains("\n"), 2.0)]),
        "marks": (0.4, [(t.contains("|"), 3.0), (t.contains("%"), 1.0)]),
    }
    return profiles.weighted_classify(_docs(spark, sf_dir, "n_chars"), rules).select("doc_id", "class", "class_score")


@register(
    "pattern_fields",
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, 'token = "([0-9a-f]+)"') THEN regexp_extract(text, 'token = "([0-9a-f]+)"', 1) WHEN regexp_matches(text, '[0-9]+@mail') THEN regexp_extract(text, '[0-9]+@mail') ELSE 'none' END AS field FROM documents""",
)
def pattern_fields(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", profiles.pattern_field(F.col("text"), ['token = "([0-9a-f]+)"', "[0-9]+@mail"], "none").alias("field"))


@register(
    "document_features",
    f"""WITH {LINES} SELECT doc_id, count(DISTINCT page_index) AS n_pages, count(*) AS n_lines, sum(length(text))::BIGINT AS n_chars, sum(regexp_matches(text, '[0-9]')::INT)::BIGINT AS n_number_lines FROM lines GROUP BY doc_id""",
)
def document_features(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("doc_id").agg(
        F.count_distinct("page_index").alias("n_pages"), F.count("*").alias("n_lines"), F.sum(F.char_length("text")).cast("long").alias("n_chars"), F.count_if(F.col("text").rlike("[0-9]")).alias("n_number_lines")
    )


# ---- recognised text


@register(
    "vector_ocr_merge",
    f"""WITH {WORDS}, vec AS (SELECT * FROM words WHERE word_no % 2 = 0), ocr AS (SELECT doc_id, page_index, line_no, word_no, text, x0 + CASE WHEN word_no % 4 = 0 THEN 1 ELSE 500 END AS x0, y0, x1 + CASE WHEN word_no % 4 = 0 THEN 1 ELSE 500 END AS x1, y1 FROM words WHERE word_no % 4 = 0 OR word_no % 5 = 1),
    kept AS (SELECT * FROM ocr o WHERE NOT EXISTS (SELECT 1 FROM vec v WHERE v.doc_id = o.doc_id AND v.page_index = o.page_index AND v.y0 = o.y0 AND v.confidence >= 0.5
      AND greatest(0, least(v.x1, o.x1) - greatest(v.x0, o.x0)) / ((v.x1 - v.x0) + (o.x1 - o.x0) - greatest(0, least(v.x1, o.x1) - greatest(v.x0, o.x0))) > 0.5))
    SELECT doc_id, 'vector' AS source, count(*) AS n FROM vec GROUP BY doc_id UNION ALL SELECT doc_id, 'ocr', count(*) FROM kept GROUP BY doc_id""",
)
def vector_ocr_merge(spark, sf_dir):
    w = virtual_pages.words(_docs(spark, sf_dir))
    move = F.when(F.col("word_no") % 4 == 0, 1.0).otherwise(500.0)
    found = w.where("word_no % 4 = 0 or word_no % 5 = 1").withColumns({"x0": F.col("x0") + move, "x1": F.col("x1") + move})
    return ocr.merge(w.where("word_no % 2 = 0"), found).groupBy("doc_id", "source").agg(F.count("*").alias("n"))


@register(
    "character_error_rate",
    "SELECT item_id, round(levenshtein(a, b) / length(a), 6) AS cer FROM (SELECT item_id, regexp_replace(text, '[^ -~]', '', 'g') AS a, replace(regexp_replace(text, '[^ -~]', '', 'g'), 'th', 'tb') AS b FROM benchmark)",
)
def character_error_rate(spark, sf_dir):
    a = F.regexp_replace("text", "[^ -~]", "")
    return table(spark, sf_dir, "benchmark").select("item_id", F.round(ocr.character_error_rate(a, F.replace(a, F.lit("th"), F.lit("tb"))), 6).alias("cer"))


@register("word_error_rate")
def word_error_rate(spark, sf_dir):
    """Word error rate of benchmark texts with some words changed; the edit table has no SQL form."""
    b = table(spark, sf_dir, "benchmark").withColumn("found", F.replace("text", F.lit(" the "), F.lit(" tbe ")))
    return ocr.word_error_rate(b, "text", "found").select("item_id", F.round("wer", 6).alias("wer"))


@register(
    "position_validation",
    f"""WITH {WORDS}, glyphs AS (SELECT doc_id, page_index, (x0 + x1) / 2 AS gx, (y0 + y1) / 2 AS gy FROM words WHERE word_no % 3 = 0),
    found AS (SELECT doc_id, page_index, line_no * 100000 + word_no AS span_index, x0 + 3 AS x0, x1 + 3 AS x1, y0, y1 FROM words WHERE word_no % 3 < 2)
    SELECT doc_id, count(*) AS n, sum((EXISTS (SELECT 1 FROM glyphs g WHERE g.doc_id = f.doc_id AND g.page_index = f.page_index AND pow(g.gx - (f.x0 + f.x1) / 2, 2) + pow(g.gy - (f.y0 + f.y1) / 2, 2) < 25))::INT)::BIGINT AS kept FROM found f GROUP BY doc_id""",
)
def position_validation(spark, sf_dir):
    # dealt by document while they are texts: words then meet where they are
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    w = virtual_pages.words(docs).select("doc_id", "page_index", "line_no", "word_no", "x0", "y0", "x1", "y1")
    at = [(F.col("line_no") * 100000 + F.col("word_no")).alias("span_index"), (F.col("x0") + 3).alias("x0"), "y0", (F.col("x1") + 3).alias("x1"), "y1"]
    found = w.where("word_no % 3 < 2").select("doc_id", "page_index", *at, F.lit(0.9).alias("confidence"))
    v = ocr.validate_positions(found, w.where("word_no % 3 = 0"))
    return v.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") > 0.4).alias("kept"))


# ---- tables


def _segments(spark, sf_dir):
    """Ruling segments from order lines: one page per order, rules at line numbers."""
    l = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.col("l_linenumber").alias("n"))
    h = l.select("doc_id", "page_index", F.lit("h").alias("orientation"), (F.lit(700.0) - 20 * F.col("n")).alias("pos"), F.lit(100.0).alias("lo"), F.lit(400.0).alias("hi"))
    v = l.select("doc_id", "page_index", F.lit("v").alias("orientation"), (F.lit(100.0) + 40 * F.col("n")).alias("pos"), F.lit(500.0).alias("lo"), (F.lit(700.0) - 20 * (F.col("n") % 3)).alias("hi"))
    return h.unionByName(v)


_SEGMENTS = """seg AS (SELECT l_orderkey AS doc_id, 0 AS page_index, 'h' AS orientation, (700 - 20 * l_linenumber)::DOUBLE AS pos, 100.0::DOUBLE AS lo, 400.0::DOUBLE AS hi FROM lineitem
  UNION ALL SELECT l_orderkey, 0, 'v', (100 + 40 * l_linenumber)::DOUBLE, 500.0, (700 - 20 * (l_linenumber % 3))::DOUBLE FROM lineitem),
  points AS (SELECT DISTINCT h.doc_id, h.page_index, v.pos AS x, h.pos AS y FROM seg h JOIN seg v ON h.doc_id = v.doc_id AND h.orientation = 'h' AND v.orientation = 'v'
    AND v.pos BETWEEN h.lo - 1 AND h.hi + 1 AND h.pos BETWEEN v.lo - 1 AND v.hi + 1),
  grid AS (SELECT doc_id, page_index, list_sort(list(DISTINCT x)) AS xs, list_sort(list(DISTINCT y)) AS ys FROM points GROUP BY ALL
    HAVING count(DISTINCT x) > 1 AND count(DISTINCT y) > 1 AND (count(DISTINCT x) - 1) * (count(DISTINCT y) - 1) >= 4)"""


@register("segment_merge", "WITH u AS (SELECT l_suppkey AS doc_id, l_partkey % 5 AS pos, l_linenumber * 10 AS lo, l_linenumber * 10 + 8 + l_orderkey % 4 AS hi FROM lineitem), f AS (SELECT *, coalesce(lo > max(hi) OVER (PARTITION BY doc_id, pos ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 2, true)::INT AS nw FROM u), r AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id, pos ORDER BY lo, hi, nw DESC ROWS UNBOUNDED PRECEDING) AS run FROM f) SELECT doc_id, 0 AS page_index, 'h' AS orientation, pos::DOUBLE AS pos, min(lo)::DOUBLE AS lo, max(hi)::DOUBLE AS hi FROM r GROUP BY doc_id, pos, run")
def segment_merge(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    n, p = F.col("l_linenumber"), F.col("l_partkey") % 5
    s = l.select(F.col("l_suppkey").alias("doc_id"), F.lit(0).alias("page_index"), F.lit("h").alias("orientation"), p.cast("double").alias("pos"), (n * 10).cast("double").alias("lo"), (n * 10 + 8 + F.col("l_orderkey") % 4).cast("double").alias("hi"))
    return tables.merge_segments(s)


@register("segment_intersections", f"WITH {_SEGMENTS} SELECT * FROM points")
def segment_intersections(spark, sf_dir):
    return tables.intersections(_segments(spark, sf_dir))


@register("table_cells", f"WITH {_SEGMENTS} SELECT doc_id, page_index, (len(ys) - 1 - j)::INT AS row, (i - 1)::INT AS col, xs[i] AS x0, ys[j] AS y0, xs[i + 1] AS x1, ys[j + 1] AS y1 FROM grid, unnest(range(1, len(xs))) AS a(i), unnest(range(1, len(ys))) AS b(j)")
def table_cells(spark, sf_dir):
    return tables.cells(tables.grids(tables.intersections(_segments(spark, sf_dir))))


@register(
    "span_cells",
    f"""WITH {_SEGMENTS}, cells AS (SELECT doc_id, (len(ys) - 1 - j)::INT AS row, (i - 1)::INT AS col, xs[i] AS x0, ys[j] AS y0, xs[i + 1] AS x1, ys[j + 1] AS y1 FROM grid, unnest(range(1, len(xs))) AS a(i), unnest(range(1, len(ys))) AS b(j)),
    spans AS (SELECT l_orderkey AS doc_id, l_linenumber AS n, (105 + 37 * l_linenumber)::DOUBLE AS cx, (695 - 21 * l_linenumber)::DOUBLE AS cy FROM lineitem)
    SELECT s.doc_id, s.n, c.row, c.col FROM spans s LEFT JOIN cells c ON s.doc_id = c.doc_id AND s.cx >= c.x0 AND s.cx < c.x1 AND s.cy >= c.y0 AND s.cy < c.y1""",
)
def span_cells(spark, sf_dir):
    cell = tables.cells(tables.grids(tables.intersections(_segments(spark, sf_dir))))
    n = F.col("l_linenumber")
    cx, cy = (F.lit(105.0) + 37 * n), (F.lit(695.0) - 21 * n)
    s = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), n.alias("n"), (cx - 1).alias("x0"), (cy - 1).alias("y0"), (cx + 1).alias("x1"), (cy + 1).alias("y1"))
    return tables.assign(s, cell, pad=0.0).select("doc_id", "n", "row", "col")


@register(
    "table_continuation",
    """WITH t AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_index, [100.0, 200.0 + o_orderkey % 7, 300.0] AS xs, CASE WHEN o_orderkey % 2 = 0 THEN 40.0 ELSE 90.0 END AS y0, CASE WHEN o_orderkey % 3 = 0 THEN 700.0 ELSE 750.0 END AS y1 FROM orders)
    SELECT a.doc_id, a.page_index, b.page_index AS next_page, round(sqrt(pow(a.xs[2] - b.xs[2], 2) / 3), 6) AS rmse FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.page_index + 1 = b.page_index WHERE a.y0 <= 50 AND b.y1 >= 742 AND sqrt(pow(a.xs[2] - b.xs[2], 2) / 3) < 5""",
)
def table_continuation(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    t = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"),
        F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("page_index"),
        F.array(F.lit(100.0), F.lit(200.0) + k % 7, F.lit(300.0)).alias("xs"),
        F.when(k % 2 == 0, 40.0).otherwise(90.0).alias("y0"),
        F.when(k % 3 == 0, 700.0).otherwise(750.0).alias("y1"),
    )
    return tables.continuations(t).withColumn("rmse", F.round("rmse", 6))


@register("borderless_tables")
def borderless_tables(spark, sf_dir):
    """Aligned columns without rules; clusters anchored at their first member are a fold without SQL form."""
    return tables.borderless(virtual_pages.words(_docs(spark, sf_dir)))


_SPACED = f"""{WORDS}, spaced AS (SELECT doc_id, page_index, x0, y0 - 100 * (row_no // 20) AS y0 FROM words WHERE line_no % 50 < 45),
  cols AS (SELECT doc_id, page_index, x0, count(*) AS n FROM spaced GROUP BY ALL HAVING count(*) >= 3), held AS (SELECT s.*, round(s.y0 / 2)::INT AS y FROM spaced s JOIN cols USING (doc_id, page_index, x0)),
  rw AS (SELECT doc_id, page_index, y FROM held GROUP BY ALL HAVING count(DISTINCT x0) >= 2),
  al AS (SELECT h.doc_id, h.page_index, h.x0, count(r.y) AS a, count(*) AS n FROM held h LEFT JOIN rw r ON h.doc_id = r.doc_id AND h.page_index = r.page_index AND h.y = r.y GROUP BY ALL),
  pg AS (SELECT doc_id, page_index, list_sort(list(x0)) AS xs FROM al GROUP BY ALL HAVING count(*) >= 3 AND NOT bool_or(a * 2 < n)),
  far AS (SELECT *, coalesce((lag(y) OVER w - y) * 2 > 100, false)::INT AS far FROM rw WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY y DESC)),
  rg AS (SELECT *, (sum(far) OVER (PARTITION BY doc_id, page_index ORDER BY y DESC))::INT AS grid, count(*) OVER (PARTITION BY doc_id, page_index) AS n FROM far),
  per AS (SELECT doc_id, page_index, grid, max(y) * 2 AS top, min(y) * 2 AS bottom FROM rg WHERE n >= 3 GROUP BY ALL),
  inside AS (SELECT DISTINCT p.doc_id, p.page_index, p.grid, round(s.y0 / 2)::INT * 2.0 AS y FROM per p JOIN spaced s ON s.doc_id = p.doc_id AND s.page_index = p.page_index AND s.y0 BETWEEN p.bottom AND p.top)"""


@register(
    "borderless_grids",
    f"""WITH {_SPACED} SELECT i.doc_id, i.page_index, i.grid, any_value(pg.xs[1]) AS x0, min(i.y)::DOUBLE AS y0, any_value(pg.xs[-1]) AS x1, max(i.y)::DOUBLE AS y1, any_value(len(pg.xs))::INT AS n_columns, count(*)::INT AS n_rows
    FROM inside i JOIN pg ON i.doc_id = pg.doc_id AND i.page_index = pg.page_index GROUP BY ALL HAVING count(*) >= 3""",
)
def borderless_grids(spark, sf_dir):
    """Words as aligned text, with a gap of 100 points after every twentieth line; starts are six points apart, so clusters are starts in SQL."""
    w = virtual_pages.words(_docs(spark, sf_dir)).where("line_no % 50 < 45")
    w = w.withColumn("y0", F.col("y0") - 100 * F.floor(F.col("row_no") / 20))
    found = tables.borderless_grids(w)
    return found.select("doc_id", "page_index", "grid", "x0", "y0", "x1", "y1", F.size("xs").alias("n_columns"), F.size("ys").alias("n_rows"))


@register("docstrum_order")
def docstrum_order(spark, sf_dir):
    """Lines of each page, dealt to two columns of uneven width, in the order of nearest neighbours."""
    n = F.col("row_no")
    left = F.when(n % 3 == 2, F.lit(330.0)).otherwise(F.lit(60.0))
    blocks_ = _lines(spark, sf_dir).select("doc_id", "page_index", n.alias("block_index"), left.alias("x0"), (left + 20 + F.char_length("text") % 200).alias("x1"), (F.lit(740.0) - 14 * n).alias("y0"), (F.lit(750.0) - 14 * n).alias("y1"))
    return reading.docstrum(blocks_).select("doc_id", "page_index", "block_index", "reading_order")


# ---- forms, links, labels, layers, structure


@register(
    "form_combine",
    """WITH a AS (SELECT o_custkey AS doc_id, 'f' || (o_orderkey % 9) AS name, min(o_orderstatus) AS value FROM orders GROUP BY ALL), x AS (SELECT o_custkey AS doc_id, 'f' || (o_orderkey % 5 + 3) AS name, max(o_orderpriority) AS value FROM orders GROUP BY ALL)
    SELECT coalesce(a.doc_id, x.doc_id) AS doc_id, coalesce(a.name, x.name) AS name, CASE WHEN a.name IS NULL THEN 'text' ELSE 'choice' END AS type, coalesce(x.value, a.value) AS value, a.name IS NOT NULL AND x.name IS NOT NULL AS collision
    FROM a FULL OUTER JOIN x ON a.doc_id = x.doc_id AND a.name = x.name""",
)
def form_combine(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    name = lambda e: F.concat(F.lit("f"), e.cast("string"))
    a = o.groupBy(F.col("o_custkey").alias("doc_id"), name(F.col("o_orderkey") % 9).alias("name")).agg(F.min("o_orderstatus").alias("value")).withColumn("type", F.lit("choice"))
    x = o.groupBy(F.col("o_custkey").alias("doc_id"), name(F.col("o_orderkey") % 5 + 3).alias("name")).agg(F.max("o_orderpriority").alias("value"))
    return documents.combine_forms(a, x)


@register(
    "label_ranges",
    f"""WITH {LINES}, p AS (SELECT DISTINCT doc_id, page_index FROM lines), l AS (SELECT doc_id, s AS start_page, CASE s % 2 WHEN 0 THEN 'D' ELSE 'r' END AS style FROM (SELECT doc_id, unnest([0, 2, 5]) AS s FROM documents))
    SELECT p.doc_id, p.page_index, l.start_page, l.style FROM p ASOF JOIN l ON p.doc_id = l.doc_id AND p.page_index >= l.start_page""",
)
def label_ranges(spark, sf_dir):
    pages = _lines(spark, sf_dir).select("doc_id", "page_index").distinct()
    labels = _docs(spark, sf_dir).select("doc_id", F.explode(F.array(F.lit(0), F.lit(2), F.lit(5))).alias("start_page"))
    labels = labels.withColumn("style", F.when(F.col("start_page") % 2 == 0, "D").otherwise("r"))
    return documents.as_of_labels(pages, labels)


@register(
    "layer_visibility",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN true WHEN o_orderkey % 4 = 1 THEN list_bool_and(s) WHEN o_orderkey % 4 = 2 THEN list_bool_or(s) ELSE NOT list_bool_or(s) END AS visible FROM (
      SELECT o_orderkey, [o_orderkey % 3 = 0, o_custkey % 2 = 0] AS s FROM orders)""".replace("list_bool_and(s)", "(s[1] AND s[2])").replace("list_bool_or(s)", "(s[1] OR s[2])"),
)
def layer_visibility(spark, sf_dir):
    k = F.col("o_orderkey")
    states = F.when(k % 4 == 0, F.array().cast("array<boolean>")).otherwise(F.array(k % 3 == 0, F.col("o_custkey") % 2 == 0))
    policy = F.when(k % 4 == 1, "AllOn").when(k % 4 == 2, "AnyOn").otherwise("AllOff")
    return table(spark, sf_dir, "orders").select("o_orderkey", documents.membership_visible(policy, states).alias("visible"))


@register(
    "bead_chains",
    """WITH RECURSIVE walk(doc_id, chain, node, position) AS (SELECT c_custkey, 'a', 1::BIGINT, 0 FROM customer
      UNION ALL SELECT doc_id, chain, node + 1, position + 1 FROM walk WHERE node < 1 + doc_id % 40) SELECT * FROM walk""",
)
def bead_chains(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    edges = c.select("doc_id", F.explode(F.sequence(F.lit(1).cast("long"), 1 + F.col("doc_id") % 40)).alias("node"))
    edges = edges.withColumn("next", F.when(F.col("node") < 1 + F.col("doc_id") % 40, F.col("node") + 1))
    return documents.walk_chain(edges, c.select("doc_id", F.lit("a").alias("chain"), F.lit(1).cast("long").alias("node")))


@register(
    "role_maps",
    """SELECT n_nationkey AS doc_id, custom, 'P' AS standard FROM nation, (VALUES ('Body'), ('Text'), ('Para')) AS r(custom)""",
)
def role_maps(spark, sf_dir):
    rows = F.array(*(F.struct(F.lit(a).alias("role"), F.lit(b).alias("maps_to")) for a, b in (("Body", "Text"), ("Text", "Para"), ("Para", "P"))))
    roles = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc_id"), F.explode(rows).alias("r")).select("doc_id", "r.role", "r.maps_to")
    return documents.resolve_roles(roles, ["P", "H1", "Table"])


@register(
    "structure_coverage",
    """WITH p AS (SELECT DISTINCT l_orderkey AS doc_id, 0 AS page_index, l_linenumber AS mcid FROM lineitem) SELECT doc_id, page_index, round(avg((mcid % 4 <> 3)::INT), 6) AS coverage, avg((mcid % 4 <> 3)::INT) < 0.8 AS falls_back FROM p GROUP BY ALL""",
)
def structure_coverage(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("page_index"), F.col("l_linenumber").alias("mcid"))
    return documents.mcid_coverage(p, p.where("mcid % 4 <> 3")).withColumn("coverage", F.round("coverage", 6))


@register(
    "signature_coverage",
    "SELECT o_orderkey, (100 + 50 + o_orderkey % 10) / (400.0 + o_orderkey % 10)::DOUBLE AS share FROM orders",
)
def signature_coverage(spark, sf_dir):
    k = F.col("o_orderkey").cast("long")
    ranges = F.array(F.lit(0).cast("long"), F.lit(100).cast("long"), F.lit(200).cast("long"), F.lit(50) + k % 10)
    return table(spark, sf_dir, "orders").select("o_orderkey", documents.signature_coverage(ranges, F.lit(400) + k % 10).alias("share"))


@register("attachments", "SELECT page_id, CASE WHEN strlen(html) <= 52428800 THEN base64(encode(html)) END AS data, strlen(html) > 52428800 AS truncated FROM pages")
def attachments(spark, sf_dir):
    p = documents.attachment_payload(F.encode("html", "UTF-8"))
    return table(spark, sf_dir, "pages").select("page_id", p.alias("p")).select("page_id", "p.data", "p.truncated")


@register(
    "links_to_spans",
    f"""WITH {WORDS}, links AS (SELECT doc_id, 0 AS page_index, 100.0 AS x0, 600.0 AS y0, 300.0 AS x1, 690.0 AS y1 FROM documents)
    SELECT w.doc_id, count(*) AS n FROM words w JOIN links l ON w.doc_id = l.doc_id AND w.page_index = l.page_index AND (w.x0 + w.x1) / 2 BETWEEN l.x0 AND l.x1 AND (w.y0 + w.y1) / 2 BETWEEN l.y0 AND l.y1 GROUP BY w.doc_id""",
)
def links_to_spans(spark, sf_dir):
    d = _docs(spark, sf_dir)
    links = d.select("doc_id", F.lit(0).alias("page_index"), F.lit(100.0).alias("l_x0"), F.lit(600.0).alias("l_y0"), F.lit(300.0).alias("l_x1"), F.lit(690.0).alias("l_y1"))
    return documents.links_to_spans(links, virtual_pages.words(d)).groupBy("doc_id").agg(F.count("*").alias("n"))


@register(
    "page_grid",
    f"WITH {WORDS} SELECT doc_id, page_index, least(greatest(floor((y0 + y1) / 2 / 792 * 8), 0), 7)::INT AS row, least(greatest(floor((x0 + x1) / 2 / 612 * 8), 0), 7)::INT AS col, count(*) AS n FROM words GROUP BY ALL",
)
def page_grid(spark, sf_dir):
    cx, cy = geometry.Box.of().centre
    row, col = geometry.grid_cell(cx, cy, F.lit(612.0), F.lit(792.0))
    return virtual_pages.words(_docs(spark, sf_dir)).groupBy("doc_id", "page_index", row.alias("row"), col.alias("col")).agg(F.count("*").alias("n"))


@register(
    "hybrid_pages",
    f"""WITH {WORDS}, glyph AS (SELECT doc_id, page_index, 7 - least(greatest(floor((y0 + y1) / 2 / 792 * 8), 0), 7)::INT AS row, least(greatest(floor((x0 + x1) / 2 / 612 * 8), 0), 7)::INT AS col, count(*) AS n, sum((word_no % 5 <> 4)::INT) AS valid FROM words GROUP BY ALL),
    cell AS (SELECT doc_id, page_index, r AS row, c AS col, doc_id % 3 AS kind, CASE doc_id % 3 WHEN 0 THEN 500.0 ELSE 792.0 END AS top FROM (SELECT DISTINCT doc_id, page_index FROM words), unnest(range(0, 8)) AS a(r), unnest(range(0, 8)) AS b(c)),
    share AS (SELECT doc_id, page_index, row, col, CASE WHEN kind = 2 THEN 0 ELSE greatest(least(top, (8 - row) * 99.0) - (7 - row) * 99.0, 0) / 99.0 END AS share FROM cell),
    classed AS (SELECT s.*, CASE WHEN n > 0 AND valid / n > 0.6 THEN 'vector' WHEN n IS NULL AND share > 0.8 THEN 'scanned' ELSE 'mixed' END AS k FROM share s LEFT JOIN glyph g ON s.doc_id = g.doc_id AND s.page_index = g.page_index AND s.row = g.row AND s.col = g.col),
    per AS (SELECT doc_id, page_index, count(*) FILTER (k = 'vector') AS vector_cells, count(*) FILTER (k = 'scanned') AS scanned_cells, string_agg(row * 8 + col, ',' ORDER BY row * 8 + col) FILTER (k = 'scanned') AS cells FROM classed GROUP BY ALL)
    SELECT doc_id, page_index, vector_cells, scanned_cells, CASE WHEN vector_cells >= 10 AND scanned_cells >= 10 THEN cells END AS hybrid_cells FROM per""",
)
def hybrid_pages(spark, sf_dir):
    """Words over images: of every three documents one has an image on the lower part of its pages, and one on the whole."""
    w = virtual_pages.words(_docs(spark, sf_dir)).withColumn("valid", F.col("word_no") % 5 != 4)
    pages = w.select("doc_id", "page_index").distinct().withColumns({"width": F.lit(612.0), "height": F.lit(792.0)})
    top = F.when(F.col("doc_id") % 3 == 0, F.lit(500.0)).otherwise(F.lit(792.0))
    images = pages.where("doc_id % 3 < 2").select("doc_id", "page_index", F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(612.0).alias("x1"), top.alias("y1"))
    found = page_class.grid_counts(page_class.grid_cells(pages, w, images))
    return found.withColumn("hybrid_cells", F.array_join(F.transform("hybrid_cells", lambda c: c.cast("string")), ","))
