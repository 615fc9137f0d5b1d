"""Layout queries over the virtual pages of documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelane.functions import geometry, scalars
from quirelane.operators import layout
from quirelane.plans.registry import register
from quirelane.plans.sqlparts import LINES, WORDS
from quirelane.session import spread, table
from quirelane.sources import virtual_pages


def _lines(spark, sf_dir):
    return virtual_pages.lines(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _words(spark, sf_dir):
    return virtual_pages.words(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def _words_in_place(spark, sf_dir):
    """Words of documents that are dealt by their key while they are texts: pages and lines then are whole where they are, and no word is shuffled."""
    return virtual_pages.words(table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id"))


def _styled(spark, sf_dir):
    """Words whose font and mode change along the line."""
    w = _words_in_place(spark, sf_dir)
    return w.withColumn("font", F.when(F.col("word_no") % 11 < 8, F.lit("Courier")).otherwise(F.lit("Helvetica-Bold"))).withColumn(
        "rendering_mode", F.when(F.col("word_no") % 23 == 0, 3).otherwise(0)
    )


STYLED = WORDS + """, styled AS (
  SELECT * REPLACE (CASE WHEN word_no % 11 < 8 THEN 'Courier' ELSE 'Helvetica-Bold' END AS font, CASE WHEN word_no % 23 = 0 THEN 3 ELSE 0 END AS rendering_mode) FROM words
)"""


@register("page_scan", f"WITH {LINES} SELECT doc_id, page_index, count(*) AS n_lines, min(y0) AS y0, max(y1) AS y1, max(x1) AS x1 FROM lines GROUP BY ALL")
def page_scan(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("doc_id", "page_index").agg(F.count("*").alias("n_lines"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.max("x1").alias("x1"))


@register("page_count", f"WITH {LINES} SELECT doc_id, max(page_index) + 1 AS n_pages FROM lines GROUP BY doc_id")
def page_count(spark, sf_dir):
    return _lines(spark, sf_dir).groupBy("doc_id").agg((F.max("page_index") + 1).alias("n_pages"))


@register("word_boxes", f"WITH {WORDS} SELECT doc_id, page_index, count(*) AS n_words, sum(x0) AS x0, sum(x1) AS x1 FROM words GROUP BY ALL")
def word_boxes(spark, sf_dir):
    return _words(spark, sf_dir).groupBy("doc_id", "page_index").agg(F.count("*").alias("n_words"), F.sum("x0").alias("x0"), F.sum("x1").alias("x1"))


@register(
    "span_merge",
    f"""WITH {STYLED}, flagged AS (
      SELECT *, coalesce(lag(font) OVER w <> font OR abs(size - lag(size) OVER w) > 0.5 OR lag(rendering_mode) OVER w <> rendering_mode, false)::INT AS brk
      FROM styled WINDOW w AS (PARTITION BY doc_id, line_no ORDER BY word_no)
    ), runs AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, line_no ORDER BY word_no)::INT AS span_index FROM flagged)
    SELECT doc_id, page_index, line_no, span_index, string_agg(text, ' ' ORDER BY word_no) AS text, min(font) AS font, min(rendering_mode) AS rendering_mode,
      min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
    FROM runs GROUP BY ALL""",
)
def span_merge(spark, sf_dir):
    return layout.merge_spans(_styled(spark, sf_dir)).drop("size", "confidence")


@register(
    "search_span_merge",
    f"""WITH {WORDS}, flagged AS (
      SELECT *, coalesce(lag(font) OVER w <> font OR abs(y0 - lag(y0) OVER w) > 0.2 * size OR x0 - lag(x1) OVER w > 2 * size, false)::INT AS brk
      FROM words WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY line_no, word_no)
    ), runs AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page_index ORDER BY line_no, word_no)::INT AS span_index FROM flagged)
    SELECT doc_id, page_index, span_index, string_agg(text, ' ' ORDER BY line_no, word_no) AS text, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
    FROM runs GROUP BY ALL""",
)
def search_span_merge(spark, sf_dir):
    return layout.merge_search_spans(_words_in_place(spark, sf_dir))


_CLUSTERED = f"""{WORDS}, based AS (SELECT *, y0 + 0.2 * (y1 - y0) AS baseline FROM words),
  flagged AS (SELECT *, coalesce(baseline - lag(baseline) OVER w > 5.0, false)::INT AS brk FROM based WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY baseline, x0)),
  clustered AS (SELECT *, sum(brk) OVER (PARTITION BY doc_id, page_index ORDER BY baseline, x0 ROWS UNBOUNDED PRECEDING)::INT AS line_index FROM flagged)"""


@register(
    "line_cluster",
    f"""WITH {_CLUSTERED} SELECT doc_id, page_index, line_index, string_agg(text, ' ' ORDER BY x0) AS text, round(avg(baseline), 6) AS baseline,
      (list_sort(list(size)))[len(list(size)) // 2 + 1] AS size, count(*) AS n_spans, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
    FROM clustered GROUP BY ALL""",
)
def line_cluster(spark, sf_dir):
    lines = layout.finish_lines(layout.cluster_lines(_words(spark, sf_dir), 10.0))
    return lines.withColumn("baseline", F.round("baseline", 6)).drop("direction")


@register(
    "line_direction",
    """SELECT doc_id, CASE WHEN l = 0 AND r = 0 THEN 'ltr' WHEN l = r THEN 'mixed' WHEN l > r THEN 'ltr' ELSE 'rtl' END AS direction
    FROM (SELECT doc_id, len(regexp_extract_all(text, '[A-Za-z\\x{00C0}-\\x{024F}\\x{0370}-\\x{058F}]')) AS l, len(regexp_extract_all(text, '[\\x{0590}-\\x{08FF}]')) AS r FROM documents)""",
)
def line_direction(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", layout.direction(F.col("text")).alias("direction"))


@register(
    "x0_histogram",
    f"WITH {WORDS} SELECT doc_id, page_index, least(greatest(floor(x0), 0), 611)::INT AS bucket, count(*) AS n FROM words GROUP BY ALL",
)
def x0_histogram(spark, sf_dir):
    return layout.x0_histogram(_words(spark, sf_dir), 612.0)


_GAPS = f"""{WORDS}, hist AS (SELECT doc_id, page_index, least(greatest(floor(x0), 0), 611)::INT AS bucket, count(*) AS n FROM words GROUP BY ALL),
  runs AS (
    SELECT doc_id, page_index, coalesce(lag(bucket) OVER w, -1) + 1 AS lo, bucket - 1 AS hi FROM hist WINDOW w AS (PARTITION BY doc_id, page_index ORDER BY bucket)
    UNION ALL SELECT doc_id, page_index, max(bucket) + 1, 611 FROM hist GROUP BY ALL
  ), gaps AS (SELECT * FROM runs WHERE hi - lo + 1 >= 19)"""


@register("column_gaps", f"WITH {_GAPS} SELECT * FROM gaps")
def column_gaps(spark, sf_dir):
    words = _words(spark, sf_dir)
    return layout.column_gaps(layout.x0_histogram(words, 612.0), 612.0)


_COLUMNS = _GAPS + """, starts AS (SELECT doc_id, page_index, min(x0) AS x0 FROM words GROUP BY doc_id, page_index, line_no),
  pages AS (SELECT DISTINCT doc_id, page_index FROM starts),
  ranges AS (
    SELECT doc_id, page_index, (hi + 1)::DOUBLE AS x0, coalesce(lead(lo) OVER (PARTITION BY doc_id, page_index ORDER BY lo)::DOUBLE, 612.0) AS x1 FROM gaps
    UNION ALL SELECT p.doc_id, p.page_index, 0.0, coalesce(min(g.lo)::DOUBLE, 612.0) FROM pages p LEFT JOIN gaps g USING (doc_id, page_index) GROUP BY ALL
  ), kept AS (
    SELECT r.doc_id, r.page_index, r.x0, r.x1, count(*) AS n_lines FROM ranges r JOIN starts s ON r.doc_id = s.doc_id AND r.page_index = s.page_index AND s.x0 >= r.x0 AND s.x0 < r.x1
    WHERE r.x1 > r.x0 GROUP BY ALL HAVING count(*) >= 3
  ), cols AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY x0) - 1 AS col FROM kept)"""


def _columns(spark, sf_dir):
    words = _words(spark, sf_dir)
    return words, layout.page_columns(words, 612.0)


@register("confirmed_columns", f'WITH {_COLUMNS} SELECT doc_id, page_index, x0, x1, n_lines, col AS "column" FROM cols')
def confirmed_columns(spark, sf_dir):
    return _columns(spark, sf_dir)[1]


@register(
    "span_columns",
    f"""WITH {_COLUMNS} SELECT w.doc_id, w.page_index, c.col AS "column", count(*) AS n_spans
    FROM words w LEFT JOIN cols c ON w.doc_id = c.doc_id AND w.page_index = c.page_index AND (w.x0 + w.x1) / 2 >= c.x0 AND (w.x0 + w.x1) / 2 < c.x1
    GROUP BY ALL""",
)
def span_columns(spark, sf_dir):
    words, columns = _columns(spark, sf_dir)
    return layout.assign_columns(words, columns).groupBy("doc_id", "page_index", "column").agg(F.count("*").alias("n_spans"))


@register(
    "line_majority_column",
    f"""WITH {WORDS}, cells AS (SELECT doc_id, line_no, floor(x0 / 200)::INT AS c FROM words),
    n AS (SELECT doc_id, line_no, c, count(*) AS k FROM cells GROUP BY ALL)
    SELECT doc_id, line_no, c AS "column" FROM n QUALIFY row_number() OVER (PARTITION BY doc_id, line_no ORDER BY k DESC, c) = 1""",
)
def line_majority_column(spark, sf_dir):
    words = _words(spark, sf_dir).withColumn("column", F.floor(F.col("x0") / 200).cast("int"))
    return layout.majority_column(words, ["doc_id", "line_no"])


@register("blocks")
def blocks(spark, sf_dir):
    """Lines in blocks; the fold over a page has no SQL form."""
    lines = _lines(spark, sf_dir).withColumn("baseline", geometry.baseline(geometry.Box.of()))
    return layout.finish_blocks(layout.group_blocks(lines))


@register("reading_order")
def reading_order(spark, sf_dir):
    lines = _lines(spark, sf_dir).withColumn("baseline", geometry.baseline(geometry.Box.of()))
    found = layout.finish_blocks(layout.group_blocks(lines))
    return layout.xy_cut(found, 612.0).select("doc_id", "page_index", "block_index", "reading_order")


@register(
    "rotated_boxes",
    f"""WITH {LINES} SELECT doc_id, line_no,
      CASE doc_id % 4 WHEN 1 THEN y0 WHEN 2 THEN 612 - x1 WHEN 3 THEN 792 - y1 ELSE x0 END AS x0,
      CASE doc_id % 4 WHEN 1 THEN 612 - x1 WHEN 2 THEN 792 - y1 WHEN 3 THEN x0 ELSE y0 END AS y0,
      CASE doc_id % 4 WHEN 1 THEN y1 WHEN 2 THEN 612 - x0 WHEN 3 THEN 792 - y0 ELSE x1 END AS x1,
      CASE doc_id % 4 WHEN 1 THEN 612 - x0 WHEN 2 THEN 792 - y0 WHEN 3 THEN x1 ELSE y1 END AS y1
    FROM lines""",
)
def rotated_boxes(spark, sf_dir):
    r = geometry.rotate(geometry.Box.of(), (F.col("doc_id") % 4) * 90, F.lit(612.0), F.lit(792.0))
    return _lines(spark, sf_dir).select("doc_id", "line_no", r.alias("r")).select("doc_id", "line_no", "r.x0", "r.y0", "r.x1", "r.y1")


@register(
    "span_style_flags",
    f"""WITH {LINES} SELECT regexp_replace(font, '^[A-Z]{{6}}\\+', '') AS font, regexp_matches(regexp_replace(font, '^[A-Z]{{6}}\\+', ''), 'Bold|Bd|Black|Heavy') AS bold,
      regexp_matches(lower(regexp_replace(font, '^[A-Z]{{6}}\\+', '')), 'mono|courier|code|fixed|console') AS mono, count(*) AS n FROM lines GROUP BY ALL""",
)
def span_style_flags(spark, sf_dir):
    f = F.col("font")
    return _lines(spark, sf_dir).groupBy(
        scalars.subset_prefix_stripped(f).alias("font"), scalars.is_bold(f).alias("bold"), scalars.is_monospace(f).alias("mono")
    ).agg(F.count("*").alias("n"))


@register(
    "visible_spans",
    f"WITH {LINES} SELECT doc_id, count(*) AS n FROM lines WHERE rendering_mode <> 3 GROUP BY doc_id",
)
def visible_spans(spark, sf_dir):
    return _lines(spark, sf_dir).where("rendering_mode <> 3").groupBy("doc_id").agg(F.count("*").alias("n"))
