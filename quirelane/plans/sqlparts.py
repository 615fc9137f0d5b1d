"""Common table expressions of the DuckDB twins."""

LINES = """lines AS (
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, CAST((i - 1) // 50 AS INTEGER) AS page_index, CAST((i - 1) % 50 AS INTEGER) AS row_no, parts[i] AS text,
    72.0::DOUBLE AS x0, (720 - 12 * ((i - 1) % 50) - 10)::DOUBLE AS y0, (72 + 6 * length(parts[i]))::DOUBLE AS x1, (720 - 12 * ((i - 1) % 50))::DOUBLE AS y1,
    CASE WHEN (i - 1) % 50 = 0 THEN 18.0 ELSE 10.0 END::DOUBLE AS size,
    CASE doc_id % 3 WHEN 0 THEN 'Helvetica' WHEN 1 THEN 'Courier' ELSE 'ABCDEF+Times-Bold' END AS font,
    (5 + doc_id % 5) / 10.0::DOUBLE AS confidence, CASE WHEN doc_id % 7 = 0 THEN 3 ELSE 0 END AS rendering_mode
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(1, len(parts) + 1)) AS u(i)
)"""

WORDS = (
    LINES
    + """, raw_words AS (
  SELECT l.* EXCLUDE (x0, x1, text), k - 1 AS word_no, ws[k] AS text,
    sum(length(ws[k]) + 1) OVER (PARTITION BY doc_id, line_no ORDER BY k) - length(ws[k]) - 1 AS off
  FROM (SELECT *, string_split(text, ' ') AS ws FROM lines) l, unnest(range(1, len(ws) + 1)) AS u(k)
), words AS (
  SELECT * EXCLUDE (off), (72 + 6 * off)::DOUBLE AS x0, (72 + 6 * (off + length(text)))::DOUBLE AS x1 FROM raw_words WHERE text <> ''
)"""
)
