"""Search queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelane.operators import search
from quirelane.plans.registry import register
from quirelane.plans.sqlparts import LINES
from quirelane.session import table
from quirelane.sources import virtual_pages


@register(
    "grep_literal_by_source",
    """SELECT source, sum(len(regexp_extract_all(text, 'tion')))::BIGINT AS n_matches, count(*) AS n_documents
    FROM documents WHERE contains(text, 'tion') GROUP BY source""",
)
def grep_literal_by_source(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "text")
    hits = docs.where(F.col("text").contains("tion"))
    n = F.regexp_count("text", F.lit("tion")).cast("long")
    return hits.groupBy("source").agg(F.sum(n).alias("n_matches"), F.count("*").alias("n_documents"))


@register(
    "grep_ignoring_case",
    r"""SELECT doc_id, len(regexp_extract_all(text, '(?i)stand')) + len(regexp_extract_all(text, '[Tt][Hh][Ee]')) AS n FROM documents WHERE regexp_matches(text, '(?i)stand|the')""",
)
def grep_ignoring_case(spark, sf_dir):
    """Matches of a literal and of a regular expression, whatever their case."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    both = search.grep(docs, "STAND", literal=True, ignore_case=True).unionByName(search.grep(docs, "T[H]E", ignore_case=True))
    return both.groupBy("doc_id").agg(F.count("*").alias("n"))


@register(
    "inverted_events",
    rf"""WITH {LINES} SELECT doc_id, page_index, count(*) AS n, min(line_no) AS first FROM lines WHERE NOT regexp_matches(' ' || text || ' ', '[^A-Za-z0-9_](?i:the)[^A-Za-z0-9_]') GROUP BY ALL""",
)
def inverted_events(spark, sf_dir):
    """Lines that hold a word nowhere, each as an event, counted by page."""
    lines = virtual_pages.lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    events = search.inverted(lines, "the", literal=True, ignore_case=True, whole_word=True).where("event = 'no_match'")
    return events.groupBy("doc_id", "page_index").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
