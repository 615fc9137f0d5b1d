"""Round trips of documents through PDF files: written as bytes, parsed, and held against the text."""

from __future__ import annotations

from pyspark.sql import functions as F

from quirelane.plans.registry import register
from quirelane.plans.sqlparts import LINES
from quirelane.session import cut, table
from quirelane.sources import virtual_pages
from quirelane.sources.pdf import reader, writer


def _files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return cut(writer.write_pages(virtual_pages.lines(docs)))


@register("pdf_pages", f"WITH {LINES} SELECT doc_id, page_index, 612.0::DOUBLE AS width, 792.0::DOUBLE AS height, sum((text <> '')::INT)::INT + sum((text = '')::INT)::INT AS text_ops FROM lines GROUP BY ALL")
def pdf_pages(spark, sf_dir):
    pages = reader.table(_files(spark, sf_dir), "pages", path="doc_id")
    return pages.select(F.col("path").alias("doc_id"), "page_index", "width", "height", "text_ops")


@register(
    "pdf_text",
    f"WITH {LINES} SELECT doc_id, page_index, md5(string_agg(text, chr(10) ORDER BY line_no)) AS h, sum(length(text))::BIGINT AS n FROM lines WHERE text <> '' GROUP BY ALL",
)
def pdf_text(spark, sf_dir):
    """Glyphs grouped to lines by their height on the page, from the top down."""
    g = reader.table(_files(spark, sf_dir), "glyphs", path="doc_id").withColumn("y", F.round("y0", 1))
    line = g.groupBy("path", "page_index", "y").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("glyph_index", "text"))), lambda r: r["text"]), "").alias("text"), F.min("glyph_index").alias("first")
    )
    rows = F.array_sort(F.collect_list(F.struct("first", "text")))
    return line.groupBy(F.col("path").alias("doc_id"), "page_index").agg(
        F.md5(F.array_join(F.transform(rows, lambda r: r["text"]), "\n")).alias("h"), F.sum(F.char_length("text")).cast("long").alias("n")
    )


@register("pdf_documents", f"WITH {LINES} SELECT doc_id, '1.7' AS version, max(page_index) + 1 AS page_count, false AS is_encrypted FROM lines GROUP BY doc_id")
def pdf_documents(spark, sf_dir):
    return reader.table(_files(spark, sf_dir), "documents", path="doc_id").select(F.col("path").alias("doc_id"), "version", "page_count", "is_encrypted")
