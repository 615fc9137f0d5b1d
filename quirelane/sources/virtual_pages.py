"""A page layout for plain text: every line of a text becomes a line of a page, every word a word box.

Fifty lines make a page. All geometry is integer arithmetic, so that any engine gives the same boxes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LINES_PER_PAGE = 50
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0


def _style(doc: Column, row: Column) -> list[Column]:
    size = F.when(row == 0, F.lit(18.0)).otherwise(F.lit(10.0))
    font = F.when(doc % 3 == 0, F.lit("Helvetica")).when(doc % 3 == 1, F.lit("Courier")).otherwise(F.lit("ABCDEF+Times-Bold"))
    return [size.alias("size"), font.alias("font"), ((F.lit(5) + doc % 5) / F.lit(10.0)).alias("confidence"), F.when(doc % 7 == 0, 3).otherwise(0).alias("rendering_mode")]


def lines(docs: DataFrame) -> DataFrame:
    """One row per line: doc_id, line_no, page_index, row_no, text and its box and style."""
    d = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "text"))
    d = d.withColumn("page_index", (F.col("line_no") / LINES_PER_PAGE).cast("int")).withColumn("row_no", F.col("line_no") % LINES_PER_PAGE)
    y1 = F.lit(720.0) - 12 * F.col("row_no")
    return d.select(
        "doc_id",
        "line_no",
        "page_index",
        "row_no",
        "text",
        F.lit(72.0).alias("x0"),
        (y1 - 10).alias("y0"),
        (F.lit(72.0) + 6 * F.char_length("text")).alias("x1"),
        y1.alias("y1"),
        *_style(F.col("doc_id"), F.col("row_no")),
    )


def page_texts(docs: DataFrame, name: str = "text") -> DataFrame:
    """(doc_id, page_index, ``name``): the whole text of each page, its lines in order."""
    rows = F.array_sort(F.collect_list(F.struct("line_no", "text")))  # at most LINES_PER_PAGE
    return lines(docs).groupBy("doc_id", "page_index").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias(name))


def words(docs: DataFrame) -> DataFrame:
    """One row per word of each line, with word_no and its own x0 and x1; empty words are left out."""
    # a word starts after each space: places come from the line's own characters, without a window over words
    after = F.transform(F.split("text", ""), lambda c, i: F.when(c == " ", i + 1))
    starts = F.concat(F.array(F.lit(0)), F.filter(after, lambda i: i.isNotNull()))
    zipped = F.arrays_zip(F.split("text", " ", -1).alias("word"), starts.alias("offset"))
    w = lines(docs).select("*", F.posexplode(zipped).alias("word_no", "__w"))
    w = w.select("*", F.col("__w.word").alias("word"), F.col("__w.offset").alias("offset")).where(F.col("word") != "")
    return w.select(
        "doc_id",
        "line_no",
        "page_index",
        "row_no",
        "word_no",
        F.col("word").alias("text"),
        (F.lit(72.0) + 6 * F.col("offset")).alias("x0"),
        "y0",
        (F.lit(72.0) + 6 * (F.col("offset") + F.char_length("word"))).alias("x1"),
        "y1",
        "size",
        "font",
        "confidence",
        "rendering_mode",
    )
