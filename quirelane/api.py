"""The engine's calls over PDF files: a path in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelane.operators import layout, page_class, receipts, search, serialise
from quirelane.session import cut
from quirelane.sources.pdf import reader

PAGE = ("path", "page_index")


def glyphs(spark: SparkSession, path: str, password: str = "") -> DataFrame:
    return reader.read_pdf(spark, path, "glyphs", password=password)


def lines(glyph: DataFrame, include_invisible: bool = False) -> DataFrame:
    """Lines of glyphs: words by gaps over a quarter of the size, lines by baselines."""
    w = ["glyph_index"]
    before = lambda c: layout.previous(c, PAGE, w)
    shown = glyph if include_invisible else glyph.where("rendering_mode <> 3")
    new_line = (F.abs(F.col("y0") - before("y0")) > 0.5 * F.col("size")) | (F.col("x0") < before("x0") - F.col("size"))
    rows = layout.islands(shown, PAGE, w, new_line, "line_no")
    inside = [*PAGE, "line_no"]
    gap = F.coalesce(F.col("x0") - layout.previous("x1", inside, w) > 0.25 * F.col("size"), F.lit(False))
    spaced = rows.withColumn("text", F.when(gap & (layout.previous("text", inside, w) != " ") & (F.col("text") != " "), F.concat(F.lit(" "), "text")).otherwise(F.col("text")))
    return spaced.groupBy(*inside).agg(
        layout.ordered_text("", "text", "glyph_index").alias("text"),
        F.median("size").alias("size"),
        F.first("font").alias("font"),
        F.min("confidence").alias("confidence"),
        F.min("x0").alias("x0"),
        F.min("y0").alias("y0"),
        F.max("x1").alias("x1"),
        F.max("y1").alias("y1"),
    )


def extract_pages(spark: SparkSession, path: str, password: str = "", include_invisible: bool = False) -> DataFrame:
    """(path, page_index, page_text), every page of every file; pages without text are empty."""
    pages = reader.read_pdf(spark, path, "pages", password=password).select(*PAGE)
    text = lines(glyphs(spark, path, password), include_invisible).groupBy(*PAGE).agg(layout.ordered_text("\n", "text", "line_no").alias("page_text"))
    return pages.join(text, list(PAGE), "left").withColumn("page_text", F.coalesce("page_text", F.lit("")))


def extract_text(spark: SparkSession, path: str) -> DataFrame:
    return serialise.document_text(extract_pages(spark, path), "path")


def extract_markdown(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_index, markdown): lines over 1.2 times the page's median size are headings."""
    from pyspark.sql import Window

    ln = lines(glyphs(spark, path)).withColumn("page_size", F.median("size").over(Window.partitionBy(*PAGE)))
    kind = F.when(F.col("size") > 1.2 * F.col("page_size"), "heading").when(F.col("text").rlike("^\\s*[\\u2022*-]\\s"), "list").otherwise("paragraph")
    blocks = ln.select(*PAGE, F.col("line_no").alias("block_index"), kind.alias("kind"), F.lit(2).alias("level"), "text")
    return serialise.page_markdown(blocks, PAGE)


def get_metadata(spark: SparkSession, path: str) -> DataFrame:
    return reader.read_pdf(spark, path, "documents")


def hash_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, fingerprint) by page texts and boxes."""
    sized = reader.read_pdf(spark, path, "pages").select(*PAGE, F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.col("width").alias("x1"), F.col("height").alias("y1"))
    pages = extract_pages(spark, path).join(sized, list(PAGE)).withColumn("text", F.col("page_text")).withColumnRenamed("path", "doc_id")
    return receipts.fingerprints(receipts.page_hashes(pages)).withColumnRenamed("doc_id", "path")


def search_text(spark: SparkSession, path: str, pattern: str, literal: bool = False) -> DataFrame:
    return search.grep(lines(glyphs(spark, path)), pattern, literal=literal)


def classify_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, page_index, page_class, class_confidence, hybrid_cells) by signals of text and images.

    Glyphs and images are also counted in the cells of an 8 x 8 grid: a page with ten cells of text and ten of image alone
    is hybrid, and ``hybrid_cells`` are the scanned ones, which a recogniser should read. The share of characters that were
    extracted stands for the density; no other count of those to be expected is known.
    """
    pages = reader.read_pdf(spark, path, "pages")
    area = F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0)) * F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))
    images, glyph = cut(reader.read_pdf(spark, path, "images")), cut(glyphs(spark, path).select(*PAGE, "x0", "y0", "x1", "y1", (F.col("confidence") > 0).alias("valid")))
    img = images.groupBy(*PAGE).agg(F.sum(area).alias("area"), F.max(area).alias("largest"))
    g = glyph.groupBy(*PAGE).agg(F.count("*").alias("chars"), F.count_if("valid").alias("valid_chars"))
    grid = page_class.grid_counts(page_class.grid_cells(pages, glyph, images, PAGE), PAGE)
    j = cut(pages.join(img, list(PAGE), "left").join(g, list(PAGE), "left").join(grid, list(PAGE), "left").na.fill(0))
    whole = F.col("width") * F.col("height")
    return page_class.classify(
        j.withColumns({"page_area": whole, "image_share": F.least(F.lit(1.0), F.col("area") / whole), "full_page_image": F.col("largest") / whole >= 0.95, "density_ratio": F.when(F.col("chars") > 0, F.col("valid_chars") / F.col("chars")).otherwise(0.0)})
    ).select(*PAGE, "page_class", "class_confidence", "hybrid_cells")


def page_slice(pages: DataFrame, first: int, last: int) -> DataFrame:
    """Pages from ``first`` to ``last``, both from 1 and included."""
    return pages.where(F.col("page_index").between(first - 1, last - 1))
