"""What a block is: heading, list, code, caption, figure, header or footer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelane.functions import scalars
from quirelane.functions.geometry import Box

PAGE = ("doc_id", "page_index")


def headings(lines: DataFrame, ratio: float = 1.2) -> DataFrame:
    """One-line blocks whose size is over ``ratio`` times the page's median size, with that median."""
    w = Window.partitionBy(*PAGE)
    return lines.withColumn("page_size", F.median("size").over(w)).where((F.col("size") / F.col("page_size") > ratio) & (F.col("n_lines") == 1))


def is_list(lines: DataFrame, keys: list[str], least: float = 0.8) -> DataFrame:
    """Blocks of which 80 per cent of lines or more start with a bullet or number, by their share."""
    hit = (scalars.is_bullet(F.col("text")) | scalars.is_numbered(F.col("text"))).cast("double")
    return lines.groupBy(*keys).agg(F.avg(hit).alias("share")).withColumn("is_list", F.col("share") >= least)


def is_code(spans: DataFrame, keys: list[str], em: float = 2.0) -> DataFrame:
    """Blocks whose spans are all monospaced and indented by two ems or more from the leftmost span of their page."""
    left = F.min("x0").over(Window.partitionBy(*PAGE))
    s = spans.withColumn("__indent", F.col("x0") - left)
    return s.groupBy(*keys).agg((F.bool_and(scalars.is_monospace(F.col("font"))) & (F.min("__indent") >= em * F.min("size"))).alias("is_code"))


def captions(blocks: DataFrame, column: str | None = None) -> DataFrame:
    """Blocks smaller than the page's median size that follow a figure within two line heights, in the same column."""
    keys = [*PAGE, *([column] if column else [])]
    order = Window.partitionBy(*keys).orderBy(F.desc("y1"), "block_index")
    prev = F.lag(F.struct("kind", "y0")).over(order)
    near = (prev["kind"] == "figure") & (prev["y0"] - F.col("y1") <= 2 * F.col("size"))
    small = F.col("size") < F.median("size").over(Window.partitionBy(*PAGE))
    return blocks.withColumn("is_caption", F.coalesce(near & small, F.lit(False)))


def figures(images: DataFrame, glyphs: DataFrame, share: float = 0.5) -> DataFrame:
    """Images of which less than ``share`` is covered by glyph boxes. The join is by page: a page's images are few."""
    img, g = Box.of("i_"), Box.of()
    pairs = images.join(glyphs, list(PAGE), "left")
    covered = F.coalesce(F.sum(img.overlap(g)), F.lit(0.0)) / F.first(img.area)
    keys = [*PAGE, "image_index"]
    out = pairs.groupBy(*keys).agg(covered.alias("covered"), F.first("i_y1").alias("top"))
    return out.where(F.col("covered") < share)


def zone(y0: Column, y1: Column, height: Column, share: float = 0.07) -> Column:
    return F.when(y1 >= (1 - share) * height, F.lit("header")).when(y0 <= share * height, F.lit("footer"))


def same_position(a: Box, b: Box) -> Column:
    """Edges within 5 points up and down; and within 10 points left and right, or both boxes 400 points wide or wider."""
    level = (F.abs(a.y0 - b.y0) < 5) | (F.abs(a.y1 - b.y1) < 5)
    column = (F.abs(a.x0 - b.x0) < 10) & (F.abs(a.x1 - b.x1) < 10)
    return level & (column | ((a.width >= 400) & (b.width >= 400)))


def headers_and_footers(blocks: DataFrame, height: float = 792.0, window: int = 4, least: int = 3) -> DataFrame:
    """Blocks of the top or bottom 7 per cent that recur on ``least`` consecutive pages or more, with their zone.

    A block and one on each of the next pages of the window must have the same zone and place, and texts within an edit
    distance of 5 per cent. Only zone blocks are joined, by document, zone and page distance; a match is found for each
    distance, and the unbroken run from the first page decides.
    """
    z = blocks.withColumn("zone", zone(F.col("y0"), F.col("y1"), F.lit(height))).where("zone is not null").select(*PAGE, "block_index", "zone", "text", "x0", "y0", "x1", "y1")
    ahead = z.select("*", F.explode(F.sequence(F.lit(1), F.lit(window - 1))).alias("step")).withColumn("page_b", F.col("page_index") + F.col("step"))
    b = z.select(*(F.col(c).alias(f"b_{c}") for c in z.columns))
    on = (ahead["doc_id"] == b["b_doc_id"]) & (ahead["page_b"] == b["b_page_index"]) & (ahead["zone"] == b["b_zone"])
    pairs = ahead.join(b, on).where(same_position(Box.of(), Box.of("b_")) & scalars.nearly_equal(F.col("text"), F.col("b_text")))
    found = pairs.groupBy("doc_id", "page_index", "block_index", "zone", "step").agg(F.min("b_block_index").alias("other"))
    runs = found.groupBy("doc_id", "page_index", "block_index", "zone").agg(F.map_from_entries(F.collect_list(F.struct("step", "other"))).alias("others"))
    steps = [F.array_contains(F.map_keys("others"), s) for s in range(1, window)]
    length, unbroken = F.lit(1), F.lit(True)
    for s in steps:
        unbroken = unbroken & s
        length = length + unbroken.cast("int")
    runs = runs.withColumn("length", length).where(F.col("length") >= least)
    member = F.explode(F.sequence(F.lit(0), F.col("length") - 1)).alias("step")
    marked = runs.select("doc_id", "page_index", "block_index", "zone", "others", member).select(
        "doc_id",
        (F.col("page_index") + F.col("step")).alias("page_index"),
        F.when(F.col("step") == 0, F.col("block_index")).otherwise(F.col("others")[F.col("step")]).alias("block_index"),
        "zone",
    )
    return marked.distinct()
