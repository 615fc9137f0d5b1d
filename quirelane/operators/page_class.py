"""Page classes by votes of signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirelane.functions.geometry import Box, grid_cell

# Thresholds and strengths of the signals.
FULL_PAGE_IMAGE, IMAGE_COVERAGE, LOW_VALIDITY, HIGH_VALIDITY, LOW_DENSITY = 0.95, 0.85, 0.4, 0.85, 0.03
SHORT_CIRCUIT, HYBRID_CELLS = 0.95, 10


def signals() -> list[tuple[str, float, Column]]:
    """(class, strength, condition) in order, over columns of page signals.

    text_ops, invisible_ops, image_share (of the page, at most 1), full_page_image, chars, valid_chars, page_area, and
    density_ratio: extracted characters by expected ones.
    """
    c = F.col
    shown = c("text_ops") > 0
    validity = F.when(c("chars") > 0, c("valid_chars") / c("chars")).otherwise(1.0)
    good = shown & (validity > HIGH_VALIDITY)
    sparse = F.when(c("page_area") > 0, c("valid_chars") / c("page_area") < LOW_DENSITY).otherwise(c("valid_chars") == 0)
    return [
        ("scanned", 0.95, (c("text_ops") == 0) & (c("image_share") > 0)),
        ("broken_vector", 0.99, (c("text_ops") > 0) & (c("invisible_ops") == c("text_ops")) & c("full_page_image")),
        ("scanned", 0.85, c("image_share") > IMAGE_COVERAGE),
        ("broken_vector", 0.80, shown & (validity < LOW_VALIDITY)),
        ("scanned", 0.95, shown & (c("density_ratio") < LOW_DENSITY)),
        ("vector", 0.90, good),
        ("scanned", 0.65, ~good & sparse),
    ]


def classify(pages: DataFrame) -> DataFrame:
    """Adds page_class and class_confidence.

    Blank pages: vector with confidence 0. A hybrid grid decides first. Then the first signal of strength 0.95 or more
    decides; else the class with the largest sum of strengths, by its share of all. Without votes: vector, 0.5.
    Ties: vector, then scanned, then broken_vector.
    """
    votes = signals()
    fired = [F.coalesce(cond, F.lit(False)) for _, _, cond in votes]
    sums = {k: sum((F.when(on, F.lit(s)).otherwise(0.0) for (c, s, _), on in zip(votes, fired, strict=True) if c == k), F.lit(0.0)) for k in ("vector", "scanned", "broken_vector")}
    total = sum(sums.values(), F.lit(0.0))
    best = F.greatest(*sums.values())
    by_vote = F.when(sums["vector"] == best, F.lit("vector")).when(sums["scanned"] == best, F.lit("scanned")).otherwise(F.lit("broken_vector"))
    blank = (F.col("chars") == 0) & (F.col("image_share") == 0)
    hybrid = (F.col("vector_cells") >= HYBRID_CELLS) & (F.col("scanned_cells") >= HYBRID_CELLS)
    cls = F.when(blank, F.lit("vector")).when(hybrid, F.lit("hybrid"))
    conf = F.when(blank, F.lit(0.0)).when(hybrid, F.least("vector_cells", "scanned_cells") / 64)
    for (name, strength, _), on in zip(votes, fired, strict=True):
        if strength >= SHORT_CIRCUIT:
            cls, conf = cls.when(on, F.lit(name)), conf.when(on, F.lit(strength))
    cls = cls.when(total == 0, F.lit("vector")).otherwise(by_vote)
    conf = conf.when(total == 0, F.lit(0.5)).otherwise(best / total)
    return pages.withColumns({"page_class": cls, "class_confidence": conf})


def cell_class(validity: Column, image_share: Column) -> Column:
    """vector from a validity of 0.6 without much image, scanned from an image share of 0.8, else mixed."""
    return F.when(image_share >= 0.80, F.lit("scanned")).when(validity >= 0.6, F.lit("vector")).otherwise(F.lit("mixed"))


#: Rows and columns of the grid over a page.
GRID = 8
# A cell with text of so much validity is vector, one without text and with more image is scanned.
CELL_VALIDITY, CELL_IMAGE = 0.6, 0.80


def grid_cells(pages: DataFrame, glyphs: DataFrame, images: DataFrame, keys: Sequence[str] = ("doc_id", "page_index")) -> DataFrame:
    """(keys, row, col, text_ops, valid, image_share, cell_class) of every cell of a page's grid that holds anything.

    ``pages`` (width, height), ``glyphs`` (box, valid) by their centres, and ``images`` (box) by what of each cell they
    cover, all images together at most 1. row 0 is at the top. vector: text of a validity over 0.6; scanned: no text and an
    image share over 0.8; else mixed.
    """
    keys = list(keys)
    size = pages.select(*keys, "width", "height").where("width > 0 AND height > 0")
    cx, cy = Box.of().centre
    up, col = grid_cell(cx, cy, F.col("width"), F.col("height"), GRID)
    box = ("x0", "y0", "x1", "y1")
    text = glyphs.select(*keys, *box, "valid").join(size, keys).groupBy(*keys, (GRID - 1 - up).alias("row"), col.alias("col")).agg(F.count("*").alias("text_ops"), F.count_if("valid").alias("valid"))
    first_up, first_col = grid_cell(F.least("x0", "x1"), F.least("y0", "y1"), F.col("width"), F.col("height"), GRID)
    last_up, last_col = grid_cell(F.greatest("x0", "x1"), F.greatest("y0", "y1"), F.col("width"), F.col("height"), GRID)
    spread = images.select(*keys, *box).join(size, keys).withColumn("up", F.explode(F.sequence(first_up, last_up))).withColumn("col", F.explode(F.sequence(first_col, last_col)))
    w, h = F.col("width") / GRID, F.col("height") / GRID
    shared = lambda lo, hi, at, side: F.greatest(F.least(hi, (at + 1) * side) - F.greatest(lo, at * side), F.lit(0.0))
    part = shared(F.least("x0", "x1"), F.greatest("x0", "x1"), F.col("col"), w) * shared(F.least("y0", "y1"), F.greatest("y0", "y1"), F.col("up"), h) / (w * h)
    cover = spread.groupBy(*keys, (GRID - 1 - F.col("up")).alias("row"), "col").agg(F.least(F.sum(part), F.lit(1.0)).alias("image_share"))
    both = text.join(cover, [*keys, "row", "col"], "full_outer").na.fill(0, ["text_ops", "valid"]).na.fill(0.0, ["image_share"])
    vector = (F.col("text_ops") > 0) & (F.col("valid") / F.col("text_ops") > CELL_VALIDITY)
    return both.withColumn("cell_class", F.when(vector, "vector").when((F.col("image_share") > CELL_IMAGE) & (F.col("text_ops") == 0), "scanned").otherwise("mixed"))


def grid_counts(cells: DataFrame, keys: Sequence[str] = ("doc_id", "page_index")) -> DataFrame:
    """(keys, vector_cells, scanned_cells, hybrid_cells): the last are the numbers, from the top left, of the scanned cells of hybrid pages."""
    is_a = lambda k: F.col("cell_class") == k
    found = cells.groupBy(*keys).agg(
        F.count_if(is_a("vector")).alias("vector_cells"), F.count_if(is_a("scanned")).alias("scanned_cells"),
        F.array_sort(F.collect_list(F.when(is_a("scanned"), F.col("row") * GRID + F.col("col")))).alias("hybrid_cells"),
    )
    hybrid = (F.col("vector_cells") >= HYBRID_CELLS) & (F.col("scanned_cells") >= HYBRID_CELLS)
    return found.withColumn("hybrid_cells", F.when(hybrid, F.col("hybrid_cells")))


def escalate(page_class: Column, readability: Column) -> Column:
    return F.when((page_class == "vector") & (readability < 0.5), F.lit("broken_vector")).otherwise(page_class)


def page_type(page_class: Column, chars: Column, image_share: Column) -> Column:
    return (
        F.when((chars == 0) & (image_share == 0), F.lit("blank"))
        .when((chars == 0) & (page_class == "vector"), F.lit("figure_only"))
        .when(page_class == "vector", F.lit("text"))
        .when(page_class == "hybrid", F.lit("mixed"))
        .otherwise(page_class)
    )
