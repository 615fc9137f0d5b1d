"""Differences of pages and documents, and tolerant comparison of nested values."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField

from quirelane.functions import scalars
from quirelane.functions.geometry import Box
from quirelane.operators.groups import folded
from quirelane.session import cut


def same_place(a: Box, b: Box) -> Column:
    """Intersection over union, and 1 for equal boxes: an empty line has a box without area, and stands where it stood."""
    equal = (a.x0 == b.x0) & (a.y0 == b.y0) & (a.x1 == b.x1) & (a.y1 == b.y1)
    return F.when(equal, F.lit(1.0)).otherwise(a.iou(b))


def block_score(a: Box, b: Box, text_a: Column, text_b: Column) -> Column:
    return 0.7 * same_place(a, b) + 0.3 * scalars.text_similarity(text_a, text_b)


def span_score(a: Box, b: Box, text_a: Column, text_b: Column) -> Column:
    return 0.5 * same_place(a, b) + 0.5 * scalars.text_similarity(text_a, text_b)


def block_pairs(old: DataFrame, new: DataFrame, keys: Sequence[str], least: float = 0.5, band: float = 24.0) -> DataFrame:
    """Candidate pairs of blocks of one page with their similarity and score, over ``least``.

    A score over one half needs an overlap of over 0.2 / 0.7, so only blocks that share a horizontal band of the page
    are met, each pair in the first band that both touch, and texts are compared, once, for overlapping boxes only.
    """
    bands = lambda lo, hi: F.sequence(F.floor(F.col(lo) / band), F.floor(F.col(hi) / band))
    a = old.select("*", F.explode(bands("y0", "y1")).alias("__band"))
    b = new.select(*(F.col(k).alias(f"b_{k}") for k in keys), *(F.col(c).alias(f"b_{c}") for c in ("block_index", "text", "x0", "y0", "x1", "y1")))
    b = b.select("*", F.explode(bands("b_y0", "b_y1")).alias("__b_band"))
    on = [*(F.col(k) == F.col(f"b_{k}") for k in keys), F.col("__band") == F.col("__b_band")]
    once = F.col("__band") == F.greatest(F.floor(F.col("y0") / band), F.floor(F.col("b_y0") / band))
    iou = same_place(Box.of(), Box.of("b_"))
    met = a.join(b, on).where(once & (iou > (least - 0.3) / 0.7))
    # a generator computes what a filter and a projection would each compute
    scored = F.array(F.struct(iou.alias("iou"), scalars.text_similarity(F.col("text"), F.col("b_text")).alias("similarity")))
    over = F.filter(scored, lambda s: 0.7 * s["iou"] + 0.3 * s["similarity"] > least)
    found = met.select("*", F.explode(over).alias("__s")).drop("__band", "__b_band")
    return found.withColumns({"similarity": F.col("__s.similarity"), "score": 0.7 * F.col("__s.iou") + 0.3 * F.col("__s.similarity")}).drop("__s")


def page_diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("doc_id", "page_index"), changed_below: float = 0.9) -> DataFrame:
    """(keys, kind, old_block, new_block, score): changed, same, removed and added blocks.

    Blocks of the old page, in order, each take their best free partner over one half: a fold over the numbers of a page's
    candidate pairs, many pages to a frame. Removed and added blocks are anti joins.
    """
    pairs = block_pairs(old, new, keys).select(*keys, F.col("block_index").alias("old_block"), F.col("b_block_index").alias("new_block"), "score", "similarity")

    def fold(frame: pd.DataFrame, first: np.ndarray) -> list[bool]:
        taken, done, keep = set(), None, []
        for on_new_page, a, b in zip(first.tolist(), frame["old_block"].tolist(), frame["new_block"].tolist(), strict=True):
            if on_new_page:
                taken, done = set(), None
            keep.append(a != done and b not in taken)
            if keep[-1]:
                done = a
                taken.add(b)
        return keep

    folded_ = folded(pairs, list(keys), ["old_block", F.desc("score"), "new_block"], fold, StructField("__keep", BooleanType()))
    matched = cut(folded_.where("__keep").drop("__keep"))
    kind = F.when(F.col("similarity") < changed_below, F.lit("changed")).otherwise(F.lit("same"))
    both = matched.select(*keys, kind.alias("kind"), "old_block", "new_block", "score")
    gone = old.select(*keys, F.col("block_index").alias("old_block")).join(matched, [*keys, "old_block"], "left_anti")
    fresh = new.select(*keys, F.col("block_index").alias("new_block")).join(matched, [*keys, "new_block"], "left_anti")
    return both.unionByName(gone.withColumn("kind", F.lit("removed")), allowMissingColumns=True).unionByName(fresh.withColumn("kind", F.lit("added")), allowMissingColumns=True)


def diff_summary(diff: DataFrame, old_pages: DataFrame, new_pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by kind and both page counts per document; documents on either side count."""
    kinds = diff.groupBy(key).agg(*(F.count_if(F.col("kind") == k).alias(k) for k in ("changed", "removed", "added", "same")))
    a = old_pages.groupBy(key).agg(F.count_distinct("page_index").alias("old_pages"))
    b = new_pages.groupBy(key).agg(F.count_distinct("page_index").alias("new_pages"))
    j = a.join(b, key, "full_outer").join(kinds, key, "left")
    return j.na.fill(0)


def compare_values(old: DataFrame, new: DataFrame, key: str = "doc_id", tolerances: dict[str, float] | None = None) -> DataFrame:
    """Rows (key, path, old, new) that differ, of two tables of (key, path, value) with text values.

    Where a path has a tolerance, numbers within it are equal. A path on one side only differs.
    """
    j = old.select(key, "path", F.col("value").alias("old")).join(new.select(key, "path", F.col("value").alias("new")), [key, "path"], "full_outer")
    same = F.col("old").eqNullSafe(F.col("new"))
    for path, most in (tolerances or {}).items():
        gap = F.abs(F.col("old").try_cast("double") - F.col("new").try_cast("double")) <= most
        same = same | ((F.col("path") == path) & F.coalesce(gap, F.lit(False)))
    return j.where(~same)


def flatten(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(key, path, value) of some columns, values as text."""
    pairs = F.array(*(F.struct(F.lit(c).alias("path"), F.col(c).cast("string").alias("value")) for c in columns))
    return df.select(key, F.explode(pairs).alias("__p")).select(key, "__p.path", "__p.value")
