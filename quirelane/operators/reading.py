"""Reading order by nearest neighbours, block kinds of tagged files, and assembled tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField

from quirelane.operators.groups import folded
from quirelane.session import cut

# Standard structure types and the block kinds that they stand for.
KINDS = {
    "P": "paragraph", "H": "heading", "H1": "heading", "H2": "heading", "H3": "heading", "H4": "heading", "H5": "heading", "H6": "heading",
    "L": "list", "LI": "list", "LBody": "list", "Lbl": "list", "Table": "table", "TR": "table", "TH": "table", "TD": "table",
    "Figure": "figure", "Caption": "caption", "Code": "code", "Formula": "formula", "Note": "footnote", "TOC": "toc", "TOCI": "toc", "BlockQuote": "quote",
}


def block_kind(role: Column) -> Column:
    """Block kind of a standard structure type; others are paragraphs."""
    pairs = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    return F.coalesce(F.try_element_at(pairs, role), F.lit("paragraph"))


def heading_level(role: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(role, "^H([1-6])$", 1), F.lit("")).cast("int"), F.when(role == "H", 1))


def shown_kinds(blocks: DataFrame, hidden: Sequence[str]) -> DataFrame:
    return blocks.where(~F.col("kind").isin(*hidden)) if hidden else blocks


def neighbours(blocks: DataFrame, keys: Sequence[str] = ("doc_id", "page_index"), index: str = "block_index", k: int = 5) -> DataFrame:
    """(keys, index, other, dx, dy, gap): each block's ``k`` nearest of its page by their centres, ties to the smaller index.

    Centres lie in a grid whose cells a page's own density sizes; a block meets those of the nine cells around it that are
    within a cell's side. Blocks that find too few look again in cells of twice the side, so no page is ever met whole
    unless it has few blocks, and the nearest are exact.
    """
    keys = list(keys)
    centre = blocks.select(*keys, index, ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    spread = lambda c: F.max(c) - F.min(c) + 1
    page = centre.groupBy(*keys).agg(F.count("*").alias("n"), (spread("cx") * spread("cy")).alias("area"))
    page = page.where("n > 1").withColumn("side", F.sqrt(F.col("area") * k / F.col("n"))).drop("area")
    points = cut(centre.join(page, keys))
    pending, found, side, offsets = points, [], F.col("side"), F.array(*(F.lit(i) for i in (-1, 0, 1)))
    for turn in range(64):
        reach = side * (1 << turn)
        cell = lambda c: F.floor(F.col(c) / reach)  # noqa: E731, B023
        own = pending.withColumn("gx", F.explode(F.transform(offsets, lambda i: cell("cx") + i))).withColumn("gy", F.explode(F.transform(offsets, lambda i: cell("cy") + i)))
        there = points.select(*keys, F.col(index).alias("other"), F.col("cx").alias("ox"), F.col("cy").alias("oy"), cell("cx").alias("gx"), cell("cy").alias("gy"))
        gap = F.sqrt((F.col("ox") - F.col("cx")) ** 2 + (F.col("oy") - F.col("cy")) ** 2)
        met = own.join(there, [*keys, "gx", "gy"]).where(F.col(index) != F.col("other")).withColumn("gap", gap).where(F.col("gap") <= reach)
        rank = F.row_number().over(Window.partitionBy(*keys, index).orderBy("gap", "other"))
        near = cut(met.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("enough", F.least(F.lit(k), F.col("n") - 1)))
        done = near.groupBy(*keys, index).agg((F.count("*") == F.first("enough")).alias("full")).where("full").select(*keys, index)
        found.append(near.join(done, [*keys, index], "left_semi").select(*keys, index, "other", (F.col("ox") - F.col("cx")).alias("dx"), (F.col("oy") - F.col("cy")).alias("dy"), "gap", "cy", "ox", "oy"))
        pending = cut(pending.join(done, [*keys, index], "left_anti"))
        if not pending.limit(1).count():
            break
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def docstrum(blocks: DataFrame, keys: Sequence[str] = ("doc_id", "page_index"), index: str = "block_index", k: int = 5, degrees: float = 30.0) -> DataFrame:
    """Adds reading_order: a walk over each block's nearest neighbours to its right, or above and below, within 30 degrees.

    Roots are blocks to which no edge leads from above, by columns of 100 points, then from the top; a block's neighbours
    are visited from the top, then from the left. Only the walk itself goes over a page's blocks one by one.
    """
    keys, slope = list(keys), math.tan(math.radians(degrees))
    dx, dy = F.col("dx"), F.col("dy")
    edge = F.when(F.abs(dy) < F.abs(dx), (dx > 0) & (F.abs(dy) <= slope * dx)).otherwise((dy != 0) & (F.abs(dx) <= slope * F.abs(dy)))
    edges = cut(neighbours(blocks, keys, index, k).where(edge))
    target = F.array_sort(F.collect_list(F.struct((-F.col("oy")).alias("down"), F.col("ox").alias("x"), F.col("other"))))  # k at most
    follow = edges.groupBy(*keys, index).agg(F.transform(target, lambda t: t["other"]).alias("__follow"))
    led = edges.where(dy < 0).select(*keys, F.col("other").alias(index), F.lit(True).alias("__led")).distinct()
    rows = blocks.join(follow, [*keys, index], "left").join(led, [*keys, index], "left")
    column, height = F.floor((F.col("x0") + F.col("x1")) / 200), -(F.col("y0") + F.col("y1"))

    def fold(frame: pd.DataFrame, first: np.ndarray) -> np.ndarray:
        """Rows of a page come in the order in which roots are taken."""
        order = np.empty(len(frame), np.int32)
        edges_at = [*np.flatnonzero(first).tolist(), len(frame)]
        names, follow, led = frame[index].tolist(), frame["__follow"].tolist(), frame["__led"].eq(True).tolist()
        for s, e in zip(edges_at, edges_at[1:], strict=False):
            place = {names[i]: i for i in range(s, e)}
            seen: set[int] = set()
            for root in [i for i in range(s, e) if not led[i]] or range(s, e):
                todo = [root]
                while todo:
                    i = todo.pop()
                    if i not in seen:
                        order[i] = len(seen)
                        seen.add(i)
                        if follow[i] is not None:
                            todo += [place[j] for j in reversed(list(follow[i]))]
            for i in sorted(set(range(s, e)) - seen, key=names.__getitem__):  # what no root reaches
                order[i] = len(seen)
                seen.add(i)
        return order

    out = folded(rows, keys, [column, height, index], fold, StructField("reading_order", IntegerType()))
    return out.select(*blocks.columns, "reading_order")


def assembled(cells: DataFrame, keys: Sequence[str] = ("doc_id", "page_index")) -> DataFrame:
    """One row per table: its rows, from the top, as arrays of cells from the left."""
    cell = F.struct("col", "text", "rowspan", "colspan", "header")
    rows = cells.groupBy(*keys, "row").agg(F.array_sort(F.collect_list(cell)).alias("cells"))
    return rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "cells"))).alias("rows"))


def valid_signals(pages: DataFrame) -> DataFrame:
    """Adds ``invalid``: why a page's signals can't be classified, or null."""
    c = F.col
    reason = (
        F.when(c("page_area") <= 0, F.lit("dimensions"))
        .when(~c("image_share").between(0, 1), F.lit("image_share"))
        .when((c("chars") < 0) | (c("valid_chars") < 0) | (c("valid_chars") > c("chars")), F.lit("characters"))
        .when(c("invisible_ops") > c("text_ops"), F.lit("operators"))
    )
    return pages.withColumn("invalid", reason)
