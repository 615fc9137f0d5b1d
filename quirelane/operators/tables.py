"""Tables from ruling segments and from aligned text.

Segments and crossings are joined within a page; a page's segments are bounded.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from quirelane.functions.geometry import Box
from quirelane.operators.groups import folded

PAGE = ("doc_id", "page_index")
SLACK, GAP, ROUND = 1.0, 2.0, 0.1


def merge_segments(segments: DataFrame, keys: Sequence[str] = (*PAGE, "orientation"), gap: float = GAP) -> DataFrame:
    """Segments (pos, lo, hi) of one whole-point position, joined where they overlap or lie within ``gap``."""
    keys = [*keys, "bucket"]
    s = segments.withColumn("bucket", F.col("pos").cast("int"))
    w = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce(F.col("lo") > reach + gap, F.lit(True)).cast("int")
    s = s.withColumn("__new", new).withColumn("__run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*keys, "__run").agg(F.min("pos").alias("pos"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("__run", "bucket")


#: Sides of the cells in which segments meet: a dozen on a common page, as each segment is filed in all cells that it crosses.
CELL = 216.0


def intersections(segments: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Points at which a horizontal and a vertical segment meet, with a point's slack; equal to a tenth: one point.

    A vertical segment is filed under its column of cells and each row that it crosses, a horizontal one under its row and
    each column; two meet in the one cell of their crossing, so segments of other parts of a page are never compared.
    """
    cell = lambda c: F.floor(c / CELL).cast("int")
    over = lambda: F.explode(F.sequence(cell(F.col("lo") - SLACK), cell(F.greatest("lo", "hi") + SLACK)))
    h = segments.where("orientation = 'h'").select(*keys, F.col("pos").alias("y"), F.col("lo").alias("hx0"), F.col("hi").alias("hx1"), over().alias("__cx"), cell(F.col("pos")).alias("__cy"))
    v = segments.where("orientation = 'v'").select(*keys, F.col("pos").alias("x"), F.col("lo").alias("vy0"), F.col("hi").alias("vy1"), cell(F.col("pos")).alias("__cx"), over().alias("__cy"))
    meet = (F.col("x") >= F.col("hx0") - SLACK) & (F.col("x") <= F.col("hx1") + SLACK) & (F.col("y") >= F.col("vy0") - SLACK) & (F.col("y") <= F.col("vy1") + SLACK)
    return h.join(v, [*keys, "__cx", "__cy"]).where(meet).select(*keys, F.round("x", 1).alias("x"), F.round("y", 1).alias("y")).distinct()


def grids(points: DataFrame, keys: Sequence[str] = PAGE, least_cells: int = 4) -> DataFrame:
    """One grid per page, of sorted distinct xs and ys, with at least four cells."""
    g = points.groupBy(*keys).agg(F.array_sort(F.collect_set("x")).alias("xs"), F.array_sort(F.collect_set("y")).alias("ys"))
    return g.where((F.size("xs") > 1) & (F.size("ys") > 1) & ((F.size("xs") - 1) * (F.size("ys") - 1) >= least_cells))


def cells(grid: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """A row per cell: row from the top, col from the left, and its box."""
    r = grid.select("*", F.explode(F.sequence(F.lit(0), F.size("ys") - 2)).alias("row"))
    c = r.select("*", F.explode(F.sequence(F.lit(0), F.size("xs") - 2)).alias("col"))
    top = F.size("ys") - F.col("row")
    return c.select(
        *keys,
        "row",
        "col",
        F.element_at("xs", F.col("col") + 1).alias("x0"),
        F.element_at("ys", top - 1).alias("y0"),
        F.element_at("xs", F.col("col") + 2).alias("x1"),
        F.element_at("ys", top).alias("y1"),
    )


def assign(spans: DataFrame, cell: DataFrame, keys: Sequence[str] = PAGE, pad: float = 0.5) -> DataFrame:
    """Spans with the cell whose padded half-open box holds their centre; row and col are null for orphans.

    The cell is found by its place in the sorted edges, so no span meets more than its page's grid.
    """
    edges = cell.groupBy(*keys).agg(F.array_sort(F.collect_set("x0")).alias("__x0"), F.array_sort(F.collect_set("y1")).alias("__y1"), F.max("x1").alias("__right"), F.min("y0").alias("__low"))
    cx, cy = Box.of().centre
    s = spans.join(edges, list(keys), "left")
    col = F.size(F.filter("__x0", lambda e: e - F.when(e == F.array_min("__x0"), pad).otherwise(0.0) <= cx)) - 1
    row = F.size(F.filter("__y1", lambda e: e + F.when(e == F.array_max("__y1"), pad).otherwise(0.0) > cy))
    inside = (cx < F.col("__right") + pad) & (cy >= F.col("__low") - pad) & (col >= 0) & (row > 0)
    return s.withColumns({"row": F.when(inside, row - 1), "col": F.when(inside, col)}).drop("__x0", "__y1", "__right", "__low")


def edge_present(covered: Column, length: Column, least: float = 0.8) -> Column:
    return covered / length >= least


def header_rows(cell: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Rows from the top, without a break, whose cells with text are all bold and at least two."""
    filled = F.col("text") != ""
    by_row = cell.groupBy(*keys, "row").agg((F.bool_and(F.when(filled, F.col("bold"))) & (F.count_if(filled) >= 2)).alias("__all"))
    first_other = F.min(F.when(~F.coalesce("__all", F.lit(False)), F.col("row"))).over(Window.partitionBy(*keys))
    return by_row.withColumn("__stop", first_other).where(F.col("__stop").isNull() | (F.col("row") < F.col("__stop"))).select(*keys, "row")


def anchored_clusters(spans: DataFrame, keys: Sequence[str] = PAGE, tolerance: float = 2.0) -> DataFrame:
    """Spans with a cluster of their x0: it holds what lies within ``tolerance`` of its first member, from the left.

    Anchoring at the first member is a fold over sorted starts; a page is a bounded group.
    """

    def fold(rows: pd.DataFrame, page: np.ndarray) -> list[int]:
        out, anchor, n = [], None, -1
        for on_new_page, x in zip(page.tolist(), rows["x0"].tolist(), strict=True):
            if on_new_page:
                anchor, n = None, -1
            if anchor is None or x - anchor > tolerance:
                anchor, n = x, n + 1
            out.append(n)
        return out

    return folded(spans, keys, ["x0"], fold, StructField("cluster", IntegerType()))


#: Spans that a task folds at once, in whole pages.
SPANS = 1 << 20


def _by_pages(spans: DataFrame, keys: Sequence[str], fold: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, list[pa.Array]]], out: StructType) -> DataFrame:
    """Rows of whole pages: ``fold`` gets page numbers, x0 and y0 of all spans of some pages, and gives rows with their pages' numbers.

    Starts are all that is shuffled, as lists made before it; both lists of a page are in one order, as one aggregation makes them
    and no value is null.
    """
    start = lambda c: F.collect_list(F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))))
    pages = spans.groupBy(*keys).agg(start("x0").alias("__x"), start("y0").alias("__y"))
    schema = StructType([*(spans.schema[k] for k in keys), *out.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends, first = np.cumsum(batch["__x"].value_lengths().to_numpy(zero_copy_only=False)), 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SPANS, "right")))
                part = batch.slice(first, last - first)
                page = np.repeat(np.arange(part.num_rows), part["__x"].value_lengths().to_numpy(zero_copy_only=False))
                own, columns = fold(page, *(part[c].flatten().to_numpy(zero_copy_only=False) for c in ("__x", "__y")))
                if len(own):
                    yield pa.RecordBatch.from_arrays([*(part[k].take(pa.array(own)) for k in keys), *columns], names=schema.names)
                first = last

    return pages.mapInArrow(run, schema)


def _clusters(page: np.ndarray, x: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, cluster, begin): spans by page and start, their clusters as in ``anchored_clusters``, and where each begins in that order."""
    order = np.lexsort((x, page))
    x, page = x[order], page[order]
    new = np.ones(len(x), bool)
    new[1:] = (page[1:] != page[:-1]) | (x[1:] - x[:-1] > tolerance)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(x))
    # starts that follow each other closely are one cluster unless they go too far together
    for a, b in zip(begin, end, strict=True) if len(x) and (x[end - 1] - x[begin] > tolerance).any() else ():
        while x[b - 1] - x[a] > tolerance:
            a += int(np.searchsorted(x[a:b] - x[a], tolerance, "right"))
            new[a] = True
    return order, np.cumsum(new) - 1, np.flatnonzero(new)


def _distinct(*columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows, sorted by the first column, then the next."""
    order = np.lexsort(columns[::-1])
    columns = tuple(c[order] for c in columns)
    new = np.ones(len(order), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return tuple(c[new] for c in columns)


def _shared(page: np.ndarray, height: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(page, height) of heights at which spans of two clusters or more lie, sorted."""
    p, h, _ = _distinct(page, height, cluster)
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    many = np.diff(np.append(at, len(p))) >= 2
    return p[at[many]], h[at[many]]


def borderless(spans: DataFrame, keys: Sequence[str] = PAGE, least_spans: int = 3, least_columns: int = 3, least_rows: int = 3, tolerance: float = 2.0) -> DataFrame:
    """Pages with a table without rules: columns are clusters of three spans or more, rows are heights that two of these share."""

    def fold(page: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        n = int(page[-1]) + 1 if len(page) else 0
        order, cluster, begin = _clusters(page, x, tolerance)
        column = np.bincount(cluster, minlength=len(begin)) >= least_spans
        held = column[cluster]
        p, h = page[order][held], np.floor(y[order][held] / 2)
        n_rows, n_columns = np.bincount(_shared(p, h, cluster[held])[0], minlength=n), np.bincount(page[order][begin[column]], minlength=n)
        own = np.flatnonzero((n_rows >= least_rows) & (n_columns >= least_columns))
        return own, [pa.array(n_rows[own]), pa.array(n_columns[own])]

    return _by_pages(spans, keys, fold, StructType([StructField("n_rows", LongType()), StructField("n_columns", LongType())]))


def borderless_grids(
    spans: DataFrame, keys: Sequence[str] = PAGE, least_spans: int = 3, least_columns: int = 3, least_rows: int = 3, most_gap: float = 100.0, tolerance: float = 2.0
) -> DataFrame:
    """(keys, grid, x0, y0, x1, y1, xs, ys): tables without rules, from the top of each page.

    Columns are clusters of three spans or more, at their leftmost start. Heights count to two points; a row is one that two
    columns share. Rows that are over 100 points apart belong to different tables; a table's ys are all heights of spans
    from its first row to its last. A page of which some column has most of its spans beside no other column is running
    text, and has none.
    """

    def fold(page: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, list[pa.Array]]:
        n = int(page[-1]) + 1 if len(page) else 0
        order, cluster, begin = _clusters(page, x, tolerance)
        p, x, y = page[order], x[order], y[order]
        low = np.floor(np.abs(y / 2))
        h = (np.sign(y) * (low + (np.abs(y / 2) - low >= 0.5))).astype(np.int64)  # to the nearest, halves away from zero
        size = np.bincount(cluster, minlength=len(begin))
        column = size >= least_spans
        held = column[cluster]
        row_page, row = _shared(p[held], h[held], cluster[held])
        # whether a span's height is a row: both are sorted by page and height
        place = lambda page, height: page * (span + 1) + height - bottom
        bottom, span = (int(h.min()), int(h.max() - h.min())) if len(h) else (0, 0)
        aligned = np.bincount(cluster, held & np.isin(place(p, h), place(row_page, row)), minlength=len(begin))
        column_page = p[begin]
        text = np.bincount(column_page[column & (aligned * 2 < size)], minlength=n) > 0
        good = ~text & (np.bincount(column_page[column], minlength=n) >= least_columns) & (np.bincount(row_page, minlength=n) >= least_rows)
        down = np.lexsort((-row, row_page))
        down = down[good[row_page[down]]]
        row_page, row = row_page[down], row[down]
        new = np.ones(len(row), bool)
        new[1:] = (row_page[1:] != row_page[:-1]) | ((row[:-1] - row[1:]) * 2 > most_gap)
        at = np.flatnonzero(new)
        top, low, of = row[at], row[np.append(at[1:], len(row)) - 1] if len(at) else row, row_page[at]
        grid = np.arange(len(at)) - np.searchsorted(of, of)
        own, grids, ys, xs = [], [], [], []
        kept = good[p]
        p, y, h = p[kept], y[kept], h[kept]
        first, last = np.searchsorted(p, of), np.searchsorted(p, of, "right")
        starts = _starts(column_page[column], x[begin[column]]) if len(of) else {}
        for q, g, t, b, i, j in zip(of.tolist(), grid.tolist(), top.tolist(), low.tolist(), first.tolist(), last.tolist(), strict=True):
            heights = np.unique(h[i:j][(y[i:j] <= t * 2) & (y[i:j] >= b * 2)])[::-1] * 2.0
            if len(heights) >= least_rows:
                own.append(q)
                grids.append(g)
                ys.append(heights)
                xs.append(starts[q])
        edge = lambda lists, i: pa.array([a[i] for a in lists], pa.float64())
        listed = lambda lists: pa.array(lists, pa.list_(pa.float64()))
        return np.array(own, np.int64), [pa.array(grids, pa.int32()), edge(xs, 0), edge(ys, -1), edge(xs, -1), edge(ys, 0), listed(xs), listed(ys)]

    edges = [StructField(c, DoubleType()) for c in ("x0", "y0", "x1", "y1")]
    return _by_pages(spans, keys, fold, StructType([StructField("grid", IntegerType()), *edges, *(StructField(c, ArrayType(DoubleType())) for c in ("xs", "ys"))]))


def _starts(page: np.ndarray, x: np.ndarray) -> dict[int, np.ndarray]:
    """The starts of each page's columns; both are sorted by page."""
    pages, first = np.unique(page, return_index=True)
    return dict(zip(pages.tolist(), np.split(x, first[1:]), strict=True))


def column_rmse(a: Column, b: Column) -> Column:
    """Root of the mean squared difference of two lists of edges of one length."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.size(a))


def continuations(tables: DataFrame, height: float = 792.0, edge: float = 50.0, most: float = 5.0) -> DataFrame:
    """Pairs of tables on following pages that are one: the first ends within 50 points of the bottom, the next starts as
    near to the top, and their edges are as many and within an RMSE of 5."""
    a, b = tables.alias("a"), tables.alias("b")
    on = (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.page_index") + 1 == F.col("b.page_index"))
    near = (F.col("a.y0") <= edge) & (F.col("b.y1") >= height - edge) & (F.size("a.xs") == F.size("b.xs"))
    rmse = column_rmse(F.col("a.xs"), F.col("b.xs"))
    return a.join(b, on).where(near & (rmse < most)).select("a.doc_id", "a.page_index", F.col("b.page_index").alias("next_page"), rmse.alias("rmse"))
