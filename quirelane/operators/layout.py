"""Runs of glyphs and words to spans, lines, blocks and columns.

Runs are found as gaps and islands: a change flag by ``lag`` in reading order, its running sum, and a grouping by that sum.
Every window is partitioned by document and page (or a finer key), so that no window ever holds a whole table.
"""

from __future__ import annotations

from bisect import insort
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from quirelane.functions.geometry import Box, baseline, union_box
from quirelane.operators.groups import folded

PAGE = ("doc_id", "page_index")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], breaks: Column, name: str = "island") -> DataFrame:
    """Adds a run number, from 0, that grows by one where ``breaks`` is true. Nulls break nothing."""
    w = Window.partitionBy(*keys).orderBy(*order)
    flagged = df.withColumn("__break", F.coalesce(breaks, F.lit(False)).cast("int"))
    return flagged.withColumn(name, F.sum("__break").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__break")


def previous(name: str | Column, keys: Sequence[str], order: Sequence[str | Column]) -> Column:
    return F.lag(name).over(Window.partitionBy(*keys).orderBy(*order))


def ordered_text(sep: str, text: str, *order: str) -> Column:
    """Texts of a group, joined in order."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text)))
    return F.array_join(F.transform(rows, lambda r: r[text]), sep)


#: Words that a task merges at once, in whole groups.
WORDS = 1 << 19


def _merged(words: DataFrame, keys: Sequence[str], order: Sequence[str], breaks: Callable[[Callable, Callable], list[pa.Array]], used: Sequence[str], firsts: Sequence[str], least: Sequence[str]) -> DataFrame:
    """(keys, span_index, text, firsts, least, box): runs of words, whose first values, least values and boxes they keep.

    ``breaks`` gets what gives a column of each word but the first and what gives that of the word before, and gives conditions
    under which a run ends; null ends none. Words of a group meet once, as a list, so no window or sort holds them beside it.
    """
    box = ["x0", "y0", "x1", "y1"]
    own = [*order, "text", *dict.fromkeys([*used, *firsts, *least, *box])]
    rows = F.collect_list(F.struct(*own))
    schema = StructType([*(words.schema[k] for k in keys), StructField("span_index", IntegerType()), StructField("text", StringType()), *(words.schema[c] for c in (*firsts, *least, *box))])

    def spans(group: np.ndarray, flat: pa.StructArray) -> tuple[np.ndarray, list[pa.Array]]:
        column = lambda c: flat.field(flat.type.get_field_index(c))
        sort = np.lexsort([*(column(c).to_numpy(zero_copy_only=False) for c in reversed(order)), group])
        flat = flat.take(pa.array(sort))
        group = group[sort]
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        for b in breaks(lambda c: column(c).slice(1), lambda c: column(c).slice(0, len(group) - 1)):
            new[1:] |= pc.fill_null(b, False).to_numpy(zero_copy_only=False)
        begin = np.flatnonzero(new)
        of = group[begin]
        number = pa.array((np.arange(len(begin)) - np.searchsorted(of, of)).astype(np.int32))
        text = column("text")
        ends = np.concatenate([[0], np.cumsum(text.is_valid().to_numpy(zero_copy_only=False))])[np.append(begin, len(group))]
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), text.drop_null()), " ")
        at, out = pa.array(begin), [number, joined]
        out += [column(c).take(at) for c in firsts]
        for c in (*least, *box):
            far = np.fmax if c in ("x1", "y1") else np.fmin
            out.append(pa.array(far.reduceat(column(c).to_numpy(zero_copy_only=False), begin), column(c).type, from_pandas=True))
        return of, out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch["__w"].value_lengths().to_numpy(zero_copy_only=False)
            ends, first = np.cumsum(size), 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + WORDS, "right")))
                part = batch.slice(first, last - first)
                of, columns = spans(np.repeat(np.arange(last - first), size[first:last]), part["__w"].flatten())
                yield pa.RecordBatch.from_arrays([*(part[k].take(pa.array(of)) for k in keys), *columns], names=schema.names)
                first = last

    return words.groupBy(*keys).agg(rows.alias("__w")).mapInArrow(run, schema)


def merge_spans(glyphs: DataFrame, keys: Sequence[str] = (*PAGE, "line_no"), order: str = "word_no", size_delta: float = 0.5) -> DataFrame:
    """Neighbouring runs of one font, size, rendering mode and colour become one span."""
    same = ["font", "rendering_mode", *(["color"] if "color" in glyphs.columns else [])]

    def breaks(own: Callable, before: Callable) -> list[pa.Array]:
        return [*(pc.not_equal(own(c), before(c)) for c in same), pc.greater(pc.abs(pc.subtract(own("size"), before("size"))), size_delta)]

    return _merged(glyphs, keys, [order], breaks, same, ["font", "size", "rendering_mode"], ["confidence"])


def merge_search_spans(words: DataFrame, keys: Sequence[str] = PAGE, order: Sequence[str] = ("line_no", "word_no")) -> DataFrame:
    """Runs for search: a new one on a font change, a baseline shift over a fifth of the size, or a gap over twice the size."""

    def breaks(own: Callable, before: Callable) -> list[pa.Array]:
        shift, gap = pc.abs(pc.subtract(own("y0"), before("y0"))), pc.subtract(own("x0"), before("x1"))
        return [pc.not_equal(own("font"), before("font")), pc.greater(shift, pc.multiply(own("size"), 0.2)), pc.greater(gap, pc.multiply(own("size"), 2.0))]

    return _merged(words, keys, order, breaks, ["font", "size"], [], [])


def cluster_lines(spans: DataFrame, threshold: float, keys: Sequence[str] = PAGE) -> DataFrame:
    """Spans in lines: sorted by baseline, a line ends where the next baseline is over half the threshold away."""
    base = spans.withColumn("baseline", baseline(Box.of()))
    order = ["baseline", "x0"]
    return islands(base, keys, order, F.col("baseline") - previous("baseline", keys, order) > 0.5 * threshold, "line_index")


def upper_median(values: Column) -> Column:
    """The element at half the count of the sorted values, counting from 0."""
    return F.element_at(F.array_sort(values), (F.floor(F.size(values) / 2) + 1).cast("int"))


LTR, RTL = "[A-Za-z\\u00C0-\\u024F\\u0370-\\u058F]", "[\\u0590-\\u08FF]"


def direction(text: Column) -> Column:
    """ltr, rtl, or mixed on a tie of strong letters; ltr where there is none."""
    left, right = F.regexp_count(text, F.lit(LTR)), F.regexp_count(text, F.lit(RTL))
    return F.when((left == 0) & (right == 0), F.lit("ltr")).when(left == right, F.lit("mixed")).when(left > right, F.lit("ltr")).otherwise(F.lit("rtl"))


def finish_lines(clustered: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """One row per line: text from left to right, mean baseline, upper median size and direction."""
    out = clustered.groupBy(*keys, "line_index").agg(
        ordered_text(" ", "text", "x0").alias("text"),
        F.avg("baseline").alias("baseline"),
        upper_median(F.collect_list("size")).alias("size"),
        F.count("*").alias("n_spans"),
        *union_box(),
    )
    return out.withColumn("direction", direction(F.col("text")))


def group_blocks(lines: DataFrame, keys: Sequence[str] = PAGE, column_width: float = 600.0) -> DataFrame:
    """Lines with a block number each, top down within columns.

    A block ends at a column change, a gap over 1.5 times the block's upper median line height, an indent over 0.03 of
    the column's width beyond its first line, a size change over a point, or a change of rendering mode. Median and
    first line belong to the block so far, so pages are folded one by one; a page is a bounded group.
    """
    has_column = "column" in lines.columns

    def fold(rows: pd.DataFrame, page: np.ndarray) -> list[int]:
        columns = rows["column"].to_numpy() if has_column else np.zeros(len(rows))
        block, first, heights, before, out = -1, None, [], None, []
        lines_of = zip(page.tolist(), columns, *(rows[c].to_numpy() for c in ("baseline", "x0", "y0", "size", "rendering_mode")), strict=True)
        for on_new_page, column, baseline, x0, y0, size, mode in lines_of:
            if on_new_page:
                block, first = -1, None
            new = first is None or first[0] != column
            if not new:
                insort(heights, before - y0)
                new = before - baseline > 1.5 * heights[len(heights) // 2] or x0 - first[1] > 0.03 * column_width or abs(size - first[2]) > 1 or mode != first[3]
            if new:
                block, first, heights = block + 1, (column, x0, size, mode), []
            before = baseline
            out.append(block)
        return out

    down = [*(["column"] if has_column else []), F.desc("baseline"), "x0"]
    return folded(lines, keys, down, fold, StructField("block_index", IntegerType()))


def finish_blocks(grouped: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    return grouped.groupBy(*keys, "block_index").agg(
        ordered_text("\n", "text", "line_no").alias("text"), F.count("*").alias("n_lines"), F.max("size").alias("size"), *union_box()
    )


def x0_histogram(spans: DataFrame, width: float, keys: Sequence[str] = PAGE) -> DataFrame:
    """Spans per bucket of one point; starts beyond the page count in its edge buckets."""
    bucket = F.greatest(F.least(F.floor("x0"), F.lit(int(width) - 1)), F.lit(0)).cast("int")
    return spans.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def column_gaps(histogram: DataFrame, width: float, keys: Sequence[str] = PAGE) -> DataFrame:
    """Runs (lo, hi) of empty buckets that are 3 per cent of the width or longer, the margins included.

    A run lies between neighbouring filled buckets, so filled buckets alone give all runs; a page without any has none.
    """
    least, last = -(-int(width * 3) // 100), int(width) - 1
    w = Window.partitionBy(*keys).orderBy("bucket")
    filled = histogram.where("n > 0")
    lo = F.coalesce(F.lag("bucket").over(w), F.lit(-1)) + 1
    before = filled.select(*keys, lo.alias("lo"), (F.col("bucket") - 1).alias("hi"))
    after = filled.groupBy(*keys).agg((F.max("bucket") + 1).alias("lo")).select(*keys, "lo", F.lit(last).alias("hi"))
    return before.unionByName(after).where(F.col("hi") - F.col("lo") + 1 >= least)


def confirm_columns(gaps: DataFrame, line_starts: DataFrame, width: float, keys: Sequence[str] = PAGE, least: int = 3) -> DataFrame:
    """Columns (column, x0, x1) between gaps in which ``least`` lines or more start, from left to right."""
    w = Window.partitionBy(*keys).orderBy("lo")
    pages = line_starts.select(*keys).distinct()
    left = gaps.select(*keys, (F.col("hi") + 1).cast("double").alias("x0"), F.coalesce(F.lead("lo").over(w).cast("double"), F.lit(float(width))).alias("x1"))
    first = pages.join(gaps.groupBy(*keys).agg(F.min("lo").alias("lo")), list(keys), "left").select(
        *keys, F.lit(0.0).alias("x0"), F.coalesce(F.col("lo").cast("double"), F.lit(float(width))).alias("x1")
    )
    ranges = left.unionByName(first).where("x1 > x0")
    starts = line_starts.select(*keys, F.col("x0").alias("start"))
    held = ranges.join(starts, list(keys)).where((F.col("start") >= F.col("x0")) & (F.col("start") < F.col("x1")))
    kept = held.groupBy(*keys, "x0", "x1").agg(F.count("*").alias("n_lines")).where(F.col("n_lines") >= least)
    return kept.withColumn("column", F.row_number().over(Window.partitionBy(*keys).orderBy("x0")) - 1)


def page_columns(spans: DataFrame, width: float, keys: Sequence[str] = PAGE, least: int = 3) -> DataFrame:
    """(keys, x0, x1, n_lines, column): histogram, gaps and confirmed columns of each page from one pass over its spans (line_no, x0).

    A page has at most as many filled buckets as points, and its lines' starts are few: both are arrays of its row.
    """
    least_gap, last = -(-int(width * 3) // 100), int(width)
    bucket = F.greatest(F.least(F.floor("x0"), F.lit(last - 1)), F.lit(0)).cast("int")
    by_line = spans.groupBy(*keys, "line_no").agg(F.min("x0").alias("start"), F.collect_set(bucket).alias("buckets"))
    filled = F.array_sort(F.array_distinct(F.flatten(F.collect_list("buckets"))))
    page = by_line.groupBy(*keys).agg(F.concat(F.array(F.lit(-1)), filled, F.array(F.lit(last))).alias("edges"), F.collect_list("start").alias("starts"))
    runs = F.zip_with(F.slice("edges", 1, F.size("edges") - 1), F.slice("edges", 2, F.size("edges") - 1), lambda a, b: F.struct((a + 1).alias("lo"), (b - 1).alias("hi")))
    page = page.select(*keys, "starts", F.filter(runs, lambda g: g["hi"] - g["lo"] + 1 >= least_gap).alias("gaps"))
    to = lambda g: F.coalesce(g["lo"].cast("double"), F.lit(float(width))).alias("x1")
    between = F.transform("gaps", lambda g, i: F.struct((g["hi"] + 1).cast("double").alias("x0"), to(F.get("gaps", i + 1))))
    page = page.select(*keys, "starts", F.concat(F.array(F.struct(F.lit(0.0).alias("x0"), to(F.get("gaps", F.lit(0))))), between).alias("ranges"))
    counted = F.transform("ranges", lambda r: F.struct(r["x0"].alias("x0"), r["x1"].alias("x1"), F.size(F.filter("starts", lambda s: (s >= r["x0"]) & (s < r["x1"]))).cast("long").alias("n_lines")))
    kept = F.filter(counted, lambda r: (r["x1"] > r["x0"]) & (r["n_lines"] >= least))
    return page.select(*keys, F.posexplode(kept).alias("column", "r")).select(*keys, "r.x0", "r.x1", "r.n_lines", "column")


def assign_columns(spans: DataFrame, columns: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Spans with the column that holds their centre; null where none does. Pages have few columns: no row multiplies."""
    c = columns.select(*keys, F.col("x0").alias("__lo"), F.col("x1").alias("__hi"), "column")
    c = c.groupBy(*keys).agg(F.collect_list(F.struct("__lo", "__hi", "column")).alias("__columns"))
    centre = (F.col("x0") + F.col("x1")) / 2
    inside = F.filter("__columns", lambda r: (centre >= r["__lo"]) & (centre < r["__hi"]))
    joined = spans.join(c, list(keys), "left")
    return joined.withColumn("column", F.try_element_at(inside, F.lit(1))["column"]).drop("__columns")


def majority_column(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The column of most of a group's spans; ties to the leftmost."""
    n = spans.where("column is not null").groupBy(*keys, "column").agg(F.count("*").alias("__n"))
    return n.groupBy(*keys).agg(F.max_by("column", F.struct("__n", -F.col("column"))).alias("column"))


def xy_cut(blocks: DataFrame, width: float, keys: Sequence[str] = PAGE, max_depth: int = 20) -> DataFrame:
    """Reading order by recursive white space: the widest vertical gap first, then the widest horizontal one.

    Gaps need 3 per cent of the page width or 15 points (vertical), 10 (horizontal), whichever is less. What can't be
    split is read from the top down. The recursion is over one page's blocks, a bounded group.
    """
    least_x, least_y = min(0.03 * width, 15.0), min(0.03 * width, 10.0)

    def widest(edges: list[tuple[float, float]], least: float) -> float | None:
        edges = sorted(edges)
        end, best, at = edges[0][1], 0.0, None
        for a, b in edges[1:]:
            if a - end >= least and a - end > best:
                best, at = a - end, (a + end) / 2
            end = max(end, b)
        return at

    def order(rows: list[tuple], depth: int) -> Iterator[tuple]:
        if len(rows) > 1 and depth < max_depth:
            if (at := widest([(x0, x1) for x0, _, x1, *_ in rows], least_x)) is not None:
                yield from order([r for r in rows if r[0] < at], depth + 1)
                yield from order([r for r in rows if r[0] >= at], depth + 1)
                return
            if (at := widest([(y0, y1) for _, y0, _, y1, *_ in rows], least_y)) is not None:
                yield from order([r for r in rows if r[1] >= at], depth + 1)
                yield from order([r for r in rows if r[1] < at], depth + 1)
                return
        yield from sorted(rows, key=lambda r: (-r[3], r[0], r[4]))

    def fold(rows: pd.DataFrame, page: np.ndarray) -> np.ndarray:
        boxes = list(zip(*(rows[c].tolist() for c in ("x0", "y0", "x1", "y1", "block_index")), range(len(rows)), strict=True))
        starts, out = np.flatnonzero(page).tolist(), np.zeros(len(rows), int)
        for a, b in zip(starts, [*starts[1:], len(boxes)], strict=True):
            for rank, box in enumerate(order(boxes[a:b], 0)):
                out[box[5]] = rank
        return out

    return folded(blocks, keys, ["block_index"], fold, StructField("reading_order", IntegerType()))


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions)
