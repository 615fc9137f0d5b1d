"""Recognised text beside embedded text: merging, validation, error rates and image preparation."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quirelane.functions.geometry import Box

PAGE = ("doc_id", "page_index")
#: Width and height of the grid cells of a page in which boxes meet.
CELL = (64.0, 24.0)


def merge(vector: DataFrame, recognised: DataFrame, keys: Sequence[str] = PAGE, iou: float = 0.5, confidence: float = 0.5) -> DataFrame:
    """Embedded spans, and those recognised spans that no sure embedded one covers.

    Boxes that overlap by more than ``iou`` (over one half) hold each other's centre, so a recognised span meets only the
    embedded ones of its page that touch the grid cell of its centre.
    """
    assert iou >= 0.5
    v = vector.where(F.col("confidence") >= confidence).select(*(F.col(k).alias(f"v_{k}") for k in keys), *(F.col(c).alias(f"v_{c}") for c in ("x0", "y0", "x1", "y1")))
    cell = lambda c, side: F.floor(c / side).cast("long")
    touched = lambda lo, hi, side: F.explode(F.sequence(cell(F.col(lo), side), cell(F.col(hi), side)))
    v = v.select("*", touched("v_y0", "v_y1", CELL[1]).alias("v_j")).select("*", touched("v_x0", "v_x1", CELL[0]).alias("v_i"))
    cx, cy = Box.of().centre
    on = [*(F.col(k) == F.col(f"v_{k}") for k in keys), cell(cx, CELL[0]) == F.col("v_i"), cell(cy, CELL[1]) == F.col("v_j")]
    fresh = recognised.join(v, [*on, Box.of().iou(Box.of("v_")) > iou], "left_anti")
    return vector.withColumn("source", F.lit("vector")).unionByName(fresh.withColumn("source", F.lit("ocr")), allowMissingColumns=True)


#: Spans that a task holds against glyphs at once, in whole pages.
SPANS = 1 << 19


def validate_positions(recognised: DataFrame, glyphs: DataFrame, keys: Sequence[str] = PAGE, near: float = 5.0, cap: float = 0.4) -> DataFrame:
    """Recognised spans whose nearest glyph centre is over ``near`` points away have their confidence capped.

    A page's spans and glyph centres meet in one grouping, as lists, and come out again as rows; a span is held against the
    glyphs in the grid cell of size ``near`` of its centre and in the cells around.
    """
    cx, cy = Box.of().centre
    own = [c for c in recognised.columns if c not in keys]
    r = recognised.select(*keys, F.struct(*(F.col(f"`{c}`") for c in own), cx.alias("__cx"), cy.alias("__cy")).alias("__r"))
    g = glyphs.select(*keys, F.struct(cx.alias("gx"), cy.alias("gy")).alias("__g")).where("__g.gx IS NOT NULL AND __g.gy IS NOT NULL")
    pages = r.unionByName(g, allowMissingColumns=True).groupBy(*keys).agg(F.collect_list("__r").alias("__r"), F.collect_list("__g").alias("__g")).where(F.size("__r") > 0)
    schema = StructType([*(recognised.schema[k] for k in keys), *(recognised.schema[c] for c in own)])
    of_confidence = recognised.schema["confidence"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch[c].value_lengths().to_numpy(zero_copy_only=False) for c in ("__r", "__g"))
            ends, first = np.cumsum(n), 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SPANS, "right")))
                part = batch.slice(first, last - first)
                pages = [np.repeat(np.arange(last - first), x[first:last]) for x in (n, m)]
                span, glyph = part["__r"].flatten(), part["__g"].flatten()
                place = lambda a, *names: [a.field(a.type.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.float64) for c in names]
                ok = near_any(pages[0], *place(span, "__cx", "__cy"), pages[1], *place(glyph, "gx", "gy"), near)
                values = {c: span.field(span.type.get_field_index(c)) for c in own}
                sure = values["confidence"]
                limit = pa.scalar(cap).cast(sure.type)
                values["confidence"] = pc.if_else(pa.array(ok), sure, pc.min_element_wise(sure, limit))
                at = pa.array(pages[0])
                yield pa.RecordBatch.from_arrays([*(part[k].take(at) for k in keys), *values.values()], names=schema.names)
                first = last

    assert of_confidence.typeName() in ("double", "float"), of_confidence
    return pages.mapInArrow(run, schema).select(*recognised.columns)


def near_any(page: np.ndarray, x: np.ndarray, y: np.ndarray, g_page: np.ndarray, gx: np.ndarray, gy: np.ndarray, near: float) -> np.ndarray:
    """Whether some point (gx, gy) of its page lies less than ``near`` from each point (x, y)."""
    ok = np.zeros(len(x), bool)
    known = np.flatnonzero(~(np.isnan(x) | np.isnan(y)))
    if not len(gx) or not len(known):
        return ok
    page, x, y = page[known], x[known], y[known]
    cell = lambda v: np.floor(v / near).astype(np.int64)
    i, j, gi, gj = cell(x), cell(y), cell(gx), cell(gy)
    low_i, low_j = gi.min() - 1, gj.min() - 1
    wide, high = gi.max() - low_i + 2, gj.max() - low_j + 2
    key = lambda p, j, i: (p * high + j - low_j) * wide + i - low_i
    at = key(g_page, gj, gi)
    order = np.argsort(at, kind="stable")
    at, gx, gy = at[order], gx[order], gy[order]
    inside = np.flatnonzero((i >= low_i) & (i <= low_i + wide - 1) & (j >= low_j) & (j <= low_j + high - 1))
    # three cells of one row follow each other in that order
    for step in (-1, 0, 1):
        left = inside[~ok[known[inside]]]
        row = j[left] + step
        left, row = (a[(row >= low_j) & (row < low_j + high)] for a in (left, row))
        lo = np.searchsorted(at, key(page[left], row, np.maximum(i[left] - 1, low_i)))
        hi = np.searchsorted(at, key(page[left], row, np.minimum(i[left] + 1, low_i + wide - 1)), "right")
        some = hi > lo
        left, lo, n = left[some], lo[some], (hi - lo)[some]
        begin = np.cumsum(n) - n
        g = np.arange(int(n.sum())) + np.repeat(lo - begin, n)
        close = (gx[g] - np.repeat(x[left], n)) ** 2 + (gy[g] - np.repeat(y[left], n)) ** 2 < near * near
        if len(left):
            ok[known[left]] |= np.logical_or.reduceat(close, begin)
    return ok


def character_error_rate(reference: Column, found: Column) -> Column:
    """Edit distance over the reference's length; for an empty reference 0 if both are, else 1."""
    n = F.char_length(reference)
    return F.when(n == 0, F.when(F.char_length(found) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(reference, found) / n)


def words_of(text: Column) -> Column:
    """Lower-case words without punctuation at their ends."""
    trimmed = F.transform(F.split(F.lower(text), "\\s+"), lambda w: F.regexp_replace(w, "^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$", ""))
    return F.filter(trimmed, lambda w: w != "")


def edit_distance(a: list[str], b: list[str]) -> int:
    """Distance of two sequences, a row of the table at a time."""
    if len(a) < len(b):
        a, b = b, a
    row = np.arange(len(b) + 1)
    number = {w: i for i, w in enumerate(dict.fromkeys([*a, *b]))}
    other = np.array([number[w] for w in b], np.int64)
    step = np.arange(len(b) + 1)
    for i, w in enumerate(a, 1):
        best = np.minimum(row[1:] + 1, row[:-1] + (other != number[w]))
        new = np.concatenate([[i], best])
        row = np.minimum.accumulate(new - step) + step
    return int(row[-1])


def word_error_rate(pairs: DataFrame, reference: str, found: str) -> DataFrame:
    """Adds wer: word edit distance over the reference's words; for an empty reference 0 if both are, else 1."""
    from pyspark.sql.functions import pandas_udf

    @pandas_udf("double")
    def rate(a, b):  # type: ignore[no-untyped-def]
        import pandas as pd

        return pd.Series([edit_distance(list(x), list(y)) / len(x) if len(x) else float(len(y) > 0) for x, y in zip(a, b, strict=True)])

    return pairs.withColumn("wer", rate(words_of(F.col(reference)), words_of(F.col(found))))


def resolution(override: Column, has_bilevel: Column, median_size: Column) -> Column:
    return F.coalesce(override, F.when(has_bilevel, 200).when(median_size < 7, 400).otherwise(300))


def otsu(gray: np.ndarray) -> int:
    """The threshold with the largest variance between the classes below and above it."""
    n = np.bincount(gray.ravel(), minlength=256).astype(np.float64)
    w, m = np.cumsum(n), np.cumsum(n * np.arange(256))
    with np.errstate(divide="ignore", invalid="ignore"):
        between = (m[-1] * w / w[-1] - m) ** 2 / (w * (w[-1] - w))
    return int(np.nanargmax(np.where(np.isfinite(between), between, -1)))


def sauvola(gray: np.ndarray, window: int = 15, k: float = 0.2, span: float = 128.0) -> np.ndarray:
    """Local threshold mask (True: background) from means and deviations by integral images."""
    g = np.pad(gray.astype(np.float64), window // 2, mode="edge")
    s, q = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (g, g * g))
    box = lambda t: t[window:, window:] - t[:-window, window:] - t[window:, :-window] + t[:-window, :-window]
    mean = box(s) / window**2
    deviation = np.sqrt(np.maximum(box(q) / window**2 - mean**2, 0))
    return gray > mean * (1 + k * (deviation / span - 1))


def stretch(gray: np.ndarray) -> np.ndarray:
    lo, hi = int(gray.min()), int(gray.max())
    return gray.copy() if lo == hi else ((gray.astype(np.float64) - lo) * 255 / (hi - lo)).round().astype(np.uint8)


def median3(gray: np.ndarray) -> np.ndarray:
    p = np.pad(gray, 1, mode="edge")
    h, w = gray.shape
    return np.median(np.stack([p[i : i + h, j : j + w] for i in range(3) for j in range(3)]), axis=0).astype(gray.dtype)
