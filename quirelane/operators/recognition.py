"""Around a text recogniser: crops, parsed results, deskewing, which results to keep, languages."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quirelane.operators.layout import islands
from quirelane.operators.ocr import merge

WORDS = "text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def cell_crops(pages: DataFrame, dpi: int = 300, n: int = 8) -> DataFrame:
    """Pixel rectangles (left, top, right, bottom) of the n x n cells of pages (width, height in points)."""
    s = dpi / 72
    k = pages.select("*", F.explode(F.sequence(F.lit(0), F.lit(n * n - 1))).alias("cell"))
    col, row = F.col("cell") % n, F.floor(F.col("cell") / n)
    px = lambda i, size: F.round(i * F.col(size) / n * s).cast("int")
    return k.withColumns({"left": px(col, "width"), "top": px(row, "height"), "right": px(col + 1, "width"), "bottom": px(row + 1, "height")})


def parse_hocr(xml: str, height: float | None = None, dpi: float = 72.0) -> list[tuple]:
    """Words (text, x0, y0, x1, y1, confidence) of recognised XHTML, in points; with ``height`` y runs from below."""
    try:
        root = ET.fromstring(re.sub(r"<!DOCTYPE[^>]*>", "", xml).replace("&nbsp;", " "))
    except ET.ParseError:
        return []
    out, s = [], 72.0 / dpi
    for e in root.iter():
        if "ocrx_word" in (e.get("class") or "").split():
            title = e.get("title") or ""
            box, sure = re.search(r"bbox (\d+) (\d+) (\d+) (\d+)", title), re.search(r"x_wconf (\d+)", title)
            text = "".join(e.itertext()).strip()
            if box and text:
                a, b, c, d = (int(v) * s for v in box.groups())
                y0, y1 = (b, d) if height is None else (height - d, height - b)
                out.append((text, a, y0, c, y1, int(sure[1]) / 100 if sure else 0.0))
    return out


def recognise(crops: DataFrame, engine: Callable[[bytes], list[tuple]], image: str = "image") -> DataFrame:
    """Words of an injected engine for each row's image; rows whose engine fails have none. The engine runs in tasks."""
    kept = [c for c in crops.columns if c != image]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["text", "x0", "y0", "x1", "y1", "confidence"]
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                words = engine(bytes(getattr(r, image)))
                if words:
                    out = pd.DataFrame(words, columns=names)
                    for i, c in enumerate(kept):
                        out.insert(i, c, getattr(r, c))
                    yield out

    schema = ", ".join(f"`{c}` {crops.schema[c].dataType.simpleString()}" for c in kept)
    return crops.mapInPandas(run, f"{schema}, {WORDS}" if kept else WORDS)


def recognise_cells(pages: DataFrame, engine: Callable[[np.ndarray], list[tuple]], keys: Sequence[str] = ("doc_id", "page_index"), dpi: int = 300, n: int = 8) -> DataFrame:
    """(keys, cell, words) of the cells of ``hybrid_cells`` of pages (width and height in points, image: its gray points by rows).

    A page's image is opened once, where it lies, and ``engine`` gets each cell's points, white beyond the image; it gives
    words (text, x0, y0, x1, y1, confidence) in the cell's points from its top left. Boxes come out in points of the page,
    from below. A cell whose engine fails gives no words, and neither does a page whose image hasn't its size.
    """
    keys = list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scale = dpi / 72
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                w, h = (int(np.ceil(getattr(r, side) * scale)) for side in ("width", "height"))
                if r.hybrid_cells is None or r.image is None or len(r.image) != w * h:
                    continue
                gray = np.frombuffer(r.image, np.uint8).reshape(h, w)
                wide, high = max(w // n, 1), max(h // n, 1)
                for cell in r.hybrid_cells:
                    top, left = int(cell) // n * high, int(cell) % n * wide
                    crop = np.full((high, wide), 255, np.uint8)
                    part = gray[top : top + high, left : left + wide]
                    crop[: part.shape[0], : part.shape[1]] = part
                    try:
                        words = engine(crop)
                    except Exception:  # noqa: BLE001  an injected engine may raise anything, and other cells go on
                        continue
                    place = [getattr(r, k) for k in keys]
                    out += [(*place, int(cell), t, (left + a) / scale, r.height - (top + d) / scale, (left + c) / scale, r.height - (top + b) / scale, sure) for t, a, b, c, d, sure in words]
            if out:
                yield pd.DataFrame(out, columns=[*keys, "cell", "text", "x0", "y0", "x1", "y1", "confidence"])

    schema = ", ".join(f"`{k}` {pages.schema[k].dataType.simpleString()}" for k in keys)
    return pages.select(*keys, "width", "height", "image", "hybrid_cells").mapInPandas(run, f"{schema}, cell int, {WORDS}")


def hybrid_pages(pages: DataFrame, cells: DataFrame, spans: DataFrame, engine: Callable[[np.ndarray], list[tuple]], keys: Sequence[str] = ("doc_id", "page_index"), dpi: int = 300) -> DataFrame:
    """The spans of hybrid pages: embedded ones, and those that the engine finds in the scanned cells and no sure embedded one covers.

    ``cells``: (keys, hybrid_cells), as ``page_class.grid_counts`` gives them; pages that aren't hybrid are left out.
    """
    hybrid = cells.where("hybrid_cells IS NOT NULL").select(*keys, "hybrid_cells")
    words = recognise_cells(pages.join(hybrid, list(keys)), engine, keys, dpi)
    return merge(spans.join(hybrid.select(*keys), list(keys), "left_semi"), words, keys)


def region_policy(words: DataFrame, keys: Sequence[str] = ("doc_id", "page_index"), apart: float = 12.0, least: float = 0.3) -> DataFrame:
    """Adds ``falls_back``: words of a region, lines within 12 points of each other, whose mean confidence is below 0.3."""
    order = ["y0", "x0"]
    gap = F.col("y0") - F.lag("y0").over(Window.partitionBy(*keys).orderBy(*order))
    regions = islands(words, keys, order, gap > apart, "region")
    return regions.withColumn("falls_back", F.avg("confidence").over(Window.partitionBy(*keys, "region")) < least)


def skew(gray: np.ndarray, most: float = 5.0, step: float = 0.25) -> float:
    """Degrees by which a page is turned: the angle whose row sums of dark points vary most."""
    y, x = np.nonzero(gray < 128)
    if not len(x):
        return 0.0
    best, at = -1.0, 0.0
    for a in np.arange(-most, most + step / 2, step):
        rows = np.round(y - x * np.tan(np.radians(a))).astype(np.int64)
        sums = np.bincount(rows - rows.min())
        score = float((sums.astype(np.float64) ** 2).sum())
        if score > best + 1e-9 or (abs(score - best) <= 1e-9 and abs(a) < abs(at)):
            best, at = score, float(a)
    return at


def deskewed(gray: np.ndarray, degrees: float) -> np.ndarray:
    """The page sheared back by an angle, column by column, with white where nothing was."""
    out = np.full_like(gray, 255)
    h = gray.shape[0]
    for x in range(gray.shape[1]):
        d = int(round(x * np.tan(np.radians(degrees))))
        a, b = max(0, -d), min(h, h - d)
        if a < b:
            out[a:b, x] = gray[a + d : b + d, x]
    return out


def missing_languages(requested: Column, installed: Column) -> Column:
    return F.array_except(requested, installed)
