"""Cells that span rows or columns, from edges that no rule covers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

CELL = ("row", "col", "x0", "y0", "x1", "y1")
_OUT = StructType([*(StructField(c, IntegerType()) for c in ("row", "col", "rowspan", "colspan")), *(StructField(c, DoubleType()) for c in CELL[2:])])
#: Rows of a batch that a task hands on.
MOST_ROWS = 1 << 16


def covered(segments: Sequence[tuple[float, float, float]], pos: float, lo: float, hi: float, slack: float = 1.0) -> float:
    """Share of the edge from lo to hi at ``pos`` that segments (pos, lo, hi) cover; overlaps count once."""
    parts = sorted((max(a, lo), min(b, hi)) for p, a, b in segments if abs(p - pos) <= slack and min(b, hi) > max(a, lo))
    total, end = 0.0, lo
    for a, b in parts:
        total += max(0.0, b - max(a, end))
        end = max(end, b)
    return total / (hi - lo) if hi > lo else 0.0


def rectangles(cells: np.ndarray, segments: np.ndarray, least: float) -> np.ndarray:
    """Rows (row, col, rowspan, colspan, box) of one page's cells (row, col, box) and rules (vertical, pos, lo, hi)."""
    rules = segments.tolist()
    h = [(pos, lo, hi) for vertical, pos, lo, hi in rules if vertical == 0]
    v = [(pos, lo, hi) for vertical, pos, lo, hi in rules if vertical == 1]
    box = {(row, col): (x0, y0, x1, y1) for row, col, x0, y0, x1, y1 in cells.tolist()}
    open_right = {k for k, b in box.items() if (k[0], k[1] + 1) in box and covered(v, b[2], b[1], b[3]) < least}
    open_down = {k for k, b in box.items() if (k[0] + 1, k[1]) in box and covered(h, b[1], b[0], b[2]) < least}
    used, out = set(), []
    for row, col in sorted(box):
        if (row, col) in used:
            continue
        w = 1
        while (row, col + w - 1) in open_right and (row, col + w) not in used:
            w += 1
        n = 1
        while all((row + n - 1, col + i) in open_down for i in range(w)) and all((row + n, col + i) in open_right for i in range(w - 1)):
            n += 1
        inside = [(row + i, col + j) for i in range(n) for j in range(w)]
        used.update(inside)
        b = [box[k] for k in inside]
        out.append((row, col, n, w, min(x[0] for x in b), min(x[1] for x in b), max(x[2] for x in b), max(x[3] for x in b)))
    return np.array(out, np.float64).reshape(-1, 8)


def _rows(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The structs of numbers in lists as a matrix, and where each list starts in it, and the last ends."""
    flat = lists.flatten()
    matrix = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in flat.flatten()])
    return matrix, np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)


def merge(cells: DataFrame, segments: DataFrame, keys: Sequence[str] = ("doc_id", "page_index"), least: float = 0.8) -> DataFrame:
    """Cells (row, col, box) joined over interior edges of which rules cover less than 80 per cent, as rectangles.

    Cells grow to the right, then down, until nothing changes. Growth depends on cells joined before: a fold over one
    page's grid and rules, both bounded. Pages come many to a batch, each with its lists; pages that are alike, as those
    of a form, are folded once a batch.
    """
    sides = {"h": 0.0, "v": 1.0}
    number = lambda names: F.struct(*(F.col(c).cast("double").alias(c) for c in names))
    side = F.when(F.col("orientation") == "h", sides["h"]).when(F.col("orientation") == "v", sides["v"]).otherwise(-1.0)
    c = cells.select(*keys, number(CELL).alias("__c"))
    s = segments.select(*keys, F.struct(side.alias("vertical"), *(F.col(n).cast("double").alias(n) for n in ("pos", "lo", "hi"))).alias("__s"))
    both = c.unionByName(s, allowMissingColumns=True).groupBy(*keys)
    pages = both.agg(F.sort_array(F.collect_list("__c")).alias("__c"), F.sort_array(F.collect_list("__s")).alias("__s")).where(F.size("__c") > 0)
    schema = StructType([*(cells.schema[k] for k in keys), *_OUT.fields])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            (grid, at), (rules, rule_at) = _rows(batch["__c"]), _rows(batch["__s"])
            seen, found, kind = {}, [], np.empty(batch.num_rows, np.int64)
            for i, (a, b, r, e) in enumerate(zip(at, at[1:], rule_at, rule_at[1:], strict=False)):
                page = (grid[a:b].tobytes(), rules[r:e].tobytes())
                if (kind_ := seen.get(page)) is None:
                    kind_ = seen[page] = len(found)
                    found.append(rectangles(grid[a:b], rules[r:e], least))
                kind[i] = kind_
            size = np.array([len(f) for f in found])
            table, start, n = np.concatenate(found), np.cumsum(size) - size, size[kind]
            rows = np.repeat(start[kind] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            own = pa.array(np.repeat(np.arange(batch.num_rows), n))
            for first in range(0, len(rows), MOST_ROWS):
                part, values = own[first : first + MOST_ROWS], table[rows[first : first + MOST_ROWS]]
                out = [pa.array(values[:, j].astype(np.int32) if j < 4 else values[:, j]) for j in range(8)]
                yield pa.RecordBatch.from_arrays([*(batch[k].take(part) for k in keys), *out], names=schema.names)

    return pages.mapInArrow(fold, schema)
