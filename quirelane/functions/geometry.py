"""Rectangles as four columns x0, y0, x1, y1."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    x0: Column
    y0: Column
    x1: Column
    y1: Column

    @classmethod
    def of(cls, prefix: str = "", suffix: str = "") -> Box:
        return cls(*(F.col(f"{prefix}{c}{suffix}") for c in ("x0", "y0", "x1", "y1")))

    @property
    def width(self) -> Column:
        return self.x1 - self.x0

    @property
    def height(self) -> Column:
        return self.y1 - self.y0

    @property
    def area(self) -> Column:
        return F.greatest(self.width, F.lit(0.0)) * F.greatest(self.height, F.lit(0.0))

    @property
    def centre(self) -> tuple[Column, Column]:
        return (self.x0 + self.x1) / 2, (self.y0 + self.y1) / 2

    def overlap(self, o: Box) -> Column:
        """Area of the intersection; 0 where the boxes are apart."""
        w = F.least(self.x1, o.x1) - F.greatest(self.x0, o.x0)
        h = F.least(self.y1, o.y1) - F.greatest(self.y0, o.y0)
        return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))

    def iou(self, o: Box) -> Column:
        """Intersection over union; 0 where both are empty."""
        both = self.overlap(o)
        union = self.area + o.area - both
        return F.when(union > 0, both / union).otherwise(F.lit(0.0))

    def holds(self, x: Column, y: Column) -> Column:
        """Half-open: the left and lower edges belong to the box."""
        return (x >= self.x0) & (x < self.x1) & (y >= self.y0) & (y < self.y1)


def union_box() -> list[Column]:
    """Aggregates that give the box around a group."""
    return [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]


def baseline(box: Box) -> Column:
    return box.y0 + F.lit(0.2) * box.height


def rotate(box: Box, rotation: Column, width: Column, height: Column) -> Column:
    """Box of a page turned clockwise by 0, 90, 180 or 270 degrees, as a struct."""
    s = lambda a, b, c, d: F.struct(a.alias("x0"), b.alias("y0"), c.alias("x1"), d.alias("y1"))
    return (
        F.when(rotation == 90, s(box.y0, width - box.x1, box.y1, width - box.x0))
        .when(rotation == 180, s(width - box.x1, height - box.y1, width - box.x0, height - box.y0))
        .when(rotation == 270, s(height - box.y1, box.x0, height - box.y0, box.x1))
        .otherwise(s(box.x0, box.y0, box.x1, box.y1))
    )


def grid_cell(x: Column, y: Column, width: Column, height: Column, n: int = 8) -> tuple[Column, Column]:
    """Row and column of the cell of an n x n page grid that holds a point; points beyond the page go to its edge."""
    bucket = lambda v, size: F.greatest(F.least(F.floor(v / size * n), F.lit(n - 1)), F.lit(0)).cast("int")
    return bucket(y, height), bucket(x, width)
