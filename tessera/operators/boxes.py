"""Boxes on pages: which overlap, and by how much."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("x0", "y0", "x1", "y1")


def _in_cells(boxes: DataFrame, side: str, width: float, height: float) -> DataFrame:
    """A row for each grid cell that a box touches. Boxes with a null, or without area, are left out."""
    good = boxes.filter("page IS NOT NULL AND x0 < x1 AND y0 < y1")

    def cells(low: str, high: str, step: float) -> Column:
        return F.explode(F.sequence(F.floor(F.col(low) / step), F.floor(F.col(high) / step)))

    across = good.select("page", F.struct("id", *SIDES).alias(side), cells("x0", "x1", width).alias("cx"), "y0", "y1")
    return across.select("page", side, "cx", cells("y0", "y1", height).alias("cy"))


def box_pairs(left: DataFrame, right: DataFrame, width: float, height: float, same: bool = False) -> DataFrame:
    """left_id, right_id, iou (common area as a share of what both cover), inside (as a share of the smaller) of boxes of a page that overlap.

    left, right: page, id, x0, y0, x1, y1; edges that only touch are no overlap. With same, both are one table and a pair comes once, the smaller id left.
    Boxes meet in the cells of a grid (width by height, about the size of a usual box), so a page of any number of boxes is as many groups as it has
    cells. A pair that shares several cells belongs to the one that holds the first corner of its common area, so nothing is made distinct later."""
    a, b = _in_cells(left, "a", width, height), _in_cells(right, "b", width, height)
    met = a.join(b, ["page", "cx", "cy"])
    x0, y0 = F.greatest("a.x0", "b.x0"), F.greatest("a.y0", "b.y0")
    wide, high = F.least("a.x1", "b.x1") - x0, F.least("a.y1", "b.y1") - y0
    held = (wide > 0) & (high > 0) & (F.floor(x0 / width) == F.col("cx")) & (F.floor(y0 / height) == F.col("cy"))
    if same:
        held &= F.col("a.id") < F.col("b.id")

    def area(box: str) -> Column:
        return (F.col(f"{box}.x1") - F.col(f"{box}.x0")) * (F.col(f"{box}.y1") - F.col(f"{box}.y0"))

    common = wide * high
    return met.filter(held).select(
        F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id"), (common / (area("a") + area("b") - common)).alias("iou"), (common / F.least(area("a"), area("b"))).alias("inside")
    )
