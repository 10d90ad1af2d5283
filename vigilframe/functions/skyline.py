"""What a skyline says, as column expressions: it is an array of one row number a column of the image, the first row that is
not sky. pixels.sky_mask and band_mask give the same masks as images."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("long"), lambda a, v: a + v)


def _within(x: Column, low, high: Column) -> Column:
    return F.least(F.greatest(x, F.lit(low)), high)


def sky_pixels(boundary: Column, height: Column, margin: int = 0) -> Column:
    """Pixels above the boundary, moved down by margin."""
    return _total(F.transform(boundary, lambda b: _within(F.ceil(b + margin).cast("long"), 0, height.cast("long"))))


def band_pixels(boundary: Column, height: Column, above: int, below: int) -> Column:
    """Pixels of the strip from `above` rows over the boundary to `below` rows under it, both included."""

    def rows(b: Column) -> Column:
        first, last = F.greatest(F.ceil(b - above), F.lit(0)), F.least(F.floor(b + below), height - 1)
        return F.greatest(last - first + 1, F.lit(0)).cast("long")

    return _total(F.transform(boundary, rows))


def height_above(boundary: Column, x: Column, y: Column) -> Column:
    """How far above the boundary a point is, negative below it; points beside the image take its outermost column. Null for
    a boundary without columns."""
    column = _within(F.bround(x).cast("int"), 0, F.size(boundary) - 1)
    return F.when(F.size(boundary) > 0, F.get(boundary, column) - y)


def _percentile(ordered: Column, p: float) -> Column:
    at = (F.size(ordered) - 1) * F.lit(p)
    low, high = (F.get(ordered, f(at).cast("int")) for f in (F.floor, F.ceil))
    return low + (high - low) * (at - F.floor(at))


def shape(boundary: Column) -> dict[str, Column]:
    """median_row, and relief_px from the 5th to the 95th percentile, both cut to whole pixels; null without columns."""
    o = F.array_sort(boundary)
    some = F.size(boundary) > 0
    median, relief = _percentile(o, 0.5), _percentile(o, 0.95) - _percentile(o, 0.05)
    return {"median_row": F.when(some, median).cast("long"), "relief_px": F.when(some, F.round(relief, 9)).cast("long")}
