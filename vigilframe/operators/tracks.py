"""Growth of tracks, and windows over a camera's frames.

Observations are (track_id, camera_id, frame_index, minute, area, top_y, base_cx, base_cy, cx, cy, w, h).
"""

from __future__ import annotations

import bisect

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _slope(y: str) -> Column:
    """Least squares against minutes; 0 where minutes don't vary."""
    return F.when(F.count("*") * F.var_pop("minute") < 1e-9, 0.0).otherwise(F.coalesce(F.regr_slope(y, "minute"), F.lit(0.0)))


#: Up to so many frames, a third is one or two.
_FEW = 8
#: Of these, medians of a track's first and last third count.
_THIRDS = ("minute", "base_cx", "base_cy", "cx", "cy")


def _middle(values: Column) -> Column:
    """The median of an array; null of none."""
    at = lambda k: F.get(F.sort_array(values), F.floor(k).cast("int"))
    return (at((F.size(values) - 1) / 2) + at(F.size(values) / 2)) / 2.0


def growth(observations: DataFrame) -> DataFrame:
    """One row per track, from two sorted windows and one aggregate on the same key, so one shuffle.

    Medians of one or two values are their mean, which costs no map of values; so only tracks of nine frames and more gather
    those of their first and last third.
    """
    w = Window.partitionBy("track_id").orderBy("frame_index")
    whole = Window.partitionBy("track_id")
    o = observations.withColumns({"n": F.count("*").over(whole), "rn": F.row_number().over(w), "last_area": F.lag("area").over(w), "last_bx": F.lag("base_cx").over(w), "last_by": F.lag("base_cy").over(w)})
    third = F.greatest(F.lit(1), F.floor(F.col("n") / 3))
    o = o.withColumns({"early": F.col("rn") <= third, "late": F.col("rn") > F.col("n") - third, "step": F.hypot(F.col("base_cx") - F.col("last_bx"), F.col("base_cy") - F.col("last_by")), "kept": F.when(F.col("last_area").isNotNull(), (F.col("area") - F.col("last_area") >= -0.02 * F.col("last_area")).cast("double"))})

    outer = F.when((F.col("n") > _FEW) & (F.col("early") | F.col("late")), F.struct("late", *_THIRDS))

    def med(c: str, part: str) -> Column:
        several = F.transform(F.filter(F.collect_list(outer), lambda x: (x["late"] == F.lit(part == "late")) & x[c].isNotNull()), lambda x: x[c])
        return F.when(F.count("*") > _FEW, _middle(several)).otherwise(F.avg(F.when(F.col(part), F.col(c))))

    def travel(x: str, y: str) -> Column:
        t = med("minute", "late") - med("minute", "early")
        t = F.when(t <= 1e-6, F.max("minute") - F.min("minute")).otherwise(t)
        return F.when((F.count("*") >= 2) & (t > 1e-6), F.hypot(med(x, "late") - med(x, "early"), med(y, "late") - med(y, "early")) / t).otherwise(0.0)

    g = o.groupBy("track_id").agg(
        F.count("*").alias("frames"), (F.max_by("minute", "rn") - F.min_by("minute", "rn")).alias("span_min"), F.min_by("area", "rn").alias("area_first"), F.max_by("area", "rn").alias("area_last"),
        _slope("area").alias("area_slope"), (-_slope("top_y")).alias("top_rise"), travel("base_cx", "base_cy").alias("base_drift"), travel("cx", "cy").alias("centroid_drift"),
        F.abs(_slope("cx")).alias("horizontal_drift"), _slope("w").alias("width_growth"), F.coalesce(F.avg("kept"), F.lit(1.0)).alias("monotonic"), F.when(F.count("*") >= 3, _middle(F.collect_list("step"))).otherwise(0.0).alias("jitter"),
    )
    return _with_ratios(g)


def aspects(observations: DataFrame) -> DataFrame:
    """(track_id, aspect_first, aspect_last): height to width of a track's first and last region, 0 wide ones as 1 wide. Keyed as
    growth is, so the join itself shuffles nothing."""
    aspect, at = F.col("h") / F.greatest(F.col("w"), F.lit(1.0)), F.col("frame_index")
    return observations.groupBy("track_id").agg(F.min_by(aspect, at).alias("aspect_first"), F.max_by(aspect, at).alias("aspect_last"))


_MEDIANS = [*(f"{part}_{c}" for part in ("early", "late") for c in _THIRDS), "step_median"]


class _Sorted:
    """Values in order, nulls left out; one goes in or out by bisection."""

    def __init__(self):
        self.values: list[float] = []

    def add(self, x: float | None) -> None:
        if x is not None:
            bisect.insort(self.values, x)

    def drop(self, x: float | None) -> None:
        if x is not None:
            del self.values[bisect.bisect_left(self.values, x)]

    def median(self) -> float | None:
        v, k = self.values, len(self.values) // 2
        return None if not v else v[k] if len(v) % 2 else (v[k - 1] + v[k]) / 2.0


def _running_medians(it):
    """Rows sorted by track and frame, each with the medians of the first and last third of its track's rows so far and of
    the steps so far. The first third only gains rows and the last one moves on, so a row goes in and out once."""
    track = object()  # none yet
    for b in it:
        named = dict(zip(b.schema.names, b.columns, strict=True))
        values = list(zip(*(named[c].to_pylist() for c in (*_THIRDS, "step")), strict=True))
        out = []
        for key, row in zip(named["track_id"].to_pylist(), values, strict=True):
            if key != track:
                track, rows, gone, taken = key, [], 0, 0
                early, late, steps = [_Sorted() for _ in _THIRDS], [_Sorted() for _ in _THIRDS], _Sorted()
            rows.append(row)
            third = max(1, len(rows) // 3)
            for kept, x in zip(late, row, strict=False):
                kept.add(x)
            steps.add(row[-1])
            while taken < third:
                for kept, x in zip(early, rows[taken], strict=False):
                    kept.add(x)
                taken += 1
            while len(rows) - gone > third:
                for kept, x in zip(late, rows[gone], strict=False):
                    kept.drop(x)
                gone += 1
            out.append([*(k.median() for k in early), *(k.median() for k in late), steps.median()])
        columns = zip(*out, strict=True) if out else [[]] * len(_MEDIANS)
        yield pa.record_batch([*b.columns, *(pa.array(c, pa.float64()) for c in columns)], names=[*b.schema.names, *_MEDIANS])


def growth_so_far(observations: DataFrame) -> DataFrame:
    """growth() of a track as of each of its frames: track_id, frame_index and all of growth()'s columns.

    One shuffle: sums and slopes run along a sorted window, and one Arrow pass over its sorted rows keeps medians of the
    rows so far, in memory that grows with the track and time that hardly depends on its length. Nulls are left out of
    medians; rows of a track that share a frame_index are in no order.
    """
    by_frame = Window.partitionBy("track_id").orderBy("frame_index")
    w = by_frame.rowsBetween(Window.unboundedPreceding, 0)
    gain = F.col("area") - F.lag("area").over(by_frame)
    step = F.hypot(*(F.col(c) - F.lag(c).over(by_frame) for c in ("base_cx", "base_cy")))
    o = observations.withColumns({"kept": (gain >= -0.02 * F.lag("area").over(by_frame)).cast("double"), "step": step})

    def slope(y: str) -> Column:
        steady = F.count("*").over(w) * F.var_pop("minute").over(w) < 1e-9
        return F.when(steady, 0.0).otherwise(F.coalesce(F.regr_slope(y, "minute").over(w), F.lit(0.0)))

    o = o.select(
        "track_id", "frame_index", *(F.col(c).cast("double").alias(c) for c in (*_THIRDS, "step")),
        F.count("*").over(w).alias("frames"), F.first("area").over(w).alias("area_first"), F.col("area").alias("area_last"),
        (F.col("minute") - F.first("minute").over(w)).alias("span_min"), (F.max("minute").over(w) - F.min("minute").over(w)).alias("minutes"),
        slope("area").alias("area_slope"), (-slope("top_y")).alias("top_rise"), F.abs(slope("cx")).alias("horizontal_drift"), slope("w").alias("width_growth"),
        F.coalesce(F.avg("kept").over(w), F.lit(1.0)).alias("monotonic"),
    )
    types = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in o.schema), *(f"{c} double" for c in _MEDIANS)])
    o = o.sortWithinPartitions("track_id", "frame_index").mapInArrow(_running_medians, types)  # as the window leaves them

    def gone(c: str) -> Column:
        return F.col(f"late_{c}") - F.col(f"early_{c}")

    minutes = F.when(gone("minute") <= 1e-6, F.col("minutes")).otherwise(gone("minute"))

    def travel(x: str, y: str) -> Column:
        return F.when((F.col("frames") >= 2) & (minutes > 1e-6), F.hypot(gone(x), gone(y)) / minutes).otherwise(0.0)

    g = o.select(
        "track_id", "frame_index", "frames", "span_min", "area_first", "area_last", "area_slope", "top_rise",
        travel("base_cx", "base_cy").alias("base_drift"), travel("cx", "cy").alias("centroid_drift"), "horizontal_drift", "width_growth", "monotonic",
        F.when(F.col("frames") >= 3, F.col("step_median")).otherwise(0.0).alias("jitter"),
    )
    return _with_ratios(g)


def _with_ratios(g: DataFrame) -> DataFrame:
    """Growth's columns that follow from others."""
    rise = F.greatest("top_rise", F.lit(0.0))
    ratio = F.col("area_last") / F.greatest("area_first", F.lit(1.0))
    anchor = F.when(rise + F.col("base_drift") > 1e-6, rise / (rise + F.col("base_drift"))).otherwise(0.0)
    return g.withColumns({"area_ratio": F.when(F.col("frames") < 2, 1.0).otherwise(ratio), "anchor": anchor})


def trailing_median(frames: DataFrame, key: str, order: str, value: str, n: int = 12, least: int = 4) -> DataFrame:
    """Of the n rows before each (null below `least` of them) and of the n up to and with it, as `before` and `with_own`."""
    w = Window.partitionBy(key).orderBy(order)
    out = frames
    for name, rows in (("before", w.rowsBetween(-n, -1)), ("with_own", w.rowsBetween(1 - n, 0))):
        out = out.withColumn(name, F.when(F.count(value).over(rows) >= least, _median(F.collect_list(value).over(rows))))
    return out


def _median(values: Column) -> Column:
    s = F.array_sort(values)
    n = F.size(s)
    return (F.element_at(s, F.greatest(F.lit(1), F.ceil(n / 2).cast("int"))) + F.element_at(s, F.greatest(F.lit(1), (F.floor(n / 2) + 1).cast("int")))) / 2.0


def frozen_runs(frames: DataFrame, key: str, order: str, difference: str, below: float = 0.35) -> DataFrame:
    """frames with repeat_count: how many frames in a row, up to this one, differ by less than `below` from the last."""
    w = Window.partitionBy(key).orderBy(order)
    breaks = F.sum(F.when(F.coalesce(F.col(difference) >= below, F.lit(True)), 1).otherwise(0)).over(w)
    g = frames.withColumn("__run", breaks)
    return g.withColumn("repeat_count", F.row_number().over(Window.partitionBy(key, "__run").orderBy(order)) - F.when(F.col("__run") == 0, 0).otherwise(1)).drop("__run")
