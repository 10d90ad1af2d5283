"""Rows as they go over the wire: names, order and decimal places, halves to the even digit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Wire name -> column and decimal places (None: as it is).
GROWTH = {
    "frames": ("frames", None), "span_s": ("span_s", 1), "area_first": ("area_first", None), "area_last": ("area_last", None),
    "area_slope_px_per_min": ("area_slope", 1), "area_ratio": ("area_ratio", 3), "monotonic_fraction": ("monotonic", 3),
    "top_rise_px_per_min": ("top_rise", 2), "base_drift_px_per_min": ("base_drift", 2), "centroid_drift_px_per_min": ("centroid_drift", 2),
    "horizontal_drift_px_per_min": ("horizontal_drift", 2), "width_growth_px_per_min": ("width_growth", 2),
    "aspect_first": ("aspect_first", 3), "aspect_last": ("aspect_last", 3), "base_jitter_px": ("jitter", 2), "anchor_score": ("anchor", 3),
}
FIX = {"lat": ("lat", 6), "lon": ("lon", 6), "residual_m": ("residual_m", 1), "semi_major_m": ("semi_major_m", 1), "semi_minor_m": ("semi_minor_m", 1), "crossing_angle_deg": ("crossing_deg", 1)}
HORIZON = {"confidence": ("confidence", 3), "sky_fraction": ("sky", 3), "threshold": ("threshold", None), "flat": ("flat", None), "median_row": ("median_row", None), "relief_px": ("relief_px", None)}

#: A value's noise behind this place doesn't decide a half.
NOISE = 9


def even(x: Column, places: int = 0) -> Column:
    """x to `places` decimals, halves to the even digit; what counts as a half is the value's decimal form to NOISE places.
    Null stays null, and so do NaN and infinity, which have no decimal form."""
    finite = F.when(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), x.cast("double"))
    return F.bround(F.round(finite, NOISE), places)


def shaped(df: DataFrame, shape: dict[str, tuple[str, int | None]], *key: str) -> DataFrame:
    """df's key columns and those of a wire shape. A column that df lacks is an error of Spark's, not a gap."""
    return df.select(*key, *((F.col(c) if n is None else even(F.col(c), n)).alias(k) for k, (c, n) in shape.items()))
