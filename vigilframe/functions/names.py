"""Timestamps, sequence facts and labels from file names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of a time in a file name's stem, first to last.
PATTERNS = (("yyyyMMdd_HHmmss", r"^\d{8}_\d{6}$"), ("yyyy-MM-dd'T'HHmmss", r"^\d{4}-\d{2}-\d{2}T\d{6}$"), ("yyyyMMdd'T'HHmmss", r"^\d{8}T\d{6}$"), ("yyyyMMddHHmmss", r"^\d{14}$"))
SEQUENCE = r"^(\d{8})_FIRE_(.+)$"
FRAME = r"^(\d{10})_([+-]\d+)(\.jpg)?$"
IMAGES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff", ".webp")


def stem(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"(?<=.)\.[^.]*$", "")


def suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.[^./]+$", 0))


def is_image(name: Column) -> Column:
    return suffix(name).isin(*IMAGES)


def epoch(name: Column) -> Column:
    """Seconds since 1970 in UTC: the first reading of the stem, its last 15, first 15 or last 14 characters as a time, by
    pattern; else the first ten of all its digits as an epoch between 1e9 and 4e9; else null. Whatever the session's time
    zone."""
    s = stem(name)
    cuts = (s, F.right(s, F.lit(15)), F.left(s, F.lit(15)), F.right(s, F.lit(14)))
    zero = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
    tried = [F.when(c.rlike(shape), F.timestamp_diff("SECOND", zero, F.try_to_timestamp(c, F.lit(p)).cast("timestamp_ntz"))) for p, shape in PATTERNS for c in cuts]
    digits = F.regexp_replace(s, r"\D", "")
    number = F.when(F.length(digits) >= 10, F.left(digits, F.lit(10)).cast("long"))
    return F.coalesce(*tried, F.when((number > 1_000_000_000) & (number < 4_000_000_000), number))


def timestamp(name: Column, fallback: Column | None = None) -> Column:
    return F.coalesce(F.timestamp_seconds(epoch(name)), *([fallback] if fallback is not None else []))


def sanitise(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def plain(name: str) -> str:
    """sanitise() of one name."""
    return re.sub(r"[^A-Za-z0-9._-]", "_", name)


def clock(seconds: Column) -> Column:
    """h:mm:ss."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)
