"""Cameras, readings, observations and evidence derived from the star-schema tables by integer arithmetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo

FRAME_WIDTH = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("camera_id"),
        F.col("s_nationkey").cast("long").alias("site_id"),
        F.col("s_name").alias("name"),
        (33.0 + (k * 37 % 40) / 100.0).alias("lat"),
        (-117.0 + (k * 53 % 40) / 100.0).alias("lon"),
        (k * 47 % 360).cast("double").alias("azimuth"),
        F.when(k % 20 == 0, 180.0).when(k % 5 == 0, 60.0).otherwise(90.0).alias("hfov"),
        F.when(k % 2 == 1, "monochrome").otherwise("color").alias("imager"),
        (k % 17 != 16).alias("active"),
        F.lit(geo.RAY_RANGE_M).alias("range_m"),
    )


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reading per event: a sequence (user) of a camera, with an offset to the fire's mark and a confidence."""
    e, cams = table(spark, sf_dir, "events"), cameras(spark, sf_dir)
    n = cams.agg(F.count("*").alias("n"))
    keyed = e.crossJoin(F.broadcast(n)).select("event_id", F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("epoch_s"), F.col("user_id").alias("sequence"), (F.col("user_id") % F.col("n")).alias("camera_id"), "event_type", "value", "props")
    c = cams.select("camera_id", "site_id", "lat", "lon", "azimuth", "hfov", "active", "range_m")
    x = (F.col("event_id") % FRAME_WIDTH).cast("double")
    joined = keyed.join(c, "camera_id")
    return joined.select(
        "event_id", "epoch_s", "sequence", (F.col("sequence") % 20).alias("date"), "camera_id", "site_id", "lat", "lon", "azimuth", "hfov", "active", "range_m", "event_type", "props",
        x.alias("x"),
        geo.bearing_from_pixel(x, F.lit(float(FRAME_WIDTH)), F.col("azimuth"), F.col("hfov")).alias("bearing"),
        (F.col("event_id") * 37 % 7200 - 3600).alias("offset_s"),
        F.least(F.col("value") / 200.0, F.lit(1.0)).alias("confidence"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions along tracks: an order is a track, its line numbers are frames; lines that share a number are one."""
    l = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("track_id"), F.col("l_linenumber").cast("long").alias("frame_index")).agg(F.min("l_quantity").alias("area"), F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    p, s = F.col("p"), F.col("s")
    return l.select(
        "track_id", "frame_index", (F.col("track_id") % 50).alias("camera_id"),
        ((F.col("frame_index") * 60 + p % 20) / 60.0).alias("minute"),
        F.col("area"),
        (300 - (p % 90)).cast("double").alias("top_y"),
        (400 + s % 25).cast("double").alias("base_cy"),
        (500 + s % 37).cast("double").alias("base_cx"),
        (510 + p % 41).cast("double").alias("cx"),
        (350 + p % 31).cast("double").alias("cy"),
        (20 + p % 60).cast("double").alias("w"),
        (20 + s % 80).cast("double").alias("h"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clear frames for calibration: (camera_id, sequence, event_id, cell of the 24 x 32 grid, confidence)."""
    return readings(spark, sf_dir).filter("offset_s < 0").select("camera_id", "sequence", "event_id", (F.col("event_id") * 7 % 768).alias("cell"), "confidence")
