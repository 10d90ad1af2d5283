"""Scenes with known answers: rings of cameras, and frames in which a plume grows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, pixels

CENTRE, RADIUS_M, HFOV, RANGE_M = (33.30, -116.85), 11_000.0, 90.0, 30_000.0
FRAME = "camera_id string, frame_index int, minute double, height int, width int, data binary"


def ring(spark: SparkSession, count: int, centre: tuple[float, float] = CENTRE, radius_m: float = RADIUS_M) -> DataFrame:
    """`count` cameras at equal bearings around the centre, looking inward."""
    bearing = F.col("id") * (360.0 / count)
    lat, lon = geo.project(F.lit(centre[0]), F.lit(centre[1]), bearing, F.lit(radius_m))
    at = spark.range(count).select(F.concat(F.lit("syn"), F.col("id").cast("string")).alias("camera_id"), F.concat(F.lit("site"), F.col("id").cast("string")).alias("site_id"), lat.alias("lat"), lon.alias("lon"))
    return at.withColumns({"azimuth": geo.bearing_between(F.col("lat"), F.col("lon"), *map(F.lit, centre)), "hfov": F.lit(HFOV), "range_m": F.lit(RANGE_M), "active": F.lit(True)})


#: What may stand before a camera, or ail it, beside a plume. The last three blind it.
IMPOSTORS = ("cloud", "dust", "droplet", "wobble", "fog", "night", "frozen")
FROM_FRAME = 8


def _veil(image: np.ndarray, x: float, y: float, wide: float, tall: float, tone: float, most: float) -> np.ndarray:
    """A soft ellipse of one tone before the scene."""
    rows, columns = np.ogrid[: image.shape[0], : image.shape[1]]
    veil = most * np.exp(-(((columns - x) / wide) ** 2) - ((rows - y) / tall) ** 2)
    return image * (1 - veil) + tone * veil


def _disturb(image: np.ndarray, ridge: np.ndarray, frame: int, impostor: str | None) -> np.ndarray:
    """The scene with an impostor: clouds and dust move sideways and neither grow nor rise, a droplet stays where it is,
    fog thickens from FROM_FRAME on, night dims all."""
    height, width = image.shape
    if impostor == "cloud":
        return _veil(image, 0.2 * width + 3.0 * frame, 0.45 * ridge.min(), 0.08 * width, 0.06 * height, 235, 0.85)
    if impostor == "dust":
        x = 0.3 * width + 3.5 * frame
        return _veil(image, x, ridge[int(x) % width] + 0.08 * height, 0.06 * width, 0.05 * height, 150, 0.7)
    if impostor == "droplet":
        rows, columns = np.ogrid[:height, :width]
        return np.where((columns - 0.6 * width) ** 2 + (rows - 0.5 * height) ** 2 <= (0.08 * height) ** 2, 0.3 * image + 147, image)
    if impostor == "fog" and frame >= FROM_FRAME:
        thick = min(0.9, 0.5 + 0.15 * (frame - FROM_FRAME))
        return pixels.convolve(image, np.full((5, 5), 0.04)) * (1 - thick) + 208 * thick
    return image * 0.12 if impostor == "night" else image


def render(seed: int, frame: int, x: float | None, plume_at: int, height: int = 96, width: int = 160, impostor: str | None = None) -> np.ndarray:
    """A grey frame: sky above a ridge of texture, and from plume_at on a soft column at x that rises from the ridge; or one
    with an impostor. A frozen camera repeats its frame FROM_FRAME, byte by byte; a wobbling one shakes by whole pixels."""
    if impostor is not None and impostor not in IMPOSTORS:
        raise ValueError(f"no impostor {impostor!r}; there are {', '.join(IMPOSTORS)}")
    if impostor == "frozen":
        frame = min(frame, FROM_FRAME)
    rng = np.random.default_rng(seed)
    ridge = 0.6 * height + 4 * np.sin(np.linspace(0, 6, width) + seed)
    rows = np.arange(height)[:, None]
    ground = rows >= ridge
    image = np.where(ground, 70 + 25 * rng.standard_normal((height, width)), 180 - 0.2 * rows)
    if x is not None and frame >= plume_at:
        tall, wide = 6.0 + 5.0 * (frame - plume_at), 3.0 + 0.8 * (frame - plume_at)
        up = (ridge[int(np.clip(x, 0, width - 1))] - rows) / tall
        veil = np.exp(-(((np.arange(width) - x) / wide) ** 2)) * np.clip(1 - up, 0, 1) * (up >= -0.1)
        image = image * (1 - 0.7 * veil) + 120 * 0.7 * veil
    image = _disturb(image, ridge, frame, impostor)
    if impostor == "wobble":
        image = pixels.shift(image, *np.random.default_rng([seed, frame, 1]).integers(-3, 4, 2))
    noise = np.random.default_rng([seed, frame]).normal(0, 1.0, image.shape)
    return np.clip(image + noise, 0, 255).astype(np.uint8)


def frames(cameras: DataFrame, fire: tuple[float, float] | None, count: int, plume_at: int, seed: int = 11, width: int = 160, height: int = 96) -> DataFrame:
    """Frames of cameras, rendered in the task that holds them; the plume is where the fire lies for each camera. A column
    `impostor` of the cameras names what stands before one of them."""
    x = F.lit(None).cast("double")
    if fire:
        x = geo.pixel_from_bearing(geo.bearing_between(F.col("lat"), F.col("lon"), *map(F.lit, fire)), F.lit(float(width)), F.col("azimuth"), F.col("hfov"))
    impostor = F.col("impostor") if "impostor" in cameras.columns else F.lit(None).cast("string")
    todo = cameras.select("camera_id", x.alias("x"), impostor.alias("impostor")).withColumn("frame_index", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))

    def run(it):
        for pdf in it:
            for at in range(0, len(pdf), 64):
                part = pdf.iloc[at : at + 64]
                data = [render(seed + sum(map(ord, c)), i, None if pd.isna(p) else p, plume_at, height, width, q if isinstance(q, str) else None).tobytes() for c, i, p, q in zip(part["camera_id"], part["frame_index"], part["x"], part["impostor"], strict=True)]
                yield pd.DataFrame({"camera_id": part["camera_id"], "frame_index": part["frame_index"], "minute": part["frame_index"].astype(float), "height": height, "width": width, "data": data})

    return todo.mapInPandas(run, FRAME)


#: Named incidents: cameras, frames, the frame a plume shows from (None: no fire).
SCENARIOS = {"crossing": (3, 18, 6), "quiet": (3, 14, None), "single": (1, 16, 6), "late": (4, 20, 12), "impostors": (7, 18, None), "blinded": (5, 18, 6)}
#: What stands before a scenario's cameras, in their order.
STANDS_BEFORE = {"impostors": IMPOSTORS, "blinded": (None, None, "fog", "night", "frozen")}


def with_impostors(cameras: DataFrame, kinds: tuple[str | None, ...]) -> DataFrame:
    """A ring's cameras with the kind of each, in their order; those beyond have none."""
    named = F.array(*(F.lit(k).cast("string") for k in kinds))
    number = F.regexp_extract("camera_id", r"\d+", 0).cast("int")
    return cameras.withColumn("impostor", F.get(named, number))


def scenario(spark: SparkSession, name: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """(cameras, frames) of a named incident, rendered into the folder the first time and read from it after."""
    count, length, plume_at = SCENARIOS[name]
    cameras, path = ring(spark, count), f"{folder}/{name}"
    if name in STANDS_BEFORE:
        cameras = with_impostors(cameras, STANDS_BEFORE[name])
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        frames(cameras, None if plume_at is None else CENTRE, length, length if plume_at is None else plume_at).write.mode("overwrite").parquet(path)
    return cameras, spark.read.parquet(path)
