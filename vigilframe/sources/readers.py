"""Readers: site metadata, network specs, bundles, folders and archives of stills, label files, calibrations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names

_SITES = "map<string, struct<name: string, lat: string, long: string, elev: string, cams: map<string, struct<imager: string, azimuth: string, horizontalView: string, active: string>>>>"
SPEC = "struct<name: string, attribution: string, cameras: array<struct<camera_id: string, site_id: string, site_name: string, lat: double, lon: double, elevation_m: double, azimuth_deg: double, hfov_deg: double, imager: string, active: boolean, range_m: double, still_url: string>>>"
MANIFEST = f"struct<name: string, notes: string, network: {SPEC}, truth: string, sequences: map<string, array<struct<path: string, timestamp: string>>>>"
LEAST_FRAMES = 8


def sites(spark: SparkSession, path: str, include_ptz: bool = False, include_unusual: bool = False, still_url: str | None = None) -> DataFrame:
    """Cameras of a script that assigns an object of sites: what lies between its first `{` and last `}` is parsed."""
    text = spark.read.text(path, wholetext=True).select(F.regexp_extract("value", r"(?s)\{.*\}", 0).alias("json"))
    s = text.select(F.explode(F.from_json("json", _SITES)).alias("site_id", "site")).select("site_id", "site.*")
    c = s.select("site_id", F.col("name").alias("site_name"), *(F.expr(f"try_cast({a} AS double)").alias(b) for a, b in (("lat", "lat"), ("long", "lon"))), F.expr("coalesce(try_cast(elev AS double), 0D)").alias("elevation_m"), F.explode("cams").alias("camera_id", "cam"))
    c = c.select("*", F.lower("cam.imager").alias("imager")).filter((F.col("imager") != "ptz") | F.lit(include_ptz))
    if not include_unusual:
        c = c.filter(F.col("imager").isin("color", "monochrome", *(["ptz"] if include_ptz else [])))
    url = F.lit(None).cast("string") if still_url is None else F.format_string(still_url, "camera_id")
    return c.select("camera_id", "site_id", "site_name", "lat", "lon", "elevation_m", F.expr("coalesce(try_cast(cam.azimuth AS double), 0D)").alias("azimuth_deg"), F.expr("coalesce(try_cast(cam.horizontalView AS double), 90D)").alias("hfov_deg"), "imager", F.lower("cam.active").startswith("y").alias("active"), F.lit(40_000.0).alias("range_m"), url.alias("still_url"))


def _defaults(c: DataFrame) -> DataFrame:
    filled = {"site_id": F.split_part("camera_id", F.lit("-"), F.lit(1)), "elevation_m": F.lit(0.0), "azimuth_deg": F.lit(0.0), "hfov_deg": F.lit(90.0), "imager": F.lit("color"), "active": F.lit(True), "range_m": F.lit(40_000.0)}
    c = c.withColumns({k: F.coalesce(k, v) for k, v in filled.items()})
    return c.withColumns({"site_name": F.coalesce("site_name", "site_id"), "position_known": F.col("lat").isNotNull() & F.col("lon").isNotNull()})


def network(spark: SparkSession, path: str) -> DataFrame:
    """Cameras of a JSON spec, with defaults for what it leaves out; a site is the part of the id before `-`."""
    spec = spark.read.text(path, wholetext=True).select(F.from_json("value", SPEC).alias("s"))
    return _defaults(spec.select(F.explode("s.cameras").alias("c")).select("c.*"))


def bundle(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(cameras, frames) of an unpacked incident: frames in order of time, numbered anew by camera. A frame's time is the
    manifest's or its name's. Frames of unknown cameras or without a time carry a problem and no number."""
    return described(spark.read.text(f"{folder}/manifest.json", wholetext=True).select(F.col("value").alias("manifest")))


def described(manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """bundle() of a manifest's text."""
    m = manifest.select(F.from_json("manifest", MANIFEST).alias("m"))
    cameras = _defaults(m.select(F.explode("m.network.cameras").alias("c")).select("c.*"))
    f = m.select(F.explode("m.sequences").alias("camera_id", "frames")).select("camera_id", F.explode("frames").alias("f"))
    f = f.select("camera_id", "f.path", F.coalesce(F.expr("try_to_timestamp(f.timestamp)"), names.timestamp(F.col("f.path"))).alias("ts"))
    known = cameras.select("camera_id", F.lit(True).alias("known"))
    f = f.join(known, "camera_id", "left").withColumn("problem", F.when(F.col("known").isNull(), "UNKNOWN_CAMERA").when(F.col("ts").isNull(), "NO_TIMESTAMP")).drop("known")
    order = Window.partitionBy("camera_id").orderBy(F.col("problem").isNotNull(), "ts", "path")
    return cameras, f.withColumn("frame_index", F.when(F.col("problem").isNull(), F.row_number().over(order) - 1))


def stills(spark: SparkSession, folder: str, start: str = "1970-01-01 00:00:00", interval_s: float = 60.0) -> DataFrame:
    """(path, content, frame_index, ts) of a folder's images in order of name. Names' times are used only if all of them
    have one and no two the same; else the times are start plus whole intervals."""
    files = spark.read.format("binaryFile").load(folder).filter(names.is_image(F.col("path")) & ~F.element_at(F.split("path", "/"), -1).startswith(".") & ~F.col("path").contains("__MACOSX"))
    own = names.timestamp(F.col("path"))
    good = files.agg((F.count(own) == F.count("*")) & (F.count_distinct(own) == F.count("*"))).first()[0]
    rows = files.select("path").withColumn("frame_index", F.row_number().over(Window.orderBy("path")) - 1)  # names of one clip
    given = F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + F.col("frame_index") * interval_s)
    return files.select("path", "content").join(rows, "path").withColumn("ts", names.timestamp(F.col("path")) if good else given)


def sequence(spark: SparkSession, camera_id: str, images: list, interval_s: float = 60.0) -> DataFrame:
    """Frames (camera_id, frame_index, minute, height, width, data) of grey images in memory, interval_s apart."""
    from ..functions import pixels
    from . import synthetic

    grey = [pixels.luma(x).round().clip(0, 255).astype("uint8") for x in images]
    rows = [(camera_id, i, i * interval_s / 60.0, *x.shape, x.tobytes()) for i, x in enumerate(grey)]
    return spark.createDataFrame(rows, synthetic.FRAME)


def archive(spark: SparkSession, root: str, cameras: DataFrame, stride: int = 1, least: int = LEAST_FRAMES) -> DataFrame:
    """Frames of `<date>_FIRE_<camera>/<epoch>_<offset>.jpg` below root: sequence, date, camera_id, offset_s, ts, smoke and
    the camera's columns; every stride-th of sequences of at least `least`. Unknown cameras stay, at (0, 0)."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    part = lambda i: F.element_at(F.split("path", "/"), i)
    f = f.select("path", "content", part(-2).alias("sequence"), part(-1).alias("file")).filter(F.col("sequence").rlike(names.SEQUENCE) & F.col("file").rlike(names.FRAME))
    f = f.withColumns({"date": F.regexp_extract("sequence", names.SEQUENCE, 1), "camera_id": F.regexp_extract("sequence", names.SEQUENCE, 2), "ts": F.timestamp_seconds(F.regexp_extract("file", names.FRAME, 1).cast("long")), "offset_s": F.regexp_extract("file", names.FRAME, 2).cast("int")})
    w = Window.partitionBy("sequence")
    f = f.withColumns({"n": F.count("*").over(w), "k": F.row_number().over(w.orderBy("offset_s", "file")) - 1}).filter((F.col("n") >= least) & (F.col("k") % stride == 0)).drop("n", "k", "file")
    c = cameras.select("camera_id", "site_id", "lat", "lon", "azimuth_deg", "hfov_deg")
    f = f.join(c, "camera_id", "left").withColumn("smoke", F.col("offset_s") >= 0)
    return f.withColumns({"site_id": F.coalesce("site_id", F.split_part("camera_id", F.lit("-"), F.lit(1))), "lat": F.coalesce("lat", F.lit(0.0)), "lon": F.coalesce("lon", F.lit(0.0)), "azimuth_deg": F.coalesce("azimuth_deg", F.lit(0.0)), "hfov_deg": F.coalesce("hfov_deg", F.lit(90.0))})


def subset(cameras: DataFrame, ids: DataFrame, still_url: str) -> DataFrame:
    """The named cameras, with the address of their latest still (%s stands for the id); ValueError where none is known."""
    found = cameras.join(ids.select("camera_id").distinct(), "camera_id", "left_semi")
    if found.isEmpty():
        raise ValueError("none of these cameras is in the network")
    return found.withColumn("still_url", F.format_string(still_url, "camera_id"))


def images(spark: SparkSession, folder: str, skip_invalid: bool = False) -> DataFrame:
    """(path, height, width, data) of a folder's images, decoded by the engine and turned to grey bytes. One that can't be
    decoded is an error that names it, unless such are to be skipped."""
    import pandas as pd

    from ..functions import pixels

    def run(it):
        import numpy as np

        for pdf in it:
            bad = pdf.loc[pdf["height"] <= 0, "origin"]
            if len(bad):
                raise ValueError(f"not an image: {bad.iloc[0]}")
            grey = [np.rint(pixels.luma(np.frombuffer(d, np.uint8).reshape(h, w, c)[..., : min(c, 3)].squeeze())).astype(np.uint8).tobytes() for h, w, c, d in zip(pdf["height"], pdf["width"], pdf["nChannels"], pdf["data"], strict=True)]
            yield pd.DataFrame({"path": pdf["origin"], "height": pdf["height"], "width": pdf["width"], "data": grey})

    return spark.read.format("image").option("dropInvalid", skip_invalid).load(folder).select("image.origin", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, "path string, height int, width int, data binary")


def missing(wanted: DataFrame, cached: DataFrame) -> DataFrame:
    """Names that were asked for and are not there."""
    return wanted.join(cached, "sequence", "left_anti").distinct()


def boxes(spark: SparkSession, path: str) -> DataFrame:
    """(path, cx, cy, w, h) of label files of `class cx cy w h` lines; lines of other shapes are left out."""
    p = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(F.input_file_name().alias("path"), p.alias("p")).filter(F.size("p") >= 5)
    return rows.select("path", *(F.expr(f"try_cast(p[{i + 1}] AS double)").alias(c) for i, c in enumerate(("cx", "cy", "w", "h")))).dropna()


def calibrations(spark: SparkSession, path: str) -> DataFrame:
    schema = "cameras array<struct<camera_id: string, clear_frames: long, p50: double, p95: double, sources: array<string>, cells: array<struct<cell: int, share: double>>>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("cameras").alias("c")).select("c.*")
