"""Zip archives of incidents and of stills: members as rows, told apart and checked."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import names, scoring
from . import readers

#: Fixed value: fewer stills than this tell nothing of growth.
LEAST_STILLS = 6


def members(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, content, refusal) of every file in zip archives, one at a time in the task that reads the archive.
    Hidden files and resource forks are left out; what isn't a zip is one row without a path that says NOT_A_ZIP."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for archive, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    z = zipfile.ZipFile(io.BytesIO(content))
                except zipfile.BadZipFile:
                    yield pd.DataFrame({"archive": [archive], "path": [None], "content": [None], "refusal": ["NOT_A_ZIP"]})
                    continue
                for info in z.infolist():
                    if not info.is_dir() and "__MACOSX" not in info.filename and not info.filename.rpartition("/")[2].startswith("."):
                        yield pd.DataFrame({"archive": [archive], "path": [info.filename], "content": [z.read(info)], "refusal": [None]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "archive string, path string, content binary, refusal string")


def kind(files: DataFrame) -> DataFrame:
    """(archive, kind): a bundle has a manifest, at its root or below one folder; else it is a clip of stills; an archive that
    couldn't be opened is neither and has no row here."""
    manifest = F.col("path").rlike(r"^([^/]+/)?manifest\.json$")
    return files.groupBy("archive").agg(F.when(F.count_if(manifest) > 0, "bundle").when(F.count("path") > 0, "stills").alias("kind")).filter("kind is not null")


def bundle(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cameras, frames with content) of a zipped incident (members of one archive)."""
    manifest = files.filter(F.col("path").rlike(r"^([^/]+/)?manifest\.json$")).select(F.col("content").cast("string").alias("manifest"), F.regexp_extract("path", r"^(.*?)manifest\.json$", 1).alias("root"))
    cameras, frames = readers.described(manifest)
    root = manifest.select("root")
    content = files.crossJoin(F.broadcast(root)).select(F.expr("substr(path, length(root) + 1)").alias("path"), "content")  # one manifest
    return cameras, frames.join(content, "path", "left").withColumn("problem", F.coalesce("problem", F.when(F.col("content").isNull(), "NO_FILE")))


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(cameras, frames) of an incident in a zip archive or a folder."""
    return bundle(members(spark, path)) if path.lower().endswith(".zip") else readers.bundle(spark, path)


def clip(files: DataFrame, interval_s: float = 60.0) -> DataFrame:
    """Stills of archives in order of name: archive, path, content, frame_index, ts, and refusal where an archive has fewer
    than LEAST_STILLS of them. Names' times count only if all of an archive's stills have one and no two the same."""
    own = names.timestamp(F.col("path"))
    w = Window.partitionBy("archive")
    s = files.filter(names.is_image(F.col("path"))).withColumns({"own": own, "n": F.count("*").over(w), "frame_index": F.row_number().over(w.orderBy("path")) - 1})
    s = s.withColumn("again", F.lag("own").over(w.orderBy("own")) == F.col("own"))
    s = s.withColumn("good", (F.count("own").over(w) == F.col("n")) & (F.count_if("again").over(w) == 0))
    ts = F.when(F.col("good"), F.col("own")).otherwise(F.timestamp_seconds(F.col("frame_index") * interval_s))
    return s.select("archive", "path", "content", "frame_index", ts.alias("ts"), F.when(F.col("n") < LEAST_STILLS, "TOO_FEW_FRAMES").alias("refusal"))


def sampled(stills: DataFrame, interval_s: float) -> DataFrame:
    """The stills of each archive that the sampling plan analyses."""
    w = Window.partitionBy("archive")
    stride, count = scoring.sampling_plan(F.col("n"), F.lit(float(interval_s)))
    s = stills.withColumn("n", F.count("*").over(w)).withColumns({"stride": stride, "count": count})
    return s.filter((F.col("frame_index") % F.col("stride") == 0) & (F.col("frame_index") / F.col("stride") < F.col("count"))).drop("n", "count")


#: An upload's field of view where none is given, and the widest that is believed.
UPLOAD_HFOV, MOST_HFOV = 60.0, 180.0


def camera(spark: SparkSession, bearing_deg: float | None = None, hfov_deg: float | None = None) -> DataFrame:
    """The camera of an upload: its aim is known if the caller gave one in range; its position is not. A number out of
    range isn't used, and refusal says so."""
    aim = bearing_deg is not None and 0 <= bearing_deg <= 360
    wide = hfov_deg is not None and 1 <= hfov_deg <= MOST_HFOV
    refusal = "BEARING_OUT_OF_RANGE" if bearing_deg is not None and not aim else "HFOV_OUT_OF_RANGE" if hfov_deg is not None and not wide else None
    row = ("upload", "upload", float(bearing_deg) if aim else 0.0, float(hfov_deg) if wide else UPLOAD_HFOV, False, aim, refusal)
    return spark.createDataFrame([row], "camera_id string, site_id string, azimuth double, hfov double, position_known boolean, aim_known boolean, refusal string")
