"""Sinks: reports, calibrations, run records and the event log as JSON, and incidents as Parquet."""

from __future__ import annotations

import contextlib
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA_VERSION = "1.0"


def report(df: DataFrame, path: str, key: str) -> None:
    """One JSON line for each row, named by its key."""
    df.select(F.lit(key).alias("report"), F.struct(*df.columns).alias("row")).write.mode("overwrite").json(path)


def calibrations(pooled: DataFrame, nuisance: DataFrame, path: str) -> None:
    """One JSON document per camera: its figures and the cells of its nuisance map (768 at most)."""
    cells = nuisance.groupBy("camera_id").agg(F.array_sort(F.collect_list(F.struct("cell", "share"))).alias("cells"))
    pooled.join(cells, "camera_id", "left").select(F.array(F.struct(F.col("camera_id").cast("string").alias("camera_id"), "clear_frames", "p50", "p95", F.transform("sources", lambda s: s.cast("string")).alias("sources"), "cells")).alias("cameras")).write.mode("overwrite").json(path)


def incident(frames: DataFrame, path: str) -> None:
    """Frames by camera."""
    frames.write.mode("overwrite").partitionBy("camera_id").parquet(path)


def bundles(frames: DataFrame, cameras: DataFrame) -> DataFrame:
    """(incident, archive): each incident of frames (incident, camera_id, frame_index, ts, height, width, data: grey bytes)
    as a zip with a manifest of its cameras (camera_id, lat, lon, azimuth, hfov) and bitmaps, as readers take it. One task
    holds an incident (240 frames a clip): write_bundles() doesn't, and has no bound."""
    import io
    import json
    import zipfile

    import numpy as np
    import pandas as pd

    from ..functions import pixels

    known = F.struct("camera_id", "lat", "lon", F.col("azimuth").alias("azimuth_deg"), F.col("hfov").alias("hfov_deg"))
    told = frames.join(cameras.select("camera_id", F.to_json(known).alias("camera")), "camera_id")
    told = told.select("incident", "camera_id", "camera", "frame_index", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "height", "width", "data")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        out, listed = io.BytesIO(), {}
        with zipfile.ZipFile(out, "w") as z:
            for r in pdf.sort_values(["camera_id", "frame_index"]).itertuples(index=False):
                path = f"frames/{r.camera_id}/{r.frame_index:04d}.bmp"
                z.writestr(path, pixels.bmp(np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)))
                listed.setdefault(r.camera_id, []).append({"path": path, "timestamp": r.ts})
            spec = {"cameras": [json.loads(c) for c in sorted(set(pdf["camera"]))]}
            z.writestr("manifest.json", json.dumps({"name": str(pdf["incident"].iloc[0]), "network": spec, "sequences": listed}))
        return pd.DataFrame({"incident": pdf["incident"].iloc[:1], "archive": [out.getvalue()]})

    incident = told.schema["incident"].dataType.simpleString()
    return told.groupBy("incident").applyInPandas(pack, f"incident {incident}, archive binary")


class Timer:
    """Milliseconds and calls by stage, in the form that run_record() takes."""

    def __init__(self, run: int):
        self.run, self.rows = run, []

    @contextlib.contextmanager
    def stage(self, name: str):
        begin = time.perf_counter()
        try:
            yield
        finally:
            self.rows.append((self.run, name, int(1000 * (time.perf_counter() - begin)), 1, None))

    def stages(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, "run long, name string, ms long, calls long, refusal string")


def run_record(stages: DataFrame) -> DataFrame:
    """(run, record): stages (run, name, ms, calls, refusal) summed by name, as one JSON text a run."""
    by_name = stages.groupBy("run", "name").agg(F.sum("ms").alias("ms"), F.sum("calls").alias("calls"), F.array_sort(F.collect_set("refusal")).alias("refusals"))
    whole = by_name.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("name", "ms", "calls", "refusals"))).alias("stages"))
    return whole.select("run", F.to_json(F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "run", "stages")).alias("record"))


def observed(df: DataFrame, name: str, confidence: str = "confidence"):
    """df with an observation of its progress: rows and highest confidence, free of a second pass."""
    from pyspark.sql import Observation

    o = Observation(name)
    return df.observe(o, F.count(F.lit(1)).alias("rows"), F.max(confidence).alias("peak")), o


def events(stream: DataFrame, path: str, checkpoint: str):
    """Appends a stream's rows to Parquet, once each."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def write_bundles(frames: DataFrame, cameras: DataFrame, folder: str) -> DataFrame:
    """Writes each incident of frames (incident, camera_id, frame_index, ts, height, width, data: grey bytes) as an archive
    into a folder that all executors share, and returns (incident, path, frames: how many).

    Frames stream into their archive by camera in order of time, so a task holds one Arrow batch and the list of names,
    however long an incident is. A name appears once its file is whole; a task that is run again writes the same. Frames of
    cameras that aren't in the table, and those without a time, are kept and read back with that problem; those without an
    incident, a camera or a picture are left out. Repeated frames are each written; of a camera listed twice, the
    description that sorts first counts. Where a name needs other characters, or is empty, a digest tells incidents apart.
    """
    import pyarrow as pa

    known = F.struct("camera_id", "lat", "lon", F.col("azimuth").alias("azimuth_deg"), F.col("hfov").alias("hfov_deg"))
    listed = cameras.groupBy("camera_id").agg(F.min(F.to_json(known)).alias("camera"))
    told = frames.dropna(subset=["incident", "camera_id", "height", "width", "data"]).join(listed, "camera_id", "left")
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")
    told = told.select(F.col("incident").cast("string"), "camera_id", "ts", "frame_index", "camera", when.alias("at"), "height", "width", "data")

    def run(it):
        open_ = None
        try:
            for batch in it:
                done = []
                for row in zip(*(batch.column(k).to_pylist() for k in (0, 1, 4, 5, 6, 7, 8)), strict=True):
                    if open_ is not None and open_.incident != row[0]:
                        done.append(open_.close())
                        open_ = None
                    open_ = open_ or _Archive(folder, row[0])
                    open_.add(*row[1:])
                yield _written(pa, done)
            if open_ is not None:
                done, open_ = [open_.close()], None
                yield _written(pa, done)
        finally:
            if open_ is not None:
                open_.give_up()

    ordered = told.repartition("incident").sortWithinPartitions("incident", "camera_id", F.col("ts").asc_nulls_last(), "frame_index", "data")
    return ordered.mapInArrow(run, "incident string, path string, frames long")


def _written(pa, done: list[tuple]):
    kinds = {"incident": pa.string(), "path": pa.string(), "frames": pa.int64()}
    return pa.record_batch({name: pa.array([d[k] for d in done], kind) for k, (name, kind) in enumerate(kinds.items())})


class _Archive:
    """An incident's archive as it is written, below a hidden name."""

    def __init__(self, folder: str, incident: str):
        import hashlib
        import uuid
        import zipfile

        from ..functions import names
        from .recorded import _files

        self.incident, self.folder = incident, folder.rstrip("/")
        self.name = names.plain(incident)
        if self.name != incident or not incident.strip("."):
            self.name += "-" + hashlib.sha256(incident.encode()).hexdigest()[:12]
        self.files, self.at = _files(self.folder)
        self.files.create_dir(self.at, recursive=True)
        self.part = f"{self.at}/.{self.name}-{uuid.uuid4().hex}"
        self.stream = self.files.open_output_stream(self.part)
        self.zip = zipfile.ZipFile(self.stream, "w")
        self.n, self.listed, self.cameras = 0, {}, {}

    def add(self, camera_id, camera: str | None, at: str | None, height: int, width: int, data: bytes) -> None:
        import json

        import numpy as np

        from ..functions import names, pixels

        camera_id = str(camera_id)
        path = f"frames/{names.plain(camera_id)}/{self.n:06d}.bmp"  # numbered through the incident, so no two are the same
        self.zip.writestr(path, pixels.bmp(np.frombuffer(data, np.uint8).reshape(height, width)))
        self.listed.setdefault(camera_id, []).append({"path": path, "timestamp": at})
        if camera is not None:
            self.cameras[camera_id] = json.loads(camera)
        self.n += 1

    def close(self) -> tuple[str, str, int]:
        import json

        spec = {"cameras": [self.cameras[c] for c in sorted(self.cameras)]}
        self.zip.writestr("manifest.json", json.dumps({"name": self.incident, "network": spec, "sequences": self.listed}))
        self.zip.close()
        self.stream.close()
        self.files.move(self.part, f"{self.at}/{self.name}.zip")
        return self.incident, f"{self.folder}/{self.name}.zip", self.n

    def give_up(self) -> None:
        self.zip.close()
        self.stream.close()
        self.files.delete_file(self.part)
