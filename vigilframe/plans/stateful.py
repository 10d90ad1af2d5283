"""Queries over order-dependent state, streams and pixels; SQL where it can express them."""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, scoring
from ..operators import detection, escalation, network, tracker, tracks
from ..sources import fixtures, recorded, scratch, sinks, synthetic
from ..streaming import escalating, tracking
from . import macros as m


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """Boxes along cameras: lines of orders, an order's lines at one place that drifts."""
    l = fixtures.observations(spark, d)
    return l.select("camera_id", (F.floor(F.col("track_id") / 50) * 8 + F.col("frame_index")).alias("frame_index"), F.col("track_id").alias("region"), (F.col("track_id") * 131 % 900 + F.col("frame_index") * 3).cast("double").alias("x"), (F.col("track_id") * 17 % 500).cast("double").alias("y"), "w", "h")


def region_tracks(spark, d):
    return tracker.track(_regions(spark, d))


def box_suppression(spark, d):
    e = fixtures.table(spark, d, "events")
    k = F.col("event_id")
    boxes = e.select((k % 500).alias("image"), F.lit(0).alias("label"), k.alias("box"), F.col("value").alias("score"), (k * 7 % 60).cast("double").alias("x"), (k * 11 % 60).cast("double").alias("y"), (20 + k % 20).cast("double").alias("w"), (20 + k % 15).cast("double").alias("h"))
    return tracker.suppress(boxes)


_HOUR, _DAY = 3600, 86_400


def _said(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Each active camera's best reading of an hour of an incident (a date's sequences on one day), blind ones too, and what
    the cameras that overlook a suspect one's bearing say of it. Readings are used several times, so they are a table."""
    r = fixtures.readings(spark, d).filter("active")
    k = F.col("event_id")
    day, hour = (F.floor(F.col("epoch_s") / n) for n in (_DAY, _HOUR))
    own = r.select("event_id", (day * 20 + F.col("date")).alias("incident"), hour.alias("tick"), F.timestamp_seconds(hour * _HOUR).alias("at"), "camera_id", (F.col("sequence") % 3).alias("track_id"), "confidence", (k % 9).alias("frames"), F.when(k % 13 == 0, "fog").alias("blind"), "lat", "lon", "bearing", "range_m", "site_id")
    best = Window.partitionBy("incident", "tick", "camera_id").orderBy(F.col("blind").isNotNull(), F.desc("confidence"), "event_id")
    own = escalation.re_examined(own.withColumn("k", F.row_number().over(best)).filter("k = 1").drop("k"), ["incident"], ["tick"])
    own = scratch.kept(own.withColumn("summary", F.format_string("scored %.2f over %d frames", "confidence", "frames")), "readings")
    suspects = own.filter((F.col("confidence") >= scoring.SUSPECT_AT) & F.col("blind").isNull())
    near = network.consultable(suspects, fixtures.cameras(spark, d))
    asked = (k * 3 % 100) / 100.0
    outcome = scoring.answer(F.lit(True), (k + F.col("camera_id")) % 11 == 0, F.col("crossing") - 60.0, asked, k % 9, tolerance=20.0)
    near = near.select("event_id", "camera_id", outcome.alias("outcome"), asked.alias("confidence"), "expected", (k % 9).alias("frames"))
    seen_at = geo.normalise(F.col("expected") + (k % 5 - 2) * 1.0 + F.when(F.col("outcome") == "off_bearing", 30.0).otherwise(0.0))
    return own, near.withColumn("said", escalation.answer_text(F.col("outcome"), F.col("expected"), seen_at, F.col("confidence"), F.col("frames"), F.when(F.col("outcome") == "blind", "fog")))


def _sweeps(own: DataFrame, said: DataFrame) -> DataFrame:
    """Detections with the answers to them, four at most."""
    answers = said.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("camera_id", "outcome", "confidence", "said"))).alias("answers"))
    return own.drop("lat", "lon", "bearing", "range_m", "site_id").join(answers, "event_id", "left").drop("event_id")


def escalation_log(spark, d):
    return escalation.escalate(_sweeps(*_said(spark, d)))


def escalation_stream(spark, d):
    """escalation_log of a stream: ticks come shuffled, in four files of a week each, with a tenth of the rows a file late; a
    last row moves the watermark past all."""
    sweeps = _sweeps(*_said(spark, d))
    week, behind = F.floor(F.unix_seconds("at") / (7.5 * _DAY)), F.pmod(F.xxhash64("incident", "tick", "camera_id"), F.lit(10)) == 0
    end = sweeps.agg(F.max("incident").alias("incident"), F.max("tick").alias("tick"), F.max("at").alias("at"))
    end = end.select((F.col("incident") + 1_000_000).alias("incident"), (F.col("tick") + 10_000).alias("tick"), (F.col("at") + F.expr("interval 300 days")).alias("at"))
    at = _in_files(spark, sweeps.unionByName(end, allowMissingColumns=True), week + behind.cast("long"))
    stream = spark.readStream.schema(sweeps.schema).option("maxFilesPerTrigger", 1).parquet(at)
    with _rocksdb(spark):
        return _run(escalating.escalate(stream, late="16 days", idle_s=_DAY), "append", spark, at).drop("batch")


def nearest_stream(spark, d):
    """nearest_frame of two streams: events in order of time, a tenth of them a week late."""
    r = fixtures.readings(spark, d).select(F.col("sequence").alias("key"), "event_id", "event_type", F.timestamp_seconds("epoch_s").alias("ts"))
    week, behind = F.floor(F.unix_seconds("ts") / (7.5 * _DAY)), F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0
    ends = r.agg(F.max("ts").alias("ts")).select(F.lit(-1).cast("long").alias("key"), F.lit(-1).cast("long").alias("event_id"), (F.col("ts") + F.expr("interval 300 days")).alias("ts"), F.explode(F.array(F.lit("error"), F.lit("view"))).alias("event_type"))
    at = _in_files(spark, r.unionByName(ends), week + behind.cast("long"))
    stream = lambda: spark.readStream.schema(r.schema).option("maxFilesPerTrigger", 1).parquet(at)
    probes = stream().filter("event_type = 'error'").select("key", F.col("event_id").alias("probe_id"), F.col("ts").alias("at"))
    frames = stream().filter("event_type != 'error'").select("key", F.col("event_id").alias("frame_id"), "ts")
    got = _run(tracking.nearest(probes, frames, 3600, late="16 days"), "append", spark, at)
    return got.filter("key >= 0").select(F.col("key").alias("sequence"), "probe_id", "frame_id", F.col("gap_s").cast("long").alias("gap_s"))


def alert_fixes(spark, d):
    """Where the alerts are: the rays of each camera's reading of a tick, and of those that support it. Answers, log and rays
    are used several times each, so they are tables."""
    own, said = _said(spark, d)
    said = scratch.kept(said, "answers")
    named = {"label": F.concat(F.lit("camera "), F.col("camera_id").cast("string")), "site_name": F.concat(F.lit("site "), F.col("site_id").cast("string"))}
    seen = own.filter((F.col("confidence") >= scoring.SUSPECT_AT) & F.col("blind").isNull())
    cols = ["incident", "tick", "origin", "camera_id", "lat", "lon", "bearing", "range_m", "label", "site_name"]
    mine = seen.withColumns({**named, "origin": F.col("camera_id")}).select(*cols)
    places = fixtures.cameras(spark, d).withColumns(named).select("camera_id", "lat", "lon", "range_m", "label", "site_name")
    asked = seen.select("event_id", "incident", "tick", F.col("camera_id").alias("origin"))
    theirs = said.filter("outcome = 'supported'").join(asked, "event_id").join(places, "camera_id").withColumn("bearing", F.col("expected")).select(*cols)
    log = scratch.kept(escalation.escalate(_sweeps(own, said)), "log")
    located = escalation.locate(log, scratch.kept(mine.unionByName(theirs).withColumn("sigma", F.lit(1.5)), "rays"))
    return located.withColumn("reasoning", F.concat_ws("\n", "reasoning"))


def _in_files(spark: SparkSession, rows: DataFrame, place) -> str:
    """Rows in files of a folder that a stream takes one by one, in order of place."""
    at = scratch.fresh_path(spark, "input")
    rows = rows.withColumn("__place", place)
    rows = rows.repartition("__place").cache()
    for n in sorted(r[0] for r in rows.select("__place").distinct().collect()):  # a few
        rows.filter(F.col("__place") == n).drop("__place").coalesce(1).write.mode("append").parquet(at)
    rows.unpersist()
    return at


@contextlib.contextmanager
def _rocksdb(spark: SparkSession):
    """The session's streams that start within keep their state in RocksDB."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, escalating.ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _run(stream: DataFrame, mode: str, spark: SparkSession, *used: str) -> DataFrame:
    """All a stream's input, through a table in the shared folder; its state and the folders it used go."""
    at = scratch.fresh_path(spark, "stream")

    def put(batch: DataFrame, n: int) -> None:
        batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{at}/out/batch_no={n}")

    stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{at}/state").foreachBatch(put).start().awaitTermination()
    for path in (f"{at}/state", *used):
        scratch.delete(spark, path)
    return spark.read.parquet(f"{at}/out").drop("batch_no")


def late_growth_stream(spark, d):
    """Tracks whose frames come out of order, some twice: the last state of each equals the batch aggregate."""
    at = scratch.fresh_path(spark, "input")
    o = fixtures.observations(spark, d).select("track_id", "frame_index", "minute", "area")
    late = F.pmod(F.xxhash64("track_id", "frame_index"), F.lit(3))
    for n in range(3):
        o.filter(late >= n).filter((late == n) | (late == 2)).write.mode("append").parquet(at)
    stream = tracking.growth(spark.readStream.schema(o.schema).option("maxFilesPerTrigger", 8).parquet(at))
    with _rocksdb(spark):
        got = _run(stream, "update", spark, at)
    last = got.groupBy("track_id").agg(F.max_by(F.struct("frames", "area_slope", "area_ratio"), "batch").alias("s"))
    return last.select("track_id", F.col("s.frames").alias("frames"), F.round("s.area_slope", 6).alias("area_slope"), F.round("s.area_ratio", 9).alias("area_ratio"))


_LATE = f"WITH {m.OBSERVATION} SELECT track_id, count(*) AS frames, round(CASE WHEN count(*) * var_pop(minute) < 1e-9 THEN 0.0 ELSE coalesce(regr_slope(area, minute), 0) END, 6) AS area_slope, round(arg_max(area, minute * 1000 + frame_index) / greatest(arg_min(area, minute * 1000 + frame_index), 1.0), 9) AS area_ratio FROM observation GROUP BY track_id"


def tiny_image_stats(spark, d):
    """Images of eight columns of vectors: mean, variance, extremes and the mean absolute step between rows (null without a
    second row)."""
    v = fixtures.table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.round(x.cast("double"), 6)).alias("e"))
    total = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    mean = total / F.size("e")
    var = F.aggregate("e", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("e")
    more = F.size("e") - 8  # components with one a row below
    steps = F.when(more > 0, F.transform(F.sequence(F.lit(1), F.greatest(more, F.lit(1))), lambda i: F.abs(F.get("e", i + 7) - F.get("e", i - 1))))
    out = v.withColumn("mean", mean).select("vec_id", "mean", var.alias("var"), F.array_min("e").alias("low"), F.array_max("e").alias("high"), (F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / more).alias("step"))
    return out.withColumns({c: F.round(c, 8) for c in ("mean", "var", "low", "high", "step")})


_TINY = "WITH v AS (SELECT vec_id, [round(CAST(x AS DOUBLE), 6) FOR x IN embedding] AS e FROM embeddings), u AS (SELECT vec_id, e, unnest(e) AS x FROM v), s AS (SELECT vec_id, avg(x) AS mean, var_pop(x) AS var, min(x) AS low, max(x) AS high FROM u GROUP BY vec_id), t AS (SELECT vec_id, avg(abs(e[i + 8] - e[i])) AS step FROM v, range(1, 57) r(i) GROUP BY vec_id) SELECT vec_id, round(mean, 8) AS mean, round(var, 8) AS var, round(low, 8) AS low, round(high, 8) AS high, round(step, 8) AS step FROM s JOIN t USING (vec_id)"


def run_records(spark, d):
    e = fixtures.table(spark, d, "events").select((F.col("user_id") % 50).alias("run"), F.col("event_type").alias("name"), F.floor("value").cast("long").alias("ms"), F.lit(1).cast("long").alias("calls"), F.when(F.col("event_type") == "error", "NO_SECOND_VIEW").alias("refusal"))
    r = sinks.run_record(e)
    return r.select("run", F.get_json_object("record", "$.schema_version").alias("version"), F.get_json_object("record", "$.stages[0].name").alias("first"), F.get_json_object("record", "$.stages[0].ms").cast("long").alias("ms"), F.get_json_object("record", "$.stages[2].refusals[0]").alias("refusal"))


_RECORDS = "WITH s AS (SELECT user_id % 50 AS run, event_type AS name, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS ms, row_number() OVER (PARTITION BY user_id % 50 ORDER BY event_type) AS k FROM events GROUP BY 1, 2) SELECT run, '1.0' AS version, max(name) FILTER (WHERE k = 1) AS first, max(ms) FILTER (WHERE k = 1) AS ms, max(CASE WHEN name = 'error' THEN 'NO_SECOND_VIEW' END) FILTER (WHERE k = 3) AS refusal FROM s GROUP BY run"


def recorded_frames(spark, d):
    """Vectors as frames of eight by eight pixels, 50 an incident, written as bundles and read back through the source: the
    frames of three of five cameras from the third minute on."""
    v = F.col("vec_id")
    grey = F.transform(F.slice("embedding", 1, 64), lambda x: F.lpad(F.hex(F.pmod(F.floor(x.cast("double") * 1000), F.lit(256))), 2, "0"))
    frames = fixtures.table(spark, d, "embeddings").select(
        F.floor(v / 50).alias("incident"), (v % 5).cast("string").alias("camera_id"), v.alias("frame_index"),
        F.timestamp_seconds(1_700_000_000 + F.floor(v % 50 / 5) * 60).alias("ts"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(F.array_join(grey, "")).alias("data"),
    )
    cams = fixtures.cameras(spark, d).filter("camera_id < 5").withColumn("camera_id", F.col("camera_id").cast("string"))
    at = scratch.fresh_path(spark, "bundles")
    sinks.write_bundles(frames, cams, at).write.format("noop").mode("overwrite").save()
    recorded.register(spark)
    read = spark.read.format("recorded").load(at).filter(F.col("camera_id").isin("1", "2", "4") & (F.col("ts") >= F.timestamp_seconds(F.lit(1_700_000_120))))
    byte = lambda i: F.conv(F.substring(F.hex("data"), 2 * i + 1, 2), 16, 10).cast("long")
    total = F.aggregate(F.transform(F.sequence(F.lit(0), F.length("data") - 1), byte), F.lit(0).cast("long"), lambda a, x: a + x)
    return read.select(F.col("incident").cast("long"), F.col("camera_id").cast("long"), F.col("frame_index").cast("long"), F.unix_seconds("ts").alias("epoch_s"), F.col("height").cast("long"), F.col("width").cast("long"), total.alias("total"), "problem")


_RECORDED = """WITH f AS (SELECT vec_id // 50 AS incident, vec_id % 5 AS camera_id, 1700000000 + vec_id % 50 // 5 * 60 AS epoch_s,
   [CAST(((floor(CAST(x AS DOUBLE) * 1000) % 256) + 256) % 256 AS BIGINT) FOR x IN embedding[1:64]] AS p FROM embeddings)
 SELECT incident, camera_id, row_number() OVER (PARTITION BY incident, camera_id ORDER BY epoch_s) - 1 AS frame_index, epoch_s,
  CAST(8 AS BIGINT) AS height, CAST(8 AS BIGINT) AS width, CAST(list_sum(p) AS BIGINT) AS total, NULL AS problem
 FROM f QUALIFY camera_id IN (1, 2, 4) AND epoch_s >= 1700000120"""


def synthetic_incident(spark, d):
    """Frames in which three cameras see a plume, down to its position: rendered, measured, tracked and crossed."""
    cams = synthetic.ring(spark, 3)
    found = detection.regions(synthetic.frames(cams, synthetic.CENTRE, 14, 6), least=20)
    number = F.regexp_extract("camera_id", r"\d+", 0).cast("long")
    boxes = found.select(number.alias("camera_id"), F.col("frame_index").cast("long"), F.col("region").cast("long"), *(F.col(c).cast("double") for c in tracker.BOX))
    tracked = tracker.track(boxes, width=160.0)
    seen = found.withColumn("camera", number).join(tracked.withColumnRenamed("camera_id", "camera"), ["camera", "frame_index", "region"])
    w = Window.partitionBy("camera_id").orderBy(F.desc("n"), F.desc("area"))
    longest = seen.withColumn("n", F.count("*").over(Window.partitionBy("camera_id", "track_id"))).withColumn("k", F.row_number().over(w)).filter("k = 1")
    rays = longest.join(cams, "camera_id").select(F.lit(0).alias("incident"), "camera_id", "lat", "lon", "range_m", geo.bearing_from_pixel(F.col("cx"), F.lit(160.0), F.col("azimuth"), F.col("hfov")).alias("bearing"), F.lit(1.5).alias("sigma"))
    from ..operators import fixes

    return fixes.cross(rays, "incident").withColumn("error_m", geo.haversine(F.col("lat"), F.col("lon"), F.lit(synthetic.CENTRE[0]), F.lit(synthetic.CENTRE[1])))


def scene_usability(spark, d):
    """Rendered frames through the usability ladder, with each camera's own contrast as its baseline."""
    s = detection.scenes(synthetic.frames(synthetic.ring(spark, 4), None, 12, 99))
    s = tracks.trailing_median(s, "camera_id", "frame_index", "contrast")
    s = tracks.frozen_runs(s, "camera_id", "frame_index", "difference")
    measures = {c: F.col(c) for c in ("mean_luma", "p98", "contrast", "dark", "saturated", "repeat_count")} | {"baseline_contrast": F.col("before"), "flat": F.lit(False), "horizon_confidence": F.lit(1.0)}
    return s.select("camera_id", "frame_index", scoring.usability(measures).alias("usability"))


def impostor_scenes(spark, d):
    """How the frames of cameras with an impostor each are judged, one after another."""
    cams = synthetic.with_impostors(synthetic.ring(spark, len(synthetic.IMPOSTORS)), synthetic.IMPOSTORS)
    seen = detection.watched(synthetic.frames(cams, None, 14, 99)).join(cams.select("camera_id", "impostor"), "camera_id")
    return seen.select("camera_id", "impostor", "frame_index", "repeat_count", "usability")


def queries() -> dict:
    own = (region_tracks, box_suppression, escalation_log, escalation_stream, nearest_stream, alert_fixes, recorded_frames, late_growth_stream, tiny_image_stats, run_records, synthetic_incident, scene_usability, impostor_scenes)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    from .catalogue import oracle_of

    return {"nearest_stream": oracle_of("nearest_frame"), "recorded_frames": _RECORDED, "late_growth_stream": _LATE, "tiny_image_stats": _TINY, "run_records": _RECORDS}
