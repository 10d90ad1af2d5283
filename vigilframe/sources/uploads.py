"""What someone uploads, opened: which stills are analysed and when they were taken, and a report of every assumption that
took, or the reason why there is nothing to analyse. Reports are rows, for any number of uploads at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, scoring, sentences
from .archives import LEAST_STILLS

#: When footage without times begins, seconds between stills where nothing is said, the bounds of what may be
#: said, and suffixes of video.
START, STILLS_INTERVAL = "2026-01-01 12:00:00", 60.0
BOUNDS = {"bearing_deg": (0.0, 360.0), "hfov_deg": (1.0, 180.0), "interval_s": (0.01, 86400.0)}
VIDEO = (".mp4", ".mov", ".avi", ".mkv", ".webm", ".m4v")
#: Fixed wording of a report's notes.
NOTES = {
    "names": "Every still carried a time in its filename, so those times were used.",
    "interval": " s a frame was assumed. Growth is measured per minute, so a wrong interval changes the scores.",
    "aim": "No camera bearing was given, so positions are reported as a place across the frame, not a compass bearing.",
    "place": "The camera's position is not known, so no second view can be consulted and no location is reported.",
}


def _general(x: Column) -> Column:
    """A number as people write it: 60, 0.5."""
    return F.regexp_replace(x.cast("decimal(12,2)").cast("string"), r"\.?0+$", "")


def _number(name: str) -> tuple[Column, Column]:
    """(number, refusal) of what a caller said; nothing or an empty text is no number and no error."""
    low, high = BOUNDS[name]
    said = F.when(F.trim(name) != "", F.trim(name))
    number = said.try_cast("double")
    fits = number.between(low, high) & ~F.isnan(number)
    refusal = F.when(said.isNotNull() & number.isNull(), f"{name.upper()}_NOT_A_NUMBER").when(said.isNotNull() & ~fits, f"{name.upper()}_OUT_OF_RANGE")
    return F.when(fits, number), refusal


def asked(uploads: DataFrame) -> DataFrame:
    """uploads (archive, and the texts bearing_deg, hfov_deg, interval_s that came with it, each of which may be null) with
    these as numbers, assumed (no interval was given), aim_known, and refusal: a number that isn't one or is out of range, one
    still, a video (there is no decoder here), or what is no upload at all."""
    read = {c: _number(c) for c in BOUNDS}
    kind = names.suffix(F.col("archive"))
    what = F.when(kind.isin(*VIDEO), "NO_VIDEO_DECODER").when(kind.isin(*names.IMAGES), "ONE_STILL").when(kind != ".zip", "NOT_AN_UPLOAD")
    u = uploads.select("archive", *(v.alias(f"{c}_given") for c, (v, _) in read.items()), F.coalesce(*(r for _, r in read.values()), what).alias("refusal"))
    return u.select(
        "archive", F.pmod(F.coalesce("bearing_deg_given", F.lit(0.0)), F.lit(360.0)).alias("azimuth"), F.coalesce("hfov_deg_given", F.lit(60.0)).alias("hfov"),
        F.coalesce("interval_s_given", F.lit(STILLS_INTERVAL)).alias("interval_s"), F.col("interval_s_given").isNull().alias("assumed"),
        F.col("bearing_deg_given").isNotNull().alias("aim_known"), "refusal",
    )


def opened(files: DataFrame, uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(frames, reports) of uploads, as `asked` takes them, and the members of their archives, (archive, path) and, where
    known, decodable.

    Times in names count, and order the stills, if all of an upload's stills have one and no two the same; else stills go by
    path, from START on. frames (archive, frame_index, raw_index, path, ts) are those that the sampling plan takes. A report
    has kind, total_frames, analysed_frames, stride, interval_s, interval_assumed, spacing_s (with times in names the upper
    median of the steps between frames), capped, timestamps, aim_known, coverage and notes, or refusal and else nulls:
    what `asked` refused, NO_STILLS, TOO_FEW_FRAMES, or UNDECODABLE where the first frame is known to be. An upload of
    several rows with one name is an error of the caller's. An upload's stills are ordered in one task, as one file held
    them; their contents aren't needed and stay where they are.
    """
    fine = F.coalesce(F.col("decodable"), F.lit(True)) if "decodable" in files.columns else F.lit(True)
    inside = ~F.col("path").contains("__MACOSX") & ~F.element_at(F.split("path", "/"), -1).startswith(".")
    stills = files.filter(names.is_image(F.col("path")) & inside).select("archive", "path", fine.alias("fine"), names.epoch(F.col("path")).alias("own"))
    counts = stills.groupBy("archive").agg(F.count("*").alias("total"), F.count("own").alias("timed"), F.count_distinct("own").alias("times"))
    told = asked(uploads).join(counts, "archive", "left").withColumn("total", F.coalesce("total", F.lit(0)))
    stride, wanted = scoring.sampling_plan(F.col("total"), F.col("interval_s"))
    told = told.withColumns({"named": (F.col("total") > 0) & (F.col("timed") == F.col("total")) & (F.col("times") == F.col("total")), "stride": stride, "wanted": wanted})
    told = told.withColumn("refusal", F.coalesce("refusal", F.when(F.col("total") == 0, "NO_STILLS"), F.when(F.col("wanted") < LEAST_STILLS, "TOO_FEW_FRAMES")))

    own = stills.join(told.filter("refusal is null").select("archive", "interval_s", "named", "stride", "wanted"), "archive")
    order = Window.partitionBy("archive").orderBy(F.when(F.col("named"), F.col("own")), "path")
    taken = own.withColumn("raw_index", (F.row_number().over(order) - 1).cast("long")).filter((F.col("raw_index") % F.col("stride") == 0) & (F.col("raw_index") < F.col("stride") * F.col("wanted")))
    start = F.unix_seconds(F.timestamp_seconds(F.unix_timestamp(F.lit(START + " UTC"), "yyyy-MM-dd HH:mm:ss z")))
    at = F.when(F.col("named"), F.col("own").cast("double")).otherwise(start + F.col("raw_index") * F.col("interval_s"))
    taken = taken.withColumns({"frame_index": F.floor(F.col("raw_index") / F.col("stride")).cast("long"), "at": at})

    steps = Window.partitionBy("archive").orderBy("frame_index")
    stepped = taken.withColumn("gap", F.col("at") - F.lag("at").over(steps))
    gaps = F.array_sort(F.collect_list("gap"))  # of the frames analysed, 240 at most
    first = stepped.groupBy("archive").agg(F.bool_and(F.when(F.col("frame_index") == 0, F.col("fine"))).alias("first_fine"), F.get(gaps, F.floor(F.size(gaps) / 2).cast("int")).alias("between"))
    r = told.join(first, "archive", "left").withColumn("refusal", F.coalesce("refusal", F.when(~F.col("first_fine"), "UNDECODABLE")))

    ok = F.col("refusal").isNull()
    capped, guessed = F.ceil(F.col("total") / F.col("stride")) > F.col("wanted"), F.col("assumed") & ~F.col("named")
    coverage = sentences.coverage(F.col("wanted"), F.col("total"), F.col("stride"))
    cut = F.concat(F.lit("The footage was too long to read whole at a usable spacing, so it was cut after "), F.col("wanted").cast("string"), F.lit(" analysed frames ("), coverage, F.lit("); the rest was not read."))
    notes = F.array(
        F.when(F.col("named"), NOTES["names"]),
        F.when(guessed, F.concat(F.lit("No capture interval was given, so "), _general(F.col("interval_s")), F.lit(NOTES["interval"]))),
        F.when(~F.col("aim_known"), NOTES["aim"]), F.lit(NOTES["place"]), F.when(capped, cut),
    )
    spacing = F.when(F.col("named") & F.col("between").isNotNull(), F.col("between")).otherwise(F.col("stride") * F.col("interval_s"))
    out = {
        "kind": F.lit("stills"), "total_frames": F.col("total"), "analysed_frames": F.col("wanted"), "stride": F.col("stride"), "interval_s": F.col("interval_s"), "interval_assumed": guessed,
        "spacing_s": F.bround(F.round(spacing, 9), 2), "capped": capped, "timestamps": F.when(F.col("named"), "filenames").otherwise("interval"), "aim_known": F.col("aim_known"), "coverage": coverage,
        "notes": F.filter(notes, lambda x: x.isNotNull()),
    }
    reports = r.select("archive", *(F.when(ok, v).alias(k) for k, v in out.items()), "refusal")
    good = r.filter("refusal is null").select("archive")
    frames = taken.join(good, "archive", "left_semi").select("archive", "frame_index", "raw_index", "path", F.timestamp_micros(F.round(F.col("at") * 1_000_000).cast("long")).alias("ts"))
    return frames, reports
