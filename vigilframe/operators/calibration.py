"""Calibrations of cameras from their own clear frames.

Evidence is long: (camera_id, sequence, event_id, cell, confidence), one row per clear frame and covered cell.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import HABITUAL, TRUST_FRAMES

FLOOR = 0.25


def pool(evidence: DataFrame, trust: int = TRUST_FRAMES) -> DataFrame:
    """Cameras with at least `trust` clear frames: clear_frames, p50 and p95 of confidences, sorted sources."""
    out = evidence.groupBy("camera_id").agg(F.count("*").alias("clear_frames"), F.percentile("confidence", F.lit(0.5)).alias("p50"), F.percentile("confidence", F.lit(0.95)).alias("p95"), F.array_sort(F.collect_set("sequence")).alias("sources"))
    return out.filter(F.col("clear_frames") >= trust)


def nuisance(evidence: DataFrame, trust: int = TRUST_FRAMES) -> DataFrame:
    """(camera_id, cell, share): the share of a trusted camera's clear frames with a strong candidate in the cell."""
    frames = evidence.groupBy("camera_id").agg(F.count("*").alias("frames")).filter(F.col("frames") >= trust)
    cells = evidence.filter(F.col("confidence") >= FLOOR).groupBy("camera_id", "cell").agg(F.count("*").alias("n"))
    return cells.join(frames, "camera_id").select("camera_id", "cell", F.least(F.col("n") / F.col("frames"), F.lit(1.0)).alias("share"))


#: Values are dealt out in so many bands of [0, 1], so that no camera's are one task's; ranks are looked up in blocks of so many.
BANDS, BLOCK = 1000, 64


def _below(counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """counts (keys, confidence, n) with `below`: how many of a key's values are smaller. Bands are summed first, then the
    values within each."""
    banded = counts.withColumn("band", F.floor(F.col("confidence") * BANDS))
    whole = banded.groupBy(*keys, "band").agg(F.sum(n).alias("in_band"))
    earlier = F.sum("in_band").over(Window.partitionBy(*keys).orderBy("band").rowsBetween(Window.unboundedPreceding, -1))
    inside = F.sum(n).over(Window.partitionBy(*keys, "band").orderBy("confidence").rowsBetween(Window.unboundedPreceding, -1))
    zero = F.lit(0).cast("long")
    return banded.withColumn("inside", F.coalesce(inside, zero)).join(whole.select(*keys, "band", F.coalesce(earlier, zero).alias("earlier")), [*keys, "band"]).withColumn("below", F.col("earlier") + F.col("inside")).drop("band", "inside", "earlier")


def held_out(evidence: DataFrame, trust: int = TRUST_FRAMES) -> DataFrame:
    """For each sequence, its camera's calibration from the camera's other sequences.

    Frame counts are the camera's less the sequence's own. The k-th of the other sequences' values is found by rank: in the
    order of all the camera's values it comes behind as many of the sequence's own as have fewer than k of the others up to
    them; so a sequence meets its own values only, and looks up the camera's value of that rank. Null confidences count as
    frames but not in percentiles.
    """
    totals = evidence.groupBy("camera_id").agg(F.count("*").alias("all"), F.count("confidence").alias("all_values"))
    own = evidence.groupBy("camera_id", "sequence").agg(F.count("*").alias("own"), F.count("confidence").alias("own_values"))
    enough = own.join(totals, "camera_id").select("camera_id", "sequence", (F.col("all") - F.col("own")).alias("clear_frames"), (F.col("all_values") - F.col("own_values")).alias("values")).filter(F.col("clear_frames") >= trust)
    told = evidence.filter("confidence is not null")
    counts = _below(told.groupBy("camera_id", "confidence").agg(F.count("*").alias("n")), ["camera_id"], "n")
    mine = _below(told.groupBy("camera_id", "sequence", "confidence").agg(F.count("*").alias("m")), ["camera_id", "sequence"], "m").withColumnRenamed("below", "own_below")
    met = mine.join(counts, ["camera_id", "confidence"])
    upto = F.col("below") - F.col("own_below") + F.col("n") - F.col("m")  # of the others, up to and with this value
    met = met.select("camera_id", "sequence", "m", upto.alias("upto"))
    at = {p: F.lit(p) * (F.col("values") - 1) for p in (0.5, 0.95)}
    wanted = F.array(*(F.struct(F.lit(p).alias("p"), k.alias("k"), w.alias("w")) for p, x in at.items() for k, w in ((F.floor(x) + 1, F.floor(x) + 1 - x), (F.floor(x) + 2, x - F.floor(x)))))
    asked = enough.filter("values > 0").select("camera_id", "sequence", F.explode(wanted).alias("q")).select("camera_id", "sequence", "q.*").filter("w > 0")
    own_before = F.sum(F.when(F.col("upto") < F.col("k"), F.col("m")).otherwise(0))
    ranked = asked.join(met, ["camera_id", "sequence"]).groupBy("camera_id", "sequence", "p", "k", "w").agg((F.col("k") + own_before).alias("rank"))
    ranked = ranked.unionByName(asked.join(met, ["camera_id", "sequence"], "left_anti").withColumn("rank", F.col("k")))
    ranked = ranked.withColumn("block", F.floor((F.col("rank") - 1) / BLOCK))
    blocks = F.explode(F.sequence(F.floor(F.col("below") / BLOCK), F.floor((F.col("below") + F.col("n") - 1) / BLOCK)))
    listed = counts.select("camera_id", "confidence", "n", "below", blocks.alias("block"))
    found = ranked.join(listed, ["camera_id", "block"]).filter((F.col("rank") > F.col("below")) & (F.col("rank") <= F.col("below") + F.col("n")))
    each = found.groupBy("camera_id", "sequence").agg(*(F.sum(F.when(F.col("p") == p, F.col("w") * F.col("confidence"))).alias(n) for p, n in ((0.5, "p50"), (0.95, "p95"))))
    return enough.select("camera_id", "sequence", "clear_frames").join(each, ["camera_id", "sequence"], "left")


def habituation(regions: DataFrame, nuisance: DataFrame) -> DataFrame:
    """(region_id, habituation, habitual): the coverage-weighted mean of the nuisance under a region, given as rows
    (region_id, camera_id, cell, coverage)."""
    r = regions.join(nuisance, ["camera_id", "cell"], "left")
    h = F.sum(F.col("coverage") * F.coalesce("share", F.lit(0.0))) / F.greatest(F.sum("coverage"), F.lit(1e-6))
    return r.groupBy("region_id").agg(h.alias("habituation")).withColumn("habitual", F.col("habituation") >= HABITUAL)


def inject(tracks: DataFrame, pooled: DataFrame, habituation: DataFrame, key: str) -> DataFrame:
    """tracks (key, camera_id, …) with what the rules ask of a calibration: clear_frames and ceiling of their camera, and
    their own habituation. A camera without a calibration has seen nothing, so no rule trusts it."""
    cams = pooled.select("camera_id", "clear_frames", F.col("p95").alias("ceiling"))
    own = habituation.select(key, "habituation")
    return tracks.join(cams, "camera_id", "left").join(own, key, "left").na.fill({"clear_frames": 0, "ceiling": 0.0, "habituation": 0.0})


def summary(pooled: DataFrame, nuisance: DataFrame) -> DataFrame:
    busy = nuisance.filter(F.col("share") >= HABITUAL).select("camera_id").distinct().withColumn("busy", F.lit(True))
    j = pooled.join(busy, "camera_id", "left")
    return j.agg(F.count("*").alias("cameras"), F.median("p95").alias("median_p95"), F.median("clear_frames").alias("median_frames"), F.count_if(F.coalesce("busy", F.lit(False))).alias("with_habitual_cells"))
