"""Which cameras see what: neighbours, frames near a time, sites."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from . import sets

#: A working guess of the range, and what a second view must offer.
ASSUMED_RANGE_M, MIN_ANGLE_DEG, MIN_BASELINE_M, MARGIN_DEG, LIMIT = 12_000.0, 10.0, 1_500.0, -2.0, 4
CELL_DEG = 0.5


def in_cells(cameras: DataFrame) -> DataFrame:
    """Each camera once for each cell of a CELL_DEG grid that its range may touch (ci, cj; longitudes wrap around)."""
    dlat = F.degrees(F.col("range_m") / geo.EARTH_RADIUS_M) * 1.01
    dlon = dlat / F.greatest(F.cos(F.radians(F.least(F.abs("lat") + dlat, F.lit(89.0)))), F.lit(0.02))
    cell = lambda x: F.floor(x / CELL_DEG)
    wide = cameras.withColumn("ci", F.explode(F.sequence(cell(F.col("lat") - dlat), cell(F.col("lat") + dlat))))
    return wide.withColumn("cj", F.explode(F.array_distinct(F.transform(F.sequence(cell(F.col("lon") - dlon), cell(F.col("lon") + dlon)), lambda j: F.pmod(j, F.lit(int(360 / CELL_DEG)))))))


def _foremost(cameras: DataFrame, keys: list[str], order: list, limit: int | None) -> DataFrame:
    """Of each key's cameras, in that order, those that can be among the first `limit` of whichever camera asks: it leaves
    out itself and its site's, so no more than limit + 1 of a site count, nor more than that and as many again in all."""
    if limit is None:
        return cameras
    for part, n in (([*keys, "site_id"], limit + 1), (keys, 2 * limit + 2)):
        cameras = cameras.withColumn("__k", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).filter(F.col("__k") <= n).drop("__k")
    return cameras


#: What is alike for cameras of one place.
PLACE = ["lat", "lon", "range_m"]


def _by_sector(cameras: DataFrame, limit: int | None) -> DataFrame:
    """Cameras once for each sector of a degree (sector, from 0 to 359) around their place that they may cover; of those that
    cover it all (sure), the foremost. Where there are as many of these as can count, the sector is `full`."""
    centre = F.col("sector") + 0.5
    off = F.abs(geo.signed_delta(centre, F.col("azimuth"))) - (F.col("hfov") / 2.0 + MARGIN_DEG)
    c = _foremost(cameras, [*PLACE, "azimuth", "hfov"], ["camera_id"], limit)
    c = c.withColumn("sector", F.explode(F.sequence(F.lit(0), F.lit(359)))).filter(off <= 0.5 + 1e-6).withColumn("sure", off <= -0.5 - 1e-6)
    if limit is None:
        return c.withColumn("full", F.lit(False))
    c = _foremost(c.filter("sure"), [*PLACE, "sector"], ["camera_id"], limit).unionByName(c.filter("not sure"))
    return c.withColumn("full", F.count_if("sure").over(Window.partitionBy(*PLACE, "sector")) == 2 * limit + 2)


def consultable(suspects: DataFrame, cameras: DataFrame, limit: int | None = LIMIT, width: float = 1024.0) -> DataFrame:
    """For each suspect (event_id, camera_id, site_id, lat, lon, bearing), the cameras of other sites that overlook the
    point ASSUMED_RANGE_M along its bearing: the `limit` that cut the bearing most squarely, ties by the longer baseline,
    then the smaller id.

    Distinct lines of sight meet the distinct places of cameras, by an equi-join on the cell of that point, as a place decides
    how its cameras cut the line. Behind the best place that is sure to have cameras enough, none count any more; only at the
    places up to there are cameras looked at, by the sector of the point. So what is compared grows with lines and places,
    whatever the number of suspects on a line or of cameras at a place.
    """
    line = ["o_lat", "o_lon", "bearing"]
    n = int(suspects.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # in full: a row becomes many
    s = suspects.select("event_id", F.col("camera_id").alias("origin"), F.col("site_id").alias("o_site"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), "bearing")
    tlat, tlon = geo.project(F.col("o_lat"), F.col("o_lon"), F.col("bearing"), F.lit(ASSUMED_RANGE_M))
    o = s.select(*line).distinct().repartition(n, *line).withColumns({"t_lat": tlat, "t_lon": tlon})
    o = o.withColumns({"ci": F.floor(F.col("t_lat") / CELL_DEG), "cj": F.pmod(F.floor(F.col("t_lon") / CELL_DEG), F.lit(int(360 / CELL_DEG)))})
    c = cameras.filter("active").select("camera_id", "site_id", "azimuth", "hfov", *PLACE)
    pairs = o.join(in_cells(c.select(*PLACE).distinct()), ["ci", "cj"])
    places = [F.col(x) for x in ("lat", "lon", "t_lat", "t_lon")]
    baseline = geo.haversine(F.col("o_lat"), F.col("o_lon"), F.col("lat"), F.col("lon"))
    pairs = sets.once(pairs, {"baseline_m": baseline, "away_m": geo.haversine(*places), "expected": geo.bearing_between(*places)})
    pairs = pairs.filter((F.col("baseline_m") >= MIN_BASELINE_M) & (F.col("away_m") <= F.col("range_m")))
    pairs = sets.once(pairs, {"crossing": geo.fold(geo.signed_delta(F.col("expected"), F.col("bearing")))}).filter(F.col("crossing") >= MIN_ANGLE_DEG)
    square, far = F.round(F.least("crossing", F.lit(90.0)), 9), F.round("baseline_m", 6)
    pairs = pairs.select(*line, *PLACE, "baseline_m", "expected", "crossing", F.struct(square.alias("square"), far.alias("far")).alias("good"), (F.floor("expected") % 360).cast("int").alias("sector"))
    c = _by_sector(c, limit)
    pairs = pairs.join(c.select(*PLACE, "sector", "full").distinct(), [*PLACE, "sector"])
    best = F.max(F.when(F.col("full"), F.col("good"))).over(Window.partitionBy(*line))
    pairs = pairs.withColumn("best", best).filter(F.col("best").isNull() | (F.col("good") >= F.col("best"))).drop("full", "best")
    pairs = pairs.join(c.drop("sure", "full"), [*PLACE, "sector"]).filter(geo.covers(F.col("expected"), F.col("azimuth"), F.col("hfov"), MARGIN_DEG))
    order = [F.desc("good"), "camera_id"]
    pairs = _foremost(pairs, line, order, limit).join(s, line).filter("site_id != o_site and camera_id != origin")
    if limit is not None:
        pairs = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("event_id").orderBy(*order))).filter(F.col("rank") <= limit)
    else:
        pairs = pairs.withColumn("rank", F.lit(None).cast("int"))
    return pairs.select("event_id", "origin", "camera_id", "rank", "baseline_m", "expected", "crossing", geo.pixel_from_bearing(F.col("expected"), F.lit(width), F.col("azimuth"), F.col("hfov")).alias("expected_x"))


#: A key's time is dealt out in slabs of so many times the tolerance.
SLAB = 100


def nearest(probes: DataFrame, frames: DataFrame, key: str | list[str], within_s: int = 90) -> DataFrame:
    """Each probe (key, probe_id, at) with the frame (key, frame_id, ts) of its key nearest in time, at most within_s
    away; of two equally near, the earlier, then the smaller id. Probes without one, or with a null key or time, are left
    out. Other columns are ignored.

    Both tables are merged in one sort by key and time, where the last frame up to a probe and the first from it on are
    its neighbours. A key's time is dealt out in slabs, so that no key is one task's; only frames within within_s of a
    slab's edge are listed in the slab next to it too.
    """
    keys = [key] if isinstance(key, str) else list(key)
    slab = lambda t: F.floor(t / (SLAB * within_s))
    p = probes.select(*keys, slab(F.col("at")).alias("slab"), F.col("at").alias("t"), F.lit(None).cast(frames.schema["frame_id"].dataType).alias("frame_id"), "probe_id", F.lit(1).alias("asks"))
    near = F.array_distinct(F.array(*(slab(F.col("ts") + d) for d in (-within_s, 0, within_s))))
    f = frames.select(*keys, F.explode(near).alias("slab"), F.col("ts").alias("t"), "frame_id", F.lit(None).cast(probes.schema["probe_id"].dataType).alias("probe_id"), F.lit(0).alias("asks"))
    n = int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # in more, smaller tasks: each sorts its rows twice
    both = p.unionByName(f).filter("t is not null").dropna(subset=keys).repartition(4 * n, *keys, "slab")
    frame = F.when(F.col("asks") == 0, F.struct(F.col("t").alias("ts"), "frame_id"))
    order = {"before": F.col("t"), "after": F.desc("t")}
    sides = {n: F.last(frame, ignorenulls=True).over(Window.partitionBy(*keys, "slab").orderBy(o, "asks", F.desc("frame_id")).rowsBetween(Window.unboundedPreceding, 0)) for n, o in order.items()}
    met = both.withColumns(sides).filter("asks = 1")
    gap = {"before": F.col("t") - F.col("before.ts"), "after": F.col("after.ts") - F.col("t")}
    earlier = F.col("after").isNull() | (F.col("before").isNotNull() & (gap["before"] <= gap["after"]))
    met = met.withColumn("frame_id", F.when(earlier, F.col("before.frame_id")).otherwise(F.col("after.frame_id"))).withColumn("gap_s", F.when(earlier, gap["before"]).otherwise(gap["after"]))
    return met.filter(F.col("gap_s") <= within_s).select(*keys, "probe_id", "frame_id", "gap_s")


def sweep(frames: DataFrame, within_s: int = 90) -> DataFrame:
    """What every camera shows at every tick: incident, tick, camera_id, frame_id, gap_s of frames (incident, camera_id,
    frame_id, ts, tick). Ticks are the distinct ones of an incident's frames, of whatever camera; a camera's frame is the
    nearest at most within_s away, of two the earlier, then the smaller id; without one a camera has no row.

    Ticks meet the cameras that have frames in or next to their stretch of within_s, not all there are: about two in three
    find a frame, so that what is asked grows with what is found.
    """
    stretch = lambda t: F.floor(t / within_s)
    ticks = frames.select("incident", "tick").filter("tick is not null").distinct().withColumn("stretch", stretch(F.col("tick")))
    near = F.array_distinct(F.array(*(stretch(F.col("ts") + d) for d in (-within_s, 0, within_s))))
    there = frames.select("incident", "camera_id", F.explode(near).alias("stretch")).distinct()
    probes = ticks.join(there, ["incident", "stretch"]).select("incident", "camera_id", F.col("tick").alias("probe_id"), F.col("tick").alias("at"))
    return nearest(probes, frames, ["incident", "camera_id"], within_s).withColumnRenamed("probe_id", "tick").select("incident", "tick", "camera_id", "frame_id", "gap_s")


def history(rows: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The last n rows of each key."""
    w = Window.partitionBy(key).orderBy(*(F.desc(c) for c in order))
    return rows.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def before(rows: DataFrame, order: str, when, n: int | None = None) -> DataFrame:
    """Rows that lie before `when`, or the last n of them."""
    earlier = rows.filter(F.col(order) < F.lit(when))
    return earlier if n is None else earlier.orderBy(F.desc(order)).limit(n)


def one(rows: DataFrame, key: str, value) -> DataFrame:
    """The rows of a key's value; KeyError, naming it, where there are none."""
    found = rows.filter(F.col(key) == F.lit(value))
    if found.isEmpty():
        raise KeyError(f"no {key} {value!r}")
    return found


def bounds(cameras: DataFrame) -> DataFrame:
    """Zeros without cameras."""
    return cameras.agg(*(F.coalesce(f(c), F.lit(0.0)).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in ("lat", "lon")))
