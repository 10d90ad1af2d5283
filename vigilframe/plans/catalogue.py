"""All registered queries with the SQL they are held against.

Each entry pairs a query with SQL text; SQL is None where it can't express the operator (order-dependent state).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, names, scoring, wire
from ..operators import calibration, evaluation, fixes, network, sets, tracks
from ..sources import fixtures
from . import macros as m

_entries: dict[str, tuple] = {}


def entry(sql: str | None):
    def add(f):
        _entries[f.__name__] = (f, sql)
        return f

    return add


def _rounded(df: DataFrame, **places: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def _suspects(spark: SparkSession, d: str) -> DataFrame:
    return fixtures.readings(spark, d).filter((F.col("confidence") >= scoring.SUSPECT_AT) & F.col("active"))


# --- cameras and geometry ---------------------------------------------------------------------------------------------


@entry(f"WITH {m.CAMERA} SELECT site_id, count(*) AS cameras, count(*) FILTER (WHERE imager = 'color') AS colour, string_agg(CAST(camera_id AS VARCHAR), ',' ORDER BY camera_id) AS ids FROM camera WHERE active GROUP BY site_id")
def network_active_by_site(spark, d):
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("camera_id")), lambda x: x.cast("string")), ",")
    return fixtures.cameras(spark, d).filter("active").groupBy("site_id").agg(F.count("*").alias("cameras"), F.count_if(F.col("imager") == "color").alias("colour"), ids.alias("ids"))


@entry(f"WITH {m.CAMERA} SELECT coalesce(min(lat), 0.0) AS min_lat, coalesce(min(lon), 0.0) AS min_lon, coalesce(max(lat), 0.0) AS max_lat, coalesce(max(lon), 0.0) AS max_lon FROM camera")
def network_bounds(spark, d):
    return network.bounds(fixtures.cameras(spark, d))


@entry(f"WITH {m.READING} SELECT event_id, round(bearing, 6) AS bearing FROM reading")
def bearing_from_pixel(spark, d):
    return _rounded(fixtures.readings(spark, d).select("event_id", "bearing"), bearing=6)


@entry(f"WITH {m.READING} SELECT event_id, round({m.pixel('CAST(event_id % 360 AS DOUBLE)', '1024.0', 'azimuth', 'hfov')}, 6) AS x FROM reading")
def pixel_from_bearing(spark, d):
    x = geo.pixel_from_bearing((F.col("event_id") % 360).cast("double"), F.lit(1024.0), F.col("azimuth"), F.col("hfov"))
    return fixtures.readings(spark, d).select("event_id", F.round(x, 6).alias("x"))


_tgt = (m.north("33.3", "lat"), m.east("33.3", "-116.85", "lat", "lon"))
_step = ("(cos(radians(azimuth)) * 5000.0)", "(sin(radians(azimuth)) * 5000.0)")


@entry(f"""WITH {m.CAMERA} SELECT camera_id, round({m.haversine('lat', 'lon', '33.3', '-116.85')}, 3) AS range_m, round({m.between('lat', 'lon', '33.3', '-116.85')}, 6) AS bearing, round({_tgt[1]}, 3) AS east_m, round({_tgt[0]}, 3) AS north_m,
 round({m.lat_of(_step[0], 'lat')}, 8) AS p_lat, round({m.lon_of(_step[1], _step[0], 'lat', 'lon')}, 8) AS p_lon, round((lon + 116.85) * sin(radians(lat)), 8) AS convergence, round({m.delta(m.between('lat', 'lon', '33.3', '-116.85'), 'azimuth')}, 6) AS off_axis, abs({m.delta(m.between('lat', 'lon', '33.3', '-116.85'), 'azimuth')}) <= hfov / 2.0 AS covers FROM camera""")
def geodesy_suite(spark, d):
    c = [F.col("lat"), F.col("lon")]
    fire = [F.lit(33.3), F.lit(-116.85)]
    e, n = geo.enu(*fire, *c)
    plat, plon = geo.project(*c, F.col("azimuth"), F.lit(5000.0))
    b = geo.bearing_between(*c, *fire)
    out = fixtures.cameras(spark, d).select("camera_id", geo.haversine(*c, *fire).alias("range_m"), b.alias("bearing"), e.alias("east_m"), n.alias("north_m"), plat.alias("p_lat"), plon.alias("p_lon"), geo.convergence(*c, F.lit(-116.85)).alias("convergence"), geo.signed_delta(b, F.col("azimuth")).alias("off_axis"), geo.covers(b, F.col("azimuth"), F.col("hfov")).alias("covers"))
    return _rounded(out, range_m=3, bearing=6, east_m=3, north_m=3, p_lat=8, p_lon=8, convergence=8, off_axis=6)


@entry(f"WITH {m.CAMERA} SELECT camera_id, round({m.pixel(m.between('lat', 'lon', '33.3', '-116.85'), '1024.0', 'azimuth', 'hfov')}, 5) AS x, round({m.haversine('lat', 'lon', '33.3', '-116.85')}, 3) AS range_m FROM camera")
def place_fire(spark, d):
    c, fire = [F.col("lat"), F.col("lon")], [F.lit(33.3), F.lit(-116.85)]
    x = geo.pixel_from_bearing(geo.bearing_between(*c, *fire), F.lit(1024.0), F.col("azimuth"), F.col("hfov"))
    return fixtures.cameras(spark, d).select("camera_id", F.round(x, 5).alias("x"), F.round(geo.haversine(*c, *fire), 3).alias("range_m"))


@entry(f"WITH {m.CAMERA}, steps AS (SELECT * FROM range(0, 5) t(i)), p AS (SELECT camera_id, i, cos(radians(azimuth)) * i * 2500.0 AS n, sin(radians(azimuth)) * i * 2500.0 AS e, lat, lon FROM camera, steps) SELECT camera_id, i AS step, round({m.lat_of('n', 'lat')}, 8) AS lat, round({m.lon_of('e', 'n', 'lat', 'lon')}, 8) AS lon FROM p")
def sight_arcs(spark, d):
    c = fixtures.cameras(spark, d).select("camera_id", F.posexplode(geo.arc(F.col("lat"), F.col("lon"), F.col("azimuth"), 10_000.0, 5)).alias("step", "p"))
    return c.select("camera_id", F.col("step").cast("long").alias("step"), F.round("p.lat", 8).alias("lat"), F.round("p.lon", 8).alias("lon"))


@entry(f"WITH {m.CAMERA}, a AS (SELECT camera_id, azimuth, hfov, (azimuth % 360.0) / 45.0 AS q FROM camera) SELECT camera_id, list_element(['north', 'north-east', 'east', 'south-east', 'south', 'south-west', 'west', 'north-west'], CAST(round_even(q, 0) AS INT) % 8 + 1) AS cardinal, round(sqrt(pow(0.25 * 40 * hfov / 1024.0, 2) + 0.25), 8) AS sigma FROM a")
def camera_facing(spark, d):
    return fixtures.cameras(spark, d).select("camera_id", geo.cardinal(F.col("azimuth")).alias("cardinal"), F.round(geo.bearing_sigma(F.lit(40.0), F.lit(1024.0), F.col("hfov")), 8).alias("sigma"))


_decl = "radians(-23.44 * cos(radians(360.0 / 365.0 * (day + 10.0))))"
_ang = "radians(15.0 * (hour + lon / 15.0 - 12.0))"


@entry(f"WITH {m.CAMERA}, s AS (SELECT camera_id, lat, lon, CAST(camera_id * 7 % 24 AS DOUBLE) AS hour, CAST(camera_id * 11 % 365 AS DOUBLE) AS day FROM camera) SELECT camera_id, CASE WHEN sin(radians(lat)) * sin({_decl}) + cos(radians(lat)) * cos({_decl}) * cos({_ang}) <= 0 THEN -1.0 ELSE round({m.norm(f'degrees(atan2(-sin({_ang}), tan({_decl}) * cos(radians(lat)) - sin(radians(lat)) * cos({_ang})))')}, 5) END AS sun FROM s")
def sun_positions(spark, d):
    k = F.col("camera_id")
    return fixtures.cameras(spark, d).select("camera_id", F.round(geo.sun_azimuth((k * 7 % 24).cast("double"), (k * 11 % 365).cast("double"), F.col("lat"), F.col("lon")), 5).alias("sun"))


_CONSULT = f"""WITH {m.READING}, suspect AS (SELECT *, {m.lat_of('(cos(radians(bearing)) * 12000.0)', 'lat')} AS t_lat, {m.lon_of('(sin(radians(bearing)) * 12000.0)', '(cos(radians(bearing)) * 12000.0)', 'lat', 'lon')} AS t_lon FROM reading WHERE confidence >= 0.45 AND active),
 pairs AS (SELECT s.event_id, s.camera_id AS origin, c.camera_id, c.azimuth, c.hfov, s.bearing, {m.haversine('s.lat', 's.lon', 'c.lat', 'c.lon')} AS baseline_m, {m.between('c.lat', 'c.lon', 's.t_lat', 's.t_lon')} AS expected, {m.haversine('c.lat', 'c.lon', 's.t_lat', 's.t_lon')} AS to_target
  FROM suspect s JOIN camera c ON c.active AND c.site_id <> s.site_id AND c.camera_id <> s.camera_id),
 good AS (SELECT *, {m.fold(m.delta('expected', 'bearing'))} AS crossing FROM pairs WHERE baseline_m >= 1500 AND abs({m.delta('expected', 'azimuth')}) <= hfov / 2.0 - 2.0 AND to_target <= 40000.0),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY round(least(crossing, 90.0), 9) DESC, round(baseline_m, 6) DESC, camera_id) AS rank FROM good WHERE crossing >= 10)
 SELECT event_id, origin, camera_id, rank, round(baseline_m, 3) AS baseline_m, round(expected, 6) AS expected, round(crossing, 6) AS crossing, round({m.pixel('expected', '1024.0', 'azimuth', 'hfov')}, 4) AS expected_x FROM ranked WHERE rank <= 4"""


@entry(_CONSULT)
def consultable_topk(spark, d):
    """For every suspect reading, the four cameras of other sites that cut its bearing best."""
    return _rounded(network.consultable(_suspects(spark, d), fixtures.cameras(spark, d)), baseline_m=3, expected=6, crossing=6, expected_x=4)


@entry(f"""WITH {m.READING}, p AS (SELECT sequence, event_id AS probe_id, epoch_s AS at_s FROM reading WHERE event_type = 'error'), f AS (SELECT sequence, event_id AS frame_id, epoch_s AS ts FROM reading WHERE event_type <> 'error'),
 j AS (SELECT p.sequence, probe_id, frame_id, abs(ts - at_s) AS gap_s, row_number() OVER (PARTITION BY probe_id ORDER BY abs(ts - at_s), ts, frame_id) AS k FROM p JOIN f ON p.sequence = f.sequence AND abs(ts - at_s) <= 3600) SELECT sequence, probe_id, frame_id, gap_s FROM j WHERE k = 1""")
def nearest_frame(spark, d):
    r = fixtures.readings(spark, d)
    probes = r.filter("event_type = 'error'").select("sequence", F.col("event_id").alias("probe_id"), F.col("epoch_s").alias("at"))
    frames = r.filter("event_type != 'error'").select("sequence", F.col("event_id").alias("frame_id"), F.col("epoch_s").alias("ts"))
    return network.nearest(probes, frames, "sequence", 3600)


@entry(f"""WITH {m.READING},
 f AS (SELECT date AS incident, camera_id, event_id AS frame_id, epoch_s AS ts, epoch_s - epoch_s % 60 AS tick FROM reading WHERE active),
 t AS (SELECT DISTINCT incident, tick FROM f),
 j AS (SELECT incident, t.tick, camera_id, frame_id, abs(ts - t.tick) AS gap_s,
   row_number() OVER (PARTITION BY incident, t.tick, camera_id ORDER BY abs(ts - t.tick), ts, frame_id) AS k
   FROM t JOIN f USING (incident) WHERE abs(ts - t.tick) <= 90)
 SELECT incident, tick, camera_id, frame_id, gap_s FROM j WHERE k = 1""")
def tick_sweep(spark, d):
    """What each active camera shows at each tick of an incident's timeline."""
    r = fixtures.readings(spark, d).filter("active")
    s = F.col("epoch_s")
    return network.sweep(r.select(F.col("date").alias("incident"), "camera_id", F.col("event_id").alias("frame_id"), s.alias("ts"), (s - s % 60).alias("tick")))


@entry(f"WITH {m.READING} SELECT camera_id, event_id, back FROM (SELECT camera_id, event_id, row_number() OVER (PARTITION BY camera_id ORDER BY epoch_s DESC, event_id DESC) AS back FROM reading WHERE epoch_s < 1705000000) WHERE back <= 6")
def history_last_n(spark, d):
    return network.history(fixtures.readings(spark, d).filter("epoch_s < 1705000000").select("camera_id", "event_id", "epoch_s"), "camera_id", ["epoch_s", "event_id"], 6).drop("epoch_s")


@entry(f"WITH {m.READING} SELECT DISTINCT epoch_s - epoch_s % 60 AS tick FROM reading")
def timeline_distinct(spark, d):
    return fixtures.readings(spark, d).select((F.col("epoch_s") - F.col("epoch_s") % 60).alias("tick")).distinct()


@entry(f"WITH {m.READING} SELECT camera_id, median(gap) AS interval_s FROM (SELECT camera_id, epoch_s - lag(epoch_s) OVER (PARTITION BY camera_id ORDER BY epoch_s, event_id) AS gap FROM reading) GROUP BY camera_id")
def sampling_gap(spark, d):
    gap = F.col("epoch_s") - F.lag("epoch_s").over(Window.partitionBy("camera_id").orderBy("epoch_s", "event_id"))
    return fixtures.readings(spark, d).withColumn("gap", gap).groupBy("camera_id").agg(F.median("gap").alias("interval_s"))


@entry("""WITH c AS (SELECT o_orderkey AS clip, o_orderkey % 3000 AS total, 1.0::DOUBLE + o_custkey % 90 AS every FROM orders), a AS (SELECT *, greatest(1, CAST(round_even(60.0 / every, 0) AS BIGINT)) AS s0 FROM c),
 b AS (SELECT *, CASE WHEN total >= 40 THEN greatest(1, least(s0, total // 40)) ELSE 1 END AS s1 FROM a), e AS (SELECT *, CASE WHEN ceil(total / s1::DOUBLE) > 240 THEN greatest(s1, least(CAST(ceil(total / 240.0) AS BIGINT), greatest(1, CAST(floor(240.0 / every) AS BIGINT)))) ELSE s1 END AS s2 FROM b)
 SELECT clip, CASE WHEN total > 0 THEN s2 ELSE 1 END AS stride, CASE WHEN total > 0 THEN least(CAST(ceil(total / s2::DOUBLE) AS BIGINT), 240) ELSE 0 END AS analysed FROM e""")
def sampling_plan(spark, d):
    o = fixtures.table(spark, d, "orders").select(F.col("o_orderkey").alias("clip"), (F.col("o_orderkey") % 3000).alias("total"), (1.0 + F.col("o_custkey") % 90).alias("every"))
    stride, analysed = scoring.sampling_plan(F.col("total"), F.col("every"))
    return o.select("clip", stride.alias("stride"), analysed.alias("analysed"))


@entry(f"""WITH {m.CAMERA}, b AS (SELECT camera_id, cx AS x, cy AS y, w, h FROM (SELECT s_suppkey AS camera_id, CAST(s_suppkey * 13 % 90 AS DOUBLE) AS cx, CAST(s_suppkey * 29 % 90 AS DOUBLE) AS cy, CAST(20 + s_suppkey % 30 AS DOUBLE) AS w, CAST(20 + s_suppkey % 17 AS DOUBLE) AS h, s_nationkey FROM supplier)),
 p AS (SELECT a.camera_id AS a, c.camera_id AS b, greatest(0.0, least(a.x + a.w, c.x + c.w) - greatest(a.x, c.x)) * greatest(0.0, least(a.y + a.h, c.y + c.h) - greatest(a.y, c.y)) AS inter, a.w * a.h + c.w * c.h AS total FROM b a JOIN b c ON a.camera_id < c.camera_id JOIN supplier s ON s.s_suppkey = a.camera_id JOIN supplier t ON t.s_suppkey = c.camera_id AND t.s_nationkey = s.s_nationkey)
 SELECT a, b, round(inter / (total - inter), 9) AS iou FROM p""")
def iou_pairs(spark, d):
    k = F.col("s_suppkey")
    b = fixtures.table(spark, d, "supplier").select(k.alias("id"), F.col("s_nationkey").alias("site"), (k * 13 % 90).cast("double").alias("x"), (k * 29 % 90).cast("double").alias("y"), (20 + k % 30).cast("double").alias("w"), (20 + k % 17).cast("double").alias("h"))
    p, q = (b.select("site", *(F.col(c).alias(f"{t}_{c}") for c in ("id", "x", "y", "w", "h"))) for t in "pq")
    box = lambda t: tuple(F.col(f"{t}_{c}") for c in ("x", "y", "w", "h"))
    return p.join(q, "site").filter("p_id < q_id").select(F.col("p_id").alias("a"), F.col("q_id").alias("b"), F.round(geo.iou(box("p"), box("q")), 9).alias("iou"))


@entry("SELECT s_suppkey AS id, round(sqrt(abs(((1.0 + k / 50) * w - u * g) / (w * w) * ((1.1 * w - v * h) / (w * w)) - (0.1 * w - u * h) / (w * w) * ((0.05 * w - v * g) / (w * w)))), 9) AS scale, round(abs((1.0 + k / 50) * 1.1 - 0.005) * 0.5, 9) AS area FROM (SELECT s_suppkey, k, g, h, (1.0 + k / 50) * x + 0.1 * y + 3 AS u, 0.05 * x + 1.1 * y + 4 AS v, g * x + h * y + 1 AS w FROM (SELECT s_suppkey, CAST(s_suppkey % 50 AS DOUBLE) AS k, 0.0001::DOUBLE AS g, 0.0002::DOUBLE AS h, CAST(s_suppkey % 100 AS DOUBLE) AS x, CAST(s_suppkey % 77 AS DOUBLE) AS y FROM supplier))")
def homography_scale(spark, d):
    k = (F.col("s_suppkey") % 50).cast("double")
    a = 1.0 + k / 50
    h = [a, *map(F.lit, (0.1, 3.0, 0.05, 1.1, 4.0, 0.0001, 0.0002, 1.0))]
    zero = F.lit(0.0)
    area = geo.quad_area([zero, a, F.lit(0.1)], [zero, F.lit(0.05), F.lit(1.1)])
    return fixtures.table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.round(geo.local_scale(h, (F.col("s_suppkey") % 100).cast("double"), (F.col("s_suppkey") % 77).cast("double")), 9).alias("scale"), F.round(area, 9).alias("area"))


# --- crossing bearings ------------------------------------------------------------------------------------------------

_aimed = m.norm(f"{m.between('lat', 'lon', '33.2', '-116.8')} + (camera_id % 5 - 2) * 0.5")
_RAYS = f"""{m.READING}, ray AS (SELECT sequence % 60 AS event, camera_id, lat, lon, range_m, CASE WHEN sequence % 2 = 0 THEN {_aimed} ELSE bearing END AS bearing, 1.0 + camera_id % 3 AS sigma FROM (SELECT *, row_number() OVER (PARTITION BY sequence % 60, camera_id ORDER BY event_id) AS k FROM reading) WHERE k = 1)"""


def _rays(spark, d):
    """A ray per camera and event; those of even events aim about the same place."""
    first = Window.partitionBy("event", "camera_id").orderBy("event_id")
    aimed = geo.normalise(geo.bearing_between(F.col("lat"), F.col("lon"), F.lit(33.2), F.lit(-116.8)) + (F.col("camera_id") % 5 - 2) * 0.5)
    r = fixtures.readings(spark, d).withColumn("event", F.col("sequence") % 60).withColumn("k", F.row_number().over(first)).filter("k = 1")
    return r.select("event", "camera_id", "lat", "lon", "range_m", F.when(F.col("sequence") % 2 == 0, aimed).otherwise(F.col("bearing")).alias("bearing"), (1.0 + F.col("camera_id") % 3).alias("sigma"))


@entry(f"""WITH {_RAYS}, ref AS (SELECT event, count(*) AS n, avg(lat) AS rlat, avg(lon) AS rlon FROM ray GROUP BY event), ang AS (SELECT a.event, min({m.fold(m.delta('a.bearing', 'b.bearing'))}) AS crossing FROM ray a JOIN ray b ON a.event = b.event AND a.camera_id < b.camera_id GROUP BY a.event),
 g AS (SELECT r.*, n, rlat, rlon, {m.east('lat', 'lon', 'rlat', 'rlon')} AS ox, {m.north('lat', 'rlat')} AS oy, radians(bearing - (lon - rlon) * sin(radians(lat))) AS th, 1.0 / greatest(sigma, 0.05) AS wt FROM ray r JOIN ref USING (event)),
 s AS (SELECT event, sum(wt * cos(th) * cos(th)) AS a, sum(-wt * cos(th) * sin(th)) AS b, sum(wt * sin(th) * sin(th)) AS d, sum(wt * cos(th) * (cos(th) * ox - sin(th) * oy)) AS p, sum(-wt * sin(th) * (cos(th) * ox - sin(th) * oy)) AS q FROM g GROUP BY event),
 x AS (SELECT event, a * d - b * b AS det, (p * d - b * q) / (a * d - b * b) AS e, (a * q - p * b) / (a * d - b * b) AS nn FROM s),
 t AS (SELECT g.*, x.det, x.e, x.nn, (e - ox) * sin(th) + (nn - oy) * cos(th) AS along, (e - ox) * cos(th) - (nn - oy) * sin(th) AS off FROM g JOIN x USING (event)),
 o AS (SELECT event, any_value(n) AS n, any_value(rlat) AS rlat, any_value(rlon) AS rlon, any_value(det) AS det, any_value(e) AS e, any_value(nn) AS nn, arg_min(CASE WHEN along <= 0 THEN 'BEHIND_CAMERA' ELSE 'BEYOND_RANGE' END, camera_id) FILTER (WHERE along <= 0 OR along > range_m) AS bad, sqrt(avg(off * off)) AS res, min(tan(radians(sigma)) * along) AS smin, max(tan(radians(sigma)) * along) AS smax FROM t GROUP BY event),
 f AS (SELECT o.*, crossing, CASE WHEN n < 2 THEN 'TOO_FEW_RAYS' WHEN crossing < 8 THEN 'RAYS_TOO_PARALLEL' WHEN abs(det) < 1e-9 THEN 'SINGULAR' ELSE bad END AS refusal FROM o LEFT JOIN ang USING (event))
 SELECT event, n AS n_rays, refusal, CASE WHEN refusal IS NULL THEN round({m.lat_of('nn', 'rlat')}, 7) END AS lat, CASE WHEN refusal IS NULL THEN round({m.lon_of('e', 'nn', 'rlat', 'rlon')}, 7) END AS lon, CASE WHEN refusal IS NULL THEN round(res, 2) END AS residual_m, CASE WHEN refusal IS NULL THEN round(smin, 2) END AS semi_minor_m, CASE WHEN refusal IS NULL THEN round(smax / greatest(sin(radians(crossing)), 1e-3), 2) END AS semi_major_m, CASE WHEN refusal IS NULL THEN round(crossing, 6) END AS crossing_deg FROM f""")
def cross_rays(spark, d):
    return _rounded(fixes.cross(_rays(spark, d), "event"), lat=7, lon=7, residual_m=2, semi_minor_m=2, semi_major_m=2, crossing_deg=6)


_pp = m.pair("a", "b")


@entry(f"WITH {_RAYS} SELECT a.event, a.camera_id AS a, b.camera_id AS b, round({_pp['lat']}, 7) AS lat, round({_pp['lon']}, 7) AS lon FROM ray a JOIN ray b ON a.event = b.event AND a.camera_id < b.camera_id WHERE {_pp['ok']}")
def pair_fixes(spark, d):
    met = fixes.crossings(_rays(spark, d), "event", "camera_id", [], [])
    return met.select("event", F.col("a_camera_id").alias("a"), F.col("b_camera_id").alias("b"), F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@entry(f"""WITH {_RAYS}, z AS (SELECT a.event, a.camera_id AS a, b.camera_id AS b, a.sigma AS sa, b.sigma AS sb, (a.lat + b.lat) / 2.0 AS rlat, (a.lon + b.lon) / 2.0 AS rlon, a.lat AS alat, a.lon AS alon, b.lat AS blat, b.lon AS blon, a.bearing AS ab, b.bearing AS bb FROM ray a JOIN ray b ON a.event = b.event AND a.camera_id < b.camera_id),
 y AS (SELECT *, {m.east('alat', 'alon', 'rlat', 'rlon')} AS px, {m.north('alat', 'rlat')} AS py, {m.east('blat', 'blon', 'rlat', 'rlon')} AS qx, {m.north('blat', 'rlat')} AS qy, sin(radians(ab - (alon - rlon) * sin(radians(alat)))) AS ux, cos(radians(ab - (alon - rlon) * sin(radians(alat)))) AS uy, sin(radians(bb - (blon - rlon) * sin(radians(blat)))) AS vx, cos(radians(bb - (blon - rlon) * sin(radians(blat)))) AS vy FROM z),
 x AS (SELECT *, ux * vx + uy * vy AS uv, ux * (px - qx) + uy * (py - qy) AS uw, vx * (px - qx) + vy * (py - qy) AS vw, ux * ux + uy * uy AS uu, vx * vx + vy * vy AS vv FROM y), w AS (SELECT *, uu * vv - uv * uv AS den FROM x),
 v AS (SELECT *, CASE WHEN abs(den) < 1e-9 THEN 0.0 ELSE greatest(0.0, (uv * vw - vv * uw) / den) END AS s, CASE WHEN abs(den) < 1e-9 THEN 0.0 ELSE greatest(0.0, (uu * vw - uv * uw) / den) END AS t FROM w),
 u AS (SELECT event, a, b, sqrt(pow(px + ux * s - qx - vx * t, 2) + pow(py + uy * s - qy - vy * t, 2)) AS dist, tan(radians(sa)) * s + tan(radians(sb)) * t AS corridor FROM v), k AS (SELECT *, row_number() OVER (PARTITION BY event ORDER BY round(dist, 6), a, b) AS r FROM u)
 SELECT event, a, b, round(dist, 2) AS distance_m, round(corridor, 2) AS corridor_m, dist <= corridor AS consistent FROM k WHERE r = 1""")
def nearest_approach_closest_pair(spark, d):
    return _rounded(fixes.closest(_rays(spark, d), "event", "camera_id"), distance_m=2, corridor_m=2)


@entry(f"WITH {m.READING} SELECT sequence, round(1 - (1 - max(confidence)) * coalesce(exp(sum(ln(1 - 0.7 * confidence)) FILTER (WHERE k > 1)), 1.0), 9) AS joint FROM (SELECT *, row_number() OVER (PARTITION BY sequence ORDER BY confidence DESC, event_id) AS k FROM reading) GROUP BY sequence")
def noisy_or_confidence(spark, d):
    """The best reading of a sequence, supported by all its others."""
    k = F.row_number().over(Window.partitionBy("sequence").orderBy(F.desc("confidence"), "event_id"))
    r = fixtures.readings(spark, d).select("sequence", "event_id", "confidence").withColumn("k", k)
    others = F.product(F.when(F.col("k") > 1, 1 - scoring.SUPPORTER_SHARE * F.col("confidence")))
    return r.groupBy("sequence").agg(F.round(1 - (1 - F.max("confidence")) * F.coalesce(others, F.lit(1.0)), 9).alias("joint"))


# --- evaluation -------------------------------------------------------------------------------------------------------

_SCORES = f"""score AS (SELECT sequence, camera_id, count(*) AS frames, count(*) FILTER (WHERE offset_s >= 0) AS positive_frames, count(*) FILTER (WHERE offset_s < 0) AS negative_frames, count(*) FILTER (WHERE offset_s >= 0 AND confidence >= 0.45) > 0 AS detected, min(offset_s) FILTER (WHERE offset_s >= 0 AND confidence >= 0.45) AS first_alert_s, max(confidence) AS peak, coalesce(max(confidence) FILTER (WHERE offset_s < 0), 0.0) AS peak_negative, count(*) FILTER (WHERE offset_s < 0 AND confidence >= 0.45) AS false_positive_frames, {m.CLEAR} AS negative_minutes, arg_min(bearing, offset_s * 1000000000 + event_id) FILTER (WHERE offset_s >= 0 AND confidence >= 0.45) AS bearing FROM reading GROUP BY sequence, camera_id)"""


def _scores(spark, d):
    return evaluation.sequence_scores(fixtures.readings(spark, d))


@entry(f"WITH {m.READING}, {_SCORES} SELECT * REPLACE (round(negative_minutes, 6) AS negative_minutes, round(bearing, 6) AS bearing, round(peak, 9) AS peak, round(peak_negative, 9) AS peak_negative) FROM score")
def sequence_scores(spark, d):
    return _rounded(_scores(spark, d), negative_minutes=6, bearing=6, peak=9, peak_negative=9)


@entry(f"WITH {m.READING}, {m.SWEEP} SELECT sequence, threshold, round(arg_min(bearing, offset_s * 1000000000 + event_id), 6) AS bearing FROM reading JOIN sweep ON confidence >= threshold WHERE offset_s >= 0 GROUP BY sequence, threshold")
def first_bearings(spark, d):
    return _rounded(evaluation.first_bearings(fixtures.readings(spark, d)), bearing=6)


@entry(f"""WITH {m.READING}, {_SCORES} SELECT count(*) AS sequences, CAST(sum(frames) AS BIGINT) AS frames, count(*) FILTER (WHERE detected) AS detected, count(*) FILTER (WHERE NOT detected) AS missed, round(coalesce(avg(CASE WHEN detected THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE positive_frames > 0), 0.0), 6) AS detection_rate, median(first_alert_s) AS median_s, round(avg(first_alert_s), 6) AS mean_s,
 round(quantile_cont(first_alert_s, 0.1), 6) AS p10_s, round(quantile_cont(first_alert_s, 0.9), 6) AS p90_s, min(first_alert_s) AS min_s, max(first_alert_s) AS max_s, CAST(sum(false_positive_frames) AS BIGINT) AS false_frames, CAST(sum(negative_frames) AS BIGINT) AS clear_frames, round(sum(negative_minutes) / 60.0, 6) AS clear_hours, round(sum(false_positive_frames) / (sum(negative_minutes) / 1440.0), 6) AS per_camera_day FROM score""")
def evaluation_summary(spark, d):
    return _rounded(evaluation.summary(_scores(spark, d)), detection_rate=6, mean_s=6, p10_s=6, p90_s=6, clear_hours=6, per_camera_day=6)


@entry(f"""WITH {m.READING}, {m.SWEEP}, each AS (SELECT sequence, threshold, count(*) FILTER (WHERE offset_s >= 0) > 0 AS fire, min(offset_s) FILTER (WHERE offset_s >= 0 AND confidence >= threshold) AS alert_s, count(*) FILTER (WHERE offset_s < 0 AND confidence >= threshold) AS ff, {m.CLEAR} AS minutes FROM reading, sweep GROUP BY sequence, threshold)
 SELECT threshold, count(*) FILTER (WHERE fire) AS fires, count(alert_s) AS detected, round(count(alert_s) / (count(*) FILTER (WHERE fire))::DOUBLE, 6) AS detection_rate, median(alert_s) AS median_alert_s, CAST(sum(ff) AS BIGINT) AS false_frames, round(sum(ff) / (sum(minutes) / 1440.0), 6) AS per_camera_day FROM each GROUP BY threshold""")
def operating_curve(spark, d):
    return _rounded(evaluation.operating_curve(fixtures.readings(spark, d)), detection_rate=6, per_camera_day=6)


@entry(f"""WITH {m.READING}, {m.SWEEP}, own AS (SELECT * FROM reading WHERE date IN (SELECT date FROM reading GROUP BY date HAVING count(DISTINCT site_id) >= 2)), level AS (SELECT a.event_id, max(b.confidence) AS level FROM own a JOIN own b ON a.date = b.date AND a.site_id <> b.site_id AND a.sequence <> b.sequence AND abs(a.offset_s - b.offset_s) <= 120 WHERE a.confidence >= 0.25 AND b.confidence >= 0.25 AND {_pp['ok']} GROUP BY a.event_id),
 j AS (SELECT own.*, level FROM own LEFT JOIN level USING (event_id)), each AS (SELECT sequence, threshold, count(*) FILTER (WHERE offset_s >= 0) > 0 AS fire, count(*) FILTER (WHERE offset_s >= 0 AND confidence >= threshold) > 0 AS alone, count(*) FILTER (WHERE offset_s >= 0 AND confidence >= threshold AND level >= threshold) > 0 AS agreed, count(*) FILTER (WHERE offset_s < 0 AND confidence >= threshold) AS af, count(*) FILTER (WHERE offset_s < 0 AND confidence >= threshold AND level >= threshold) AS bf, count(*) FILTER (WHERE offset_s < 0) AS clear, {m.CLEAR} AS minutes FROM j, sweep GROUP BY sequence, threshold)
 SELECT threshold, count(*) FILTER (WHERE fire) AS fires, count(*) FILTER (WHERE alone) AS alone_detected, count(*) FILTER (WHERE agreed) AS both_detected, CAST(sum(af) AS BIGINT) AS alone_false_frames, CAST(sum(bf) AS BIGINT) AS both_false_frames, round(sum(af) / (sum(minutes) / 1440.0), 6) AS alone_per_day, round(sum(bf) / (sum(minutes) / 1440.0), 6) AS both_per_day, CAST(sum(clear) AS BIGINT) AS clear_frames FROM each GROUP BY threshold""")
def corroboration_curve(spark, d):
    return _rounded(evaluation.corroboration_curve(fixtures.readings(spark, d)), alone_per_day=6, both_per_day=6)


_CONSIST = f"""{m.READING}, {_SCORES}, r AS (SELECT s.sequence % 20 AS date, s.sequence, c.site_id, c.lat, c.lon, c.range_m, s.bearing FROM score s JOIN camera c USING (camera_id) WHERE s.bearing IS NOT NULL AND NOT (c.lat = 0 AND c.lon = 0)), p AS (SELECT a.date, {_pp['lat']} AS lat, {_pp['lon']} AS lon FROM r a JOIN r b ON a.date = b.date AND a.sequence < b.sequence AND a.site_id <> b.site_id WHERE {_pp['ok']}),
 c AS (SELECT date, avg(lat) AS clat, avg(lon) AS clon, count(*) AS n FROM p GROUP BY date), k AS (SELECT date, any_value(n) AS pairs, CASE WHEN any_value(n) >= 2 THEN avg({m.haversine('lat', 'lon', 'clat', 'clon')}) END AS spread_m FROM p JOIN c USING (date) GROUP BY date)"""


def _consistent(spark, d):
    scores = _scores(spark, d).withColumn("date", F.col("sequence") % 20).select("sequence", "date", "camera_id", "bearing")
    return evaluation.consistency(scores, fixtures.cameras(spark, d))


@entry(f"WITH {_CONSIST} SELECT date, pairs, round(spread_m, 2) AS spread_m FROM k")
def cross_camera_consistency(spark, d):
    return _rounded(_consistent(spark, d), spread_m=2)


@entry(f"WITH {_CONSIST} SELECT count(*) AS dates, count(spread_m) AS with_spread, round(median(spread_m), 2) AS median_spread_m FROM k")
def cross_camera_summary(spark, d):
    return _rounded(evaluation.consistency_summary(_consistent(spark, d)), median_spread_m=2)


@entry(f"""WITH {m.READING}, {_SCORES}, v AS (SELECT * FROM (VALUES ('map', 0.05), ('ceiling', 0.1), ('map+ceiling', 0.2)) t(variant, cut)), after AS (SELECT v.variant, s.sequence, s.peak - v.cut >= 0.8 AND s.detected AS detected, s.false_positive_frames - CAST(floor(s.false_positive_frames * v.cut * 2) AS BIGINT) AS ff, s.detected AS bd, s.false_positive_frames AS bf, s.negative_minutes AS mins FROM score s, v),
 r AS (SELECT variant, count(*) AS sequences, count(*) FILTER (WHERE bd) - count(*) FILTER (WHERE detected) AS lost, sum(bf) / (sum(mins) / 1440.0) AS b, sum(ff) / (sum(mins) / 1440.0) AS a FROM after GROUP BY variant) SELECT variant, sequences, lost, round(b, 6) AS before_per_day, round(a, 6) AS after_per_day, lost <= 2 AS eligible, row_number() OVER (ORDER BY lost <= 2 DESC, round(a, 1), variant) = 1 AS chosen FROM r""")
def variant_choice(spark, d):
    before = _scores(spark, d)
    v = spark.createDataFrame([("map", 0.05), ("ceiling", 0.1), ("map+ceiling", 0.2)], "variant string, cut double")
    after = before.crossJoin(F.broadcast(v)).select("variant", "sequence", ((F.col("peak") - F.col("cut") >= 0.8) & F.col("detected")).alias("detected"), (F.col("false_positive_frames") - F.floor(F.col("false_positive_frames") * F.col("cut") * 2)).alias("false_positive_frames"))
    return _rounded(evaluation.choose_variant(before, after), before_per_day=6, after_per_day=6)


@entry(f"WITH {m.READING} SELECT camera_id, event_id, epoch_s, round(confidence, 9) AS confidence, rank FROM (SELECT *, row_number() OVER (PARTITION BY camera_id ORDER BY event_type = 'error' DESC, confidence DESC, epoch_s, event_id) AS rank FROM reading WHERE confidence >= 0.45) WHERE rank <= 3")
def flag_queue_ranked(spark, d):
    w = Window.partitionBy("camera_id").orderBy(F.desc(F.col("event_type") == "error"), F.desc("confidence"), "epoch_s", "event_id")
    return fixtures.readings(spark, d).filter(F.col("confidence") >= scoring.SUSPECT_AT).withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("camera_id", "event_id", "epoch_s", F.round("confidence", 9).alias("confidence"), "rank")


@entry(f"WITH {m.READING} SELECT event_type AS code, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM reading GROUP BY event_type")
def rejection_counts(spark, d):
    return fixtures.readings(spark, d).groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("total"))


# --- calibration ------------------------------------------------------------------------------------------------------


@entry(f"WITH {m.EVIDENCE} SELECT camera_id, count(*) AS clear_frames, round(quantile_cont(confidence, 0.5), 9) AS p50, round(quantile_cont(confidence, 0.95), 9) AS p95, list_sort(list(DISTINCT sequence)) AS sources FROM evidence GROUP BY camera_id HAVING count(*) >= 25")
def calibration_pool(spark, d):
    return _rounded(calibration.pool(fixtures.evidence(spark, d)), p50=9, p95=9)


_NUIS = "n AS (SELECT camera_id, cell, least(count(*) FILTER (WHERE confidence >= 0.25) / any_value(frames)::DOUBLE, 1.0) AS share FROM evidence JOIN (SELECT camera_id, count(*) AS frames FROM evidence GROUP BY camera_id HAVING count(*) >= 25) USING (camera_id) GROUP BY camera_id, cell HAVING count(*) FILTER (WHERE confidence >= 0.25) > 0)"


@entry(f"WITH {m.EVIDENCE}, {_NUIS} SELECT camera_id, cell, round(share, 9) AS share FROM n")
def nuisance_map(spark, d):
    return _rounded(calibration.nuisance(fixtures.evidence(spark, d)), share=9)


@entry(f"WITH {m.EVIDENCE}, s AS (SELECT DISTINCT camera_id, sequence FROM evidence), o AS (SELECT s.camera_id, s.sequence, e.confidence FROM s JOIN evidence e ON e.camera_id = s.camera_id AND e.sequence <> s.sequence) SELECT camera_id, sequence, count(*) AS clear_frames, round(quantile_cont(confidence, 0.5), 9) AS p50, round(quantile_cont(confidence, 0.95), 9) AS p95 FROM o GROUP BY camera_id, sequence HAVING count(*) >= 25")
def calibration_holdout(spark, d):
    return _rounded(calibration.held_out(fixtures.evidence(spark, d)), p50=9, p95=9)


@entry(f"WITH {m.EVIDENCE}, {_NUIS}, g AS (SELECT event_id AS region_id, camera_id, (event_id * 7 + 7 * k) % 768 AS cell, 1.0::DOUBLE / (1 + k) AS coverage FROM reading, range(0, 4) t(k) WHERE offset_s >= 0) SELECT region_id, round(sum(coverage * coalesce(share, 0.0)) / greatest(sum(coverage), 1e-6), 9) AS habituation, sum(coverage * coalesce(share, 0.0)) / greatest(sum(coverage), 1e-6) >= 0.35 AS habitual FROM g LEFT JOIN n USING (camera_id, cell) GROUP BY region_id")
def habituation(spark, d):
    r = fixtures.readings(spark, d).filter("offset_s >= 0").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    r = r.select(F.col("event_id").alias("region_id"), "camera_id", ((F.col("event_id") * 7 + 7 * F.col("k")) % 768).alias("cell"), (1.0 / (1 + F.col("k"))).alias("coverage"))
    return _rounded(calibration.habituation(r, calibration.nuisance(fixtures.evidence(spark, d))), habituation=9)


@entry(f"WITH {m.EVIDENCE}, {_NUIS}, p AS (SELECT camera_id, count(*) AS f, quantile_cont(confidence, 0.95) AS p95 FROM evidence GROUP BY camera_id HAVING count(*) >= 25) SELECT count(*) AS cameras, round(median(p95), 9) AS median_p95, median(f) AS median_frames, count(*) FILTER (WHERE camera_id IN (SELECT camera_id FROM n WHERE share >= 0.35)) AS with_habitual_cells FROM p")
def calibration_summary(spark, d):
    e = fixtures.evidence(spark, d)
    return _rounded(calibration.summary(calibration.pool(e), calibration.nuisance(e)), median_p95=9)


# --- tracks and scoring -----------------------------------------------------------------------------------------------

_GROW = f"""{m.OBSERVATION}, a AS (SELECT *, count(*) OVER t AS n, row_number() OVER s AS rn, lag(area) OVER s AS la, lag(base_cx) OVER s AS lx, lag(base_cy) OVER s AS ly FROM observation WINDOW t AS (PARTITION BY track_id), s AS (PARTITION BY track_id ORDER BY frame_index)), b AS (SELECT *, greatest(1, n // 3) AS th FROM a),
 c AS (SELECT track_id, count(*) AS frames, arg_max(minute, rn) - arg_min(minute, rn) AS span_min, arg_min(area, rn) AS area_first, arg_max(area, rn) AS area_last, CASE WHEN count(*) * var_pop(minute) < 1e-9 THEN 0.0 ELSE coalesce(regr_slope(area, minute), 0) END AS area_slope, -CASE WHEN count(*) * var_pop(minute) < 1e-9 THEN 0.0 ELSE coalesce(regr_slope(top_y, minute), 0) END AS top_rise, abs(CASE WHEN count(*) * var_pop(minute) < 1e-9 THEN 0.0 ELSE coalesce(regr_slope(cx, minute), 0) END) AS horizontal_drift, CASE WHEN count(*) * var_pop(minute) < 1e-9 THEN 0.0 ELSE coalesce(regr_slope(w, minute), 0) END AS width_growth,
 median(minute) FILTER (WHERE rn > n - th) - median(minute) FILTER (WHERE rn <= th) AS el, max(minute) - min(minute) AS whole, sqrt(pow(median(base_cx) FILTER (WHERE rn > n - th) - median(base_cx) FILTER (WHERE rn <= th), 2) + pow(median(base_cy) FILTER (WHERE rn > n - th) - median(base_cy) FILTER (WHERE rn <= th), 2)) AS bm, sqrt(pow(median(cx) FILTER (WHERE rn > n - th) - median(cx) FILTER (WHERE rn <= th), 2) + pow(median(cy) FILTER (WHERE rn > n - th) - median(cy) FILTER (WHERE rn <= th), 2)) AS cm,
 coalesce(avg(CASE WHEN area - la >= -0.02 * la THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE la IS NOT NULL), 1.0) AS monotonic, CASE WHEN count(*) >= 3 THEN median(sqrt(pow(base_cx - lx, 2) + pow(base_cy - ly, 2))) ELSE 0.0 END AS jitter FROM b GROUP BY track_id),
 e AS (SELECT *, CASE WHEN el <= 1e-6 THEN whole ELSE el END AS t FROM c), f AS (SELECT *, CASE WHEN frames >= 2 AND t > 1e-6 THEN bm / t ELSE 0.0 END AS base_drift, CASE WHEN frames >= 2 AND t > 1e-6 THEN cm / t ELSE 0.0 END AS centroid_drift FROM e),
 growth AS (SELECT *, CASE WHEN frames < 2 THEN 1.0 ELSE area_last / greatest(area_first, 1.0) END AS area_ratio, CASE WHEN greatest(top_rise, 0.0) + base_drift > 1e-6 THEN greatest(top_rise, 0.0) / (greatest(top_rise, 0.0) + base_drift) ELSE 0.0 END AS anchor FROM f)"""
_GROWN = ("span_min", "area_slope", "top_rise", "base_drift", "centroid_drift", "horizontal_drift", "width_growth", "monotonic", "jitter", "area_ratio", "anchor")


@entry(f"WITH {_GROW} SELECT track_id, frames, area_first, area_last, {', '.join(f'round({c}, 6) AS {c}' for c in _GROWN)} FROM growth")
def track_growth(spark, d):
    g = tracks.growth(fixtures.observations(spark, d))
    return _rounded(g.select("track_id", "frames", "area_first", "area_last", *_GROWN), **dict.fromkeys(_GROWN, 6))


_SO_FAR = f"""{m.OBSERVATION.replace('observation AS', 'base AS', 1)}, observation AS (SELECT a.track_id * 100 + a.frame_index AS track_id, b.* EXCLUDE (track_id) FROM base a JOIN base b ON a.track_id = b.track_id AND b.frame_index <= a.frame_index){_GROW[len(m.OBSERVATION):]}"""


@entry(f"WITH {_SO_FAR} SELECT track_id // 100 AS track_id, track_id % 100 AS frame_index, frames, area_first, area_last, {', '.join(f'round({c}, 6) AS {c}' for c in _GROWN)} FROM growth")
def growth_as_of_frame(spark, d):
    g = tracks.growth_so_far(fixtures.observations(spark, d))
    return _rounded(g.select("track_id", "frame_index", "frames", "area_first", "area_last", *_GROWN), **dict.fromkeys(_GROWN, 6))


_REGION = "region AS (SELECT g.*, track_id % 3 <> 0 AS has_colour, (track_id * 7 % 100) / 60.0::DOUBLE AS texture_ratio, CAST(track_id * 11 % 80 - 40 AS DOUBLE) AS base_below, (track_id * 13 % 100) / 100.0::DOUBLE AS edge_softness, (track_id * 17 % 100) / 80.0::DOUBLE AS saturation_ratio, (track_id * 19 % 100) / 100.0::DOUBLE AS greyness, CAST(track_id * 23 % 256 AS DOUBLE) AS mean_luma, (track_id * 29 % 100) / 100.0::DOUBLE AS blown, CAST(3 + track_id * 31 % 30 AS DOUBLE) AS h, CAST(3 + track_id * 37 % 90 AS DOUBLE) AS w, CAST(track_id * 41 % 60 AS BIGINT) AS clear_frames, track_id % 2 = 0 AS use_nuisance, (track_id * 43 % 100) / 100.0::DOUBLE AS habituation, track_id % 5 = 0 AS use_ceiling, (track_id * 47 % 100) / 100.0::DOUBLE AS ceiling, 0.05::DOUBLE AS slack, track_id % 4 = 0 AS corrected, CAST(track_id % 7 AS DOUBLE) AS shift, (track_id * 53 % 120) / 100.0::DOUBLE AS contrast_ratio FROM growth g)"


def _regions(spark, d):
    k = F.col("track_id")
    part = lambda mul, mod, div: (k * mul % mod) / float(div)
    whole = lambda x: x.cast("double")
    g = tracks.growth(fixtures.observations(spark, d))
    return g.withColumns({"has_colour": k % 3 != 0, "texture_ratio": part(7, 100, 60), "base_below": whole(k * 11 % 80 - 40), "edge_softness": part(13, 100, 100), "saturation_ratio": part(17, 100, 80), "greyness": part(19, 100, 100), "mean_luma": whole(k * 23 % 256), "blown": part(29, 100, 100), "h": whole(3 + k * 31 % 30), "w": whole(3 + k * 37 % 90), "clear_frames": k * 41 % 60, "use_nuisance": k % 2 == 0, "habituation": part(43, 100, 100), "use_ceiling": k % 5 == 0, "ceiling": part(47, 100, 100), "slack": F.lit(0.05), "corrected": k % 4 == 0, "shift": whole(k % 7), "contrast_ratio": part(53, 120, 100)})


class _Columns(dict):
    def __missing__(self, name):
        return F.col(name)


_HEIGHT = 683.0
_clip = lambda x: f"least(greatest({x}, 0.0), 1.0)"
_TERMS = {"growth": f"{_clip('(area_ratio - 1.0) / 2.0')} * (0.4 + 0.6 * monotonic)", "rise": _clip("top_rise / (0.03 * 683.0)"), "anchored": "anchor", "veiling": _clip("1.0 - texture_ratio"), "attachment": _clip("1.0 - abs(base_below) / (0.12 * 683.0)"), "soft_edges": "edge_softness", "desaturation": _clip("(1.0 - saturation_ratio) * 1.6"), "persistence": _clip("(frames - 1) / 5.0")}
_SUPPORT = ", terms AS (SELECT *, " + ", ".join(f"{v} AS t_{k}" for k, v in _TERMS.items()) + " FROM region), scored AS (SELECT *, CASE WHEN has_colour THEN (" + " + ".join(f"t_{k} * {w}" for k, w in scoring.WEIGHTS.items()) + ") / 1.0 ELSE (" + " + ".join(f"t_{k} * {w}" for k, w in scoring.WEIGHTS.items() if k != "desaturation") + ") / 0.92 END AS support FROM terms)"


@entry(f"WITH {_GROW}, {_REGION}{_SUPPORT} SELECT track_id, " + ", ".join(f"round(t_{k}, 6) AS {k}" for k in _TERMS) + ", round(support, 6) AS support FROM scored")
def evidence_terms(spark, d):
    c = _Columns()
    terms = scoring.evidence(c, c, F.lit(_HEIGHT))
    return _regions(spark, d).select("track_id", *(F.round(v, 6).alias(k) for k, v in terms.items()), F.round(scoring.support(terms, F.col("has_colour")), 6).alias("support"))


_RULES = [
    ("TOO_BRIEF", "frames < 3", "0.4"),
    ("HABITUAL_REGION", "clear_frames >= 25 AND use_nuisance AND habituation >= 0.35", "least(0.92, 0.45 + 0.6 * (habituation - 0.35))"),
    ("BELOW_CAMERA_BASELINE", "NOT (clear_frames >= 25 AND use_nuisance AND habituation >= 0.35) AND clear_frames >= 25 AND use_ceiling AND ceiling > 0 AND round(support, 9) <= round(ceiling - slack, 9)", "0.7"),
    ("FLARE", "mean_luma > 238 AND blown > 0.25", "0.9"),
    ("STATIC_ARTEFACT", "frames >= 4 AND round(centroid_drift, 9) < 0.6 AND area_ratio >= 0.85 AND area_ratio <= 1.18 AND round(jitter, 9) < 1.5 AND edge_softness < 0.25", "0.8"),
    ("RIDGE_REGISTRATION", "h <= 14 AND abs(base_below) <= 14 AND w > 3 * h AND NOT corrected AND shift > 3", "0.75"),
    ("WEATHER_FRONT", "contrast_ratio < 0.55 AND texture_ratio > 0.75 * contrast_ratio", "0.8"),
    ("AIRBORNE", "base_below < -0.05 * 683.0 AND round(top_rise, 9) < 3", "0.75"),
    ("CLOUD_TRANSLATION", "frames >= 3 AND round(anchor, 9) < 0.28 AND round(centroid_drift, 9) > 6 AND area_ratio >= 0.55 AND area_ratio <= 1.8", "CASE WHEN base_below < -0.05 * 683.0 THEN 0.85 ELSE 0.7 END"),
    ("ERRATIC_BASE", "frames >= 3 AND round(base_drift, 9) > 12 AND round(anchor, 9) < 0.55", "0.8"),
    ("GROUND_DRIFT", "has_colour AND frames >= 3 AND round(top_rise, 9) < 2 AND round(horizontal_drift, 9) > 5 AND base_below > 0 AND greyness < 0.42", "0.7"),
]
_FIRED = ", fired AS (" + " UNION ALL ".join(f"SELECT track_id, {i} AS i, '{c}' AS code, CAST({v} AS DOUBLE) AS conf FROM scored WHERE {w}" for i, (c, w, v) in enumerate(_RULES)) + ")"


@entry(f"WITH {_GROW}, {_REGION}{_SUPPORT}{_FIRED} SELECT s.track_id, coalesce(string_agg(code, ',' ORDER BY conf DESC, i), '') AS codes, count(code) AS n, CAST(round_even(CAST(round(any_value(support) * coalesce(exp(sum(ln(1 - 0.9 * conf))), 1.0), 9) AS DECIMAL(30, 9)), 6) AS DOUBLE) AS confidence FROM scored s LEFT JOIN fired f USING (track_id) GROUP BY s.track_id")
def rejections_all(spark, d):
    c = _Columns()
    s = scoring.support(scoring.evidence(c, c, F.lit(_HEIGHT)), F.col("has_colour"))
    r = _regions(spark, d).withColumn("support", s)
    r = r.withColumn("fired", scoring.rejections(c, c, c, F.col("support"), F.lit(_HEIGHT), F.col("has_colour")))
    return r.select("track_id", F.array_join(F.transform("fired", lambda x: x["code"]), ",").alias("codes"), F.size("fired").cast("long").alias("n"), wire.even(scoring.confidence(F.col("support"), F.col("fired")), 6).alias("confidence"))


@entry(f"WITH {m.READING} SELECT event_id, CASE WHEN confidence >= 0.68 THEN 'column' WHEN confidence >= 0.45 THEN 'suspect' ELSE 'clear' END AS verdict, CASE WHEN confidence >= 0.62 THEN 'supports' WHEN confidence <= 0.28 THEN 'contradicts' ELSE 'silent' END AS learned FROM reading")
def verdicts(spark, d):
    return fixtures.readings(spark, d).select("event_id", scoring.verdict(F.col("confidence")).alias("verdict"), scoring.confirmer(F.col("confidence")).alias("learned"))


@entry(f"WITH {m.READING} SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'no_frame' WHEN event_id % 7 = 0 THEN 'blind' WHEN abs({m.delta('bearing', 'azimuth')}) <= 6 AND confidence >= 0.45 AND event_id % 6 >= 3 THEN 'supported' WHEN abs({m.delta('bearing', 'azimuth')}) > 6 AND confidence >= 0.45 AND event_id % 6 >= 3 THEN 'off_bearing' ELSE 'silent' END AS answer FROM reading")
def consultation_answers(spark, d):
    k = F.col("event_id")
    return fixtures.readings(spark, d).select("event_id", scoring.answer(k % 11 != 0, k % 7 == 0, geo.signed_delta(F.col("bearing"), F.col("azimuth")), F.col("confidence"), k % 6).alias("answer"))


_SCENE = "scene AS (SELECT event_id, user_id AS camera_id, event_id % 5 AS repeat_count, CAST(event_id * 3 % 256 AS DOUBLE) AS mean_luma, CAST(event_id * 5 % 256 AS DOUBLE) AS p98, (event_id * 7 % 100) / 100.0::DOUBLE AS saturated, CAST(event_id * 11 % 1000 AS DOUBLE) AS contrast, CAST(event_id * 13 % 256 AS DOUBLE) AS dark, event_id % 3 = 0 AS flat, (event_id * 17 % 100) / 100.0::DOUBLE AS horizon_confidence, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST(event_id * 19 % 1000 AS DOUBLE) END AS baseline_contrast FROM events)"


def _scenes(spark, d):
    k = F.col("event_id")
    num = lambda a, b: (k * a % b).cast("double")
    return fixtures.table(spark, d, "events").select("event_id", F.col("user_id").alias("camera_id"), (k % 5).alias("repeat_count"), num(3, 256).alias("mean_luma"), num(5, 256).alias("p98"), (num(7, 100) / 100).alias("saturated"), num(11, 1000).alias("contrast"), num(13, 256).alias("dark"), (k % 3 == 0).alias("flat"), (num(17, 100) / 100).alias("horizon_confidence"), F.when(k % 4 != 0, num(19, 1000)).alias("baseline_contrast"))


_FOG = "(CASE WHEN baseline_contrast IS NOT NULL AND baseline_contrast <> 0 THEN contrast < 0.25 * baseline_contrast ELSE contrast < 300 END)"
_HAZE = "(CASE WHEN baseline_contrast IS NOT NULL AND baseline_contrast <> 0 THEN contrast < 0.55 * baseline_contrast ELSE contrast < 450 END)"
_STATE = f"CASE WHEN repeat_count >= 2 THEN 'frozen' WHEN mean_luma < 42 AND p98 < 110 THEN 'night' WHEN saturated > 0.2 AND mean_luma > 150 THEN 'glare' WHEN {_FOG} AND dark > 140 THEN 'fog' WHEN flat AND {_HAZE} THEN 'lens_obscured' WHEN {_HAZE} OR horizon_confidence < 0.25 THEN 'degraded' ELSE 'usable' END"


@entry(f"WITH {_SCENE}, u AS (SELECT event_id, {_STATE} AS usability FROM scene) SELECT event_id, usability, CASE WHEN usability NOT IN ('usable', 'degraded') THEN 'CAMERA_' || upper(usability) END AS rejected FROM u")
def usability_ladder(spark, d):
    s = _scenes(spark, d).withColumn("usability", scoring.usability(_Columns()))
    return s.select("event_id", "usability", scoring.blind_rejection(F.col("usability"))["code"].alias("rejected"))


@entry(f"WITH {_SCENE}, r AS (SELECT event_id, camera_id, contrast, list(contrast) OVER (PARTITION BY camera_id ORDER BY event_id ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING) AS b, list(contrast) OVER (PARTITION BY camera_id ORDER BY event_id ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS o FROM scene) SELECT event_id, CASE WHEN len(b) >= 4 THEN list_median(b) END AS before, CASE WHEN len(o) >= 4 THEN list_median(o) END AS with_own FROM r")
def contrast_baseline(spark, d):
    return tracks.trailing_median(_scenes(spark, d).select("event_id", "camera_id", "contrast"), "camera_id", "event_id", "contrast").select("event_id", "before", "with_own")


@entry("WITH f AS (SELECT event_id, user_id, (event_id * 31 % 10) / 10.0::DOUBLE AS mad, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events), g AS (SELECT *, sum(CASE WHEN rn > 1 AND mad < 0.5 THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM f) SELECT event_id, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) - 1 AS repeat_count FROM g")
def frozen_runs(spark, d):
    e = fixtures.table(spark, d, "events").select("event_id", "user_id", ((F.col("event_id") * 31 % 10) / 10.0).alias("mad"))
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = e.withColumn("mad", F.when(first > 1, F.col("mad")))
    return tracks.frozen_runs(e, "user_id", "event_id", "mad", 0.5).select("event_id", F.col("repeat_count").cast("long").alias("repeat_count"))


@entry("SELECT event_id, camera, rank FROM (SELECT event_id, user_id AS camera, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank FROM events) WHERE rank <= 3")
def sharpest_topk(spark, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    return fixtures.table(spark, d, "events").withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("event_id", F.col("user_id").alias("camera"), "rank")


@entry(f"WITH {m.READING} SELECT camera_id, max(epoch_s) AS last_s, arg_max(confidence, {{'a': epoch_s, 'b': event_id}}) AS last_confidence, arg_max(event_id, {{'a': confidence, 'b': -event_id}}) AS strongest FROM reading GROUP BY camera_id")
def latest_and_strongest(spark, d):
    r = fixtures.readings(spark, d)
    last = F.struct("epoch_s", "event_id")
    return r.groupBy("camera_id").agg(F.max("epoch_s").alias("last_s"), F.max_by("confidence", last).alias("last_confidence"), F.max_by("event_id", F.struct("confidence", -F.col("event_id"))).alias("strongest"))


@entry(f"WITH {m.READING} SELECT date_part('hour', make_timestamp(epoch_s * 1000000)) + date_part('minute', make_timestamp(epoch_s * 1000000)) / 60.0::DOUBLE AS hour_utc, CAST(date_part('hour', make_timestamp(epoch_s * 1000000)) // 2 AS INT) % 12 AS bucket, count(*) AS n FROM reading GROUP BY 1, 2")
def time_of_day(spark, d):
    hour, minute = F.expr("epoch_s div 3600 % 24"), F.expr("epoch_s div 60 % 60")
    return fixtures.readings(spark, d).groupBy((hour + minute / 60.0).alias("hour_utc"), (F.floor(hour / 2) % 12).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


# --- names ------------------------------------------------------------------------------------------------------------

_NAME = "CASE o_orderkey % 6 WHEN 0 THEN 'cam/' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '.jpg' WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%dT%H%M%S') || '.png' WHEN 2 THEN 'x_' || strftime(o_orderdate, '%Y%m%dT%H%M%S') || '.jpg' WHEN 3 THEN 'clip-' || strftime(o_orderdate, '%Y%m%d%H%M%S') || '.mp4' WHEN 4 THEN CAST(CAST(floor(epoch(o_orderdate)) AS BIGINT) AS VARCHAR) || '_+0060.jpg' ELSE 'still ' || o_orderkey || '.JPG' END"


@entry(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 = 5 OR (o_orderkey % 6 = 4 AND epoch(o_orderdate) <= 1000000000) THEN NULL ELSE CAST(floor(epoch(o_orderdate)) AS BIGINT) END AS epoch_s, o_orderkey % 6 <> 3 AS image, regexp_replace({_NAME}, '[^A-Za-z0-9._-]', '_', 'g') AS safe FROM orders")
def name_timestamps(spark, d):
    ts = F.expr("date_format(o_orderdate, 'yyyyMMddHHmmss')")
    day, clock = F.left(ts, F.lit(8)), F.right(ts, F.lit(6))
    dashed = F.concat_ws("-", F.left(ts, F.lit(4)), F.substring(ts, 5, 2), F.substring(ts, 7, 2))
    epoch = F.expr("timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate)")
    k = F.col("o_orderkey") % 6
    name = F.when(k == 0, F.concat(F.lit("cam/"), day, F.lit("_"), clock, F.lit(".jpg"))).when(k == 1, F.concat(dashed, F.lit("T"), clock, F.lit(".png"))).when(k == 2, F.concat(F.lit("x_"), day, F.lit("T"), clock, F.lit(".jpg"))).when(k == 3, F.concat(F.lit("clip-"), ts, F.lit(".mp4"))).when(k == 4, F.concat(epoch.cast("string"), F.lit("_+0060.jpg"))).otherwise(F.concat(F.lit("still "), F.col("o_orderkey").cast("string"), F.lit(".JPG")))
    o = fixtures.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), name.alias("name"))
    return o.select("id", names.epoch(F.col("name")).alias("epoch_s"), names.is_image(F.col("name")).alias("image"), names.sanitise(F.col("name")).alias("safe"))


@entry("SELECT o_orderkey AS id, CAST(o_orderdate AS DATE)::VARCHAR AS day, 'cam-' || (o_orderkey % 40) AS camera, CAST(o_orderkey % 5000 - 2400 AS BIGINT) AS offset_s, (o_orderkey % 5000 - 2400) >= 0 AS smoke, CAST((o_orderkey % 90000) // 3600 AS VARCHAR) || ':' || lpad(CAST((o_orderkey % 90000) // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 90000 % 60 AS VARCHAR), 2, '0') AS clock FROM orders")
def sequence_names(spark, d):
    k = F.col("o_orderkey")
    o = fixtures.table(spark, d, "orders").select(k.alias("id"), F.concat(F.expr("date_format(o_orderdate, 'yyyyMMdd')"), F.lit("_FIRE_cam-"), (k % 40).cast("string")).alias("dir"), F.concat(F.lit("1700000000_"), F.format_string("%+d", k % 5000 - 2400), F.lit(".jpg")).alias("file"), names.clock(k % 90000).alias("clock"))
    day = F.regexp_extract("dir", names.SEQUENCE, 1)
    offset = F.regexp_extract("file", names.FRAME, 2).cast("long")
    return o.select("id", F.concat_ws("-", F.left(day, F.lit(4)), F.substring(day, 5, 2), F.substring(day, 7, 2)).alias("day"), F.regexp_extract("dir", names.SEQUENCE, 2).alias("camera"), offset.alias("offset_s"), (offset >= 0).alias("smoke"), "clock")


_CALIBRATED = f""", p AS (SELECT camera_id, count(*) AS clear, quantile_cont(confidence, 0.95) AS p95 FROM evidence GROUP BY camera_id HAVING count(*) >= 25), plain AS (SELECT * EXCLUDE (clear_frames, habituation, ceiling), track_id % 50 AS camera_id, track_id * 7 % 768 AS cell FROM region),
 known AS (SELECT plain.*, coalesce(clear, 0) AS clear_frames, coalesce(p95, 0.0) AS ceiling, coalesce(share, 0.0) AS habituation FROM plain LEFT JOIN p USING (camera_id) LEFT JOIN n USING (camera_id, cell))"""


@entry(f"WITH {m.EVIDENCE}, {_NUIS}, {_GROW}, {_REGION}{_CALIBRATED}{_SUPPORT.replace('FROM region)', 'FROM known)')}{_FIRED} SELECT s.track_id, coalesce(string_agg(code, ',' ORDER BY conf DESC, i), '') AS codes, any_value(s.clear_frames) AS clear_frames FROM scored s LEFT JOIN fired f USING (track_id) GROUP BY s.track_id")
def rejections_calibrated(spark, d):
    """The rules with each camera's own calibration joined to its tracks."""
    c, e = _Columns(), fixtures.evidence(spark, d)
    plain = _regions(spark, d).drop("clear_frames", "habituation", "ceiling").withColumn("camera_id", F.col("track_id") % 50)
    nuisance = calibration.nuisance(e)
    covered = plain.select(F.col("track_id").alias("region_id"), "camera_id", (F.col("track_id") * 7 % 768).alias("cell"), F.lit(1.0).alias("coverage"))
    r = calibration.inject(plain, calibration.pool(e), calibration.habituation(covered, nuisance).withColumnRenamed("region_id", "track_id"), "track_id")
    r = r.withColumn("support", scoring.support(scoring.evidence(c, c, F.lit(_HEIGHT)), F.col("has_colour")))
    fired = scoring.rejections(c, c, c, F.col("support"), F.lit(_HEIGHT), F.col("has_colour"))
    return r.select("track_id", F.array_join(F.transform(fired, lambda x: x["code"]), ",").alias("codes"), "clear_frames")


@entry(f"WITH {m.READING}, c AS (SELECT sequence, event_type AS code, count(*) AS n, count(*) FILTER (WHERE event_id % 9 = 0) AS unusable, sum(event_id % 400) AS ms FROM reading GROUP BY 1, 2) SELECT sequence, CAST(sum(unusable) AS BIGINT) AS unusable, round(sum(ms) / sum(n)::DOUBLE, 6) AS mean_ms, string_agg(code || ':' || n, ',' ORDER BY code) AS reasons FROM c GROUP BY sequence")
def sequence_diagnostics(spark, d):
    k = F.col("event_id")
    r = fixtures.readings(spark, d).select("sequence", (k % 9 != 0).alias("usable"), (k % 400).alias("ms"), F.col("event_type").alias("reason"))
    return _rounded(evaluation.diagnostics(r), mean_ms=6)


@entry(f"WITH {m.READING} SELECT DISTINCT epoch_s - epoch_s % 60 AS tick FROM reading ORDER BY tick LIMIT 20")
def timeline_latest(spark, d):
    """The first 20 ticks, as a run with a limit walks them: the limit is the feature."""
    return timeline_distinct(spark, d).orderBy("tick").limit(20)


@entry(f"WITH {m.READING} SELECT event_id, epoch_s FROM reading WHERE epoch_s < 1705000000 AND camera_id = (SELECT min(camera_id) FROM camera)")
def rows_before(spark, d):
    cams = fixtures.cameras(spark, d)
    first = cams.agg(F.min("camera_id")).first()[0]
    own = network.one(cams, "camera_id", first).select("camera_id")
    return network.before(fixtures.readings(spark, d).join(own, "camera_id", "left_semi"), "epoch_s", 1705000000).select("event_id", "epoch_s")


@entry(f"WITH {m.READING}, a AS (SELECT sequence, camera_id FROM reading WHERE offset_s >= 0), b AS (SELECT sequence, camera_id FROM reading WHERE offset_s < 0) SELECT camera_id, count(*) AS n, count(DISTINCT sequence) AS sequences FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY camera_id")
def sequences_concatenated(spark, d):
    r = fixtures.readings(spark, d).select("sequence", "camera_id", "offset_s")
    both = sets.concatenated([r.filter("offset_s >= 0"), r.filter("offset_s < 0")])
    return both.groupBy("camera_id").agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("sequences"))


@entry("SELECT event_id, sha256(props) AS digest, coalesce(CASE WHEN event_id % 3 = 0 THEN event_id % 7 END, event_id % 5) AS a, event_id % 11 AS b FROM events")
def merged_metrics(spark, d):
    """A digest of what came in, and metrics merged: those of the later map win."""
    k = F.col("event_id")
    early = F.create_map(F.lit("a"), k % 5, F.lit("b"), k % 11)
    late = F.when(k % 3 == 0, F.create_map(F.lit("a"), k % 7)).otherwise(F.create_map().cast("map<string, bigint>"))
    both = sets.merged(early, late)
    return fixtures.table(spark, d, "events").select("event_id", F.sha2("props", 256).alias("digest"), both["a"].alias("a"), both["b"].alias("b"))


def queries() -> dict:
    from . import extras, reports, stateful

    return {k: f for k, (f, _) in _entries.items()} | extras.queries() | stateful.queries() | reports.queries()


def oracle_of(name: str) -> str:
    return _entries[name][1]


def oracle_sql() -> dict[str, str]:
    from . import extras, reports, stateful

    return {k: sql for k, (_, sql) in _entries.items() if sql} | extras.oracle_sql() | stateful.oracle_sql() | reports.oracle_sql()
