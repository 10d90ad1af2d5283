"""Queries of reports, sentences and wire forms, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, sentences, skyline, wire
from ..operators import escalation, evaluation, tracks
from ..sources import fixtures, uploads
from . import catalogue, stateful
from . import macros as m


def even(x: str, places: int = 0) -> str:
    """Halves to the even digit, of a value's nine places."""
    return f"round_even(CAST(round({x}, 9) AS DECIMAL(30, 9)), {places})"


def evaluation_report(spark, d):
    """Every figure of an evaluation, of events as readings: some can't be believed, some come before the model is warm."""
    k = F.col("event_id")
    r = fixtures.readings(spark, d).withColumns({
        "unusable": F.when(k % 13 == 0, "fog").when(k % 17 == 0, "night"), "warmed": k % 19 != 0, "ms": k % 400,
        "rejections": F.concat(F.when(k % 3 == 0, F.array(F.upper("event_type"))).otherwise(F.array()), F.when(k % 10 < 3, F.array(F.lit("TOO_BRIEF"))).otherwise(F.array())),
    })
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["code"], F.lit(":"), x["n"].cast("string"))), ",").alias(c)
    out = evaluation.report(r)
    out = out.select(*(listed(c) if c in ("unusable_frames", "rejections_fired") else c for c in out.columns))
    return catalogue._rounded(out, detection_rate=6, mean_s=6, p10_s=6, p90_s=6, clear_hours=6, per_camera_day=6, median_ms=6, max_ms=6)


_REPORT = f"""WITH {m.READING.replace('reading AS', 'taken AS', 1)},
 said AS (SELECT *, CASE WHEN event_id % 13 = 0 THEN 'fog' WHEN event_id % 17 = 0 THEN 'night' END AS unusable,
   event_id % 13 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0 AS good FROM taken),
 reading AS (SELECT * REPLACE (CASE WHEN good THEN confidence END AS confidence) FROM said),
 {catalogue._SCORES},
 fired AS (SELECT code, count(*) AS n FROM (SELECT upper(event_type) AS code FROM said WHERE good AND event_id % 3 = 0
   UNION ALL SELECT 'TOO_BRIEF' FROM said WHERE good AND event_id % 10 < 3) GROUP BY code),
 blind AS (SELECT unusable AS code, count(*) AS n FROM said WHERE unusable IS NOT NULL GROUP BY 1),
 took AS (SELECT avg(event_id % 400) AS ms FROM said GROUP BY sequence, camera_id HAVING avg(event_id % 400) <> 0)
 SELECT count(*) AS sequences, CAST(sum(frames) AS BIGINT) AS frames, count(*) FILTER (WHERE detected) AS detected,
  count(*) FILTER (WHERE NOT detected) AS missed,
  round(coalesce(avg(CASE WHEN detected THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (WHERE positive_frames > 0), 0.0), 6) AS detection_rate,
  median(first_alert_s) AS median_s, round(avg(first_alert_s), 6) AS mean_s, round(quantile_cont(first_alert_s, 0.1), 6) AS p10_s,
  round(quantile_cont(first_alert_s, 0.9), 6) AS p90_s, min(first_alert_s) AS min_s, max(first_alert_s) AS max_s,
  CAST(sum(false_positive_frames) AS BIGINT) AS false_frames, CAST(sum(negative_frames) AS BIGINT) AS clear_frames,
  round(sum(negative_minutes) / 60.0, 6) AS clear_hours,
  round(sum(false_positive_frames) / (sum(negative_minutes) / 1440.0), 6) AS per_camera_day,
  0.45::DOUBLE AS threshold, count(first_alert_s) AS alerts, count(*) FILTER (WHERE first_alert_s < 0) AS before_mark,
  (SELECT round(median(ms), 6) FROM took) AS median_ms, (SELECT round(max(ms), 6) FROM took) AS max_ms,
  (SELECT string_agg(code || ':' || n, ',' ORDER BY code) FROM blind) AS unusable_frames,
  (SELECT string_agg(code || ':' || n, ',' ORDER BY n DESC, code) FROM fired) AS rejections_fired FROM score"""


def detection_summaries(spark, d):
    """A sentence for each track: its verdict, the two strongest reasons, and the strongest rule against it."""
    c, k = catalogue._Columns(), F.col("track_id")
    terms, height = scoring.evidence(c, c, F.lit(catalogue._HEIGHT)), F.lit(catalogue._HEIGHT)
    r = catalogue._regions(spark, d).withColumn("support", scoring.support(terms, F.col("has_colour")))
    r = r.withColumn("fired", scoring.rejections(c, c, c, F.col("support"), height, F.col("has_colour")))
    r = r.withColumn("confidence", F.round(scoring.confidence(F.col("support"), F.col("fired")), 9))
    because = sentences.strongest(terms, F.col("has_colour"), sentences.reasons(c, c))
    r = r.withColumns({"because": because, "against": sentences.objection(F.get("fired", 0)["code"], c, c, c, F.col("support"))})
    bearing, x = (k * 13 % 3600) / 10.0, (k * 7 % 1024) / 1024.0
    return r.select("track_id", sentences.detection(scoring.verdict(F.col("confidence")), k % 4 != 0, bearing, x, F.col("because"), F.col("against")).alias("summary"))


def _p(x: str, places: int = 0, sign: str = "") -> str:
    return f"printf('%{sign}.{places}f', CAST({even(x, places)} AS DOUBLE))"


def _cent(x: str) -> str:
    return f"{_p(f'100 * ({x})')} || '%'"


_int = lambda x: f"CAST(CAST({x} AS BIGINT) AS VARCHAR)"
_WHY = {
    "growth": f"'it grew from ' || {_int('area_first')} || ' to ' || {_int('area_last')} || ' px over ' || {_p('span_min')} || ' minutes, without shrinking in ' || {_cent('monotonic')} || ' of steps'",
    "rise": f"'its top edge climbed ' || {_p('top_rise', 1)} || ' px a minute'",
    "anchored": f"'its base stayed put while its top moved (anchor ' || {_p('anchor', 2)} || ', base drift ' || {_p('base_drift', 1)} || ' px a minute)'",
    "veiling": f"'the detail behind it dropped to ' || {_cent('texture_ratio')} || ' of what the background reference has there, which is what a translucent veil does'",
    "attachment": f"'its base sits ' || {_p('base_below', 0, '+')} || ' px from the skyline, so it is joined to the ground'",
    "soft_edges": f"'its boundary is soft (softness ' || {_p('edge_softness', 2)} || '), not a hard edge'",
    "desaturation": f"'it is ' || {_cent('1 - saturation_ratio')} || ' less saturated than its surroundings'",
    "persistence": "'it has been there for ' || frames || ' frames'",
}
_change = _cent("abs(1 - area_ratio)")
_OBJECTIONS = {
    "TOO_BRIEF": "'seen in ' || frames || CASE WHEN frames = 1 THEN ' frame' ELSE ' frames' END || '; a column is identified by how it grows, which needs at least 3'",
    "HABITUAL_REGION": f"'this camera raises a candidate in this part of its view on ' || {_cent('habituation')} || ' of its clear frames, learned from ' || clear_frames || ' frames on other days; whatever it is, it was already there'",
    "BELOW_CAMERA_BASELINE": f"'scored ' || {_p('support', 2)} || ', and this camera reaches ' || {_p('ceiling', 2)} || ' on its clear frames; that is not unusual for this view'",
    "FLARE": f"'mean brightness ' || {_p('mean_luma')} || ' of 255 with ' || {_cent('blown')} || ' of it clipped; smoke scatters light, it does not saturate a sensor'",
    "STATIC_ARTEFACT": f"'unchanged for ' || frames || ' frames — it moved ' || {_p('centroid_drift', 2)} || ' px a minute, changed area by ' || {_change} || ', and has a hard edge (softness ' || {_p('edge_softness', 2)} || '); that is on the glass, not on the hill'",
    "RIDGE_REGISTRATION": f"'a ' || {_int('w')} || 'x' || {_int('h')} || ' px sliver sitting on the skyline in a frame that moved ' || {_p('shift', 1)} || ' px and could not be re-registered'",
    "WEATHER_FRONT": f"'detail contrast across the entire frame fell to ' || {_cent('contrast_ratio')} || ' of this camera''s recent normal, and this patch is no softer than the rest of it'",
    "AIRBORNE": f"'the bottom of this shape sits ' || {_p('-base_below')} || ' px above the skyline with nothing joining it to the ground'",
    "CLOUD_TRANSLATION": f"'the whole shape moved ' || {_p('centroid_drift', 1)} || ' px a minute while its area changed by only ' || {_change} || ', and its base moved as fast as its top (anchor ' || {_p('anchor', 2)} || '); that is something passing through, not something growing out of the ground'",
    "ERRATIC_BASE": f"'the bottom of this shape travelled ' || {_p('base_drift')} || ' px a minute; the base of a real column stays where the fire is'",
    "GROUND_DRIFT": f"'it tracked sideways at ' || {_p('horizontal_drift', 1)} || ' px a minute below the skyline without rising (' || {_p('top_rise', 1)} || ' px a minute), and its colour is not neutral (greyness ' || {_p('greyness', 2)} || ')'",
}
_REASONED = " UNION ALL ".join(
    f"SELECT track_id, {i} AS i, round(t_{k} * {scoring.WEIGHTS[k]}, 9) AS part, {_WHY[k]} AS text FROM scored{' WHERE has_colour' if k == 'desaturation' else ''}" for i, k in enumerate(scoring.WEIGHTS)
)
_TEXTS = " ".join(f"WHEN '{k}' THEN {v}" for k, v in _OBJECTIONS.items())
_PLACE = f"""CASE WHEN track_id % 4 <> 0 THEN 'at bearing ' || {_p('(track_id * 13 % 3600) / 10.0::DOUBLE', 1)} || ' degrees'
   ELSE 'at ' || CAST({even('100 * (track_id * 7 % 1024) / 1024.0::DOUBLE')} AS BIGINT) || '% across the frame' END"""
_SUMMARIES = f"""WITH {catalogue._GROW}, {catalogue._REGION}{catalogue._SUPPORT}{catalogue._FIRED},
 reasoned AS ({_REASONED}),
 best AS (SELECT track_id, string_agg(text, '; ' ORDER BY part DESC, i) AS because
   FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY part DESC, i) AS k FROM reasoned) WHERE k <= 2 GROUP BY track_id),
 against AS (SELECT track_id, list(code ORDER BY conf DESC, i)[1] AS code, exp(sum(ln(1 - 0.9 * conf))) AS share FROM fired GROUP BY track_id),
 j AS (SELECT s.*, because, code, round(support * coalesce(share, 1.0), 9) AS left_over FROM scored s JOIN best USING (track_id) LEFT JOIN against USING (track_id))
 SELECT track_id, CASE WHEN left_over >= 0.68 THEN 'A column' WHEN left_over >= 0.45 THEN 'Something' ELSE 'Nothing worth calling' END || ' ' || {_PLACE}
  || ': ' || because || '.' || coalesce(' Against it: ' || CASE code {_TEXTS} END || '.', '') AS summary FROM j"""


def wire_growth(spark, d):
    """Growth of tracks as it goes over the wire."""
    o = fixtures.observations(spark, d)
    g = tracks.growth(o).join(tracks.aspects(o), "track_id").withColumn("span_s", F.col("span_min") * 60)
    return wire.shaped(g, wire.GROWTH, "track_id")


def _wired(source: str, places: int | None) -> str:
    source = "span_min * 60" if source == "span_s" else source
    return source if places is None else f"CAST({even(source, places)} AS DOUBLE)"


_WIRE = f"""WITH {catalogue._GROW},
 aspects AS (SELECT track_id, arg_min(h / greatest(w, 1.0), frame_index) AS aspect_first, arg_max(h / greatest(w, 1.0), frame_index) AS aspect_last FROM observation GROUP BY track_id)
 SELECT track_id, {', '.join(f'{_wired(c, n)} AS {k}' for k, (c, n) in wire.GROWTH.items())} FROM growth JOIN aspects USING (track_id)"""


def horizon_masks(spark, d):
    """Vectors as skylines of images of 64 rows: pixels of sky and of the strip around it, a point's height, their shape."""
    v = F.col("vec_id")
    rows = F.transform("embedding", lambda x: F.least(F.greatest(F.floor(32 + 100 * x.cast("double")), F.lit(0)), F.lit(64)))
    b, h = F.col("boundary"), F.lit(64)
    out = {"sky": skyline.sky_pixels(b, h), "sky_margin": skyline.sky_pixels(b, h, 3), "band": skyline.band_pixels(b, h, 6, 2), "above": skyline.height_above(b, (v * 7 % 90).cast("double"), (v % 64).cast("double"))}
    return fixtures.table(spark, d, "embeddings").select("vec_id", rows.alias("boundary")).select("vec_id", *(c.alias(k) for k, c in {**out, **skyline.shape(b)}.items()))


_HORIZON = """WITH v AS (SELECT vec_id, [least(greatest(CAST(floor(32 + 100 * CAST(x AS DOUBLE)) AS BIGINT), 0), 64) FOR x IN embedding] AS b FROM embeddings),
 u AS (SELECT vec_id, unnest(b) AS y FROM v),
 s AS (SELECT vec_id, CAST(sum(y) AS BIGINT) AS sky, CAST(sum(least(y + 3, 64)) AS BIGINT) AS sky_margin,
   CAST(sum(greatest(least(y + 2, 63) - greatest(y - 6, 0) + 1, 0)) AS BIGINT) AS band,
   CAST(floor(median(y)) AS BIGINT) AS median_row, CAST(floor(round(quantile_cont(y, 0.95) - quantile_cont(y, 0.05), 9)) AS BIGINT) AS relief_px FROM u GROUP BY vec_id)
 SELECT vec_id, sky, sky_margin, band, CAST(b[least(vec_id * 7 % 90, len(b) - 1) + 1] - vec_id % 64 AS DOUBLE) AS above, median_row, relief_px FROM s JOIN v USING (vec_id)"""


def upload_reports(spark, d):
    """Users as uploads, their events as stills: a third carry times in their names; some say too little or too much."""
    u, k = F.col("user_id"), F.col("event_id")
    archive = F.concat(F.lit("upload"), u.cast("string"), F.when(u % 23 == 0, ".jpg").when(u % 29 == 0, ".mp4").otherwise(".zip")).alias("archive")
    e = fixtures.table(spark, d, "events")
    path = F.when(u % 3 == 0, F.concat(F.lit("cam_"), F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyyMMdd_HHmmss"), F.lit(".jpg"))).otherwise(F.format_string("%07d.png", "event_id"))
    files = e.select(archive, F.concat(F.when(k % 31 == 0, "__MACOSX/").otherwise("stills/"), path).alias("path"), (k % 37 != 0).alias("decodable"))
    params = {
        "bearing_deg": F.when(u % 5 == 0, "400").when(u % 5 < 3, ((u * 10) % 360).cast("string")), "hfov_deg": F.when(u % 11 == 0, "wide"),
        "interval_s": F.when(u % 2 == 0, (u % 40 + 1).cast("string")),
    }
    _, reports = uploads.opened(files, e.select("user_id").distinct().select(archive, *(v.alias(n) for n, v in params.items())))
    return reports.withColumn("notes", F.array_join("notes", " "))


_UPLOAD = """WITH e AS (SELECT *, 'upload' || user_id || CASE WHEN user_id % 23 = 0 THEN '.jpg' WHEN user_id % 29 = 0 THEN '.mp4' ELSE '.zip' END AS archive,
   CASE WHEN user_id % 3 = 0 THEN CAST(floor(epoch(ts)) AS BIGINT) END AS own,
   CASE WHEN user_id % 3 = 0 THEN 'cam_' || strftime(ts, '%Y%m%d_%H%M%S') || '.jpg' ELSE printf('%07d.png', event_id) END AS path FROM events),
 f AS (SELECT * FROM e WHERE event_id % 31 <> 0),
 n AS (SELECT archive, count(*) AS total, count(own) = count(*) AND count(DISTINCT own) = count(*) AS named FROM f GROUP BY archive),
 p AS (SELECT DISTINCT archive, user_id, user_id % 2 <> 0 AS assumed, user_id % 5 IN (1, 2) AS aim, CASE WHEN user_id % 2 = 0 THEN CAST(user_id % 40 + 1 AS DOUBLE) ELSE 60.0 END AS every,
   CASE WHEN user_id % 5 = 0 THEN 'BEARING_DEG_OUT_OF_RANGE' WHEN user_id % 11 = 0 THEN 'HFOV_DEG_NOT_A_NUMBER' WHEN user_id % 23 = 0 THEN 'ONE_STILL' WHEN user_id % 29 = 0 THEN 'NO_VIDEO_DECODER' END AS said FROM e),
 q AS (SELECT p.*, coalesce(total, 0) AS total, coalesce(named, false) AS named FROM p LEFT JOIN n USING (archive)),
 a AS (SELECT *, greatest(1, CAST(round_even(60.0 / every, 0) AS BIGINT)) AS s0 FROM q),
 b AS (SELECT *, CASE WHEN total >= 40 THEN greatest(1, least(s0, total // 40)) ELSE 1 END AS s1 FROM a),
 c AS (SELECT *, CASE WHEN ceil(total / s1::DOUBLE) > 240 THEN greatest(s1, least(CAST(ceil(total / 240.0) AS BIGINT), greatest(1, CAST(floor(240.0 / every) AS BIGINT)))) ELSE s1 END AS stride FROM b),
 t AS (SELECT *, least(CAST(ceil(total / stride::DOUBLE) AS BIGINT), 240) AS wanted FROM c),
 r AS (SELECT f.archive, f.own, f.event_id % 37 <> 0 AS fine, row_number() OVER (PARTITION BY f.archive ORDER BY CASE WHEN named THEN own END, f.path) - 1 AS raw, stride, wanted FROM f JOIN t USING (archive)),
 k AS (SELECT *, own - lag(own) OVER (PARTITION BY archive ORDER BY raw) AS gap FROM r WHERE raw % stride = 0 AND raw < stride * wanted),
 g AS (SELECT archive, list_sort(list(gap) FILTER (WHERE gap IS NOT NULL)) AS gaps, bool_and(fine) FILTER (WHERE raw = 0) AS first_fine FROM k GROUP BY archive),
 z AS (SELECT t.*, gaps, coalesce(said, CASE WHEN total = 0 THEN 'NO_STILLS' WHEN wanted < 6 THEN 'TOO_FEW_FRAMES' WHEN NOT first_fine THEN 'UNDECODABLE' END) AS refusal,
   ceil(total / stride::DOUBLE) > wanted AS cut, 'analysed ' || wanted || ' of ' || total || ' frames' || CASE WHEN stride > 1 THEN ', one in every ' || stride ELSE '' END AS covered FROM t LEFT JOIN g USING (archive)),
 o AS (SELECT * FROM z WHERE refusal IS NULL)
 SELECT z.archive, CASE WHEN o.archive IS NOT NULL THEN 'stills' END AS kind, o.total AS total_frames, o.wanted AS analysed_frames, o.stride, o.every AS interval_s, o.assumed AND NOT o.named AS interval_assumed,
  CASE WHEN o.named THEN CAST(o.gaps[len(o.gaps) // 2 + 1] AS DOUBLE) ELSE o.stride * o.every END AS spacing_s, o.cut AS capped, CASE WHEN o.named THEN 'filenames' WHEN NOT o.named THEN 'interval' END AS timestamps,
  o.aim AS aim_known, o.covered AS coverage, CASE WHEN o.archive IS NOT NULL THEN concat_ws(' ', CASE WHEN o.named THEN '@names' END,
   CASE WHEN o.assumed AND NOT o.named THEN 'No capture interval was given, so ' || CAST(o.every AS BIGINT) || '@interval' END, CASE WHEN NOT o.aim THEN '@aim' END, '@place',
   CASE WHEN o.cut THEN 'The footage was too long to read whole at a usable spacing, so it was cut after ' || o.wanted || ' analysed frames (' || o.covered || '); the rest was not read.' END) END AS notes,
  z.refusal FROM z LEFT JOIN o USING (archive)"""
for _name, _text in uploads.NOTES.items():
    _UPLOAD = _UPLOAD.replace(f"@{_name}", _text.replace("'", "''"))


def incident_records(spark, d):
    """What each incident of the escalation came to."""
    out = escalation.records(stateful._sweeps(*stateful._said(spark, d)))
    return out.withColumn("confidence", F.round("confidence", 9)).withColumn("cameras_consulted", F.size("consulted").cast("long"))


_entries = {
    "evaluation_report": (evaluation_report, _REPORT), "detection_summaries": (detection_summaries, _SUMMARIES), "wire_growth": (wire_growth, _WIRE),
    "horizon_masks": (horizon_masks, _HORIZON), "upload_reports": (upload_reports, _UPLOAD), "incident_records": (incident_records, None),
}


def queries() -> dict:
    return {k: f for k, (f, _) in _entries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for k, (_, sql) in _entries.items() if sql}
