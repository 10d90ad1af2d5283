"""Queries over measurements, labels and set operations, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import measures
from ..operators import network, sets
from ..sources import fixtures
from . import macros as m

_H = "SELECT s_suppkey AS id, 2.0::DOUBLE + (s_suppkey % 5) / 10.0 AS a, 0.1::DOUBLE AS b, 3.0::DOUBLE AS c, 0.05::DOUBLE AS d, 1.9::DOUBLE AS e, 4.0::DOUBLE AS f, 0.0001::DOUBLE AS g, 0.0002::DOUBLE AS h, 1.0::DOUBLE AS i, CAST(s_suppkey % 90 AS DOUBLE) AS x, CAST(s_suppkey % 70 AS DOUBLE) AS y FROM supplier"
_DET = "(a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g))"


def _back(x: str, y: str) -> tuple[str, str]:
    u, v, w = (f"((({p}) * {x} + ({q}) * {y} + ({r})) / {_DET})" for p, q, r in (("e * i - f * h", "c * h - b * i", "b * f - c * e"), ("f * g - d * i", "a * i - c * g", "c * d - a * f"), ("d * h - e * g", "b * g - a * h", "a * e - b * d")))
    return f"({u} / {w})", f"({v} / {w})"


_p, _q = _back("x", "y"), _back("(x + 30.0)", "(y + 40.0)")
_edges = [f"sqrt(pow(({x2}) - ({x1}), 2) + pow(({y2}) - ({y1}), 2))" for (x1, y1), (x2, y2) in (((0, 0), ("40 + x", 0)), (("40 + x", 0), ("40 + x", "30 + y")), (("40 + x", "30 + y"), (5, "30 + y")), ((5, "30 + y"), (0, 0)))]
_area = "abs((40 + x) * (30 + y) - 0 + ((40 + x) * (30 + y) - 5 * (30 + y))) / 2.0"


def plane_measures(spark, d):
    k = F.col("s_suppkey")
    lit = lambda *v: [F.lit(float(x)) for x in v]
    h = [2.0 + (k % 5) / 10.0, *lit(0.1, 3, 0.05, 1.9, 4, 0.0001, 0.0002, 1)]
    x, y = (k % 90).cast("double"), (k % 70).cast("double")
    xs, ys = [F.lit(0.0), 40.0 + x, 40.0 + x, F.lit(5.0)], [F.lit(0.0), F.lit(0.0), 30.0 + y, 30.0 + y]
    u, v = measures.transform(h, x, y)
    return fixtures.table(spark, d, "supplier").select(
        k.alias("id"), F.round(measures.segment_mm(h, (x, y), (x + 30.0, y + 40.0)), 6).alias("segment_mm"), F.round(measures.residual_px(h, [(x, y)], [(u + 3.0, v + 4.0)]), 6).alias("residual"),
        F.round(measures.obliquity(xs, ys), 6).alias("tilt"), measures.degenerate(xs, ys, 32.0).alias("degenerate"), F.round(measures.px_to_mm(x, F.lit(4.0), F.when(k % 3 == 0, "NO_FIDUCIAL")), 6).alias("mm"),
    )


_PLANE = f"WITH s AS ({_H}), e AS (SELECT *, {', '.join(f'{x} AS e{i}' for i, x in enumerate(_edges))}, {_area} AS area FROM s) SELECT id, round(sqrt(pow({_p[0]} - {_q[0]}, 2) + pow({_p[1]} - {_q[1]}, 2)), 6) AS segment_mm, 5.0 AS residual, round(degrees(acos(least(1.0, least(e0, e1, e2, e3) / greatest(e0, e1, e2, e3)))), 6) AS tilt, area < 0.5 * pow((e0 + e1 + e2 + e3) / 4.0, 2) OR least(e0, e1, e2, e3) < 32 AS degenerate, CASE WHEN id % 3 <> 0 THEN round(x / 4.0, 6) END AS mm FROM e"


def map_places(spark, d):
    c = fixtures.cameras(spark, d)
    b = network.bounds(c)
    x, y = measures.map_place(F.col("lat"), F.col("lon"), {n: F.col(n) for n in b.columns}, 800.0, 500.0)
    return c.crossJoin(F.broadcast(b)).select("camera_id", F.round(x, 5).alias("x"), F.round(y, 5).alias("y"))  # one row


_MAP = f"WITH {m.CAMERA}, b AS (SELECT min(lat) - greatest((max(lat) - min(lat)) * 0.42, 0.02) AS l, max(lat) + greatest((max(lat) - min(lat)) * 0.42, 0.02) AS t, min(lon) - greatest((max(lon) - min(lon)) * 0.42, 0.02) AS w, max(lon) + greatest((max(lon) - min(lon)) * 0.42, 0.02) AS e FROM camera), k AS (SELECT *, cos(radians((l + t) / 2.0)) AS s FROM b), z AS (SELECT *, least(800.0 / ((e - w) * s), 500.0 / (t - l)) AS q FROM k) SELECT camera_id, round((800.0 - (e - w) * s * q) / 2.0 + (lon - w) * s * q, 5) AS x, round(500.0 - (500.0 - (t - l) * q) / 2.0 - (lat - l) * q, 5) AS y FROM camera, z"


def detector_boxes(spark, d):
    k = F.col("event_id")
    raw = [(k % 10) / 10.0, (k % 7) / 10.0, (k % 13) / 10.0 - 0.5, (k % 11) / 10.0 - 0.5]
    stride = F.when(k % 3 == 0, 8).when(k % 3 == 1, 16).otherwise(32)
    box = measures.decode_box(raw, (k % 20).cast("double"), (k % 15).cast("double"), stride)
    logits = F.array((k % 5).cast("double"), (k % 9) / 3.0)
    return fixtures.table(spark, d, "events").select("event_id", *(F.round(x, 6).alias(n) for x, n in zip(box, ("cx", "cy", "w", "h"), strict=True)), F.round(measures.softmax_last(logits), 8).alias("p"))


_BOXES = "WITH e AS (SELECT event_id AS k, CASE event_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 16 ELSE 32 END AS s FROM events) SELECT k AS event_id, round(((k % 10) / 10.0::DOUBLE + k % 20) * s, 6) AS cx, round(((k % 7) / 10.0::DOUBLE + k % 15) * s, 6) AS cy, round(exp((k % 13) / 10.0::DOUBLE - 0.5) * s, 6) AS w, round(exp((k % 11) / 10.0::DOUBLE - 0.5) * s, 6) AS h, round(exp((k % 9) / 3.0::DOUBLE) / (exp(CAST(k % 5 AS DOUBLE)) + exp((k % 9) / 3.0::DOUBLE)), 8) AS p FROM e"


def clear_regions(spark, d):
    k = F.col("event_id")
    e = fixtures.table(spark, d, "events")
    box = [(k * 37 % 4000).cast("double").alias("x"), (k * 91 % 3000).cast("double").alias("y"), (10 + k % 40).cast("double").alias("w"), (10 + k % 30).cast("double").alias("h")]
    a = e.filter("event_type != 'error'").select((F.col("user_id") % 10).alias("image"), k.alias("box"), *box)
    b = e.filter("event_type = 'error'").select((F.col("user_id") % 10).alias("image"), k.alias("box"), *box)
    return sets.clear_of(a, b, "image").select("image", "box")


_CLEAR = "WITH r AS (SELECT user_id % 10 AS image, event_id AS box, event_type, CAST(event_id * 37 % 4000 AS DOUBLE) AS x, CAST(event_id * 91 % 3000 AS DOUBLE) AS y, CAST(10 + event_id % 40 AS DOUBLE) AS w, CAST(10 + event_id % 30 AS DOUBLE) AS h FROM events) SELECT image, box FROM r a WHERE event_type <> 'error' AND NOT EXISTS (SELECT 1 FROM r b WHERE b.event_type = 'error' AND b.image = a.image AND NOT (a.x + a.w + 16 < b.x OR b.x + b.w + 16 < a.x OR a.y + a.h + 16 < b.y OR b.y + b.h + 16 < a.y))"


def first_answers(spark, d):
    r = fixtures.readings(spark, d).select("sequence", "camera_id", "event_type", "epoch_s", "event_id")
    return sets.first_of(r, ["sequence", "event_type"], ["epoch_s", "event_id"]).select("sequence", "event_type", "event_id", F.col("place").cast("long").alias("place"))


_FIRST = f"WITH {m.READING}, f AS (SELECT sequence, event_type, arg_min(event_id, epoch_s * 1000000 + event_id) AS event_id, min(epoch_s * 1000000 + event_id) AS o FROM reading GROUP BY sequence, event_type) SELECT sequence, event_type, event_id, row_number() OVER (PARTITION BY sequence ORDER BY o) AS place FROM f"


def last_states(spark, d):
    r = fixtures.readings(spark, d).select("camera_id", "event_type", "epoch_s", "event_id")
    return sets.last_of(r, ["camera_id"], ["epoch_s", "event_id"]).select("camera_id", "event_type", "event_id")


_LAST = f"WITH {m.READING} SELECT camera_id, arg_max(event_type, epoch_s * 1000000 + event_id) AS event_type, arg_max(event_id, epoch_s * 1000000 + event_id) AS event_id FROM reading GROUP BY camera_id"


def scored_only(spark, d):
    r = fixtures.readings(spark, d)
    named = r.filter("event_type = 'signup' AND confidence >= 0.9").select("sequence")
    return sets.only(r, named, "sequence").groupBy("sequence").agg(F.count("*").alias("n"))


_ONLY = f"WITH {m.READING} SELECT sequence, count(*) AS n FROM reading WHERE sequence IN (SELECT sequence FROM reading WHERE event_type = 'signup' AND confidence >= 0.9) GROUP BY sequence"


def confusion_counts(spark, d):
    l = fixtures.table(spark, d, "labels")
    out = sets.confusion(l.filter("quality is not null and toxic is not null"), "quality", "toxic")
    return out.withColumns({c: F.round(c, 8) for c in ("accuracy", "precision", "recall")})


_CONF = "WITH l AS (SELECT count(*) FILTER (WHERE quality = 1 AND toxic = 1) AS tp, count(*) FILTER (WHERE quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (WHERE quality = 1 AND toxic <> 1) AS fn, count(*) FILTER (WHERE quality <> 1 AND toxic <> 1) AS tn FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL) SELECT *, round((tp + tn) / (tp + fp + fn + tn)::DOUBLE, 8) AS accuracy, round(tp / (tp + fp)::DOUBLE, 8) AS precision, round(tp / (tp + fn)::DOUBLE, 8) AS recall FROM l"


def alert_labels(spark, d):
    r = fixtures.readings(spark, d)
    aim = F.col("event_id") % 4 != 0
    place = measures.where(aim, F.lit(10.0) * (F.col("event_id") % 36), F.col("x") / 1024.0)
    asked = F.when(F.col("event_id") % 5 == 0, "none").otherwise((F.col("event_id") % 10 / 10.0).cast("string"))
    state = F.when(F.col("event_id") % 2 == 0, "needs_human").otherwise("alerted")
    bearing = F.when(aim, F.lit(10.0) * (F.col("event_id") % 36))
    range_m = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 200 * 100.0)
    label, site = (F.concat(F.lit(f"{n} "), F.col(f"{n}_id").cast("string")) for n in ("camera", "site"))
    headline = measures.headline(state, range_m, bearing, place, label, site, 2 + F.col("event_id") % 3)
    return r.select(
        "event_id", measures.alert_id(F.col("camera_id"), F.col("epoch_s")).alias("alert_id"), place.alias("place"),
        measures.threshold(asked).alias("threshold"), headline.alias("headline"),
    )


_PLACE = """CASE WHEN event_id % 4 <> 0 THEN 'at bearing ' || (10 * (event_id % 36)) || '.0 degrees'
   ELSE 'at ' || CAST(round_even(100 * x / 1024.0, 0) AS BIGINT) || '% across the frame' END"""
_LABELS = f"""WITH {m.READING},
 p AS (SELECT *, {_PLACE} AS place, CASE WHEN event_id % 2 = 0 THEN 'Unresolved: possible smoke' ELSE 'Smoke' END AS lead FROM reading)
 SELECT event_id, camera_id || '-' || epoch_s AS alert_id, place,
  CASE WHEN event_id % 5 = 0 THEN 0.45 ELSE least(greatest((event_id % 10) / 10.0::DOUBLE, 0.1), 0.68::DOUBLE - 0.01) END AS threshold,
  CASE WHEN event_id % 4 = 0 THEN lead || ' ' || place || ', one camera, no location'
   WHEN event_id % 2 = 1 AND event_id % 3 = 0 THEN printf('Smoke %.1f km from site %d, confirmed by %d cameras', event_id % 200 / 10.0, site_id, 2 + event_id % 3)
   ELSE lead || ' on bearing ' || (10 * (event_id % 36)) || ' from camera ' || camera_id END AS headline FROM p"""

_entries = {"plane_measures": _PLANE, "map_places": _MAP, "detector_boxes": _BOXES, "clear_regions": _CLEAR, "first_answers": _FIRST, "last_states": _LAST, "scored_only": _ONLY, "confusion_counts": _CONF, "alert_labels": _LABELS}


def queries() -> dict:
    return {k: globals()[k] for k in _entries}


def oracle_sql() -> dict[str, str]:
    return dict(_entries)
