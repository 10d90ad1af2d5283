"""The same geometry in SQL text, written apart from the column expressions that it is held against."""

from __future__ import annotations

R = "6371008.8"


def norm(x):
    return f"(((({x}) % 360.0) + 360.0) % 360.0)"


def delta(b, ref):
    d = f"({norm(f'({b}) - ({ref}) + 180.0')} - 180.0)"
    return f"(CASE WHEN {d} = -180.0 THEN 180.0 ELSE {d} END)"


def fold(a):
    m = f"(abs({a}) % 180.0)"
    return f"least({m}, 180.0 - {m})"


def bearing(x, width, az, hfov):
    o = f"(2.0 * ({x}) / {width} - 1.0)"
    return norm(f"({az}) + CASE WHEN ({hfov}) >= 120 THEN {o} * ({hfov}) / 2.0 ELSE degrees(atan({o} * tan(radians({hfov}) / 2.0))) END")


def pixel(b, width, az, hfov):
    d = delta(b, az)
    return f"(CASE WHEN abs({d}) < ({hfov}) / 2.0 THEN ((CASE WHEN ({hfov}) >= 120 THEN {d} / (({hfov}) / 2.0) ELSE tan(radians({d})) / tan(radians({hfov}) / 2.0) END) + 1.0) * {width} / 2.0 END)"


def east(lat, lon, rlat, rlon):
    return f"(radians(({lon}) - ({rlon})) * {R} * cos(radians((({lat}) + ({rlat})) / 2.0)))"


def north(lat, rlat):
    return f"(radians(({lat}) - ({rlat})) * {R})"


def lat_of(n, rlat):
    return f"(({rlat}) + degrees(({n}) / {R}))"


def lon_of(e, n, rlat, rlon):
    return f"(({rlon}) + degrees(({e}) / ({R} * greatest(cos(radians(({lat_of(n, rlat)} + ({rlat})) / 2.0)), 1e-9))))"


def haversine(a, b, c, d):
    return f"(2 * {R} * asin(least(1.0, sqrt(pow(sin(radians(({c}) - ({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians(({d}) - ({b})) / 2), 2)))))"


def between(a, b, c, d):
    dl = f"radians(({d}) - ({b}))"
    return norm(f"degrees(atan2(sin({dl}) * cos(radians({c})), cos(radians({a})) * sin(radians({c})) - sin(radians({a})) * cos(radians({c})) * cos({dl})))")


CAMERA = """camera AS (SELECT s_suppkey AS camera_id, CAST(s_nationkey AS BIGINT) AS site_id, s_name AS name, 33.0::DOUBLE + (s_suppkey * 37 % 40) / 100.0::DOUBLE AS lat, -117.0::DOUBLE + (s_suppkey * 53 % 40) / 100.0::DOUBLE AS lon,
 CAST(s_suppkey * 47 % 360 AS DOUBLE) AS azimuth, CASE WHEN s_suppkey % 20 = 0 THEN 180.0::DOUBLE WHEN s_suppkey % 5 = 0 THEN 60.0::DOUBLE ELSE 90.0::DOUBLE END AS hfov,
 CASE WHEN s_suppkey % 2 = 1 THEN 'monochrome' ELSE 'color' END AS imager, s_suppkey % 17 <> 16 AS active, 40000.0::DOUBLE AS range_m FROM supplier)"""
READING = CAMERA + f""", reading AS (SELECT e.event_id, CAST(floor(epoch(e.ts)) AS BIGINT) AS epoch_s, e.user_id AS sequence, e.user_id % 20 AS date, c.camera_id, c.site_id, c.lat, c.lon, c.azimuth, c.hfov, c.active, c.range_m, e.event_type, e.props,
 CAST(e.event_id % 1024 AS DOUBLE) AS x, {bearing('CAST(e.event_id % 1024 AS DOUBLE)', '1024.0', 'c.azimuth', 'c.hfov')} AS bearing, e.event_id * 37 % 7200 - 3600 AS offset_s, least(e.value / 200.0, 1.0) AS confidence
 FROM events e JOIN camera c ON c.camera_id = e.user_id % (SELECT count(*) FROM supplier))"""
OBSERVATION = """observation AS (SELECT l_orderkey AS track_id, CAST(l_linenumber AS BIGINT) AS frame_index, l_orderkey % 50 AS camera_id, (l_linenumber * 60 + min(l_partkey) % 20) / 60.0::DOUBLE AS minute, min(l_quantity) AS area,
 CAST(300 - (min(l_partkey) % 90) AS DOUBLE) AS top_y, CAST(400 + min(l_suppkey) % 25 AS DOUBLE) AS base_cy, CAST(500 + min(l_suppkey) % 37 AS DOUBLE) AS base_cx, CAST(510 + min(l_partkey) % 41 AS DOUBLE) AS cx, CAST(350 + min(l_partkey) % 31 AS DOUBLE) AS cy,
 CAST(20 + min(l_partkey) % 60 AS DOUBLE) AS w, CAST(20 + min(l_suppkey) % 80 AS DOUBLE) AS h FROM lineitem GROUP BY l_orderkey, l_linenumber)"""
EVIDENCE = READING + ", evidence AS (SELECT camera_id, sequence, event_id, event_id * 7 % 768 AS cell, confidence FROM reading WHERE offset_s < 0)"
SWEEP = "sweep AS (SELECT x / 100.0::DOUBLE AS threshold FROM range(25, 70, 5) t(x))"
CLEAR = "CASE WHEN count(*) FILTER (WHERE offset_s < 0) >= 2 THEN (max(offset_s) FILTER (WHERE offset_s < 0) - min(offset_s) FILTER (WHERE offset_s < 0)) / 60.0::DOUBLE ELSE 0.0 END"


def pair(a: str, b: str) -> dict[str, str]:
    """Refusal, lat and lon of the crossing of rays a and b (table aliases with lat, lon, bearing, range_m)."""
    rlat, rlon = f"(({a}.lat + {b}.lat) / 2.0)", f"(({a}.lon + {b}.lon) / 2.0)"
    th = {t: f"radians({t}.bearing - ({t}.lon - {rlon}) * sin(radians({t}.lat)))" for t in (a, b)}
    o = {t: (east(f"{t}.lat", f"{t}.lon", rlat, rlon), north(f"{t}.lat", rlat)) for t in (a, b)}
    det = f"(sin({th[a]}) * cos({th[b]}) - cos({th[a]}) * sin({th[b]}))"
    wx, wy = f"({o[b][0]} - {o[a][0]})", f"({o[b][1]} - {o[a][1]})"
    s = f"(({wx} * cos({th[b]}) - {wy} * sin({th[b]})) / {det})"
    t = f"(({wx} * cos({th[a]}) - {wy} * sin({th[a]})) / {det})"
    ok = f"({fold(delta(f'{a}.bearing', f'{b}.bearing'))} >= 8.0 AND {s} > 0 AND {t} > 0 AND {s} <= {a}.range_m AND {t} <= {b}.range_m)"
    e, n = f"({o[a][0]} + sin({th[a]}) * {s})", f"({o[a][1]} + cos({th[a]}) * {s})"
    return {"ok": ok, "lat": lat_of(n, rlat), "lon": lon_of(e, n, rlat, rlon)}
