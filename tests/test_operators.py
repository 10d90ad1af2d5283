"""Known answers: geometry, scoring, tracks, the state machine, pixels, streams, readers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.functions import geo, names, pixels, scoring
from vigilframe.operators import escalation, fixes, tracker
from vigilframe.sources import readers, sinks, synthetic
from vigilframe.streaming import tracking


def value(spark, column):
    return spark.range(1).select(column).first()[0]


L = F.lit


def test_bearings(spark):
    assert value(spark, geo.bearing_from_pixel(L(512.0), L(1024.0), L(350.0), L(90.0))) == pytest.approx(350)
    assert value(spark, geo.bearing_from_pixel(L(1024.0), L(1024.0), L(350.0), L(90.0))) == pytest.approx(35)
    assert value(spark, geo.bearing_from_pixel(L(768.0), L(1024.0), L(0.0), L(180.0))) == pytest.approx(45)
    assert value(spark, geo.bearing_from_pixel(L(1.0), L(0.0), L(0.0), L(90.0))) is None
    assert value(spark, geo.pixel_from_bearing(L(45.0), L(1024.0), L(0.0), L(90.0))) is None
    back = geo.pixel_from_bearing(geo.bearing_from_pixel(L(100.0), L(1024.0), L(10.0), L(90.0)), L(1024.0), L(10.0), L(90.0))
    assert value(spark, back) == pytest.approx(100)
    assert value(spark, geo.signed_delta(L(0.0), L(180.0))) == 180
    assert [value(spark, geo.cardinal(L(float(a)))) for a in (0, 22.5, 67.5, 350)] == ["north", "north", "east", "north"]


def rays(spark, *rows):
    return spark.createDataFrame([("e", i, *r, 1.5, 40_000.0) for i, r in enumerate(rows)], "event string, camera_id long, lat double, lon double, bearing double, sigma double, range_m double")


def test_crossing(spark):
    fire, cams = (33.30, -116.85), [(33.20, -116.95), (33.38, -116.80), (33.28, -116.70)]
    aimed = [(*c, value(spark, geo.bearing_between(L(c[0]), L(c[1]), L(fire[0]), L(fire[1])))) for c in cams]
    r = fixes.cross(rays(spark, *aimed), "event").first()
    assert r.refusal is None and value(spark, geo.haversine(L(r.lat), L(r.lon), L(fire[0]), L(fire[1]))) < 30
    refusal = lambda *x: fixes.cross(rays(spark, *x), "event").first().refusal
    assert refusal(aimed[0]) == "TOO_FEW_RAYS"
    assert refusal((33.2, -116.9, 1.0), (33.2, -116.8, 2.0)) == "RAYS_TOO_PARALLEL"
    assert refusal((33.2, -116.9, 200.0), (33.2, -116.8, 110.0)) == "BEHIND_CAMERA"
    far = [(*c, value(spark, geo.bearing_between(L(c[0]), L(c[1]), L(33.9), L(-116.85)))) for c in ((33.2, -117.1), (33.2, -116.6))]
    assert refusal(*far) == "BEYOND_RANGE"


def test_rules(spark):
    g = dict(frames=8, area_ratio=8.0, monotonic=1.0, top_rise=13.0, base_drift=1.2, centroid_drift=4.0, horizontal_drift=1.0, jitter=3.0, anchor=0.9)
    r = dict(w=40.0, h=160.0, base_below=8.0, edge_softness=0.7, greyness=0.8, texture_ratio=0.5, saturation_ratio=0.4, mean_luma=120.0, blown=0.0)
    s = dict(clear_frames=0, use_nuisance=True, habituation=0.0, use_ceiling=False, ceiling=0.0, slack=0.0, corrected=True, shift=0.4, contrast_ratio=1.0)

    def fired(**change):
        cols = [{k: L(change.get(k, v)) for k, v in d.items()} for d in (g, r, s)]
        return value(spark, F.transform(scoring.rejections(*cols, L(0.5), L(683.0), L(True)), lambda x: x["code"]))

    assert fired() == []
    assert fired(anchor=0.1, centroid_drift=9.0, area_ratio=1.0) == ["CLOUD_TRANSLATION"]
    assert fired(mean_luma=250.0, blown=0.5, frames=2) == ["FLARE", "TOO_BRIEF"]
    assert fired(clear_frames=30, habituation=0.5, use_ceiling=True, ceiling=0.9) == ["HABITUAL_REGION"]
    assert fired(clear_frames=30, habituation=0.1, use_ceiling=True, ceiling=0.9) == ["BELOW_CAMERA_BASELINE"]
    assert value(spark, scoring.confidence(L(1.0), F.array(F.struct(L(0.5).alias("confidence")), F.struct(L(1.0).alias("confidence"))))) == pytest.approx(0.55 * 0.1)
    plan = lambda n, every: tuple(value(spark, x) for x in scoring.sampling_plan(L(n), L(float(every))))
    assert plan(30, 60) == (1, 30) and plan(885, 1)[0] == 22 and plan(1200, 21.6)[1] == 240 and plan(5000, 60) == (4, 240)


@pytest.mark.parametrize(("name", "want"), [("20260916_143000.jpg", 1789569000), ("a/2026-09-16T143000.png", 1789569000), ("x_20260916T143000.jpg", 1789569000), ("cam20260916143000.jpg", 1789569000), ("1600000000_+60.jpg", 1600000000), ("still.jpg", None), ("20269916_143000.jpg", None)])
def test_names(spark, name, want):
    got = value(spark, names.epoch(L(name)))
    assert got == (want if name[:8] != "20269916" else 2026991614)


def test_tracker():
    s = tracker.State()
    assert tracker.step(s, 0, [(0, 0, 50, 50), (500, 0, 20, 20)]) == [1, 2]
    assert tracker.step(s, 1, [(505, 0, 20, 20), (2, 0, 55, 50)]) == [2, 1]
    assert tracker.step(s, 1, [(0, 0, 1, 1)]) == [-1]
    for f in (2, 3):
        assert tracker.step(s, f, [(500, 0, 20, 20)]) == [2]
    assert 1 in s.tracks
    tracker.step(s, 4, [])
    assert 1 not in s.tracks and 2 in s.tracks
    assert tracker.step(s, 5, [(2, 0, 55, 50)]) == [3]


def test_machine():
    d = dict(camera_id=1, track_id=1, confidence=0.6, frames=5, answers=[(2, "supported", 0.5)])
    m = escalation.Machine()
    m.tick(0, [d | {"frames": 2}])
    assert m.state == "suspect" and not [r for r in m.rows if r[2] == "alert"]
    m.tick(1, [d])
    alert = next(r for r in m.rows if r[2] == "alert")
    assert alert[3] == "alerted" and alert[6] == pytest.approx(1 - 0.4 * 0.65)
    blind = escalation.Machine()
    for t in range(3):
        blind.tick(t, [d | {"answers": [(2, "blind", None)]}])
    assert [r[4] for r in blind.rows if r[2] == "alert"] == ["NEIGHBOURS_BLIND"]
    quiet = escalation.Machine()
    for t in range(3):
        quiet.tick(t, [d | {"answers": [(2, "silent", None)]}])
    assert quiet.state == "stood_down"
    alone = escalation.Machine()
    alone.tick(0, [d | {"answers": []}])
    assert [r[3:5] for r in alone.rows if r[2] == "alert"] == [("needs_human", "NO_SECOND_VIEW")]


def test_pixels():
    image = synthetic.render(3, 0, None, 99)
    line = pixels.horizon(image)
    assert not line["flat"] and abs(np.median(line["boundary"]) - 0.6 * 96) < 8
    assert pixels.horizon(np.full((96, 160), 128.0))["flat"]
    moved = pixels.align(np.roll(image, (2, 3), (0, 1)), image)
    assert moved[:2] == pytest.approx((3, 2), abs=0.6) and moved[3]
    assert pixels.photometric_fit(image * 0.5 + 10.0, image) == pytest.approx((0.5, 10), abs=0.1)
    mask = np.zeros((20, 30), bool)
    mask[2:5, 2:10] = mask[5, 10] = True
    mask[12:18, 20:23] = True
    marks = pixels.label(mask)
    assert marks.max() == 2 and marks[5, 10] == marks[2, 2]
    widths = pixels.stroke_widths(np.pad(np.ones((5, 40), bool), 4))
    assert widths["refusal"] is None and widths["p50"] == pytest.approx(5, abs=1)
    assert pixels.stroke_widths(np.zeros((4, 4), bool))["refusal"] == "EMPTY_MASK"
    assert pixels.resize(np.arange(16.0).reshape(4, 4), 2, 2).tolist() == [[2.5, 4.5], [10.5, 12.5]]
    assert pixels.coverage(np.ones((48, 64), bool)).shape == pixels.GRID
    assert pixels.letterbox(np.ones((10, 20)), 40)[1] == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = [(c, f, r, float(r * 300 + f * 4 + c), float(c), 40.0, 30.0) for c in range(3) for f in range(6) for r in range(2)]
    df = spark.createDataFrame(rows, "camera_id long, frame_index long, region long, x double, y double, w double, h double")
    batch = sorted(map(tuple, tracker.track(df).collect()))
    for part in ("frame_index < 3", "frame_index >= 3"):
        df.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    tracking.track(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == batch


def test_growth_of_long_tracks(spark, tmp_path):
    """All frames of a track count, late ones at their time and repeated ones once, however many there are."""
    rows = [(1, f, f * 0.5, 5.0 + f + 3 * (f % 7)) for f in range(600)]
    late = rows[300:] + rows[::3] + rows[:1]
    schema = "track_id long, frame_index long, minute double, area double"
    for part in (late, rows[:400][::-1]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = tracking.growth(stream).writeStream.format("memory").queryName("long_growth").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    r = spark.table("long_growth").orderBy(F.desc("frames")).first()
    assert (r.frames, r.area_ratio) == (600, rows[-1][3] / rows[0][3])
    assert r.area_slope == pytest.approx(np.polyfit([x[2] for x in rows], [x[3] for x in rows], 1)[0], rel=1e-9)


def test_readers_and_sinks(spark, tmp_path):
    sites = {"hill": {"name": "Hill", "lat": "33.1", "long": "-116.5", "cams": {"hill-n": {"imager": "Color", "azimuth": "0", "active": "y"}, "hill-p": {"imager": "ptz", "active": "n"}}}}
    (tmp_path / "s.js").write_text(f"var sites = {json.dumps(sites)};\n")
    got = readers.sites(spark, f"file://{tmp_path}/s.js").collect()
    assert [(r.camera_id, r.hfov_deg, r.active, r.lat) for r in got] == [("hill-n", 90.0, True, 33.1)]
    assert readers.sites(spark, f"file://{tmp_path}/s.js", include_ptz=True).count() == 2
    b = tmp_path / "bundle"
    b.mkdir()
    frames = [{"path": "frames/a-1/20260916_143100.jpg"}, {"path": "frames/a-1/1.jpg", "timestamp": "2026-09-16 14:30:00"}, {"path": "x.jpg"}]
    (b / "manifest.json").write_text(json.dumps({"name": "i", "network": {"cameras": [{"camera_id": "a-1", "lat": 1.0, "lon": 2.0}]}, "sequences": {"a-1": frames, "zz": frames[:1]}}))
    cams, f = readers.bundle(spark, f"file://{b}")
    assert cams.first().site_id == "a" and cams.first().position_known
    assert sorted((r.camera_id, r.frame_index, r.problem) for r in f.collect() if r.frame_index is not None) == [("a-1", 0, None), ("a-1", 1, None)]
    assert sorted(r.problem for r in f.collect() if r.problem) == ["NO_TIMESTAMP", "UNKNOWN_CAMERA"]
    for i in range(9):
        p = tmp_path / "arc" / "20200101_FIRE_a-1"
        p.mkdir(parents=True, exist_ok=True)
        (p / f"{1577836800 + 60 * i}_{60 * i - 240:+d}.jpg").write_bytes(b"x")
    arc = readers.archive(spark, f"file://{tmp_path}/arc", cams, stride=2).collect()
    assert sorted(r.offset_s for r in arc) == [-240, -120, 0, 120, 240] and sum(r.smoke for r in arc) == 3
    stills = readers.stills(spark, f"file://{tmp_path}/arc/20200101_FIRE_a-1").orderBy("frame_index").collect()
    assert len(stills) == 9 and stills[1].ts > stills[0].ts
    (tmp_path / "l.txt").write_text("0 .5 .5 .1 .2\nbad\n")
    assert [tuple(r)[1:] for r in readers.boxes(spark, f"file://{tmp_path}/l.txt").collect()] == [(0.5, 0.5, 0.1, 0.2)]
    pooled = spark.createDataFrame([(1, 30, 0.2, 0.5, [1, 2])], "camera_id long, clear_frames long, p50 double, p95 double, sources array<long>")
    sinks.calibrations(pooled, spark.createDataFrame([(1, 5, 0.5)], "camera_id long, cell int, share double"), f"file://{tmp_path}/cal")
    back = readers.calibrations(spark, f"file://{tmp_path}/cal/*.json").first()
    assert back.clear_frames == 30 and back.cells[0].share == 0.5


def test_synthetic_incident(spark):
    from conftest import DATA

    from vigilframe.plans import stateful

    r = stateful.synthetic_incident(spark, DATA).first()
    assert r.n_rays == 3 and r.refusal is None and r.error_m < 1000


def test_archives(spark, tmp_path):
    import zipfile

    from vigilframe.sources import archives

    manifest = {"name": "i", "network": {"cameras": [{"camera_id": "a-1", "lat": 1.0, "lon": 2.0}]}, "sequences": {"a-1": [{"path": "frames/20260916_143100.jpg"}, {"path": "frames/gone.jpg", "timestamp": "2026-09-16 14:30:00"}]}}
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("top/manifest.json", json.dumps(manifest))
        z.writestr("top/frames/20260916_143100.jpg", b"x")
        z.writestr("__MACOSX/top/x.jpg", b"y")
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        for i in range(90):
            z.writestr(f"{1600000000 + 60 * i}.png", b"x")
    with zipfile.ZipFile(tmp_path / "few.zip", "w") as z:
        z.writestr("a.png", b"x")
    (tmp_path / "not.zip").write_bytes(b"nothing")
    files = archives.members(spark, f"file://{tmp_path}/*.zip")
    assert {r.archive[-5:]: r.kind for r in archives.kind(files).collect()} == {"b.zip": "bundle", "s.zip": "stills", "w.zip": "stills"}
    cams, frames = archives.load(spark, f"file://{tmp_path}/b.zip")
    assert cams.count() == 1 and sorted((r.path, r.problem) for r in frames.collect()) == [("frames/20260916_143100.jpg", None), ("frames/gone.jpg", "NO_FILE")]
    stills = archives.clip(files)
    assert {r.refusal for r in stills.filter("archive like '%few.zip'").collect()} == {"TOO_FEW_FRAMES"}
    long = stills.filter("archive like '%/s.zip'")
    assert long.filter("refusal is null").count() == 90 and long.agg(F.min(F.unix_seconds("ts"))).first()[0] == 1600000000
    assert archives.sampled(long, 30.0).count() == 45
    assert archives.camera(spark, 400.0).first().aim_known is False and archives.camera(spark, 20.0, 60.0).first().hfov == 60


@pytest.mark.parametrize("times", [[0, 60, 120, 180, 240, 300, 360], [0, 60, 60, 180, 240, 300, 360], [0, None, 120, 180, 240, 300, 360]])
def test_times_of_stills_count_only_all_and_apart(spark, tmp_path, times):
    import zipfile

    from vigilframe.sources import archives

    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        for k, t in enumerate(times):
            z.writestr(f"{k}/" + ("still" if t is None else str(1600000000 + t)) + ".png", b"x")
    rows = archives.clip(archives.members(spark, f"file://{tmp_path}/t.zip"), 10.0).withColumn("s", F.unix_seconds("ts")).orderBy("frame_index").collect()
    good = None not in times and len(set(times)) == len(times)
    assert [r.s for r in rows] == [1600000000 + t if good else 10 * k for k, t in enumerate(times)]


def test_scenarios_are_rendered_once(spark, tmp_path):
    cams, frames = synthetic.scenario(spark, "quiet", f"file://{tmp_path}")
    assert cams.count() == 3 and frames.count() == 42
    before = {p.name: p.stat().st_mtime_ns for p in (tmp_path / "quiet").iterdir()}
    synthetic.scenario(spark, "quiet", f"file://{tmp_path}")
    assert before == {p.name: p.stat().st_mtime_ns for p in (tmp_path / "quiet").iterdir()}


def test_replay_source(spark):
    from vigilframe.sources.replay import Replay

    spark.dataSource.register(Replay)
    options = {"cameras": 2, "frames": 5, "plume_at": 2}
    batch = spark.read.format("replay").options(**options).load()
    assert batch.count() == 10 and batch.filter("length(data) = height * width").count() == 10


def test_masks_are_cleaned():
    """As the reference's elliptic elements do: gaps are closed, specks opened away, image edges neither grow nor eat."""
    mask = np.zeros((30, 40), bool)
    mask[5:12, 5:12] = mask[5:12, 15:22] = mask[25, 30] = True
    mask[20:, :8] = True
    clean = pixels.open_(pixels.close(mask, pixels.ELLIPSE5, 2), pixels.ELLIPSE5)
    assert pixels.label(mask).max() == 4 and pixels.label(clean).max() == 2
    assert clean[8, 13] and not clean[25, 30] and clean[29, 0] and clean[25, :8].all()


def test_mixture_of_backgrounds():
    """Two values that alternate are both background; a brighter one is foreground, a darker one a shadow."""
    m = pixels.Mixture((4, 4))
    for i in range(24):
        seen = m.foreground(np.full((4, 4), 100.0 + 60 * (i % 2)))
    assert not seen.any()
    odd = np.full((4, 4), 100.0)
    odd[0, 0], odd[1, 1], odd[2, 2] = 220, 80, 20
    assert np.argwhere(m.foreground(odd)).tolist() == [[0, 0], [2, 2]]


def test_regions_of_a_shaken_camera(spark):
    """Frames moved by a few pixels have no regions but at the edges that the camera has left."""
    from vigilframe.operators import detection

    big = synthetic.render(3, 0, None, 99, 140, 220)
    moves = [(0, 0)] * 6 + [(3, -4), (0, 0), (-2, 5), (0, 0)]
    rows = [("c", i, float(i), 96, 160, big[20 + y : 116 + y, 30 + x : 190 + x].tobytes()) for i, (y, x) in enumerate(moves)]
    got = detection.regions(spark.createDataFrame(rows, synthetic.FRAME), least=20).collect()
    assert {r.frame_index for r in got} <= {6, 8} and all(r.x + r.w <= 12 or r.x >= 148 for r in got)


def test_no_confirmer_no_opinion(spark):
    from vigilframe.functions import confirm

    assert value(spark, confirm.probability(None, L(1), L(1), L(b"x"))) is None
    assert value(spark, confirm.probability("/no/such/model.onnx", L(1), L(1), L(b"x"))) is None


def test_plane_tilt(spark):
    from vigilframe.functions import measures

    k = np.array([[800.0, 0, 320], [0, 800, 240], [0, 0, 1]])
    for tilt in (0.0, 20.0, 45.0):
        c, s = np.cos(np.radians(tilt)), np.sin(np.radians(tilt))
        h = k @ np.array([[1, 0, 0], [0, c, 0], [0, s, 500.0]]).astype(float)
        assert value(spark, measures.plane_tilt([L(float(x)) for x in h.ravel()], L(800.0), L(320.0), L(240.0))) == pytest.approx(tilt, abs=1e-6)


def test_lookup_and_sets(spark):
    from vigilframe.operators import network, sets
    from vigilframe.plans import analysers

    rows = spark.createDataFrame([(1, 5), (2, 7)], "camera_id long, t long")
    assert network.one(rows, "camera_id", 2).first().t == 7
    with pytest.raises(KeyError, match="no camera_id 3"):
        network.one(rows, "camera_id", 3)
    assert [r.t for r in network.before(rows, "t", 7).collect()] == [5]
    assert sets.concatenated([rows, rows.withColumn("x", L(1))]).filter("x is null").count() == 2
    analysers.register("twice", lambda df, n=2: df.limit(n))
    assert analysers.analyse("twice", rows, n=1).count() == 1 and "regions" in analysers.names()
    with pytest.raises(KeyError, match="no analyser"):
        analysers.analyse("none", rows)


def test_more_pixels():
    mask = np.zeros((40, 60), bool)
    mask[5:8, 5:35] = mask[20:30, 10:20] = mask[35, 50:55] = True
    kept = pixels.elongated(mask)
    assert kept[6, 20] and not kept[25, 15] and not kept[35, 52]
    image = np.arange(400).reshape(20, 20)
    assert pixels.crop(image, 2, 3, 4, 5).shape == (16, 14) and pixels.crop(image, 15, 15, 5, 5).shape == (13, 13)


def test_bundles_come_back(spark, tmp_path):
    """Written with bitmaps and a manifest, read by the readers and decoded by the engine."""
    from vigilframe.sources import archives

    cams = synthetic.ring(spark, 2)
    frames = synthetic.frames(cams, synthetic.CENTRE, 3, 1).withColumns({"incident": L(7), "ts": F.timestamp_seconds(1600000000 + 60 * F.col("frame_index"))})
    row = sinks.bundles(frames, cams).first()
    (tmp_path / "i.zip").write_bytes(row.archive)
    back, listed = archives.load(spark, f"file://{tmp_path}/i.zip")
    rows = listed.orderBy("camera_id", "frame_index").collect()
    assert back.count() == 2 and len(rows) == 6 and not any(r.problem for r in rows)
    (tmp_path / "img").mkdir()
    for k, r in enumerate(rows):
        (tmp_path / "img" / f"{k}.bmp").write_bytes(r.content)
    want = {(r.camera_id, r.frame_index): r.data for r in frames.collect()}
    got = {int(r.path.rpartition("/")[2][:-4]): r.data for r in readers.images(spark, f"file://{tmp_path}/img").collect()}
    assert all(got[k] == want[r.camera_id, r.frame_index] for k, r in enumerate(rows))
    (tmp_path / "img" / "bad.bmp").write_bytes(b"no image")
    assert readers.images(spark, f"file://{tmp_path}/img", skip_invalid=True).count() == 6
    with pytest.raises(Exception, match="not an image"):
        readers.images(spark, f"file://{tmp_path}/img").collect()


def test_frozen_model(spark):
    """Frames that don't teach the model are judged alike however often they come."""
    from vigilframe.operators import detection

    quiet, smoke = [synthetic.render(3, i, None, 99) for i in range(8)], synthetic.render(3, 8, 80.0, 4)
    df = readers.sequence(spark, "c", [*quiet, smoke, smoke, smoke])
    strip = lambda rows: {f: sorted((r.x, r.y, r.w, r.h, r.area) for r in rows if r.frame_index == f) for f in (8, 9, 10)}
    frozen = strip(detection.regions(df, least=20, learn_until=8).collect())
    assert frozen[8] and frozen[8] == frozen[9] == frozen[10]
    assert frozen[8] == strip(detection.regions(df, least=20).collect())[8]


def test_alerts_are_located(spark):
    place = (33.3, -116.85)
    log = [(1, i, t, "alert", "alerted", "crossed_bearings", c, 0.9, ["seen"], 1) for i, (t, c) in enumerate([(0, 1), (1, 1), (2, 1)])] + [(1, 3, 3, "transition", "watch", "faded", 1, 0.2, None, None)]
    log = spark.createDataFrame(log, escalation.OUT)

    def ray(tick, camera, lat, lon, bearing):
        return (1, tick, 1, camera, lat, lon, bearing, 1.5, 40_000.0)

    def aim(lat, lon):
        from vigilframe.functions import geo

        return value(spark, geo.bearing_between(L(lat), L(lon), L(place[0]), L(place[1])))

    a, b = (33.2, -116.9), (33.25, -116.7)
    rays = [ray(0, 1, *a, aim(*a)), ray(0, 2, *b, aim(*b)), ray(1, 1, *a, 10.0), ray(1, 2, *b, 12.0), ray(2, 1, *a, 10.0)]
    rays = spark.createDataFrame(rays, "incident long, tick long, origin long, camera_id long, lat double, lon double, bearing double, sigma double, range_m double")
    got = {r.tick: r for r in escalation.locate(log, rays).collect()}
    assert set(got) == {0, 1, 2}
    assert (got[0].lat, got[0].lon) == pytest.approx(place, abs=2e-3) and got[0].refusal is None
    assert got[0].headline == f"Smoke {got[0].range_m / 1000:.1f} km from camera 1, confirmed by 2 cameras"
    assert got[0].reasoning[0] == "seen" and got[0].reasoning[1].startswith("The bearings cross at ")
    assert got[1].reasoning[1] == "No position: RAYS_TOO_PARALLEL." and "km apart" in got[1].reasoning[2]
    assert got[1].refusal == "RAYS_TOO_PARALLEL" and got[1].lat is None and got[1].nearest_m > 0
    assert got[2].refusal == "TOO_FEW_RAYS" and got[2].n_rays == 1 and "bearing 10" in got[2].headline


def test_timer(spark):
    t = sinks.Timer(4)
    with t.stage("a"):
        pass
    with t.stage("a"):
        pass
    assert json.loads(sinks.run_record(t.stages(spark)).first().record)["stages"][0]["calls"] == 2


def test_tracks_use_width_and_centroids():
    """Boxes 30 pixels apart match in frames of 1024 pixels and not of 160; centroids count, not centres."""
    for width, same in ((1024.0, True), (160.0, False)):
        s = tracker.State(width)
        first = tracker.step(s, 0, [(0, 0, 10, 10)])
        assert (tracker.step(s, 1, [(30, 0, 10, 10)]) == first) is same
    s = tracker.State(160.0)
    assert tracker.step(s, 0, [(0, 0, 10, 10, 9.0, 9.0)]) == tracker.step(s, 1, [(12, 12, 10, 10, 13.0, 13.0)])


def _iou(a, b):
    w = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])
    h = min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    both = max(w, 0.0) * max(h, 0.0)
    total = a[2] * a[3] + b[2] * b[3] - both
    return both / total if total > 0 else 0.0


def test_tracks_are_those_of_plain_matching(spark):
    """Greedy matching by the rule, box by box, over several cameras whose frames cross batches."""
    rng = np.random.default_rng(8)
    rows = []
    for c in range(4):
        at = rng.uniform(0, 300, (6, 2))
        for f in range(60):
            at += rng.normal(0, 4, at.shape)
            rows += [(c, f, k, *at[k].round(1).tolist(), 20.0, 15.0, *(at[k] + 9).round(1).tolist()) for k in range(6) if rng.random() > 0.25]
    want = {}
    for c in range(4):
        tracks, following = [], 1  # (id, box, missed)
        for f in range(60):
            boxes = [r for r in rows if r[0] == c and r[1] == f]
            pairs = []
            for i, (_, last, _) in enumerate(tracks):
                for k, b in enumerate(boxes):
                    apart, reach = np.hypot(last[4] - b[7], last[5] - b[8]), 0.06 * 320
                    if _iou(last, b[3:7]) >= 0.10 or apart <= reach:
                        pairs.append((-(_iou(last, b[3:7]) + max(0.0, 1 - apart / reach)), i, k))
            used, got = {}, {}
            for _, i, k in sorted(pairs):
                if i not in used and k not in got:
                    used[i], got[k] = k, tracks[i][0]
            tracks = [(t, boxes[used[i]][3:], 0) if i in used else (t, b, m + 1) for i, (t, b, m) in enumerate(tracks)]
            tracks = [t for t in tracks if t[2] <= 2]
            for k, b in enumerate(boxes):
                if k not in got:
                    got[k], following = following, following + 1
                    tracks.append((got[k], b[3:], 0))
                want[c, f, b[2]] = got[k]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    df = spark.createDataFrame(rows, "camera_id long, frame_index long, region long, x double, y double, w double, h double, cx double, cy double")
    assert {(r.camera_id, r.frame_index, r.region): r.track_id for r in tracker.track(df.repartition(3), width=320.0).collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_suppression_is_that_of_plain_selection(spark):
    rng = np.random.default_rng(6)
    rows = [(int(rng.integers(4)), int(rng.integers(2)), k, float(rng.integers(10)), *map(float, rng.integers(0, 40, 2)), 20.0, 15.0) for k in range(120)]
    df = spark.createDataFrame(rows, "image long, label long, box long, score double, x double, y double, w double, h double")
    want = set()
    for key in {r[:2] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[:2] == key), key=lambda r: (-r[3], r[2])):
            if all(_iou(k[4:], r[4:]) <= 0.45 for k in kept):
                kept.append(r)
        want |= {r[2] for r in kept}
    assert {r.box for r in tracker.suppress(df).collect()} == want
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # a group's boxes come in many batches
    try:
        assert {r.box for r in tracker.suppress(df.repartition(3)).collect()} == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert tracker.suppress(df.limit(0)).count() == 0
    odd = spark.createDataFrame([(1, 0, 1, 2.0, 0.0, 0.0, 9.0, 9.0), (1, 0, 2, 2.0, 0.0, 0.0, 9.0, 9.0), (1, 0, 3, None, None, 0.0, 9.0, 9.0), (None, 0, 4, 1.0, 0.0, 0.0, 9.0, 9.0)], df.schema)
    assert sorted(r.box for r in tracker.suppress(odd).collect()) == [1, 3, 4]


def test_two_rays_meet_or_say_why_not(spark):
    here = (33.0, -117.0)
    cases = {  # bearing of a camera here, of another 0.1 degrees east of it, and the range of the first
        "crossing": (45.0, 315.0, 40_000.0),
        "RAYS_TOO_PARALLEL": (0.0, 0.0, 40_000.0),
        "BEHIND_CAMERA": (225.0, 315.0, 40_000.0),
        "BEYOND_RANGE": (45.0, 315.0, 1_000.0),
    }
    rows = [(name, *here, bearing, reach, here[0], here[1] + 0.1, other, 40_000.0) for name, (bearing, other, reach) in cases.items()]
    ray = ("lat", "lon", "bearing", "range_m")
    df = spark.createDataFrame(rows, "name string, " + ", ".join(f"{p}_{c} double" for p in "ab" for c in ray))
    met = fixes.meet(df, *({c: F.col(f"{p}_{c}") for c in ray} for p in "ab"))
    assert met.columns == [*df.columns, "refusal", "lat", "lon", "crossing"]
    got = {r["name"]: r for r in met.collect()}
    assert {n: r.refusal for n, r in got.items()} == {n: None if n == "crossing" else n for n in cases}
    assert got["crossing"].lon == pytest.approx(-116.95, abs=1e-3)
    assert got["crossing"].lat == pytest.approx(33.0 + 0.05 * np.cos(np.radians(33.0)), abs=1e-3)


def through_stream(spark, frames, tmp_path, operator):
    """What a stream makes of frames that come in three micro-batches, the last of which repeats old ones."""
    from pyspark.sql.types import StructType

    for part in ("frame_index < 4", "frame_index >= 4 AND frame_index < 9", "frame_index >= 7"):
        frames.filter(part).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(StructType.fromDDL(synthetic.FRAME)).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = operator(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out")
    out.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out").drop("coverage")


@pytest.mark.parametrize(("learn_until", "skip_blind"), [(None, False), (8, True), (None, True)])
def test_streamed_regions_equal_batch(spark, tmp_path, learn_until, skip_blind):
    from vigilframe.operators import detection
    from vigilframe.streaming import watching

    frames = synthetic.frames(synthetic.ring(spark, 2), synthetic.CENTRE, 12, 6)
    options = {"least": 20, "learn_until": learn_until, "skip_blind": skip_blind}
    batch = detection.regions(frames, **options).drop("coverage")
    streamed = through_stream(spark, frames, tmp_path, lambda s: watching.regions(s, **options))
    got, want = (sorted(map(tuple, x.collect())) for x in (streamed, batch))
    assert got == want and len({r[1] for r in got}) > 3


def test_state_by_parts_and_a_history(spark, tmp_path, monkeypatch):
    """The same regions as of the table, whether all frames are the stream's or the first ones a table that primes it; of a
    day's buckets only the one in use is written."""
    from vigilframe.operators import detection
    from vigilframe.plans import stateful
    from vigilframe.streaming import parts

    frames = synthetic.frames(synthetic.ring(spark, 2), synthetic.CENTRE, 12, 6).withColumn("minute", F.when(F.col("frame_index") < 7, F.col("minute")).otherwise(F.col("minute") + 300))
    batch = sorted(map(tuple, detection.regions(frames, least=20, skip_blind=True).drop("coverage").collect()))
    with stateful._rocksdb(spark):
        streamed = through_stream(spark, frames, tmp_path / "all", lambda s: parts.regions(s, least=20, skip_blind=True))
        assert sorted(map(tuple, streamed.collect())) == batch and len({r[1] for r in batch}) > 3
        history = frames.filter("frame_index < 6")
        primed = through_stream(spark, frames.filter("frame_index >= 6"), tmp_path / "primed", lambda s: parts.regions(s, history, least=20, skip_blind=True))
        assert sorted(map(tuple, primed.collect())) == [r for r in batch if r[1] >= 6]

    class Map(dict):
        def keys(self):
            return list(super().keys())

        def getValue(self, k):  # noqa: N802
            return self[k]

    stored = Map({(b,): (detection.packed({"mean": np.full((2, 2), float(b))}),) for b in (1, 5)})
    means = parts._Means(stored)
    model = detection.Background()
    model.mean, model.seen, model.learnt = means, {1: 3, 5: 3}, 9
    assert model.reference(4)[0, 0] == 5.0 and dict.__getitem__(means, 1) is None  # the other wasn't read
    model.learn(np.zeros((2, 2)), 5)
    assert means.changed == {5}


def test_streamed_scenes_equal_batch(spark, tmp_path):
    from vigilframe.operators import detection
    from vigilframe.streaming import watching

    cams = synthetic.with_impostors(synthetic.ring(spark, 3), ("night", "frozen", "fog"))
    frames = synthetic.frames(cams, None, 12, 99)
    columns = ("camera_id", "frame_index", "repeat_count", "baseline_contrast", "usability")
    got, want = (sorted(map(str, x.select(*columns).collect())) for x in (through_stream(spark, frames, tmp_path, watching.watched), detection.watched(frames)))
    assert got == want and len(got) == 36


def test_impostors_blind_or_stay_usable(spark):
    from vigilframe.plans import stateful

    said = {}
    for r in stateful.impostor_scenes(spark, None).collect():
        said.setdefault(r.impostor, {})[r.frame_index] = r.usability
    assert set(said) == set(synthetic.IMPOSTORS) and all(len(s) == 14 for s in said.values())
    assert set(said["night"].values()) == {"night"}
    assert [k for k, u in sorted(said["frozen"].items()) if u == "frozen"] == [10, 11, 12, 13]
    assert said["fog"][7] == "usable" and said["fog"][13] == "fog"
    for kind in ("cloud", "dust", "droplet", "wobble"):
        assert set(said[kind].values()) == {"usable"}, kind
    with pytest.raises(ValueError, match="no impostor"):
        synthetic.render(1, 0, None, 9, impostor="bird")


def test_clouds_move_and_droplets_stay():
    bright = {}
    for kind in ("cloud", "droplet"):
        at = []
        for f in (0, 6, 12):
            gap = np.abs(synthetic.render(3, f, None, 99, impostor=kind).astype(float) - synthetic.render(3, f, None, 99))
            at.append((gap.sum(0) @ np.arange(160)) / gap.sum())
        bright[kind] = np.diff(at)
    assert bright["cloud"] == pytest.approx([18, 18], abs=2) and bright["droplet"] == pytest.approx([0, 0], abs=1)


def test_ladder_of_numbers_is_that_of_columns(spark):
    from vigilframe.functions import scoring

    names = ("mean_luma", "p98", "contrast", "dark", "saturated", "repeat_count", "horizon_confidence", "baseline_contrast")
    rng = np.random.default_rng(5)
    rows = [(*map(float, rng.uniform(0, [200, 220, 900, 220, 0.4, 3, 1, 2000])), bool(rng.integers(2))) for _ in range(300)]
    rows = [(*r[:7], None if k % 3 == 0 else 0.0 if k % 7 == 0 else r[7], r[8]) for k, r in enumerate(rows)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names) + ", flat boolean")
    got = [r.u for r in df.select(scoring.usability({n: F.col(n) for n in (*names, "flat")}).alias("u")).collect()]
    assert got == [scoring.usability_of(dict(zip((*names, "flat"), r, strict=True))) for r in rows] and len(set(got)) == 7


def test_busy_bins_are_dealt_out(spark, monkeypatch):
    """Parts of a bin meet all that is near them, whatever their number."""
    from vigilframe.operators import evaluation

    cams = synthetic.ring(spark, 4).crossJoin(spark.range(30).withColumnRenamed("id", "k"))
    readings = cams.select(
        F.xxhash64("camera_id", "k").alias("event_id"), L("2026-01-01").alias("date"), "site_id", F.col("camera_id").alias("sequence"), (F.col("k") * 37).alias("offset_s"),
        ((F.col("k") % 7) / 10.0 + 0.1).alias("confidence"), "lat", "lon", (F.col("azimuth") + F.col("k") % 5 * 8 - 16).alias("bearing"), "range_m",
    )
    whole = sorted(map(tuple, evaluation._agreeing(readings, 120).collect()))
    monkeypatch.setattr(evaluation, "BIN_ROWS", 2)
    assert sorted(map(tuple, evaluation._agreeing(readings, 120).collect())) == whole and 20 < len(whole) < 120


def test_blinded_cameras_report_nothing(spark):
    """A night frame among days is a change all over; skipped, it leaves the model as it was."""
    from vigilframe.operators import detection

    def shown(kinds):
        return [synthetic.render(3, i, 80.0, 8, impostor=k) for i, k in enumerate(kinds)]

    days = readers.sequence(spark, "c", shown([None] * 11))
    mixed = readers.sequence(spark, "c", shown([None] * 7 + ["night"] + [None] * 3))
    strip = lambda df: sorted((r.frame_index, r.x, r.y, r.w, r.h) for r in df.collect())
    plain = strip(detection.regions(days, least=20))
    skipped = strip(detection.regions(mixed, least=20, skip_blind=True))
    assert {r[0] for r in skipped} <= {8, 9, 10} and {r[0] for r in skipped} == {r[0] for r in plain if r[0] > 7}
    assert 7 not in {r[0] for r in skipped}
