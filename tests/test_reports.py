"""Reports, sentences, wire forms, skylines and uploads, against plain Python."""

import datetime

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F
from test_escalation import random_incident, sweeps

from vigilframe.functions import pixels, sentences, skyline, wire
from vigilframe.operators import escalation, evaluation, tracks
from vigilframe.sources import uploads

FILES = "archive string, path string, decodable boolean"
ASKED = "archive string, bearing_deg string, hfov_deg string, interval_s string"


def test_halves_go_to_the_even_digit(spark):
    values = [0.5, 1.5, -0.5, 2.5, 0.125, 0.375, 2.675, 0.1 + 0.2, None, float("nan"), float("inf")]
    got = spark.createDataFrame([(x,) for x in values], "x double").select(wire.even(F.col("x")).alias("a"), wire.even(F.col("x"), 2).alias("b")).collect()
    assert [r.a for r in got] == [0.0, 2.0, -0.0, 2.0, 0.0, 0.0, 3.0, 0.0, None, None, None]
    assert [r.b for r in got] == [0.5, 1.5, -0.5, 2.5, 0.12, 0.38, 2.68, 0.3, None, None, None]


def test_a_wire_form_needs_all_its_columns(spark):
    with pytest.raises(Exception, match="semi_major_m|UNRESOLVED"):
        wire.shaped(spark.createDataFrame([(1, 2.0)], "k int, lat double"), wire.FIX, "k").collect()


def test_a_horizon_over_the_wire(spark):
    got = pixels.horizon(np.vstack([np.full((60, 80), 200.0), np.full((40, 80), 60.0)]).astype(np.uint8)[..., None].repeat(3, 2))
    row = (1, got["boundary"].tolist(), got["confidence"], got["sky"], int(got["threshold"]), got["flat"])
    df = spark.createDataFrame([row], "k int, boundary array<int>, confidence double, sky double, threshold int, flat boolean")
    r = wire.shaped(df.select("*", *(v.alias(k) for k, v in skyline.shape(F.col("boundary")).items())), wire.HORIZON, "k").first()
    assert list(r.asDict()) == ["k", *wire.HORIZON] and (r.sky_fraction, r.median_row, r.relief_px) == (round(got["sky"], 3), int(np.median(got["boundary"])), 0)


def test_first_and_last_aspects(spark):
    rows = [(1, 2, 0.0, 9.0), (1, 0, 4.0, 2.0), (1, 1, 5.0, 5.0), (2, 5, 2.0, 3.0)]
    got = tracks.aspects(spark.createDataFrame(rows, "track_id int, frame_index int, w double, h double"))
    assert {tuple(r) for r in got.collect()} == {(1, 0.5, 9.0), (2, 1.5, 1.5)}


def test_skylines_as_columns_and_as_masks(spark):
    rng = np.random.default_rng(3)
    lines = [rng.integers(0, 41, n).tolist() for n in (1, 2, 7, 64)] + [[0, 0, 0], [40, 40], []]
    b, h = F.col("b"), F.lit(40)
    points = [(-3.0, 5.0), (0.4, 40.0), (2.5, 0.0), (900.0, 7.5)]
    out = {"sky": skyline.sky_pixels(b, h, 2), "band": skyline.band_pixels(b, h, 6, 3), **skyline.shape(b)}
    above = F.array(*(skyline.height_above(b, F.lit(x), F.lit(y)) for x, y in points)).alias("above")
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, b array<int>").select("i", *(v.alias(k) for k, v in out.items()), above).orderBy("i").collect()
    for line, r in zip(lines, rows, strict=True):
        a = np.array(line)
        assert r.sky == pixels.sky_mask(a, 40, 2).sum() and r.band == pixels.band_mask(a, 40, 6, 3).sum()
        if line:
            assert r.median_row == int(np.median(a)) and r.relief_px == int(round(np.percentile(a, 95) - np.percentile(a, 5), 9))
            assert r.above == [float(line[int(np.clip(round(x), 0, len(line) - 1))] - y) for x, y in points]
        else:
            assert (r.median_row, r.relief_px, r.above) == (None, None, [None] * 4)


def test_reasons_without_colour_leave_it_out_and_ties_keep_their_order(spark):
    names = list(sentences.WEIGHTS)
    terms = {k: F.lit(1.0 if k in ("desaturation", "soft_edges") else 0.0) for k in names}
    texts = {k: F.lit(k) for k in names}
    got = spark.range(1).select(*(sentences.strongest(terms, F.lit(c), texts, 3).alias(n) for c, n in ((True, "colour"), (False, "grey")))).first()
    assert got.colour == ["soft_edges", "desaturation", "growth"] and got.grey == ["soft_edges", "growth", "rise"]


def test_a_detection_without_reasons_or_objections(spark):
    none = F.array().cast("array<string>")
    said = [sentences.detection(F.lit(v), F.lit(aim), F.lit(12.25), F.lit(0.125), because, against).alias(f"c{i}") for i, (v, aim, because, against) in enumerate([
        ("column", True, none, F.lit(None).cast("string")), ("suspect", False, F.array(F.lit("a"), F.lit("b")), F.lit("c")), ("clear", False, none, F.lit("d"))])]
    assert list(spark.range(1).select(*said).first()) == [
        "A column at bearing 12.2 degrees: no positive evidence.", "Something at 12% across the frame: a; b. Against it: c.", "Nothing worth calling at 12% across the frame: no positive evidence. Against it: d.",
    ]


READ = "event_id long, sequence long, camera_id long, offset_s long, confidence double, bearing double, unusable string, warmed boolean, ms double, rejections array<string>"


def test_a_report_counts_believed_frames_only(spark):
    rows = [
        (1, 1, 1, -120, 0.9, 1.0, None, False, 10.0, ["A"]), (2, 1, 1, -60, 0.9, 1.0, "fog", True, 20.0, ["A"]), (3, 1, 1, 60, 0.9, 1.0, None, True, 30.0, ["B", "A", None]),
        (4, 2, 1, -60, 0.8, None, None, True, 0.0, []), (5, 2, 1, 0, 0.8, 2.0, "night", True, 0.0, None), (6, 2, 1, 30, None, 2.0, None, True, None, ["B"]), (7, 3, 2, 5, 0.1, 2.0, "fog", True, None, ["C"]),
    ]
    r = evaluation.report(spark.createDataFrame(rows, READ)).first()
    assert (r.sequences, r.frames, r.detected, r.missed, r.alerts, r.before_mark, r.false_frames, r.clear_frames) == (3, 7, 1, 2, 1, 0, 1, 3)
    assert [tuple(x) for x in r.unusable_frames] == [("fog", 2), ("night", 1)] and [tuple(x) for x in r.rejections_fired] == [("B", 2), ("A", 1)]
    assert (r.median_ms, r.max_ms, r.threshold, r.detection_rate) == (20.0, 20.0, 0.45, pytest.approx(1 / 3))
    e = evaluation.report(spark.createDataFrame([], READ)).first()
    assert (e.sequences, e.frames, e.detection_rate, e.median_s, e.unusable_frames, e.rejections_fired, e.median_ms, e.per_camera_day) == (0, 0, 0.0, None, [], [], None, 0.0)


def test_records_say_what_the_log_says(spark):
    incidents = {i: random_incident(i) for i in range(80)}
    table = sweeps(spark, incidents).drop("at")
    log = {}
    for row in sorted(escalation.escalate(table, True, 2).collect(), key=lambda r: (r.incident, r.seq)):
        log.setdefault(row.incident, []).append(row)
    got = {r.incident: r for r in escalation.records(table, True, 2).collect()}
    assert set(got) == {i for i, own in incidents.items() if own} and any(r.stopped_early for r in got.values()) and not all(r.stopped_early for r in got.values())
    for i, r in got.items():
        own = log.get(i, [])
        alerts = [x for x in own if x.kind == "alert"]
        ends = next((x.tick for x in alerts[1:2]), None)  # with its second alert
        asked = {(x.tick, x.camera_id) for x in own if x.cause == "bearing_selected_cameras"}
        consulted = {a[0] for t, camera, *_, answers in incidents[i] if (t, camera) in asked for a in answers}
        assert (r.state, r.alerts, set(r.consulted)) == (own[-1].state, len(alerts), consulted)
        assert r.frames_read == sum(ends is None or x[0] <= ends for x in incidents[i])
        assert (r.stopped_early is None) == (own[-1].cause == "sequence_ended") and r.confidence == (alerts[-1].confidence if alerts else None)


def test_cameras_that_cannot_be_believed_at_the_end(spark):
    rows = [(0, 1, None, None, None, "fog", None, None, None), (0, 2, None, None, None, "night", None, None, None), (1, 1, 1, 0.1, 1, None, None, None, None)]
    r = escalation.records(sweeps(spark, {7: rows}).drop("at")).first()
    assert [tuple(x) for x in r.unusable] == [(2, "night")] and (r.state, r.alerts, r.consulted, r.stopped_early) == ("watch", 0, [], None)


def test_uploads(spark):
    stills = [("a.zip", f"s/{9 - i}.png", True) for i in range(8)] + [("a.zip", "__MACOSX/s/0.png", True), ("a.zip", "s/.x.png", True), ("a.zip", "notes.txt", None)]
    stamped = [("b.zip", f"z{i}/cam_20240101_{h:02d}0000.jpg", None) for i, h in enumerate([5, 1, 9, 2, 3, 4, 6])]
    twice = [("c.zip", f"{i}/cam_20240101_000000.jpg", i != 3) for i in range(6)]  # one time for all, so none counts
    files = [*stills, *stamped, *twice, *[("d.zip", f"{i}.png", i != 0) for i in range(6)], *[("e.zip", f"{i}.png", True) for i in range(5)], *[("l.zip", f"{i:04d}.png", True) for i in range(1500)]]
    asked = [("a.zip", "10", "", "0.5"), ("b.zip", None, None, None), ("c.zip", " ", None, None), *((f"{x}.zip", "360", None, None) for x in "def"), ("g.zip", "north", None, None), ("h.zip", None, "181", None), ("i.zip", None, None, "0"), ("j.JPG", None, None, None), ("k", None, None, None), ("m.mp4", None, None, None), ("l.zip", None, None, "200"), (None, None, None, None)]
    frames, reports = uploads.opened(spark.createDataFrame(files, FILES), spark.createDataFrame(asked, ASKED))
    r = {x.archive: x for x in reports.collect()}
    assert {k: x.refusal for k, x in r.items() if x.refusal} == {
        "d.zip": "UNDECODABLE", "e.zip": "TOO_FEW_FRAMES", "f.zip": "NO_STILLS", "g.zip": "BEARING_DEG_NOT_A_NUMBER", "h.zip": "HFOV_DEG_OUT_OF_RANGE",
        "i.zip": "INTERVAL_S_OUT_OF_RANGE", "j.JPG": "ONE_STILL", "k": "NOT_AN_UPLOAD", "m.mp4": "NO_VIDEO_DECODER", None: "NO_STILLS",
    }
    a, b, c, long = (r[x] for x in ("a.zip", "b.zip", "c.zip", "l.zip"))
    assert (a.total_frames, a.analysed_frames, a.stride, a.interval_s, a.interval_assumed, a.spacing_s, a.timestamps, a.aim_known) == (8, 8, 1, 0.5, False, 0.5, "interval", True)
    assert a.notes == [uploads.NOTES["place"]] and a.coverage == "analysed 8 of 8 frames"
    assert (b.timestamps, b.spacing_s, b.interval_assumed) == ("filenames", 3600.0, False) and b.notes[0] == uploads.NOTES["names"]
    assert (c.timestamps, c.interval_assumed, c.aim_known) == ("interval", True, False) and c.notes[0].startswith("No capture interval was given, so 60 s a frame")
    assert (long.stride, long.analysed_frames, long.capped) == (1, 240, True) and "cut after 240 analysed frames (analysed 240 of 1500 frames)" in long.notes[-1]
    got = {}
    for x in sorted(frames.collect(), key=lambda x: (x.archive, x.frame_index)):
        got.setdefault(x.archive, []).append(x)
    assert set(got) == {"a.zip", "b.zip", "c.zip", "l.zip"} and len(got["l.zip"]) == 240
    assert [x.path for x in got["a.zip"]] == sorted(p for _, p, _ in stills[:8])
    assert [x.ts.hour for x in got["b.zip"]] == [1, 2, 3, 4, 5, 6, 9]
    assert got["a.zip"][3].ts == datetime.datetime(2026, 1, 1, 12, 0, 1, 500000)


def test_records_of_the_given_tables(spark):
    from vigilframe.plans import catalogue

    r = catalogue.queries()["incident_records"](spark, DATA)
    log = catalogue.queries()["escalation_log"](spark, DATA)
    assert {x.incident: x.alerts for x in r.collect() if x.alerts} == {x.incident: x["count"] for x in log.filter("kind = 'alert'").groupBy("incident").count().collect()}
