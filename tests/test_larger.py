"""Queries whose work once grew faster than their input, and comparisons that noise once decided, on tables made for it."""

import duckdb
import pytest
from conftest import DATA, matches, views

from vigilframe.operators import network
from vigilframe.plans import catalogue
from vigilframe.sources import fixtures


@pytest.fixture(scope="module")
def crowded(tmp_path_factory):
    """4000 cameras at 40 places, and readings of a few of them."""
    at = str(tmp_path_factory.mktemp("crowded"))
    c = duckdb.connect()
    c.execute(f"COPY (SELECT i AS s_suppkey, 'S' || i AS s_name, CAST(i * 7 % 11 % 5 AS INTEGER) AS s_nationkey, 0.0::DOUBLE AS s_acctbal FROM range(4000) t(i)) TO '{at}/supplier.parquet'")
    c.execute(f"COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i * 977) AS ts, i * 37 % 1500 AS user_id, 'view' AS event_type, CAST(i * 13 % 300 AS DOUBLE) AS value, '{{}}' AS props FROM range(600) t(i)) TO '{at}/events.parquet'")
    return at


def test_consultable_cameras_of_crowded_places(spark, crowded):
    """Places have more cameras than count; what is looked at doesn't grow with their number."""
    duck = duckdb.connect()
    for t in ("supplier", "events"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{crowded}/{t}.parquet'")
    assert matches(spark, duck, catalogue.queries()["consultable_topk"], catalogue.oracle_sql()["consultable_topk"], crowded) > 1000
    cams = fixtures.cameras(spark, crowded).filter("active")
    few, many = (network._by_sector(cams.filter(f"camera_id < {n}"), network.LIMIT).count() for n in (2000, 4000))
    assert many < 1.3 * few
    assert network._by_sector(cams, network.LIMIT).filter("full").count() > 0


def test_strongest_reading_of_large_ids(spark, tmp_path):
    """A slightly stronger reading with a much larger id is the stronger one, and a later one with a smaller id the later."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT i AS s_suppkey, 'S' AS s_name, 0 AS s_nationkey, 0.0::DOUBLE AS s_acctbal FROM range(2) t(i)) TO '{tmp_path}/supplier.parquet'")
    c.execute(f"COPY (SELECT * FROM (VALUES (5, TIMESTAMP '2024-01-01 00:00:01', 0, 'view', 100.0::DOUBLE, '{{}}'), (3000000, TIMESTAMP '2024-01-01 00:00:00', 0, 'view', 100.01::DOUBLE, '{{}}')) t(event_id, ts, user_id, event_type, value, props)) TO '{tmp_path}/events.parquet'")
    for t in ("supplier", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    query, sql = catalogue.queries()["latest_and_strongest"], catalogue.oracle_sql()["latest_and_strongest"]
    assert matches(spark, c, query, sql, str(tmp_path)) == 1
    assert [(r.last_confidence, r.strongest) for r in query(spark, str(tmp_path)).collect()] == [(0.5, 3000000)]


def test_noise_fires_no_rule(spark):
    """A drift of just its limit, give or take what a sum's order leaves, is not above it."""
    from pyspark.sql import functions as F

    from vigilframe.functions import scoring

    named = dict(frames=4, area_ratio=3.0, centroid_drift=0.0, base_drift=0.0, top_rise=0.0, jitter=9.0, anchor=1.0, h=30.0, w=30.0, base_below=5.0, edge_softness=1.0, texture_ratio=0.1, greyness=0.1, mean_luma=0.0, blown=0.0, clear_frames=0, use_nuisance=False, habituation=0.0, use_ceiling=False, ceiling=0.0, slack=0.0, corrected=True, shift=0.0, contrast_ratio=1.0)
    c = {k: F.lit(v) for k, v in named.items()} | {"horizontal_drift": F.col("x")}
    fired = scoring.rejections(c, c, c, F.lit(0.5), F.lit(683.0), F.lit(True))
    rows = spark.createDataFrame([(5.0 - 1e-14,), (5.0,), (5.000000000000002,), (5.001,)], "x double")
    assert [r.n for r in rows.select(F.size(fired).alias("n")).collect()] == [0, 0, 0, 1]


def test_few_boxes_are_tracked_as_many_are(monkeypatch):
    """Frames taken as plain numbers get the ids that arrays give, frames seen before none; and take less time."""
    import time

    import numpy as np

    from vigilframe.operators import tracker

    r = np.random.default_rng(5)
    frames = np.sort(np.concatenate([r.integers(0, 4000, 9000), np.repeat(r.integers(0, 4000, 20), 40)]))
    xy = r.integers(0, 300, (len(frames), 2)).astype(float)
    boxes = np.column_stack([xy, r.integers(0, 60, (len(frames), 2)), xy + r.integers(0, 5, xy.shape)])
    got, took = {}, {}
    for few in (-1, 64):
        monkeypatch.setattr(tracker, "FEW", few)
        state, start = tracker.State(), time.perf_counter()
        ids = [tracker.fold(state, frames[a:b], boxes[a:b]).tolist() for a, b in ((0, 3000), (2990, 9820))]
        took[few], got[few] = time.perf_counter() - start, (ids, state.tracks.tolist(), state.boxes.tolist(), state.missed.tolist(), state.next_id)
    assert got[64] == got[-1] and -1 in got[64][0][1]
    assert took[64] < 0.7 * took[-1]


def test_streamed_growth_keeps_its_state_built_in(spark, tmp_path):
    """A repetition that comes in a later file counts once, and no track is folded by a function of its own."""
    from vigilframe.streaming import tracking

    rows = [(1, 0, 0.0, 10.0), (1, 2, 2.0, 30.0), (1, 1, 1.0, 20.0), (1, 2, 2.0, 90.0), (2, 5, 1.0, 0.0)]
    for n, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, "track_id long, frame_index long, minute double, area double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("track_id long, frame_index long, minute double, area double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = tracking.growth(stream)
    assert "PythonUDF" not in got._jdf.queryExecution().analyzed().toString() and "run(" not in got._jdf.queryExecution().analyzed().toString()
    got.writeStream.format("memory").queryName("built_in").outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    last = {r.track_id: (r.frames, r.area_slope, r.area_ratio) for r in spark.table("built_in").orderBy("frames").collect()}
    assert last[1][0] == 3 and last[1][2] == 3.0 and abs(last[1][1] - 10.0) < 1e-9 and last[2] == (1, 0.0, 0.0)


def test_closest_rays_in_parts(spark, monkeypatch):
    """Parts of a few rays give what all pairs do, joined by merging."""
    from vigilframe.operators import fixes

    monkeypatch.setattr(fixes, "CLOSEST_ROWS", 2)
    query, sql = catalogue.queries()["nearest_approach_closest_pair"], catalogue.oracle_sql()["nearest_approach_closest_pair"]
    assert matches(spark, views(DATA.replace("0.001", "0.01")), query, sql, DATA.replace("0.001", "0.01")) == 60
    plan = query(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Cartesian" not in plan


@pytest.mark.parametrize("tried", [(1,), (2, 8), None])
def test_readings_of_a_busy_time_bin_meet_few(spark, tmp_path, monkeypatch, tried):
    """Of a bin of 900 readings hardly one is left to meet all, and the curve is its SQL's, however many are tried first."""
    from pyspark.sql import functions as F

    from vigilframe.operators import evaluation

    c = duckdb.connect()
    c.execute(f"COPY (SELECT i AS s_suppkey, 'S' || i AS s_name, CAST(i % 25 AS INTEGER) AS s_nationkey, 0.0::DOUBLE AS s_acctbal FROM range(400) t(i)) TO '{tmp_path}/supplier.parquet'")
    c.execute(f"COPY (SELECT i // 3 * 7200 + i % 3 AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, i * 7 % 400 * 20 + i % 20 // 19 AS user_id, 'view' AS event_type, CAST(i * 13 % 300 AS DOUBLE) AS value, '{{}}' AS props FROM range(900) t(i)) TO '{tmp_path}/events.parquet'")
    for t in ("supplier", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    if tried:
        monkeypatch.setattr(evaluation, "TRIED", tried)
    assert matches(spark, c, catalogue.queries()["corroboration_curve"], catalogue.oracle_sql()["corroboration_curve"], str(tmp_path)) == 9
    r = fixtures.readings(spark, str(tmp_path)).filter(F.col("date") == 0)
    left = evaluation._unmet(r, 120).count()
    assert 0 < r.filter("confidence >= 0.25").count() and (left < 40 if tried is None else left > 0)


def test_short_tracks_need_no_maps_of_values(spark):
    """Growth takes its medians without an aggregate that keeps a map a measure, and they are medians whatever a track's length."""
    import math
    import statistics

    from vigilframe.operators import tracks

    rows = [(n, f, f * 1.5, float(f * 37 % 11 + 1), 5.0, f * f * 13 % 17 + 0.5, float(f * 29 % 7), None if f == 2 else float(f * 31 % 13), float(f * 7 % 5), 3.0, 4.0) for n in (*range(1, 14), 40) for f in range(n)]
    names = ["track_id", "frame_index", "minute", "area", "top_y", "base_cx", "base_cy", "cx", "cy", "w", "h"]
    df = tracks.growth(spark.createDataFrame(rows, ", ".join(f"{c} {'long' if i < 2 else 'double'}" for i, c in enumerate(names))))
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "median(" not in plan and "percentile" not in plan
    for got in df.collect():
        own = [dict(zip(names, r, strict=True)) for r in rows if r[0] == got.track_id]
        third = max(1, len(own) // 3)
        med = lambda c, part: statistics.median([r[c] for r in part if r[c] is not None])
        early, late = own[:third], own[-third:]
        t = med("minute", late) - med("minute", early)
        for field, x, y in (("base_drift", "base_cx", "base_cy"), ("centroid_drift", "cx", "cy")):
            if all(r[x] is None for r in early) or all(r[x] is None for r in late):
                assert got[field] is None
                continue
            want = math.hypot(med(x, late) - med(x, early), med(y, late) - med(y, early)) / t if t > 1e-6 else 0.0
            assert math.isclose(got[field], want, abs_tol=1e-9)
        steps = [math.hypot(b["base_cx"] - a["base_cx"], b["base_cy"] - a["base_cy"]) for a, b in zip(own, own[1:])]
        assert math.isclose(got.jitter, statistics.median(steps) if len(own) >= 3 else 0.0, abs_tol=1e-9)


def test_readings_of_the_escalation_are_worked_out_once(spark):
    """The sweeps of alert_fixes, escalation_stream and incident_records read a table of readings, not the events again and
    again; a frame's rows come as plain values, nulls as None."""
    import pandas as pd

    from vigilframe.operators import escalation
    from vigilframe.plans import stateful

    own, said = stateful._said(spark, DATA)
    assert not [f for f in stateful._sweeps(own, said).inputFiles() if "events" in f]
    pdf = pd.DataFrame({"camera_id": [1, 2], "track_id": [3.0, None], "confidence": [0.5, float("nan")], "frames": [4, 5], "again_frames": [None, None], "answers": [None, [{"camera_id": 1, "outcome": "silent", "confidence": None, "said": "x"}]]})
    rows = escalation.rows_of(pdf)
    assert [(r["track_id"], r["confidence"]) for r in rows] == [(3, 0.5), (None, None)] and {type(x) for r in rows for x in (r["camera_id"], r["frames"])} == {int}
    assert [r["answers"] for r in rows] == [[], [(1, "silent", None, "x")]]
