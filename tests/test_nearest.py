"""Nearest frames, the sweep of all cameras and growth as of each frame against plain loops; nearest frames on streams."""

import datetime

import numpy as np
import pytest
from conftest import plain
from pyspark.sql import functions as F

from vigilframe.operators import network, tracks
from vigilframe.streaming import tracking


def closest(at, frames, within):
    near = [(abs(ts - at), ts, i) for i, ts in frames if abs(ts - at) <= within]
    return min(near) if near else None


@pytest.mark.parametrize("slab", [1, 100])
def test_nearest_is_the_plain_minimum(spark, monkeypatch, slab):
    """With ties, frames at a probe's time, repeated times, slabs of one tolerance, probes without any, nulls."""
    monkeypatch.setattr(network, "SLAB", slab)
    rng = np.random.default_rng(4)
    frames = [(int(k), i, int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 150), rng.integers(-2000, 4000, 150) // 10 * 10, strict=True))]
    probes = [(int(k), i, int(t)) for i, (k, t) in enumerate(zip(rng.integers(0, 4, 300), rng.integers(-2200, 4200, 300) // 5 * 5, strict=True))]
    odd = [(None, 900, 10), (1, 901, None)]
    f = spark.createDataFrame([*frames, *odd], "key long, frame_id long, ts long").withColumn("slab", F.lit("clash"))
    p = spark.createDataFrame([*probes, *odd], "key long, probe_id long, at long").withColumn("asks", F.lit("clash"))
    got = {r.probe_id: (r.gap_s, r.frame_id) for r in network.nearest(p, f, "key", 90).collect()}
    want = {i: closest(at, [(j, ts) for k2, j, ts in frames if k2 == k], 90) for k, i, at in probes}
    assert got == {i: (w[0], w[2]) for i, w in want.items() if w}
    assert network.nearest(p.filter("false"), f, "key").count() == 0 and network.nearest(p, f.filter("false"), "key").count() == 0
    text = network.nearest(p, f, "key")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text


def test_sweep_reads_every_camera_at_every_tick(spark):
    rng = np.random.default_rng(6)
    frames = [(int(rng.integers(0, 2)), int(rng.integers(0, 4)), i, int(t)) for i, t in enumerate(rng.integers(0, 30_000, 300))]
    got = network.sweep(spark.createDataFrame([(*f, f[3] // 60 * 60) for f in frames], "incident long, camera_id long, frame_id long, ts long, tick long"))
    want = set()
    for inc in {f[0] for f in frames}:
        for tick in {f[3] // 60 * 60 for f in frames if f[0] == inc}:
            for camera in {f[1] for f in frames if f[0] == inc}:
                if best := closest(tick, [(i, ts) for n, c, i, ts in frames if (n, c) == (inc, camera)], 90):
                    want.add((inc, tick, camera, best[2], best[0]))
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_streamed_nearest_is_that_of_the_tables(spark, tmp_path):
    """Late rows within the watermark count; later ones are dropped; a probe comes once."""
    rng = np.random.default_rng(2)
    begin = datetime.datetime(2024, 1, 1)
    rows = [(int(rng.integers(0, 3)), i, begin + datetime.timedelta(seconds=int(t)), bool(rng.random() < 0.4)) for i, t in enumerate(rng.integers(0, 20_000, 400))]
    table = spark.createDataFrame(rows, "key long, id long, ts timestamp, asks boolean").withColumn("s", F.unix_seconds("ts"))
    # Four micro-batches in order of time, an eighth of the rows one behind; then the end, and rows that are too late.
    part = F.floor((F.col("s") - int(begin.replace(tzinfo=datetime.timezone.utc).timestamp())) / 5000) + (F.col("id") % 8 == 0).cast("long")
    for k in range(5):
        table.filter(part == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for ids, day in (((9001, 9002), 9), ((9003, 9004), 0), ((9005, 9006), 20)):
        late = [(-1 if day else 0, i, begin + datetime.timedelta(days=day, seconds=77), bool(i % 2)) for i in ids]
        spark.createDataFrame(late, "key long, id long, ts timestamp, asks boolean").withColumn("s", F.unix_seconds("ts")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    probes = stream().filter("asks").select("key", F.col("id").alias("probe_id"), F.col("ts").alias("at"))
    frames = stream().filter("not asks").select("key", F.col("id").alias("frame_id"), "ts")
    out = tracking.nearest(probes, frames, 90, late="3 hours").writeStream.format("parquet").option("path", f"{tmp_path}/out")
    out.option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.probe_id, r.frame_id, r.gap_s) for r in spark.read.parquet(f"{tmp_path}/out").filter("key >= 0").collect())
    batch = network.nearest(table.filter("asks").select("key", F.col("id").alias("probe_id"), F.col("s").alias("at")), table.filter("not asks").select("key", F.col("id").alias("frame_id"), F.col("s").alias("ts")), "key", 90)
    assert got == sorted((r.probe_id, r.frame_id, float(r.gap_s)) for r in batch.collect()) and len(got) > 30


OBSERVED = "track_id long, frame_index long, minute double, area double, top_y double, base_cx double, base_cy double, cx double, cy double, w double, h double"


def test_growth_so_far_is_growth_of_each_beginning(spark):
    rng = np.random.default_rng(1)
    rows = [(t, i, float(i + rng.integers(0, 2) / 4), *(float(x) for x in rng.integers(1, 60, 8))) for t in range(4) for i in range(1 + 6 * t)]
    rows += [(9, i, 5.0, *[7.0] * 8) for i in range(7)]  # no time passes, nothing moves
    got = tracks.growth_so_far(spark.createDataFrame(rows, OBSERVED))
    begun = [(100 * r[0] + n, *r[1:]) for t in {r[0] for r in rows} for own in [[r for r in rows if r[0] == t]] for n in range(1, len(own) + 1) for r in own[:n]]
    want = tracks.growth(spark.createDataFrame(begun, OBSERVED)).withColumnRenamed("track_id", "k")
    columns = [c for c in want.columns if c != "k"]
    a = plain([r.asDict() | {"k": 100 * r.track_id + r.frames} for r in got.collect()], ["k", *columns])
    assert a == plain([r.asDict() for r in want.collect()], ["k", *columns])


def test_growth_so_far_of_a_long_track(spark):
    """A track of 100,000 frames: its last row is its growth."""
    rows = spark.range(100_000).selectExpr("1L AS track_id", "id AS frame_index", "id / 4.0D AS minute", *(f"CAST(pmod(hash(id, {k}), 1000) AS DOUBLE) AS {c}" for k, c in enumerate("area top_y base_cx base_cy cx cy w h".split())))
    last = tracks.growth_so_far(rows).filter("frame_index = 99999").first().asDict()
    whole = tracks.growth(rows).first().asDict()
    assert all(last[c] == pytest.approx(whole[c], rel=1e-6, abs=1e-9) for c in whole)


RAY = "key long, id long, site_id long, lat double, lon double, bearing double, range_m double"


def test_crossings_are_those_of_all_pairs(spark):
    """On a wide network, far north, across the date line, for long ranges, lines along a row or column of cells."""
    from vigilframe.operators import fixes

    rng = np.random.default_rng(9)
    rows = []
    for key, (lat, lon, wide, metres) in enumerate([(33.0, -117.0, 0.4, 40_000.0), (62.0, 20.0, 1.5, 40_000.0), (-45.0, 179.9, 0.8, 60_000.0), (10.0, 5.0, 6.0, 40_000.0)]):
        for i in range(90):
            bearing = float(rng.choice([rng.uniform(0, 360), rng.integers(0, 8) * 45]))
            rows.append((key, 100 * key + i, i % 7, float(lat + rng.uniform(-wide, wide)), float(lon + rng.uniform(-wide, wide)), bearing, metres))
    rays = spark.createDataFrame(rows, RAY)
    got = sorted((r.a_id, r.b_id, round(r.lat, 9), round(r.lon, 9)) for r in fixes.crossings(rays, "key", "id", [], ["site_id"]).collect())
    a, b = (rays.select("key", *(F.col(c).alias(f"{p}_{c}") for c in rays.columns[1:])) for p in "ab")
    pairs = a.join(b, "key").filter("a_id < b_id AND a_site_id != b_site_id")
    ray = lambda p: {k: F.col(f"{p}_{k}") for k in ("lat", "lon", "bearing", "range_m")}
    met = fixes.meet(pairs, ray("a"), ray("b")).filter("refusal is null")
    want = sorted((r.a_id, r.b_id, round(r.lat, 9), round(r.lon, 9)) for r in met.collect())
    assert got == want and len({i // 100 for i, *_ in want}) == 4
    # Over the wide network few pairs share a cell.
    wide = fixes.walked(rays.filter("key = 3")).select("ci", "cj", "id")
    shared = wide.join(wide.withColumnRenamed("id", "other"), ["ci", "cj"]).filter("id < other").select("id", "other").distinct().count()
    assert shared < 0.03 * 90 * 89 / 2
