"""The source of recorded incidents: archives and folders, filters, columns, scaling, broken members, the replay."""

import io
import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.functions import pixels
from vigilframe.sources import recorded, sinks, synthetic


@pytest.fixture(scope="module")
def place(spark, tmp_path_factory):
    """Two archives that the engine wrote, an unpacked folder, an archive below one root, and what is none."""
    at = tmp_path_factory.mktemp("incidents")
    cams = synthetic.ring(spark, 2)
    frames = synthetic.frames(cams, synthetic.CENTRE, 3, 1).withColumns({"incident": F.explode(F.array(F.lit(7), F.lit(8))), "ts": F.timestamp_seconds(1600000000 + 60 * F.col("frame_index") + 7 * (F.col("camera_id") == "syn1").cast("int"))})
    sinks.write_bundles(frames, cams, f"file://{at}").collect()
    picture = pixels.bmp(np.arange(60, dtype=np.uint8).reshape(5, 12))
    manifest = {"name": "odd", "network": {"cameras": [{"camera_id": "a"}]}, "sequences": {"a": [{"path": "f/2.bmp", "timestamp": "2020-09-13T12:28:00+00:00"}, {"path": "f/1.bmp", "timestamp": "2020-09-13 12:27:00"}, {"path": "f/gone.bmp", "timestamp": "2020-09-13 12:29:00"}, {"path": "f/bad.bmp", "timestamp": "2020-09-13 12:30:00"}, {"path": "f/0.bmp"}], "b": [{"path": "f/1.bmp", "timestamp": "2020-09-13 12:27:00"}]}}
    members = {"manifest.json": json.dumps(manifest).encode(), "f/1.bmp": picture, "f/2.bmp": picture, "f/0.bmp": picture, "f/bad.bmp": b"BMno"}
    for name, content in members.items():
        (at / "folder" / name).parent.mkdir(parents=True, exist_ok=True)
        (at / "folder" / name).write_bytes(content)
    with zipfile.ZipFile(at / "rooted.zip", "w") as z:
        for name, content in members.items():
            z.writestr(f"root/{name}", content)
    (at / "broken.zip").write_bytes(b"PK no")
    with zipfile.ZipFile(at / "bare.zip", "w") as z:
        z.writestr("x.txt", "x")
    (at / "other.txt").write_text("no bundle")
    recorded.register(spark)
    return f"file://{at}", frames


def load(spark, path, **options):
    return spark.read.format("recorded").options(**options).load(path)


def test_bundles_are_read_back(spark, place):
    path, frames = place
    rows = load(spark, path).collect()
    want = {(str(r.incident), r.camera_id, r.frame_index): (r.ts, r.height, r.width, r.data) for r in frames.collect()}
    assert {(r.incident, r.camera_id, r.frame_index): (r.ts, r.height, r.width, bytes(r.data)) for r in rows if r.incident in ("7", "8")} == want
    odd = sorted((r.path, r.camera_id, r.frame_index, r.minute, r.problem) for r in rows if r.incident == "odd")
    assert odd == sorted(2 * [("f/0.bmp", "a", None, None, "NO_TIMESTAMP"), ("f/1.bmp", "a", 0, 0.0, None), ("f/1.bmp", "b", None, None, "UNKNOWN_CAMERA"), ("f/2.bmp", "a", 1, 1.0, None), ("f/bad.bmp", "a", 3, 3.0, "NOT_AN_IMAGE"), ("f/gone.bmp", "a", 2, 2.0, "NO_FILE")], key=str)
    assert {r.path.rpartition("/")[2]: r.problem for r in rows if r.incident is None} == {"broken.zip": "NOT_A_ZIP", "bare.zip": "NO_MANIFEST"}
    assert load(spark, f"{path}/rooted.zip").count() == 6 and load(spark, f"{path}/folder").count() == 6


def test_filters_and_columns_reach_the_source(spark, place, monkeypatch):
    path, frames = place
    late = F.timestamp_seconds(F.lit(1600000060))
    df = load(spark, path).filter((F.col("camera_id") == "syn1") & (F.col("ts") > late) & (F.col("height") > 1))
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "camera_id" not in text.split("Filter ")[1].split("\n")[0] and "height" in text.split("Filter ")[1].split("\n")[0]
    assert sorted((r.incident, r.frame_index) for r in df.collect()) == [(i, k) for i in ("7", "8") for k in (1, 2)]
    # With a schema of its own a reader gives these columns only, and opens no frame.
    few = spark.read.format("recorded").schema("camera_id string, path string").load(f"{path}/folder")
    assert few.columns == ["camera_id", "path"] and few.count() == 6
    monkeypatch.setattr(recorded, "_decoded", lambda *_: pytest.fail("opened"))
    assert len(list(recorded._rows(f"{path}/folder", 0, 1, [], ["camera_id", "ts"], None))) == 6
    parts = [r for k in range(3) for r in recorded._rows(f"{path}/rooted.zip", k, 3, [], ["path"], None)]
    assert len(parts) == 6


def test_frames_are_scaled(spark, place):
    path, _ = place
    r = load(spark, f"{path}/rooted.zip", width=24).filter("frame_index = 0").first()
    assert (r.height, r.width, len(r.data)) == (10, 24, 240)
    grey = pixels.from_bmp(pixels.bmp(np.arange(35, dtype=np.uint8).reshape(5, 7)))
    assert (grey == np.arange(35).reshape(5, 7)).all() and pixels.from_bmp(b"") is None
    colour = io.BytesIO()
    colour.write(b"BM" + (54 + 8).to_bytes(4, "little") + bytes(4) + (54).to_bytes(4, "little") + (40).to_bytes(4, "little") + (2).to_bytes(4, "little") + (1).to_bytes(4, "little") + (1).to_bytes(2, "little") + (24).to_bytes(2, "little") + bytes(24) + bytes([255, 0, 0, 0, 0, 255, 0, 0]))
    assert pixels.from_bmp(colour.getvalue()).tolist() == [[29, 76]]


def test_replay_gives_the_table_tick_by_tick(spark, place, tmp_path):
    path, _ = place
    seen = []

    def put(batch, n):
        seen.append(sorted({r.ts for r in batch.select("ts").collect()}))
        batch.write.mode("append").parquet(f"{tmp_path}/out")

    stream = spark.readStream.format("recorded").load(f"{path}/7.zip")
    q = stream.writeStream.option("checkpointLocation", f"{tmp_path}/state").foreachBatch(put).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got, want = (sorted(map(str, x.collect())) for x in (spark.read.parquet(f"{tmp_path}/out"), load(spark, f"{path}/7.zip")))
    assert got == want and len(got) == 6
    times = [t for b in seen for t in b]
    assert times == sorted(set(times)) and len([b for b in seen if b]) == 6


@pytest.mark.parametrize("zone", ["UTC", "America/Los_Angeles"])
def test_odd_incidents_are_written_whole(spark, tmp_path, zone):
    """Names that only differ in characters a file can't have, repeated frames, cameras nobody knows, no time, fractions of a
    second, an incident of many Arrow batches; and none at all."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.session.timeZone", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    try:
        spark.conf.set("spark.sql.session.timeZone", zone)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        grey = lambda k: bytes([k % 256] * 6)
        rows = [(i, c, k, 1_700_000_000.25 + 60 * k, 2, 3, grey(k)) for i in ("a/b", "a_b", "", "..") for c in ("x", "y/z") for k in range(3)]
        rows += [("a_b", "x", 0, 1_700_000_000.25, 2, 3, grey(0)), ("a_b", "nobody", 0, 1_700_000_000.25, 2, 3, grey(9)), ("a_b", "x", 5, None, 2, 3, grey(5))]
        rows += [("long", "x", k, 1_700_000_000.25 + k, 2, 3, grey(k)) for k in range(100)]
        left_out = [(None, "x", 0, 1.0, 2, 3, grey(0)), ("a_b", None, 0, 1.0, 2, 3, grey(0)), ("a_b", "x", 0, 1.0, 2, 3, None)]
        df = spark.createDataFrame(rows + left_out, "incident string, camera_id string, frame_index int, t double, height int, width int, data binary")
        cams = spark.createDataFrame([("x", 1.0, 2.0, 0.0, 60.0), ("x", 1.0, 3.0, 0.0, 60.0), ("y/z", 1.0, 2.0, 0.0, 60.0)], "camera_id string, lat double, lon double, azimuth double, hfov double")
        frames = df.withColumn("ts", F.timestamp_micros((F.col("t") * 1_000_000).cast("long")))
        for _ in range(2):  # once more writes the same
            written = sinks.write_bundles(frames, cams, f"file://{tmp_path}/out").collect()
        assert {r.incident: r.frames for r in written} == {"a/b": 6, "a_b": 9, "": 6, "..": 6, "long": 100}
        assert sorted(f"file://{x}" for x in (tmp_path / "out").iterdir()) == sorted(r.path for r in written)  # and nothing else
        recorded.register(spark)
        back = load(spark, f"file://{tmp_path}/out").select("incident", "camera_id", F.unix_micros("ts").alias("us"), "data", "problem").collect()
        problem = lambda r: "UNKNOWN_CAMERA" if r[1] == "nobody" else "NO_TIMESTAMP" if r[3] is None else None
        want = [(r[0], r[1], None if r[3] is None else int(r[3] * 1_000_000), None if problem(r) else r[6], problem(r)) for r in rows]
        assert sorted(((r.incident, r.camera_id, r.us, r.data and bytes(r.data), r.problem) for r in back), key=str) == sorted(want, key=str)
        assert sinks.write_bundles(frames.filter("false"), cams, f"file://{tmp_path}/none").count() == 0
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_an_archive_that_breaks_off_leaves_nothing(spark, tmp_path):
    rows = [("i", "x", k, 2, 3, b"123456" if k < 50 else b"1") for k in range(51)]
    frames = spark.createDataFrame(rows, "incident string, camera_id string, frame_index int, height int, width int, data binary").withColumn("ts", F.timestamp_seconds(F.col("frame_index")))
    cams = spark.createDataFrame([("x", 1.0, 2.0, 0.0, 60.0)], "camera_id string, lat double, lon double, azimuth double, hfov double")
    with pytest.raises(Exception, match="reshape"):
        sinks.write_bundles(frames, cams, f"file://{tmp_path}").collect()
    assert not list(tmp_path.iterdir())
