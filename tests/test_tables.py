"""Table functions from SQL give what the operators give on DataFrames."""

import pytest
from pyspark.sql import functions as F

from vigilframe.operators import detection, tracker
from vigilframe.plans import stateful, tables
from vigilframe.sources import synthetic


def test_tracks_from_sql(spark):
    from conftest import DATA

    tables.register(spark)
    regions = stateful._regions(spark, DATA).filter("camera_id < 6").withColumn("note", F.lit("kept"))
    regions.createOrReplaceTempView("regions_seen")
    for width in (1024.0, 300.0):
        got = spark.sql(f"SELECT * FROM tracks(TABLE(regions_seen), width => {width})")
        assert got.columns == [*regions.columns, "track_id"] and {r.note for r in got.collect()} == {"kept"}
        rows, want = (sorted(map(tuple, x.select("camera_id", "frame_index", "region", "track_id").collect())) for x in (got, tracker.track(regions, width)))
        assert rows == want and len(rows) > 20
    assert spark.sql("SELECT * FROM tracks(TABLE(SELECT * FROM regions_seen WHERE false))").count() == 0


def test_watched_from_sql(spark):
    tables.register(spark)
    cams = synthetic.with_impostors(synthetic.ring(spark, 2), ("night", "frozen"))
    frames = synthetic.frames(cams, None, 7, 99)
    frames.createOrReplaceTempView("frames_seen")
    got, want = (sorted(map(str, x.collect())) for x in (spark.sql("SELECT * FROM watched(TABLE(frames_seen))"), detection.watched(frames)))
    assert got == want and len(got) == 14


@pytest.mark.parametrize("call", ["tracks(TABLE(SELECT 1 AS camera_id))", "tracks(5)", "watched(TABLE(SELECT 1 AS x))"])
def test_calls_that_cannot_be(spark, call):
    tables.register(spark)
    with pytest.raises(Exception, match="lacks|takes a table"):
        spark.sql(f"SELECT * FROM {call}").collect()
