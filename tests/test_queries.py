"""Every registered query of the sensor operators against its SQL, and the driver's contract."""

import subprocess
import sys

import pytest
from conftest import DATA, ROOT, matches, views

import __spark_entry__
from vigilframe.plans import catalogue


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, duck, name):
    matches(spark, duck, catalogue.queries()[name], catalogue.oracle_sql()[name])


@pytest.fixture(scope="module")
def larger():
    return views(DATA.replace("0.001", "0.01"))


@pytest.mark.parametrize("name", ["growth_as_of_frame", "track_growth", "calibration_holdout", "tick_sweep", "pair_fixes", "cross_camera_consistency"])
def test_against_sql_on_more_rows(spark, larger, name):
    assert matches(spark, larger, catalogue.queries()[name], catalogue.oracle_sql()[name], DATA.replace("0.001", "0.01"))


def test_streamed_escalation_is_that_of_the_table(spark):
    log, stream = (sorted(map(str, catalogue.queries()[n](spark, DATA).collect())) for n in ("escalation_log", "escalation_stream"))
    assert log == stream and len(log) > 50


def test_no_such_camera(spark):
    from vigilframe.sources import readers

    cams = spark.createDataFrame([("a",), ("b",)], "camera_id string")
    assert [r.still_url for r in readers.subset(cams, cams.filter("camera_id = 'b'"), "http://x/%s.jpg").collect()] == ["http://x/b.jpg"]
    with pytest.raises(ValueError, match="none of these"):
        readers.subset(cams, cams.filter("false"), "%s")


@pytest.mark.parametrize("name", ["alert_fixes", "region_tracks", "box_suppression", "escalation_log", "scene_usability", "synthetic_incident"])
def test_rows(spark, name):
    assert catalogue.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_registry_without_the_corpus_folders(tmp_path):
    code = "import sys, builtins; real = builtins.__import__\ndef no(name, *a, **k):\n    if name == 'vigilframe.llm' or name == 'corpus_pipeline' or (name.startswith('vigilframe.llm')): raise ModuleNotFoundError(name, name=name)\n    return real(name, *a, **k)\nbuiltins.__import__ = no\nimport __spark_entry__ as e\nassert len(e.queries()) > 40 and not any(q.startswith('op') and q[2].isdigit() for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT)
