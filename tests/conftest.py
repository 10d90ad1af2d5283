import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": "2g", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"file://{tmp_path_factory.mktemp('shared')}"}
    s = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    return views(DATA)


def views(data):
    import duckdb

    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def plain(rows, columns):
    """Rows as sorted tuples of text, floats to six places."""

    def text(x):
        if isinstance(x, float):
            return "nan" if x != x else repr(round(x, 6) + 0.0)
        return str([text(y) for y in x]) if isinstance(x, (list, tuple)) else str(x)

    return sorted(tuple(text(r[c]) for c in columns) for r in rows)


def matches(spark, duck, query, sql, data=DATA):
    df = query(spark, data)
    columns = sorted(df.columns)
    got = duck.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = [dict(zip(names, r, strict=True)) for r in got.fetchall()]
    mine = [r.asDict() for r in df.collect()]
    assert plain(mine, columns) == plain(want, columns)
    return len(mine)
