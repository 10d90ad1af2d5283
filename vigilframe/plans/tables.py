"""Analysers as table functions of SQL: partitioned and ordered by themselves, so that a caller can't forget to.

    tables.register(spark)
    spark.sql("SELECT * FROM tracks(TABLE(regions), width => 1920.0)")
    spark.sql("SELECT * FROM watched(TABLE(SELECT * FROM frames WHERE camera_id = 'a'))")

Each is polymorphic: tracks gives back all columns of its table and track_id, watched the columns of detection.WATCHED.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, Row, StringType, StructField, StructType

from ..operators import detection, tracker


_KINDS = {"string": StringType(), "int": IntegerType(), "double": DoubleType(), "boolean": BooleanType()}


def _table(argument: AnalyzeArgument, needs: tuple[str, ...], name: str) -> StructType:
    if not argument.isTable:
        raise ValueError(f"{name} takes a table: {name}(TABLE(...))")
    lack = [c for c in needs if c not in argument.dataType.names]
    if lack:
        raise ValueError(f"{name}'s table lacks {', '.join(lack)}")
    return argument.dataType


def _ordered(schema: StructType, *order: str) -> AnalyzeResult:
    return AnalyzeResult(schema, partitionBy=[PartitioningColumn("camera_id")], orderBy=[OrderingColumn(c) for c in order])


class Tracks:
    """tracker.track() of a table of regions, one camera a partition: a frame's rows are taken together."""

    def __init__(self):
        self.state, self.frame, self.rows = None, None, []

    @staticmethod
    def analyze(table: AnalyzeArgument, width: AnalyzeArgument | None = None) -> AnalyzeResult:
        schema = _table(table, ("camera_id", "frame_index", "region", "x", "y", "w", "h"), "tracks")
        if width is not None and (not width.isConstantExpression or not width.value or width.value <= 0):
            raise ValueError("tracks: width is a positive constant")
        return _ordered(StructType([*schema.fields]).add("track_id", LongType()), "frame_index", "region")

    def eval(self, row: Row, width: float | None = None) -> Iterator[tuple]:
        if self.state is None:
            self.state = tracker.State(float(width or tracker.FRAME_WIDTH))
        if self.rows and row["frame_index"] != self.frame:
            yield from self._frame()
        self.frame = row["frame_index"]
        self.rows.append(row)

    def terminate(self) -> Iterator[tuple]:
        if self.rows:
            yield from self._frame()

    def _frame(self) -> Iterator[tuple]:
        placed = "cx" in self.rows[0] and "cy" in self.rows[0]
        boxes = [[float(r[c]) for c in (tracker.BOX if placed else tracker.BOX[:4])] for r in self.rows]
        ids = tracker.step(self.state, int(self.frame), boxes)
        yield from ((*r, i) for r, i in zip(self.rows, ids, strict=True))
        self.rows = []


class Watched:
    """detection.watched() of a table of frames, one camera a partition."""

    def __init__(self):
        self.scene = detection.Scene()

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        _table(table, ("camera_id", "frame_index", "height", "width", "data"), "watched")
        return _ordered(StructType([StructField(n, _KINDS[t]) for n, t in map(str.split, detection.WATCHED.split(", "))]), "frame_index")

    def eval(self, row: Row) -> Iterator[tuple]:
        image = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"])
        m = {"camera_id": row["camera_id"]} | self.scene.observe(row["frame_index"], image)
        yield tuple(m[c.split()[0]] for c in detection.WATCHED.split(", "))


def register(spark: SparkSession) -> None:
    """Makes tracks and watched known to the session's SQL."""
    for name, function in (("tracks", Tracks), ("watched", Watched)):
        spark.udtf.register(name, udtf(function))
