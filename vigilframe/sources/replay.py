"""A data source of rendered frames, read as a batch or replayed tick by tick as a stream.

    spark.dataSource.register(Replay)
    spark.read.format("replay").options(cameras=3, frames=18, plume_at=6).load()
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from . import synthetic


class _Part(InputPartition):
    def __init__(self, camera: int):
        self.camera = camera


def _row(o: dict, camera: int, frame: int) -> tuple:
    height, width, plume = int(o.get("height", 96)), int(o.get("width", 160)), int(o.get("plume_at", 1 << 30))
    x = width * (camera + 1) / (int(o.get("cameras", 3)) + 1)
    return f"syn{camera}", frame, float(frame), height, width, synthetic.render(int(o.get("seed", 11)) + camera, frame, x, plume, height, width).tobytes()


class _Reader(DataSourceReader):
    """A partition for each camera."""

    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Part(c) for c in range(int(self.options.get("cameras", 3)))]

    def read(self, partition: _Part) -> Iterator[tuple]:
        for f in range(int(self.options.get("frames", 12))):
            yield _row(self.options, partition.camera, f)


class _Ticks(SimpleDataSourceStreamReader):
    """One frame of every camera a micro-batch, until the last; the offset is the next tick."""

    def __init__(self, options: dict):
        self.options = options

    def initialOffset(self) -> dict:  # noqa: N802
        return {"tick": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        tick = start["tick"]
        if tick >= int(self.options.get("frames", 12)):
            return iter([]), start
        return iter([_row(self.options, c, tick) for c in range(int(self.options.get("cameras", 3)))]), {"tick": tick + 1}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter([_row(self.options, c, f) for f in range(start["tick"], end["tick"]) for c in range(int(self.options.get("cameras", 3)))])


class Replay(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay"

    def schema(self) -> str:
        return synthetic.FRAME

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Ticks(dict(self.options))
