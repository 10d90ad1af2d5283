"""Streams of frames whose state is kept in parts: of a camera's backgrounds by time of day, a micro-batch reads and writes
those it uses; mixture, last frame and counts are values of their own. A history can prime them.

The same steps and rows as operators.detection.regions; watching.regions keeps a camera's whole state in one value.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import detection
from .watching import FRAME


class _Means(dict):
    """A background's means by bucket, each read from the map state when it is first asked for."""

    def __init__(self, state):
        super().__init__({b: None for (b,) in state.keys()})
        self.state, self.changed = state, set()

    def __getitem__(self, bucket: int) -> np.ndarray:
        if super().__getitem__(bucket) is None:
            super().__setitem__(bucket, detection.unpacked(bytes(self.state.getValue((bucket,))[0]))["mean"])
        return super().__getitem__(bucket)

    def get(self, bucket: int, default=None):
        return self[bucket] if bucket in self else default

    def __setitem__(self, bucket: int, mean: np.ndarray) -> None:
        super().__setitem__(bucket, mean)
        self.changed.add(bucket)


class Cameras(StatefulProcessor):
    """detection.Watch of each camera in states: known (counts), mixture, last (frame and scene) and means (by bucket)."""

    def __init__(self, least: int, skip_blind: bool, idle_s: int | None):
        self.least, self.skip_blind, self.idle_ms = least, skip_blind, None if idle_s is None else 1000 * idle_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "counts string", self.idle_ms)
        self.mixture = handle.getValueState("mixture", "packed binary", self.idle_ms)
        self.last = handle.getValueState("last", "packed binary", self.idle_ms)
        self.means = handle.getMapState("means", "bucket int", "packed binary", self.idle_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802
        self._observe(key, initialState)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        yield detection.table(self._observe(key, pd.concat(list(rows), ignore_index=True)), detection.REGION)

    def _observe(self, key, frames: pd.DataFrame) -> list[dict]:
        watch, out = self._load() if self.known.exists() else None, []
        for r in frames.sort_values("frame_index").itertuples(index=False):
            if watch is None:
                watch = detection.Watch(r.height, r.width, self.skip_blind)
                watch.model.mean = _Means(self.means)
            if r.frame_index > watch.newest:
                out += [{"camera_id": key[0]} | m for m in watch.observe(r.frame_index, r.minute, r.data, self.least)]
        if watch is not None:
            self._keep(watch)
        return out

    def _load(self) -> detection.Watch:
        shape, frames, learnt, newest, seen = json.loads(self.known.get()[0])
        watch = detection.Watch(*shape, self.skip_blind)
        z = detection.unpacked(bytes(self.mixture.get()[0]))
        watch.mixture.weight, watch.mixture.mean, watch.mixture.var, watch.mixture.frames = z["weight"], z["mean"], z["var"], frames
        watch.model.mean, watch.model.seen = _Means(self.means), {int(b): n for b, n in seen.items()}
        watch.model.learnt, watch.newest = learnt, newest
        z = detection.unpacked(bytes(self.last.get()[0]))
        watch.last = z.get("last")
        watch.scene = detection.Scene.from_bytes(z["scene"].tobytes()) if "scene" in z else None
        return watch

    def _keep(self, watch: detection.Watch) -> None:
        m, x = watch.model, watch.mixture
        self.known.update((json.dumps([x.weight.shape[1:], x.frames, m.learnt, watch.newest, m.seen]),))
        self.mixture.update((detection.packed({"weight": x.weight, "mean": x.mean, "var": x.var}),))
        last = {} if watch.last is None else {"last": watch.last}
        if watch.scene is not None:
            last["scene"] = np.frombuffer(watch.scene.to_bytes(), np.uint8)
        self.last.update((detection.packed(last),))
        for bucket in sorted(m.mean.changed):
            self.means.updateValue((bucket,), (detection.packed({"mean": m.mean[bucket]}),))

    def close(self) -> None:
        pass


def regions(frames: DataFrame, history: DataFrame | None = None, least: int = 40, skip_blind: bool = False, idle_s: int | None = None) -> DataFrame:
    """detection.regions() of a stream of frames. A table of earlier frames of any of the cameras, as `history`, is learnt
    before the stream's first and gives no rows. Frames not newer than a camera's latest change nothing and give no rows.
    With idle_s, a part of the state that nothing has written for so many seconds goes: a bucket that a camera no longer
    reaches, or all of a camera that sends nothing.

    The session's state store must be RocksDB (escalating.ROCKSDB).
    """
    first = None if history is None else history.select(*FRAME).groupBy("camera_id")
    processor = Cameras(least, skip_blind, idle_s)
    mode = "none" if idle_s is None else "processingTime"
    return frames.select(*FRAME).groupBy("camera_id").transformWithStateInPandas(statefulProcessor=processor, outputStructType=detection.REGION, outputMode="append", timeMode=mode, initialState=first)
