"""Streams of frames: what is kept of a camera, its background, mixture and contrasts, as keyed state.

The same steps as in operators.detection; frames not newer than the latest one of their camera change nothing and give no
rows, those of one micro-batch are taken in order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState

from ..operators import detection
from .tracking import _timeout

FRAME = ("camera_id", "frame_index", "minute", "height", "width", "data")


def _fold(frames: DataFrame, schema: str, start: Callable, load: Callable, step: Callable, idle_s: int | None) -> DataFrame:
    """Rows that step(state, frame) gives along each camera's frames; states are start(frame), or load(bytes) of the last
    micro-batch's. With idle_s, that of a camera that sends nothing for so many seconds is dropped."""

    def run(key, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        state, out = load(bytes(group.get[0])) if group.exists else None, []
        for r in pd.concat(list(batches), ignore_index=True).sort_values("frame_index").itertuples(index=False):
            state = start(r) if state is None else state
            if r.frame_index > state.newest:
                out += [{"camera_id": key[0]} | m for m in step(state, r)]
        group.update((state.to_bytes(),))
        if idle_s is not None:
            group.setTimeoutDuration(1000 * idle_s)
        yield detection.table(out, schema)

    return frames.select(*FRAME).groupBy("camera_id").applyInPandasWithState(run, schema, "state binary", "append", _timeout(idle_s))


def regions(frames: DataFrame, least: int = 40, learn_until: int | None = None, skip_blind: bool = False, idle_s: int | None = None) -> DataFrame:
    """detection.regions() of a stream of frames. A history that comes first, with learn_until after it, primes the model."""

    def step(watch: detection.Watch, r) -> list[dict]:
        return watch.observe(r.frame_index, r.minute, r.data, least, learn_until is None or r.frame_index < learn_until)

    return _fold(frames, detection.REGION, lambda r: detection.Watch(r.height, r.width, skip_blind), detection.Watch.from_bytes, step, idle_s)


def watched(frames: DataFrame, idle_s: int | None = None) -> DataFrame:
    """detection.watched() of a stream of frames."""

    def step(scene: detection.Scene, r) -> list[dict]:
        return [scene.observe(r.frame_index, np.frombuffer(r.data, np.uint8).reshape(r.height, r.width))]

    return _fold(frames, detection.WATCHED, lambda r: detection.Scene(), detection.Scene.from_bytes, step, idle_s)
