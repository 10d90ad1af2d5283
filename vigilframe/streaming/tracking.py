"""Streams: the tracker with keyed state, growth that takes late frames in order of time, and windows with watermarks."""

from __future__ import annotations

import bisect
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import tracker


def _timeout(idle_s: int | None) -> str:
    return GroupStateTimeout.NoTimeout if idle_s is None else GroupStateTimeout.ProcessingTimeTimeout


def track(regions: DataFrame, width: float = tracker.FRAME_WIDTH, idle_s: int | None = None) -> DataFrame:
    """tracker.track() of a stream: the same step, with a camera's open tracks as state. Frames that come after a newer
    one of their camera was folded get no track; those of one micro-batch are folded in order. With idle_s, the state of
    a camera that sends nothing for so many seconds is dropped, and its tracks with it (for streams that run on: timeouts
    keep a stream that ends with its input from ending)."""

    def run(key, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        state = tracker.State(width)
        if group.exists:
            ids, boxes, missed, state.next_id, state.last_frame = json.loads(group.get[0])
            state.tracks, state.missed = np.array(ids, np.int64), np.array(missed, np.int64)
            state.boxes = np.array(boxes, float).reshape(-1, 6)
        rows = pd.concat(list(batches), ignore_index=True).sort_values(["frame_index", "region"])
        rows["track_id"] = tracker.fold(state, rows["frame_index"].to_numpy(), rows[list(tracker.BOX)].to_numpy(float))
        group.update((json.dumps([state.tracks.tolist(), state.boxes.tolist(), state.missed.tolist(), state.next_id, state.last_frame]),))
        if idle_s is not None:
            group.setTimeoutDuration(1000 * idle_s)
        yield rows.loc[rows["track_id"] > 0, ["camera_id", "frame_index", "region", "track_id"]]

    grouped = tracker.with_centroids(regions).groupBy("camera_id")
    return grouped.applyInPandasWithState(run, tracker.OUT, "state string", "append", _timeout(idle_s))


def _new(runs: list[list[int]], frame: int) -> bool:
    """Whether frame is in none of the runs [first, last] of frame numbers; it then is."""
    k = bisect.bisect_right(runs, frame, key=lambda r: r[0])
    if k and frame <= runs[k - 1][1]:
        return False
    after = k < len(runs) and runs[k][0] == frame + 1
    if k and runs[k - 1][1] == frame - 1:
        runs[k - 1][1] = runs.pop(k)[1] if after else frame
    elif after:
        runs[k][0] = frame
    else:
        runs.insert(k, [frame, frame])
    return True


def growth(observations: DataFrame, idle_s: int | None = None) -> DataFrame:
    """(track_id, frames, area_slope, area_ratio) of tracks after each trigger, over all their observations. A late one
    counts at its time; a frame seen before is taken for a repetition, late or not, however long ago: what a source sends
    twice counts once. Repetitions are dropped by a state of frame numbers and growth is an aggregate of running sums, both
    built in. With idle_s, the state of a track without rows for so many seconds is dropped, as in track(): such tracks
    are folded one by one, with frame numbers as runs."""
    rows = observations.select("track_id", "frame_index", "minute", "area")
    if idle_s is None:
        own = F.struct("minute", "frame_index", "area")
        g = rows.dropDuplicates(["track_id", "frame_index"]).groupBy("track_id")
        n, first, last = F.count("*"), F.min(own)["area"], F.max(own)["area"]
        slope = F.when(n * F.var_pop("minute") < 1e-9, 0.0).otherwise(F.coalesce(F.regr_slope("area", "minute"), F.lit(0.0)))
        return g.agg(n.alias("frames"), slope.alias("area_slope"), (last / F.greatest(first, F.lit(1.0))).alias("area_ratio"))
    out = "track_id long, frames long, area_slope double, area_ratio double"

    def run(key, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        if group.hasTimedOut:
            group.remove()
            return
        n, mx, my, var, cov, first, last, runs = json.loads(group.get[0]) if group.exists else (0, 0.0, 0.0, 0.0, 0.0, None, None, [])
        for pdf in batches:
            for f, x, y in zip(pdf["frame_index"].tolist(), pdf["minute"].tolist(), pdf["area"].tolist(), strict=True):
                if not _new(runs, int(f)):
                    continue
                n, x, y = n + 1, float(x), float(y)
                dx = x - mx
                mx, my = mx + dx / n, my + (y - my) / n
                var, cov = var + dx * (x - mx), cov + dx * (y - my)
                own = [x, int(f), y]
                first, last = min(first or own, own), max(last or own, own)
        group.update((json.dumps([n, mx, my, var, cov, first, last, runs]),))
        if idle_s is not None:
            group.setTimeoutDuration(1000 * idle_s)
        yield pd.DataFrame({"track_id": [int(key[0])], "frames": [n], "area_slope": [cov / var if var >= 1e-9 else 0.0], "area_ratio": [last[2] / max(first[2], 1.0)]})

    return rows.groupBy("track_id").applyInPandasWithState(run, out, "state string", "update", _timeout(idle_s))


def unique_frames(frames: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Frames (camera_id, frame_index, ts) once each, if repetitions come within `late`."""
    return frames.withWatermark("ts", late).dropDuplicatesWithinWatermark(["camera_id", "frame_index"])


def report(readings: DataFrame, every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Readings and highest confidence by camera and window of time, once the watermark has passed it."""
    return readings.withWatermark("ts", late).groupBy(F.window("ts", every), "camera_id").agg(F.count("*").alias("readings"), F.max("confidence").alias("peak")).select(F.col("window.start").alias("start"), "camera_id", "readings", "peak")


def nearest(probes: DataFrame, frames: DataFrame, within_s: int = 90, late: str = "10 minutes") -> DataFrame:
    """network.nearest() of two streams (key, probe_id, at) and (key, frame_id, ts), both times timestamps: key, probe_id, at,
    frame_id and gap_s of the nearest frame at most within_s from a probe, of two the earlier, then the smaller id.

    An interval join, and behind it an aggregate that keeps one frame a probe until the watermark passes the probe, then
    gives it once. Rows that come up to `late` after the newest of their stream count at their time; later ones are
    dropped. The join keeps what may still meet, the aggregate one frame a probe.
    """
    p = probes.select("key", "probe_id", "at").withWatermark("at", late)
    f = frames.select(F.col("key").alias("f_key"), "frame_id", "ts").withWatermark("ts", late)
    near = p.join(f, F.expr(f"key = f_key AND ts >= at - interval {within_s} seconds AND ts <= at + interval {within_s} seconds"))
    micros = F.unix_micros("ts")
    near = near.select("key", "probe_id", "at", "frame_id", micros.alias("ts_us"), F.abs(micros - F.unix_micros("at")).alias("gap_us"))
    best = near.groupBy("at", "key", "probe_id").agg(F.min(F.struct("gap_us", "ts_us", "frame_id")).alias("best"))
    return best.select("key", "probe_id", "at", F.col("best.frame_id").alias("frame_id"), (F.col("best.gap_us") / 1e6).alias("gap_s"))
