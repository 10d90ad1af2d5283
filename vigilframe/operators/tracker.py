"""Tracks of regions along a camera's frames: a pure step, shared by a batch and a streaming form.

Order matters here (the best pair is taken first, one to one; two missed frames close a track), so each camera's frames
are folded in order. Rows stream through sorted partitions; what is kept per camera is its open tracks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values.
MATCH_IOU, MATCH_DISTANCE, MISSES = 0.10, 0.06, 2
FRAME_WIDTH = 1024.0
OUT = "camera_id long, frame_index long, region long, track_id long"
BOX = ("x", "y", "w", "h", "cx", "cy")


@dataclass
class State:
    """Open tracks of one camera, oldest first: ids, last boxes (x, y, w, h, cx, cy) and missed frames; the next id; the
    last frame seen; the width of its frames."""

    width: float = FRAME_WIDTH
    tracks: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    boxes: np.ndarray = field(default_factory=lambda: np.zeros((0, 6)))
    missed: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    next_id: int = 1
    last_frame: int = -1


def overlap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Intersection over union of every box of a with every box of b."""
    both = np.ones((len(a), len(b)))
    for o in (0, 1):
        both *= np.maximum(np.minimum.outer(a[:, o] + a[:, o + 2], b[:, o] + b[:, o + 2]) - np.maximum.outer(a[:, o], b[:, o]), 0)
    total = np.add.outer(a[:, 2] * a[:, 3], b[:, 2] * b[:, 3]) - both
    return np.divide(both, total, out=np.zeros_like(both), where=total > 0)


def _boxes(boxes) -> np.ndarray:
    """Boxes (x, y, w, h) get their centre as centroid."""
    if not len(boxes):
        return np.zeros((0, 6))
    b = np.asarray(boxes, float)
    return b if b.shape[1] == 6 else np.column_stack([b, b[:, :2] + b[:, 2:] / 2])


def step(state: State, frame_index: int, boxes) -> list[int]:
    """The track id of each box of a frame. A frame that was seen before, or is older, changes nothing: ids are -1.

    A track and a box fit if they overlap enough or their centroids are near; of all that fit, the best are taken first.
    """
    if frame_index <= state.last_frame:
        return [-1] * len(boxes)
    state.last_frame = frame_index
    now, reach = _boxes(boxes), state.width * MATCH_DISTANCE
    out = np.zeros(len(now), np.int64)
    if len(state.tracks):
        state.missed += 1
        if len(now):
            share = overlap(state.boxes, now)
            apart = np.hypot(np.subtract.outer(state.boxes[:, 4], now[:, 4]), np.subtract.outer(state.boxes[:, 5], now[:, 5]))
            t, k = np.nonzero((share >= MATCH_IOU) | (apart <= reach))
            if len(t):
                score = share[t, k] + np.maximum(0.0, 1.0 - apart[t, k] / reach)
                taken = np.zeros(len(state.tracks), bool)
                for i in np.lexsort((k, t, -score)).tolist():
                    if not taken[t[i]] and not out[k[i]]:
                        taken[t[i]], out[k[i]] = True, state.tracks[t[i]]
                        state.boxes[t[i]], state.missed[t[i]] = now[k[i]], 0
    new = np.flatnonzero(out == 0)
    out[new] = state.next_id + np.arange(len(new))
    state.next_id += len(new)
    open_ = state.missed <= MISSES
    state.tracks = np.concatenate([state.tracks[open_], out[new]])
    state.boxes = np.concatenate([state.boxes[open_], now[new]])
    state.missed = np.concatenate([state.missed[open_], np.zeros(len(new), np.int64)])
    return out.tolist()


#: Up to so many pairs of a track and a box are compared one by one, which takes less time than arrays do.
FEW = 64


def _step_few(tracks: list[list], boxes: list[tuple], reach: float, next_id: int) -> tuple[list[list], list[int], int]:
    """step() on plain numbers: open tracks [id, box, missed], oldest first, and boxes (x, y, w, h, cx, cy); the open tracks
    behind it, the ids of the boxes, the next id."""
    fits, out = [], [0] * len(boxes)
    for i, t in enumerate(tracks):
        t[2] += 1
        ax, ay, aw, ah, acx, acy = t[1]
        for k, (x, y, w, h, cx, cy) in enumerate(boxes):
            both = max(min(ax + aw, x + w) - max(ax, x), 0.0) * max(min(ay + ah, y + h) - max(ay, y), 0.0)
            total = aw * ah + w * h - both
            share = both / total if total > 0 else 0.0
            apart = abs(complex(acx - cx, acy - cy))  # as numpy's hypot rounds
            if share >= MATCH_IOU or apart <= reach:
                fits.append((-(share + max(0.0, 1.0 - apart / reach)), i, k))
    for _, i, k in sorted(fits):
        t = tracks[i]
        if t[2] and not out[k]:
            out[k], t[1], t[2] = t[0], boxes[k], 0
    tracks = [t for t in tracks if t[2] <= MISSES]
    for k, known in enumerate(out):
        if not known:
            out[k] = next_id
            tracks.append([next_id, boxes[k], 0])
            next_id += 1
    return tracks, out, next_id


def fold(state: State, frames: np.ndarray, boxes: np.ndarray) -> np.ndarray:
    """Track ids of the rows of one camera, which are sorted by frame. Frames of few boxes and tracks are taken as plain
    numbers, others as arrays; both do the same."""
    out = np.full(len(frames), -1, np.int64)
    cuts = np.flatnonzero(np.diff(frames, prepend=frames[:1] - 1)).tolist() if len(frames) else []
    numbers, rows, reach, tracks = frames.tolist(), list(map(tuple, boxes.tolist())), state.width * MATCH_DISTANCE, None
    plain = bool(np.isfinite(boxes).all())
    for a, b in zip(cuts, [*cuts[1:], len(frames)], strict=True):
        if not plain or (len(state.tracks) if tracks is None else len(tracks)) * (b - a) > FEW:
            _kept(state, tracks)
            tracks = None
            out[a:b] = step(state, numbers[a], boxes[a:b])
        elif numbers[a] > state.last_frame:
            if tracks is None:
                tracks = [[i, tuple(x), n] for i, x, n in zip(state.tracks.tolist(), state.boxes.tolist(), state.missed.tolist(), strict=True)]
            state.last_frame = numbers[a]
            tracks, out[a:b], state.next_id = _step_few(tracks, rows[a:b], reach, state.next_id)
    _kept(state, tracks)
    return out


def _kept(state: State, tracks: list[list] | None) -> None:
    """Puts open tracks that were taken as plain numbers back into their state."""
    if tracks is not None:
        state.tracks, state.missed = (np.array([t[k] for t in tracks], np.int64) for k in (0, 2))
        state.boxes = np.array([t[1] for t in tracks], float).reshape(-1, 6)


def with_centroids(regions: DataFrame) -> DataFrame:
    """The columns that tracking takes; boxes without centroids get their centres."""
    own = {"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2}
    placed = regions.withColumns({c: v for c, v in own.items() if c not in regions.columns})
    return placed.select("camera_id", "frame_index", "region", *(F.col(c).cast("double").alias(c) for c in BOX))


def track(regions: DataFrame, width: float = FRAME_WIDTH) -> DataFrame:
    """(camera_id, frame_index, region, track_id) of regions (camera_id, frame_index, region, x, y, w, h and, if they have
    them, centroids cx and cy) in frames of `width` pixels."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        camera, state, held = None, None, None
        for b in it:
            keys = [b.column(k).to_numpy() for k in range(3)]
            boxes = np.column_stack([b.column(k).to_numpy() for k in range(3, 9)])
            if held is not None:
                keys, boxes = [np.concatenate(x) for x in zip(held[0], keys, strict=True)], np.concatenate([held[1], boxes])
            if not len(boxes):
                continue
            # A frame's rows may go on in the next batch.
            before = np.flatnonzero((keys[0] != keys[0][-1]) | (keys[1] != keys[1][-1]))
            end = int(before[-1]) + 1 if len(before) else 0
            held = [k[end:] for k in keys], boxes[end:]
            camera, state, ids = _fold_cameras(camera, state, [k[:end] for k in keys], boxes[:end], width)
            yield pa.record_batch([*(pa.array(k[:end]) for k in keys), pa.array(ids)], names=_names)
        if held is not None:
            ids = _fold_cameras(camera, state, *held, width)[2]
            yield pa.record_batch([*(pa.array(k) for k in held[0]), pa.array(ids)], names=_names)

    rows = with_centroids(regions).withColumns({c: F.col(c).cast("long") for c in _names[:3]})
    return rows.repartition("camera_id").sortWithinPartitions("camera_id", "frame_index", "region").mapInArrow(run, OUT)


_names = [c.split()[0] for c in OUT.split(", ")]


def _fold_cameras(camera, state, keys, boxes, width):
    """(last camera, its state, ids) of rows sorted by camera and frame, going on from a camera's state."""
    ids = np.empty(len(boxes), np.int64)
    cuts = np.flatnonzero(np.diff(keys[0], prepend=keys[0][:1] - 1)).tolist() if len(boxes) else []
    for a, b in zip(cuts, [*cuts[1:], len(boxes)], strict=True):
        if camera is None or keys[0][a] != camera:
            camera, state = keys[0][a], State(width)
        ids[a:b] = fold(state, keys[1][a:b], boxes[a:b])
    return camera, state, ids


def suppress(boxes: DataFrame, most: float = 0.45) -> DataFrame:
    """Non-maximum suppression within each (image, label) of boxes (image, label, box, score, x, y, w, h): the best box
    stays, those that overlap it by more than `most` go, and so on; ties by the smaller box.

    Boxes stream from the best on, and only those that stayed are held. Boxes with null places overlap nothing.
    """

    columns = [boxes.columns.index(c) for c in ("image", "label", "x", "y", "w", "h")]

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, kept = None, np.empty((0, 4))
        for batch in it:
            images, labels = (batch.column(k).to_pylist() for k in columns[:2])
            places = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(float) for k in columns[2:]])
            stays = np.zeros(len(places), bool)
            starts = [k for k in range(len(images)) if k == 0 or (images[k], labels[k]) != (images[k - 1], labels[k - 1])]
            for a, b in zip(starts, [*starts[1:], len(images)], strict=True):
                if (images[a], labels[a]) != group:
                    group, kept = (images[a], labels[a]), np.empty((0, 4))
                left = np.arange(a, b)
                left = left[_clear_of(kept, places[left], most)]
                while len(left):
                    stays[left[0]] = True
                    left = left[1:][_clear_of(places[left[:1]], places[left[1:]], most)]
                kept = np.concatenate([kept, places[a:b][stays[a:b]]])
            yield batch.filter(pa.array(stays))

    order = ["image", "label", F.desc("score"), "box"]
    return boxes.repartition("image", "label").sortWithinPartitions(*order).mapInArrow(run, boxes.schema)


#: Boxes that are compared at once with those kept before.
KEPT_AT_ONCE = 1024


def _clear_of(kept: np.ndarray, boxes: np.ndarray, most: float) -> np.ndarray:
    """Which boxes overlap none of those kept by more than `most`."""
    clear = np.ones(len(boxes), bool)
    for k in range(0, len(kept), KEPT_AT_ONCE):
        clear[clear] = (overlap(kept[k : k + KEPT_AT_ONCE], boxes[clear]) <= most).all(axis=0)
    return clear
