"""From frames to regions: a background per camera, what differs from it, and measurements of the largest parts."""

from __future__ import annotations

import copy
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..functions import pixels, scoring

#: Frames before a background counts, and the least weight of a new frame in it.
WARM_UP, LEAST_WEIGHT = 5, 0.2
REGION = "camera_id string, frame_index int, minute double, region int, x int, y int, w int, h int, area int, cx double, cy double, base_cx double, base_cy double, elongation double, texture_ratio double, saturation_ratio double, greyness double, edge_softness double, base_below double, mean_luma double, blown double, coverage array<double>"
SCENE = "camera_id string, frame_index int, mean_luma double, p98 double, contrast double, dark double, saturated double, difference double"
WATCHED = SCENE + ", flat boolean, horizon_confidence double, repeat_count int, baseline_contrast double, usability string"
#: The mean difference below which a frame repeats the last, how many usable frames make a camera's own
#: contrast, and how many it takes at least.
REPEATS_BELOW, CONTRASTS, LEAST_CONTRASTS = 0.35, 12, 4


class Background:
    """Running means by time of day (12 buckets); the nearest learnt bucket stands in for an empty one."""

    def __init__(self):
        self.mean: dict[int, np.ndarray] = {}
        self.seen: dict[int, int] = {}
        self.learnt = 0

    def reference(self, bucket: int) -> np.ndarray | None:
        near = min(self.mean, key=lambda b: (min(abs(b - bucket), 12 - abs(b - bucket)), b), default=None)
        return None if near is None else self.mean[near]

    def difference(self, grey: np.ndarray, bucket: int) -> np.ndarray | None:
        """Gain and offset, then low-frequency shading, are taken out; null while warming up."""
        ref = self.reference(bucket)
        if ref is None or self.learnt < WARM_UP:
            return None
        gain, offset = pixels.photometric_fit(grey, ref)
        rest = grey - gain * ref - offset
        return rest - pixels.shading(rest)

    def learn(self, grey: np.ndarray, bucket: int, where: np.ndarray | None = None) -> None:
        n = self.seen[bucket] = self.seen.get(bucket, 0) + 1
        self.learnt += 1
        old = self.mean.get(bucket)
        if old is None:
            self.mean[bucket] = grey.copy()
        else:
            weight = max(1 / n, LEAST_WEIGHT)
            self.mean[bucket] = old + weight * (grey - old) * (1 if where is None else where)


def _ordered(frames: DataFrame) -> DataFrame:
    return frames.select("camera_id", "frame_index", "minute", "height", "width", "data").repartition("camera_id").sortWithinPartitions("camera_id", "frame_index")


def packed(arrays: dict[str, np.ndarray]) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, **arrays)
    return out.getvalue()


def unpacked(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        return dict(z)


class Scene:
    """What the usability ladder needs of one camera's past: its last frame, how often that was repeated, and the contrasts
    of the latest frames that didn't blind it."""

    def __init__(self):
        self.previous, self.repeats, self.contrasts, self.newest = None, 0, [], -1

    def observe(self, frame_index: int, image: np.ndarray) -> dict:
        """Measures and usability (WATCHED without camera_id) of the next frame."""
        m = {"frame_index": frame_index, "difference": None} | pixels.scene_measures(image, self.previous)
        again = m["difference"] is not None and m["difference"] < REPEATS_BELOW
        sky = pixels.horizon(image)
        m["flat"], m["horizon_confidence"] = bool(sky["flat"]), float(sky["confidence"])
        m["repeat_count"] = self.repeats = self.repeats + 1 if again else 0
        m["baseline_contrast"] = float(np.median(self.contrasts)) if len(self.contrasts) >= LEAST_CONTRASTS else None
        m["usability"] = scoring.usability_of(m)
        self.previous, self.newest = image, frame_index
        if m["usability"] not in scoring.BLIND:
            self.contrasts = [*self.contrasts, m["contrast"]][-CONTRASTS:]
        return m

    def to_bytes(self) -> bytes:
        arrays = {"counts": np.array([self.repeats, self.newest]), "contrasts": np.array(self.contrasts, float)}
        return packed(arrays if self.previous is None else arrays | {"previous": self.previous})

    @classmethod
    def from_bytes(cls, data: bytes) -> Scene:
        out, z = cls(), unpacked(data)
        (out.repeats, out.newest), out.contrasts, out.previous = map(int, z["counts"]), z["contrasts"].tolist(), z.get("previous")
        return out


class Watch:
    """All that is kept of one camera between frames: its background, its mixture of Gaussians, the frame that the next
    ones are moved onto and, if frames that blind it are to be skipped, its scene."""

    def __init__(self, height: int, width: int, skip_blind: bool = False):
        self.model, self.mixture, self.last, self.newest = Background(), pixels.Mixture((height, width)), None, -1
        self.scene = Scene() if skip_blind else None

    def observe(self, frame_index: int, minute: float, data: bytes, least: int, learns: bool = True) -> list[dict]:
        """Regions of the next frame, which is then learnt unless learns is false: in that case nothing changes."""
        shape = self.mixture.weight.shape[1:]
        image = np.frombuffer(data, np.uint8).reshape(shape)
        self.newest = frame_index
        if self.scene is not None:
            scene = self.scene if learns else copy.copy(self.scene)
            if scene.observe(frame_index, image)["usability"] in scoring.BLIND:
                return []
        grey = image.astype(float)
        if self.last is not None:
            dx, dy, _, moved = pixels.align(grey, self.last)
            grey = pixels.shift(grey, dx, dy) if moved else grey
        self.last = grey if learns or self.last is None else self.last
        kept = None if learns else self.mixture.copy()
        foreground = pixels.close(pixels.open_(self.mixture.foreground(grey), pixels.ELLIPSE3), pixels.ELLIPSE3, 2)
        bucket = int(minute / 120) % 12
        change = self.model.difference(grey, bucket)
        mask, found = None, []
        if change is not None:
            mask = foreground | pixels.hysteresis(np.abs(change))
            sky = pixels.horizon(grey)["boundary"]
            keep = np.arange(shape[0])[:, None] <= sky + 0.3 * shape[0]
            keep[: int(0.02 * shape[0])] = False
            mask &= keep
            mask = pixels.open_(pixels.close(mask, pixels.ELLIPSE5, 2), pixels.ELLIPSE5)
            found = [{"frame_index": frame_index, "minute": minute, "region": k} | m for k, m in enumerate(pixels.regions(mask, grey, sky, least))]
        if learns:
            self.model.learn(grey, bucket, None if mask is None else ~mask)
        else:
            self.mixture = kept
        return found

    def to_bytes(self) -> bytes:
        m, x = self.model, self.mixture
        buckets = sorted(m.mean)
        arrays = {"weight": x.weight, "mean": x.mean, "var": x.var, "counts": np.array([x.frames, m.learnt, self.newest]), "buckets": np.array(buckets, int), "seen": np.array([m.seen[b] for b in buckets], int)}
        arrays |= {f"bucket{b}": m.mean[b] for b in buckets}
        if self.scene is not None:
            arrays["scene"] = np.frombuffer(self.scene.to_bytes(), np.uint8)
        return packed(arrays if self.last is None else arrays | {"last": self.last})

    @classmethod
    def from_bytes(cls, data: bytes) -> Watch:
        z = unpacked(data)
        out = cls(*z["weight"].shape[1:])
        out.mixture.weight, out.mixture.mean, out.mixture.var = z["weight"], z["mean"], z["var"]
        out.mixture.frames, out.model.learnt, out.newest = map(int, z["counts"])
        for b, n in zip(z["buckets"].tolist(), z["seen"].tolist(), strict=True):
            out.model.mean[b], out.model.seen[b] = z[f"bucket{b}"], n
        out.last = z.get("last")
        out.scene = Scene.from_bytes(z["scene"].tobytes()) if "scene" in z else None
        return out


def table(rows: list[dict], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def regions(frames: DataFrame, least: int = 40, learn_until: int | None = None, skip_blind: bool = False) -> DataFrame:
    """Regions of frames (camera_id, frame_index, minute, height, width, data: grey bytes). A camera's frames stream in
    order through one background; pixels that changed aren't learnt. Each is first moved onto the camera's last frame; the
    mask joins what a mixture of Gaussians takes for foreground to what differs from the background, and is closed and
    opened before it is labelled. With learn_until, frames from that number on are judged by the model as it was then:
    they are examined again without teaching it what they show. With skip_blind, frames that blind a camera (see watched)
    give no regions and aren't learnt."""

    def run(it):
        camera, watch = None, None
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                if r.camera_id != camera:
                    camera, watch = r.camera_id, Watch(r.height, r.width, skip_blind)
                learns = learn_until is None or r.frame_index < learn_until
                out += [{"camera_id": camera} | m for m in watch.observe(r.frame_index, r.minute, r.data, least, learns)]
            yield table(out, REGION)

    return _ordered(frames).mapInPandas(run, REGION)


def scenes(frames: DataFrame) -> DataFrame:
    """What the usability ladder asks of each frame; difference is to the camera's last one."""

    def run(it):
        camera, last = None, None
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                image = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)
                out.append({"camera_id": r.camera_id, "frame_index": r.frame_index} | pixels.scene_measures(image, last if r.camera_id == camera else None))
                camera, last = r.camera_id, image
            yield table(out, SCENE)

    return _ordered(frames).mapInPandas(run, SCENE)


def watched(frames: DataFrame) -> DataFrame:
    """Scenes in order with repetitions, each camera's own contrast (the median of its latest frames that didn't blind it;
    null while there are too few) and usability, as WATCHED."""

    def run(it):
        camera, scene = None, None
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                if r.camera_id != camera:
                    camera, scene = r.camera_id, Scene()
                out.append({"camera_id": camera} | scene.observe(r.frame_index, np.frombuffer(r.data, np.uint8).reshape(r.height, r.width)))
            yield table(out, WATCHED)

    return _ordered(frames).mapInPandas(run, WATCHED)
