"""Measurements in a plane, map projection, detector output and labels, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import CONFIRM_AT, SUSPECT_AT

#: Fixed values.
MAP_PAD, MAP_LEAST_PAD = 0.42, 0.02
STRIDES = (8, 16, 32)


def inverse(h: list[Column]) -> list[Column]:
    """Of a 3 x 3 matrix by row; null where it has none."""
    minor = lambda a, b, c, d: h[a] * h[d] - h[b] * h[c]
    adjugate = [minor(4, 5, 7, 8), -minor(1, 2, 7, 8), minor(1, 2, 4, 5), -minor(3, 5, 6, 8), minor(0, 2, 6, 8), -minor(0, 2, 3, 5), minor(3, 4, 6, 7), -minor(0, 1, 6, 7), minor(0, 1, 3, 4)]
    det = h[0] * adjugate[0] + h[1] * adjugate[3] + h[2] * adjugate[6]
    return [F.when(F.abs(det) > 1e-15, x / det) for x in adjugate]


def transform(h: list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    u, v, w = (h[3 * i] * x + h[3 * i + 1] * y + h[3 * i + 2] for i in range(3))
    return u / w, v / w


def px_to_mm(px: Column, px_per_mm: Column, refusal: Column) -> Column:
    return F.when(refusal.isNull() & px_per_mm.isNotNull(), px / px_per_mm)


def segment_mm(mm_to_px: list[Column], p: tuple[Column, Column], q: tuple[Column, Column]) -> Column:
    """Length in the plane of a segment of the image."""
    back = inverse(mm_to_px)
    (a, b), (c, d) = transform(back, *p), transform(back, *q)
    return F.hypot(a - c, b - d)


def residual_px(h: list[Column], plane: list[tuple[Column, Column]], image: list[tuple[Column, Column]]) -> Column:
    """Root mean square of points' distances from where the plane's points fall."""
    off = [(u - x) * (u - x) + (v - y) * (v - y) for (u, v), (x, y) in ((transform(h, *a), b) for a, b in zip(plane, image, strict=True))]
    return F.sqrt(sum(off[1:], off[0]) / len(off))


def quad_edges(xs: list[Column], ys: list[Column]) -> list[Column]:
    return [F.hypot(xs[(i + 1) % 4] - xs[i], ys[(i + 1) % 4] - ys[i]) for i in range(4)]


def obliquity(xs: list[Column], ys: list[Column], aspect: float = 1.0) -> Column:
    """Degrees by which a rectangle of known aspect seems tilted: corners in order from the upper left."""
    e = quad_edges(xs, ys)
    scaled = [e[0] / aspect, e[1], e[2] / aspect, e[3]]
    longest = F.greatest(*scaled)
    return F.when(longest <= 0, 90.0).otherwise(F.degrees(F.acos(F.least(F.lit(1.0), F.least(*scaled) / longest))))


def plane_tilt(mm_to_px: list[Column], focal: Column, cx: Column, cy: Column) -> Column:
    """Degrees between a plane's normal and the line of sight to it, from its homography and the camera's focal length and
    centre in pixels; null where the homography is degenerate."""
    h = mm_to_px
    m = [[(h[i] - cx * h[6 + i]) / focal, (h[3 + i] - cy * h[6 + i]) / focal, h[6 + i]] for i in range(3)]  # columns
    (a1, a2, a3), (b1, b2, b3), (t1, t2, t3) = m
    n = a2 * b3 - a3 * b2, a3 * b1 - a1 * b3, a1 * b2 - a2 * b1
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2]) * F.sqrt(t1 * t1 + t2 * t2 + t3 * t3)
    cosine = F.abs(n[0] * t1 + n[1] * t2 + n[2] * t3) / size
    return F.when(size > 1e-12, F.degrees(F.acos(F.least(F.lit(1.0), cosine))))


def degenerate(xs: list[Column], ys: list[Column], least_px: float) -> Column:
    """Folded, collinear or tiny: an area below half of the mean edge's square, or an edge below least_px."""
    from .geo import quad_area

    e = quad_edges(xs, ys)
    mean = (e[0] + e[1] + e[2] + e[3]) / 4.0
    return (quad_area(xs, ys) < 0.5 * mean * mean) | (F.least(*e) < least_px)


def map_place(lat: Column, lon: Column, bounds: dict[str, Column], width: float, height: float) -> tuple[Column, Column]:
    """Pixels on a map that shows bounds (min_lat, max_lat, min_lon, max_lon) with a margin; a degree of longitude is
    shortened by the latitude's cosine."""
    pad = {k: F.greatest((bounds[f"max_{k}"] - bounds[f"min_{k}"]) * MAP_PAD, F.lit(MAP_LEAST_PAD)) for k in ("lat", "lon")}
    low = {k: bounds[f"min_{k}"] - pad[k] for k in pad}
    high = {k: bounds[f"max_{k}"] + pad[k] for k in pad}
    shorter = F.cos(F.radians((low["lat"] + high["lat"]) / 2.0))
    wide, tall = (high["lon"] - low["lon"]) * shorter, high["lat"] - low["lat"]
    scale = F.least(width / wide, height / tall)
    return (width - wide * scale) / 2.0 + (lon - low["lon"]) * shorter * scale, height - (height - tall * scale) / 2.0 - (lat - low["lat"]) * scale


def softmax_last(logits: Column) -> Column:
    """The last class's probability; of a single logit, its sigmoid."""
    top = F.array_max(logits)
    total = F.aggregate(logits, F.lit(0.0), lambda a, x: a + F.exp(x - top))
    last = F.element_at(logits, -1)
    return F.when(F.size(logits) == 1, 1.0 / (1.0 + F.exp(-last))).otherwise(F.exp(last - top) / total)


def anchors(size: int, strides: tuple[int, ...] = STRIDES) -> list[tuple[int, int, int]]:
    """(column, row, stride) of a grid detector's outputs, in order."""
    return [(i, j, s) for s in strides for j in range(size // s) for i in range(size // s)]


def decode_box(raw: list[Column], column: Column, row: Column, stride: Column) -> tuple[Column, ...]:
    """(cx, cy, w, h) in pixels of a grid detector's (dx, dy, log w, log h)."""
    return (raw[0] + column) * stride, (raw[1] + row) * stride, F.exp(raw[2]) * stride, F.exp(raw[3]) * stride


def overlaps(a: tuple[Column, ...], b: tuple[Column, ...], pad: float = 16) -> Column:
    """Boxes (x, y, w, h) that touch when each is padded."""
    return ~((a[0] + a[2] + pad < b[0]) | (b[0] + b[2] + pad < a[0]) | (a[1] + a[3] + pad < b[1]) | (b[1] + b[3] + pad < a[1]))


def threshold(asked: Column) -> Column:
    """A caller's threshold, within what makes sense; the default where it is no number."""
    number = asked.try_cast("double")
    return F.when(number.isNull(), F.lit(SUSPECT_AT)).otherwise(F.least(F.greatest(number, F.lit(0.1)), F.lit(CONFIRM_AT - 0.01)))


def where(aim_known: Column, bearing: Column, x_share: Column) -> Column:
    return F.when(aim_known, F.format_string("at bearing %.1f degrees", bearing)).otherwise(F.format_string("at %d%% across the frame", F.bround(100 * x_share).cast("long")))


def alert_id(camera: Column, epoch_s: Column) -> Column:
    return F.concat_ws("-", camera.cast("string"), epoch_s.cast("string"))


def headline(state: Column, range_m: Column, bearing: Column, place: Column, label: Column, site: Column, cameras: Column) -> Column:
    """An alert's first line: range_m is null without a fix, bearing where the camera's aim isn't known."""
    open_ = state == "needs_human"
    lead = F.when(open_, "Unresolved: possible smoke").otherwise("Smoke")
    on = F.format_string(" on bearing %d from %s", F.bround(bearing).cast("long"), label)
    fixed = F.format_string("Smoke %.1f km from %s, confirmed by %d cameras", range_m / 1000.0, site, cameras)
    unaimed = F.concat(lead, F.lit(" "), place, F.lit(", one camera, no location"))
    return F.when(bearing.isNull(), unaimed).when(~open_ & range_m.isNotNull(), fixed).otherwise(F.concat(lead, on))


#: Why an alert has no position, by cause.
_NO_POSITION = {"NO_SECOND_VIEW": "no camera overlooks that bearing", "NEIGHBOURS_BLIND": "every camera that overlooks that bearing is unusable, which is not a stand-down but a gap in cover", "UNRESOLVED": "no neighbour agrees; a person should look at this"}


def fix_sentences(refusal: Column, crossing: Column, semi_major_m: Column, distance_m: Column, corridor_m: Column, cause: Column) -> Column:
    """The last lines of an alert's reasoning, as an array with nulls: how good a fix is, or why there is none and how far the
    closest bearings pass each other."""
    fix = F.format_string("The bearings cross at %.0f degrees, giving a position good to about %.0f m along the long axis.", crossing, semi_major_m)
    why = refusal
    for k, text in _NO_POSITION.items():
        why = F.when(cause == k, text).otherwise(why)
    none = F.concat(F.lit("No position: "), why, F.lit("."))
    verdict = F.when(distance_m <= corridor_m, "they are consistent and it is the geometry that is soft.").otherwise("they are not looking at the same thing.")
    apart = F.concat(F.format_string("The bearings pass %.1f km apart, against a combined uncertainty of %.0f m at that range, so ", distance_m / 1000.0, corridor_m), verdict)
    return F.array(F.when(refusal.isNull() & crossing.isNotNull(), fix).when(why.isNotNull(), none), F.when(refusal.isNotNull() & distance_m.isNotNull(), apart))
