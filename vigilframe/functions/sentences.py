"""Sentences that say why a detection was scored as it was, as column expressions over its growth g, region r and scene s."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import measures, wire
from .scoring import MINIMUM_FRAMES, WEIGHTS

#: Fixed value: what a verdict's sentence begins with.
LEADS = {"column": "A column", "suspect": "Something", "clear": "Nothing worth calling"}


def fixed(x: Column, places: int = 0, sign: str = "") -> Column:
    """x as text with that many decimals, halves to the even digit."""
    return F.format_string(f"%{sign}.{places}f", wire.even(x, places))


def _percent(x: Column) -> Column:
    return F.concat(fixed(100 * x), F.lit("%"))


def _said(*parts) -> Column:
    return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))


def reasons(g: dict[str, Column], r: dict[str, Column]) -> dict[str, Column]:
    """A sentence for each term of the evidence. The wording is fixed, as consumers show and search it."""
    whole = lambda x: x.cast("long").cast("string")
    return {
        "growth": _said("it grew from ", whole(g["area_first"]), " to ", whole(g["area_last"]), " px over ", fixed(g["span_min"]), " minutes, without shrinking in ", _percent(g["monotonic"]), " of steps"),
        "rise": _said("its top edge climbed ", fixed(g["top_rise"], 1), " px a minute"),
        "anchored": _said("its base stayed put while its top moved (anchor ", fixed(g["anchor"], 2), ", base drift ", fixed(g["base_drift"], 1), " px a minute)"),
        "veiling": _said("the detail behind it dropped to ", _percent(r["texture_ratio"]), " of what the background reference has there, which is what a translucent veil does"),
        "attachment": _said("its base sits ", fixed(r["base_below"], 0, "+"), " px from the skyline, so it is joined to the ground"),
        "soft_edges": _said("its boundary is soft (softness ", fixed(r["edge_softness"], 2), "), not a hard edge"),
        "desaturation": _said("it is ", _percent(1 - r["saturation_ratio"]), " less saturated than its surroundings"),
        "persistence": _said("it has been there for ", whole(g["frames"]), " frames"),
    }


def objection(code: Column, g: dict[str, Column], r: dict[str, Column], s: dict[str, Column], support: Column) -> Column:
    """What the rule of that code says against a detection; null for a code without a rule here. Fixed wording, too."""
    whole = lambda x: x.cast("long").cast("string")
    change = _percent(F.abs(1 - g["area_ratio"]))
    said = {
        "TOO_BRIEF": _said("seen in ", whole(g["frames"]), F.when(g["frames"] == 1, " frame").otherwise(" frames"), f"; a column is identified by how it grows, which needs at least {MINIMUM_FRAMES}"),
        "HABITUAL_REGION": _said("this camera raises a candidate in this part of its view on ", _percent(s["habituation"]), " of its clear frames, learned from ", whole(s["clear_frames"]), " frames on other days; whatever it is, it was already there"),
        "BELOW_CAMERA_BASELINE": _said("scored ", fixed(support, 2), ", and this camera reaches ", fixed(s["ceiling"], 2), " on its clear frames; that is not unusual for this view"),
        "FLARE": _said("mean brightness ", fixed(r["mean_luma"]), " of 255 with ", _percent(r["blown"]), " of it clipped; smoke scatters light, it does not saturate a sensor"),
        "STATIC_ARTEFACT": _said("unchanged for ", whole(g["frames"]), " frames — it moved ", fixed(g["centroid_drift"], 2), " px a minute, changed area by ", change, ", and has a hard edge (softness ", fixed(r["edge_softness"], 2), "); that is on the glass, not on the hill"),
        "RIDGE_REGISTRATION": _said("a ", whole(r["w"]), "x", whole(r["h"]), " px sliver sitting on the skyline in a frame that moved ", fixed(s["shift"], 1), " px and could not be re-registered"),
        "WEATHER_FRONT": _said("detail contrast across the entire frame fell to ", _percent(s["contrast_ratio"]), " of this camera's recent normal, and this patch is no softer than the rest of it"),
        "AIRBORNE": _said("the bottom of this shape sits ", fixed(-r["base_below"]), " px above the skyline with nothing joining it to the ground"),
        "CLOUD_TRANSLATION": _said("the whole shape moved ", fixed(g["centroid_drift"], 1), " px a minute while its area changed by only ", change, ", and its base moved as fast as its top (anchor ", fixed(g["anchor"], 2), "); that is something passing through, not something growing out of the ground"),
        "ERRATIC_BASE": _said("the bottom of this shape travelled ", fixed(g["base_drift"]), " px a minute; the base of a real column stays where the fire is"),
        "GROUND_DRIFT": _said("it tracked sideways at ", fixed(g["horizontal_drift"], 1), " px a minute below the skyline without rising (", fixed(g["top_rise"], 1), " px a minute), and its colour is not neutral (greyness ", fixed(r["greyness"], 2), ")"),
    }
    text = F.lit(None).cast("string")
    for k, v in said.items():
        text = F.when(code == k, v).otherwise(text)
    return text


def strongest(terms: dict[str, Column], has_colour: Column, texts: dict[str, Column], n: int = 2) -> Column:
    """The texts of the n terms that contribute most, in that order, ties in the terms' order; without colour, desaturation
    is no reason."""
    rank = lambda i, k: F.struct((-F.round(terms[k] * WEIGHTS[k], 9)).alias("c"), F.lit(i).alias("i"), texts[k].alias("text"))
    items = F.array(*(F.when(has_colour | F.lit(k != "desaturation"), rank(i, k)) for i, k in enumerate(WEIGHTS)))
    return F.transform(F.slice(F.array_sort(F.filter(items, lambda x: x.isNotNull())), 1, n), lambda x: x["text"])


def detection(verdict: Column, aim_known: Column, bearing: Column, x_share: Column, because: Column, against: Column) -> Column:
    """A detection in one sentence, and a second one where a rule speaks against it (`against` not null)."""
    lead = F.lit(None).cast("string")
    for k, v in LEADS.items():
        lead = F.when(verdict == k, v).otherwise(lead)
    why = F.when(F.size(because) > 0, F.array_join(because, "; ")).otherwise("no positive evidence")
    but = F.when(against.isNotNull(), F.concat(F.lit(" Against it: "), against, F.lit("."))).otherwise("")
    return F.concat(lead, F.lit(" "), measures.where(aim_known, wire.even(bearing, 1), x_share), F.lit(": "), why, F.lit("."), but)


def coverage(analysed: Column, total: Column, stride: Column) -> Column:
    every = F.when(stride > 1, F.format_string(", one in every %d", stride)).otherwise("")
    return F.concat(F.format_string("analysed %d of %d frames", analysed, total), every)
