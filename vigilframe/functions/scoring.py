"""Evidence terms, rules against impostors, verdicts: column expressions over a track's growth and its latest region."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Thresholds and the weights of the evidence terms.
SUSPECT_AT, CONFIRM_AT, MINIMUM_FRAMES = 0.45, 0.68, 3
WEIGHTS = {"growth": 0.20, "rise": 0.16, "anchored": 0.16, "veiling": 0.14, "attachment": 0.12, "soft_edges": 0.08, "desaturation": 0.08, "persistence": 0.06}
LEARNED_WEIGHT = 0.12
REJECTION_SHARE, SUPPORTER_SHARE = 0.9, 0.7
HABITUAL, TRUST_FRAMES = 0.35, 25
BLIND = ("night", "fog", "lens_obscured", "glare", "frozen")


def clip(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def evidence(g: dict[str, Column], r: dict[str, Column], height: Column) -> dict[str, Column]:
    """The eight terms in [0, 1] from growth g and region r."""
    return {
        "growth": clip((g["area_ratio"] - 1.0) / 2.0) * (0.4 + 0.6 * g["monotonic"]),
        "rise": clip(g["top_rise"] / (0.03 * height)),
        "anchored": g["anchor"],
        "veiling": clip(1.0 - r["texture_ratio"]),
        "attachment": clip(1.0 - F.abs(r["base_below"]) / (0.12 * height)),
        "soft_edges": r["edge_softness"],
        "desaturation": clip((1.0 - r["saturation_ratio"]) * 1.6),
        "persistence": clip((g["frames"] - 1) / 5.0),
    }


def support(terms: dict[str, Column], has_colour: Column, learned: Column | None = None) -> Column:
    """Weighted mean of the terms; without colour, desaturation doesn't count. A learned probability joins if given."""
    grey = {k: w for k, w in WEIGHTS.items() if k != "desaturation"}
    more = 0.0 if learned is None else learned * LEARNED_WEIGHT
    extra = 0.0 if learned is None else LEARNED_WEIGHT

    def mean(weights):
        return (sum(terms[k] * w for k, w in weights.items()) + more) / F.lit(max(sum(weights.values()) + extra, 1e-6))

    return F.when(has_colour, mean(WEIGHTS)).otherwise(mean(grey))


#: A measure's noise behind this place doesn't decide whether a rule fires.
NOISE = 9

#: What each rule compares with, and the confidence it rejects with.
BRIEF = {"confidence": 0.4}
HABIT = {"most": 0.92, "base": 0.45, "slope": 0.6, "baseline": 0.7}
FLARE = {"luma": 238, "blown": 0.25, "confidence": 0.9}
STATIC = {"frames": 4, "drift": 0.6, "low": 0.85, "high": 1.18, "jitter": 1.5, "softness": 0.25, "confidence": 0.8}
RIDGE = {"height": 14, "below": 14, "flat": 3, "shift": 3, "confidence": 0.75}
WEATHER = {"contrast": 0.55, "texture": 0.75, "confidence": 0.8}
AIR = {"above": -0.05, "rise": 3, "confidence": 0.75}
CLOUD = {"frames": 3, "anchor": 0.28, "drift": 6, "low": 0.55, "high": 1.8, "airborne": 0.85, "confidence": 0.7}
ERRATIC = {"frames": 3, "drift": 12, "anchor": 0.55, "confidence": 0.8}
DUST = {"frames": 3, "rise": 2, "drift": 5, "below": 0, "greyness": 0.42, "confidence": 0.7}


def _rejection(code: str, when: Column, confidence) -> Column:
    value = F.struct(F.lit(code).alias("code"), (confidence if isinstance(confidence, Column) else F.lit(float(confidence))).alias("confidence"))
    return F.when(when, value)


def rejections(g: dict[str, Column], r: dict[str, Column], s: dict[str, Column], support: Column, height: Column, has_colour: Column, minimum: int = MINIMUM_FRAMES) -> Column:
    """Array of (code, confidence) of the rules that fire, by falling confidence, ties in the rules' order: brief, habitual
    (or below the camera's baseline), flare, static, ridge, weather, airborne, cloud, erratic, dust. Measures and support are
    compared to NOISE places."""
    g = {k: g[k] if k in ("frames", "area_ratio") else F.round(g[k], NOISE) for k in ("frames", "area_ratio", "centroid_drift", "base_drift", "horizontal_drift", "top_rise", "jitter", "anchor")}
    airborne = r["base_below"] < AIR["above"] * height
    trusted = s["clear_frames"] >= TRUST_FRAMES
    habituated = trusted & s["use_nuisance"] & (s["habituation"] >= HABITUAL)
    below = trusted & s["use_ceiling"] & (s["ceiling"] > 0) & (F.round(support, NOISE) <= F.round(s["ceiling"] - s["slack"], NOISE))
    habit = F.least(F.lit(HABIT["most"]), HABIT["base"] + HABIT["slope"] * (s["habituation"] - HABITUAL))
    still = (g["frames"] >= STATIC["frames"]) & (g["centroid_drift"] < STATIC["drift"]) & g["area_ratio"].between(STATIC["low"], STATIC["high"])
    thin = (r["h"] <= RIDGE["height"]) & (F.abs(r["base_below"]) <= RIDGE["below"]) & (r["w"] > RIDGE["flat"] * r["h"])
    adrift = (g["frames"] >= CLOUD["frames"]) & (g["anchor"] < CLOUD["anchor"]) & (g["centroid_drift"] > CLOUD["drift"])
    dusty = has_colour & (g["frames"] >= DUST["frames"]) & (g["top_rise"] < DUST["rise"]) & (g["horizontal_drift"] > DUST["drift"])
    fired = [
        _rejection("TOO_BRIEF", g["frames"] < minimum, BRIEF["confidence"]),
        F.coalesce(_rejection("HABITUAL_REGION", habituated, habit), _rejection("BELOW_CAMERA_BASELINE", ~habituated & below, HABIT["baseline"])),
        _rejection("FLARE", (r["mean_luma"] > FLARE["luma"]) & (r["blown"] > FLARE["blown"]), FLARE["confidence"]),
        _rejection("STATIC_ARTEFACT", still & (g["jitter"] < STATIC["jitter"]) & (r["edge_softness"] < STATIC["softness"]), STATIC["confidence"]),
        _rejection("RIDGE_REGISTRATION", thin & ~s["corrected"] & (s["shift"] > RIDGE["shift"]), RIDGE["confidence"]),
        _rejection("WEATHER_FRONT", (s["contrast_ratio"] < WEATHER["contrast"]) & (r["texture_ratio"] > WEATHER["texture"] * s["contrast_ratio"]), WEATHER["confidence"]),
        _rejection("AIRBORNE", airborne & (g["top_rise"] < AIR["rise"]), AIR["confidence"]),
        _rejection("CLOUD_TRANSLATION", adrift & g["area_ratio"].between(CLOUD["low"], CLOUD["high"]), F.when(airborne, CLOUD["airborne"]).otherwise(CLOUD["confidence"])),
        _rejection("ERRATIC_BASE", (g["frames"] >= ERRATIC["frames"]) & (g["base_drift"] > ERRATIC["drift"]) & (g["anchor"] < ERRATIC["anchor"]), ERRATIC["confidence"]),
        _rejection("GROUND_DRIFT", dusty & (r["base_below"] > DUST["below"]) & (r["greyness"] < DUST["greyness"]), DUST["confidence"]),
    ]
    numbered = F.filter(F.array(*(F.struct((-x["confidence"]).alias("c"), F.lit(i).alias("i"), x.alias("x")) for i, x in enumerate(fired))), lambda y: y["x"].isNotNull())
    return F.transform(F.sort_array(numbered), lambda y: y["x"])


def confidence(support: Column, rejections: Column) -> Column:
    """What is left of the support after every rejection."""
    return F.aggregate(rejections, support, lambda a, x: a * (1.0 - REJECTION_SHARE * x["confidence"]))


def verdict(confidence: Column, suspect=SUSPECT_AT, confirm=CONFIRM_AT) -> Column:
    return F.when(confidence >= confirm, "column").when(confidence >= suspect, "suspect").otherwise("clear")


#: Fixed values of the usability ladder: repetitions of a frozen feed, luma of a night's mean and bright end, glare's share and
#: mean, what is left of a camera's own contrast in fog and in haze (and these where that isn't known), fog's darkest
#: channel, and the least confidence in a horizon.
FROZEN_AT, NIGHT_MEAN, NIGHT_P98, GLARE_SHARE, GLARE_MEAN = 2, 42, 110, 0.20, 150
FOG_LEFT, HAZE_LEFT, FOG_CONTRAST, HAZE_CONTRAST, FOG_DARK, LEAST_HORIZON = 0.25, 0.55, 300.0, 450.0, 140, 0.25


def usability(m: dict[str, Column]) -> Column:
    """The first that holds of a scene's measures m: frozen, night, glare, fog, lens_obscured, degraded, usable."""
    base = m["baseline_contrast"]
    known = base.isNotNull() & (base != 0)
    fog = F.when(known, m["contrast"] < FOG_LEFT * base).otherwise(m["contrast"] < FOG_CONTRAST)
    haze = F.when(known, m["contrast"] < HAZE_LEFT * base).otherwise(m["contrast"] < HAZE_CONTRAST)
    return (
        F.when(m["repeat_count"] >= FROZEN_AT, "frozen")
        .when((m["mean_luma"] < NIGHT_MEAN) & (m["p98"] < NIGHT_P98), "night")
        .when((m["saturated"] > GLARE_SHARE) & (m["mean_luma"] > GLARE_MEAN), "glare")
        .when(fog & (m["dark"] > FOG_DARK), "fog")
        .when(m["flat"] & haze, "lens_obscured")
        .when(haze | (m["horizon_confidence"] < LEAST_HORIZON), "degraded")
        .otherwise("usable")
    )


def usability_of(m: dict) -> str:
    """usability() of one scene's numbers, for folds that need the last frame's before they judge the next."""
    base = m["baseline_contrast"]
    fog = m["contrast"] < (FOG_LEFT * base if base else FOG_CONTRAST)
    haze = m["contrast"] < (HAZE_LEFT * base if base else HAZE_CONTRAST)
    ladder = {
        "frozen": m["repeat_count"] >= FROZEN_AT,
        "night": m["mean_luma"] < NIGHT_MEAN and m["p98"] < NIGHT_P98,
        "glare": m["saturated"] > GLARE_SHARE and m["mean_luma"] > GLARE_MEAN,
        "fog": fog and m["dark"] > FOG_DARK,
        "lens_obscured": m["flat"] and haze,
        "degraded": haze or m["horizon_confidence"] < LEAST_HORIZON,
    }
    return next((k for k, holds in ladder.items() if holds), "usable")


def blind_rejection(usability: Column) -> Column:
    """A rejection of confidence 1 for a frame that can't be believed, else null."""
    return _rejection_of(F.concat(F.lit("CAMERA_"), F.upper(usability)), usability.isin(*BLIND))


def _rejection_of(code: Column, when: Column) -> Column:
    return F.when(when, F.struct(code.alias("code"), F.lit(1.0).alias("confidence")))


def confirmer(probability: Column) -> Column:
    return F.when(probability >= 0.62, "supports").when(probability <= 0.28, "contradicts").otherwise("silent")


def answer(frame: Column, blind: Column, best_delta: Column, best_confidence: Column, frames: Column, tolerance: float = 6.0, suspect: float = SUSPECT_AT, least_frames: int = MINIMUM_FRAMES) -> Column:
    """What a consulted camera says of a bearing."""
    strong = (best_confidence >= suspect) & (frames >= least_frames)
    return F.when(~frame, "no_frame").when(blind, "blind").when((F.abs(best_delta) <= tolerance) & strong, "supported").when((F.abs(best_delta) > tolerance) & strong, "off_bearing").otherwise("silent")


def sampling_plan(total: Column, interval_s: Column) -> tuple[Column, Column]:
    """(stride, frames analysed) of a clip: about a minute apart, 40 to 240 frames, at most four minutes apart."""
    stride = F.greatest(F.lit(1), F.bround(60.0 / interval_s).cast("long"))
    stride = F.when(total >= 40, F.greatest(F.lit(1), F.least(stride, F.floor(total / 40)))).otherwise(F.lit(1))
    wider = F.least(F.ceil(total / 240), F.greatest(F.lit(1), F.floor(240.0 / interval_s)))
    stride = F.when(F.ceil(total / stride) > 240, F.greatest(stride, wider)).otherwise(stride)
    stride = F.when(total > 0, stride).otherwise(F.lit(1)).cast("long")
    return stride, F.when(total > 0, F.least(F.ceil(total / stride), F.lit(240))).otherwise(F.lit(0)).cast("long")
