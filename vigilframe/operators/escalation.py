"""The escalation of a suspect reading: a state machine folded over an incident's ticks.

States: watch, suspect, consult, confirmed, alerted, stood_down, needs_human. A tick's sweep is every camera's best
detection with the answers of the cameras that overlook its bearing and what re-examining its last frames with a frozen
model found, joined beforehand, so that the fold reads nothing. Cameras that can't be believed come as rows with the reason.
streaming.escalating runs the same machine on keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, measures
from ..functions.scoring import CONFIRM_AT, SUPPORTER_SHARE, SUSPECT_AT
from . import fixes

#: Fixed values.
ROUNDS, ESCALATE_FRAMES, CAP, MOST_ALERTS, AGAIN_FRAMES = 3, 4, 0.99, 8, 4
#: Rows that a fold hands on at once.
BATCH = 2000
OUT = "incident long, seq long, tick long, kind string, state string, cause string, camera_id long, confidence double, reasoning array<string>, supporters long"
ANSWER = "array<struct<camera_id: bigint, outcome: string, confidence: double, said: string>>"
SWEEP = {"camera_id": "long", "track_id": "long", "confidence": "double", "frames": "long", "summary": "string", "blind": "string", "again": "double", "again_frames": "long", "answers": ANSWER}


@dataclass
class Machine:
    """What is known of an incident so far; everything is plain numbers, texts, lists and dictionaries."""

    keep_watching: bool = True
    most_alerts: int = MOST_ALERTS
    state: str = "watch"
    rounds: int = 0
    pursued: list | None = None  # camera and track
    asked: list = field(default_factory=list)  # in this pursuit
    blind: list = field(default_factory=list)  # cameras that ever were when asked
    silent: bool = False  # whether one that was asked ever saw nothing on the bearing
    supported: int = 0  # answers that ever supported
    told: dict = field(default_factory=dict)  # the first answer of each camera asked
    unusable: dict = field(default_factory=dict)  # cameras and why
    alerts: int = 0
    over: bool = False
    last: int | None = None
    n: int = 0  # rows said so far
    rows: list = field(default_factory=list)

    #: Tracks that were raised, and how loudly: 1 for a person to settle, 2 for an assertion. Kept apart: it alone may grow.
    flagged: dict = field(default_factory=dict)

    def dump(self) -> dict:
        return {k: v for k, v in asdict(self).items() if k not in ("rows", "flagged", "unusable")}

    def say(self, tick, kind, state, cause, camera, confidence, reasoning=None, supporters=None):
        self.rows.append((self.n, tick, kind, state, cause, camera, confidence, reasoning, supporters))
        self.n += 1

    def go(self, tick, state, cause, camera, confidence):
        self.state = state
        self.say(tick, "transition", state, cause, camera, confidence)

    def forget(self):
        self.rounds, self.pursued, self.asked = 0, None, []

    def alert(self, tick, best, confidence, state, cause):
        confidence = min(confidence, CAP)
        camera = best["camera_id"]
        told = [f"camera {c}: {said}" for c, said in self.told.items()]
        others = [f"camera {c} could not help: {why}" for c, why in self.unusable.items() if c not in self.told]
        self.say(tick, "alert", state, cause, camera, confidence, [best.get("summary") or f"scored {best['confidence']:.2f}", *told, *others], self.supported)
        self.alerts += 1
        self.go(tick, state, "alert_raised", camera, confidence)
        if self.keep_watching and self.alerts < self.most_alerts:
            self.flagged[camera, best["track_id"]] = 2 if confidence >= CONFIRM_AT else 1
            self.go(tick, "watch", "kept_watching", camera, confidence)
            self.forget()
        else:
            self.over = True

    def tick(self, tick: int, sweep: list[dict]) -> None:
        """One sweep, in the order of cameras: a dictionary a camera with camera_id and either blind (why it can't be
        believed) or its best detection's track_id, confidence, frames, answers, again and again_frames, or neither."""
        if self.over:
            return
        self.last, found = tick, []
        for d in sweep:
            if d.get("blind"):
                self.unusable[d["camera_id"]] = d["blind"]
                continue
            self.unusable.pop(d["camera_id"], None)
            raised = self.flagged.get((d["camera_id"], d["track_id"]), 0)
            if d["confidence"] is not None and raised < (2 if d["confidence"] >= CONFIRM_AT else 1):
                found.append(d)
        if not found:
            return
        best = max(found, key=lambda d: d["confidence"])
        if [best["camera_id"], best["track_id"]] != self.pursued:
            self.forget()
            self.pursued = [best["camera_id"], best["track_id"]]
        c = best["confidence"]
        if c < SUSPECT_AT:
            if self.state != "watch":
                self.go(tick, "watch", "faded", best["camera_id"], c)
                self.forget()
            return
        if self.state in ("watch", "stood_down"):
            self.go(tick, "suspect", "weak_detection", best["camera_id"], c)
        if (best.get("again") or 0.0) > c:
            best = best | {"confidence": best["again"], "frames": best["again_frames"]}
            if best["again"] - c > 1e-6:
                self.say(tick, "transition", self.state, "re_examined", best["camera_id"], best["again"])
        if best["frames"] >= ESCALATE_FRAMES:
            self.consult(tick, best)

    def consult(self, tick: int, best: dict) -> None:
        c, camera = best["confidence"], best["camera_id"]
        if not best["answers"]:
            sure = c >= CONFIRM_AT
            self.go(tick, *(("confirmed", "single_camera_confident") if sure else ("needs_human", "no_second_view")), camera, c)
            self.alert(tick, best, c, "alerted" if sure else "needs_human", "NO_SECOND_VIEW")
            return
        self.go(tick, "consult", "bearing_selected_cameras", camera, c)
        self.rounds += 1
        fresh = [a for a in best["answers"] if a[0] not in self.asked] or best["answers"]
        support = []
        for other, outcome, confidence, *said in fresh:
            self.asked += [] if other in self.asked else [other]
            self.told.setdefault(other, said[0] if said and said[0] else outcome)
            if outcome == "blind":
                self.blind += [] if other in self.blind else [other]
                self.unusable[other] = said[0] if said and said[0] else outcome
            elif outcome == "supported":
                support.append(confidence or 0.0)
            self.silent = self.silent or outcome in ("silent", "off_bearing")
        self.supported += len(support)
        if support and c + 0.5 * sum(support) >= CONFIRM_AT:
            joint = 1 - c
            for s in support:
                joint *= 1 - SUPPORTER_SHARE * s
            self.go(tick, "confirmed", "crossed_bearings", camera, 1 - joint)
            self.alert(tick, best, 1 - joint, "alerted", "crossed_bearings")
        elif self.rounds >= ROUNDS:
            if not self.silent and any(x in self.asked for x in self.blind):
                self.go(tick, "needs_human", "neighbours_blind", camera, c)
                self.alert(tick, best, c, "needs_human", "NEIGHBOURS_BLIND")
            elif c >= CONFIRM_AT:
                self.go(tick, "needs_human", "unresolved", camera, c)
                self.alert(tick, best, c, "needs_human", "UNRESOLVED")
            else:
                self.go(tick, "stood_down", "not_corroborated", camera, c)
                self.rounds, self.asked = 0, []

    def end(self) -> None:
        """The incident has no more ticks."""
        if self.last is not None and not self.over:
            self.over = True
            self.go(self.last, "needs_human" if self.alerts else "watch", "sequence_ended", None, None)


def prepared(sweeps: DataFrame, *more: str) -> DataFrame:
    """sweeps with all of SWEEP's columns, null where they lack, and `more`."""
    have = {c: F.col(c) if c in sweeps.columns else F.lit(None) for c in SWEEP}
    if "answers" in sweeps.columns:
        part = sweeps.schema["answers"].dataType.elementType.names
        have["answers"] = F.transform("answers", lambda a: F.struct(*(a[n].alias(n) if n in part else F.lit(None).alias(n) for n in ("camera_id", "outcome", "confidence", "said"))))
    return sweeps.select(F.col("incident").cast("long"), F.col("tick").cast("long"), *(v.cast(SWEEP[c]).alias(c) for c, v in have.items()), *more)


def rows_of(pdf: pd.DataFrame) -> list[dict]:
    """A frame's rows as the machine takes them: answers as tuples, nulls as None."""
    columns = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in pdf.columns]  # much faster than to_dict
    out = [dict(zip(pdf.columns, r, strict=True)) for r in zip(*columns, strict=True)]
    for r in out:
        r["answers"] = [(a["camera_id"], a["outcome"], a["confidence"], a["said"]) for a in (r["answers"] if r["answers"] is not None else [])]
        for k in ("track_id", "frames", "again_frames", "camera_id"):
            r[k] = None if r[k] is None else int(r[k])
    return out


def escalate(sweeps: DataFrame, keep_watching: bool = True, most_alerts: int = MOST_ALERTS) -> DataFrame:
    """Transitions and alerts, numbered, of sweeps (incident, tick, camera_id, track_id, confidence, frames, answers; also
    blind, again, again_frames, summary where there are any). Rows stream through partitions sorted by incident and tick,
    and one machine is kept at a time. An incident ends with its last tick, with its first alert where it isn't to keep
    watching, or with its `most_alerts`-th.

    A row without a track is a camera that sees nothing; rows of a camera that tie are taken in order of track. Rows without
    an incident or a tick are left out.
    """

    def run(it):
        done = []
        for incident, machine, _ in _folded(it, keep_watching, most_alerts):
            done += [(incident, *row) for row in machine.rows]
            if len(done) >= BATCH:
                yield said(done)
                done = []
        yield said(done)

    return _walkable(sweeps).mapInPandas(run, OUT)


def _walkable(sweeps: DataFrame) -> DataFrame:
    rows = prepared(sweeps).filter("incident is not null and tick is not null")
    return rows.repartition("incident").sortWithinPartitions("incident", "tick", "camera_id", "track_id")


def _folded(it: Iterator[pd.DataFrame], keep_watching: bool, most_alerts: int) -> Iterator[tuple[int, Machine, int]]:
    """(incident, its machine at its end, readings that it looked at) from sorted rows, one machine at a time."""
    now, machine, tick, sweep, read = None, None, None, [], 0
    for pdf in it:
        for r in rows_of(pdf):
            if (r["incident"], r["tick"]) != (now, tick):
                if sweep:
                    read += 0 if machine.over else len(sweep)
                    machine.tick(tick, sweep)
                sweep, tick = [], r["tick"]
                if r["incident"] != now:
                    if machine:
                        machine.end()
                        yield now, machine, read
                    now, machine, read = r["incident"], Machine(keep_watching, most_alerts), 0
            sweep.append(r)
    if machine:
        read += 0 if machine.over else len(sweep)
        machine.tick(tick, sweep)
        machine.end()
        yield now, machine, read


RECORD = {
    "incident": "long", "state": "string", "frames_read": "long", "consulted": "array<bigint>", "unusable": "array<struct<camera_id: bigint, reason: string>>",
    "alerts": "long", "confidence": "double", "stopped_early": "string",
}


def records(sweeps: DataFrame, keep_watching: bool = True, most_alerts: int = MOST_ALERTS) -> DataFrame:
    """A row per incident of what its escalation came to: the last state, the readings looked at, the cameras ever
    consulted, those that couldn't be believed at the end and why, alerts, the last alert's confidence, and why it stopped
    before the end of the footage, if it did. sweeps as escalate takes them."""

    def run(it):
        done = []
        for incident, machine, read in _folded(it, keep_watching, most_alerts):
            raised = [row for row in machine.rows if row[2] == "alert"]
            ended = machine.rows and machine.rows[-1][4] == "sequence_ended"
            early = None if ended or not raised else f"The watch stopped at its {len(raised)}th flag, the most one upload may raise, before the end of the footage"
            confidence = raised[-1][6] if raised else None
            done.append((incident, machine.state, read, sorted(machine.told), sorted(machine.unusable.items()), len(raised), confidence, early))
            if len(done) >= BATCH:
                yield pd.DataFrame(done, columns=list(RECORD))
                done = []
        yield pd.DataFrame(done, columns=list(RECORD))

    return _walkable(sweeps).mapInPandas(run, ", ".join(f"{k} {v}" for k, v in RECORD.items()))


_names = [c.split()[0] for c in OUT.split(", ")]


def said(rows: list[tuple]) -> pd.DataFrame:
    """Rows of a log as a frame with its types."""
    out = pd.DataFrame(rows, columns=_names)
    return out.astype({"incident": "int64", "seq": "int64", "tick": "int64", "camera_id": "Int64", "confidence": "float64", "supporters": "Int64"})


def re_examined(readings: DataFrame, key: list[str], order: list[str], n: int = AGAIN_FRAMES) -> DataFrame:
    """readings (camera_id, track_id, confidence, frames and key, order) with again and again_frames: the best confidence of
    the same track in the camera's last n frames before each, and how long it had been tracked there; null with fewer than
    two such frames. Where the readings come from a model frozen at the row's time, that is re-examination."""
    w = Window.partitionBy(*key, "camera_id").orderBy(*order).rowsBetween(-n, -1)
    seen = readings.withColumn("__back", F.collect_list(F.struct("confidence", "frames", "track_id")).over(w))
    same = F.filter("__back", lambda x: x["track_id"] == F.col("track_id"))
    best = F.when(F.size("__back") >= 2, F.array_max(same))
    return seen.withColumns({"again": best["confidence"], "again_frames": best["frames"].cast("long")}).drop("__back")


def locate(log: DataFrame, rays: DataFrame) -> DataFrame:
    """Alerts of a log with where they are: incident, seq, tick, camera_id, state, cause, confidence, headline, reasoning,
    n_rays, refusal (of fixes.cross), lat, lon, residual_m, range_m (of the fix from the alert's camera) and nearest_m, how
    close the two closest rays come where they don't cross. rays (incident, tick, origin, camera_id, lat, lon, bearing,
    sigma, range_m and, for headlines, label and site_name) are the lines of sight of each reading: its camera's own and
    those of cameras that support it, a few for each. Only an alert that bearings crossed counts more than its camera's.
    """
    own = ["incident", "seq", "tick", "camera_id", "state", "cause", "confidence"]
    alerts = log.filter("kind = 'alert'").select(*own, "reasoning", "supporters", F.concat_ws("-", "incident", "seq").alias("alert"))
    named = {c: F.col(c) if c in rays.columns else F.lit(None).cast("string") for c in ("label", "site_name")}
    seen = alerts.select("alert", "incident", "tick", F.col("camera_id").alias("origin"), "cause").join(rays.withColumns(named), ["incident", "tick", "origin"])
    seen = seen.filter((F.col("cause") == "crossed_bearings") | (F.col("camera_id") == F.col("origin")))  # others didn't count
    fix = fixes.cross(seen.select("alert", "camera_id", "lat", "lon", "bearing", "sigma", "range_m"), "alert")
    a, b = ({c: F.col(f"{p}_{c}") for c in ("lat", "lon", "bearing", "sigma")} for p in "ab")
    sides = [seen.select("alert", *(F.col(c).alias(f"{p}_{c}") for c in ("camera_id", "lat", "lon", "bearing", "sigma"))) for p in "ab"]
    near = fixes.approach(a, b)
    pairs = sides[0].join(sides[1], "alert").filter("a_camera_id < b_camera_id")  # a few rays an alert
    near = pairs.groupBy("alert").agg(F.min(F.struct(near["distance_m"].alias("distance_m"), near["corridor_m"].alias("corridor_m"))).alias("near"))
    aim = seen.filter("camera_id = origin").groupBy("alert").agg(F.first(F.struct("bearing", F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), "label", "site_name")).alias("o"))
    out = alerts.join(fix, "alert", "left").join(near, "alert", "left").join(aim, "alert", "left")
    range_m = F.when(F.col("lat").isNotNull(), geo.haversine(F.col("o.o_lat"), F.col("o.o_lon"), F.col("lat"), F.col("lon")))
    label = F.coalesce("o.label", F.concat(F.lit("camera "), F.col("camera_id").cast("string")))
    headline = measures.headline(F.col("state"), range_m, F.col("o.bearing"), F.lit("in view"), label, F.coalesce("o.site_name", label), F.col("supporters") + 1)
    missed = F.when(F.col("refusal").isNotNull(), F.col("near.distance_m")).alias("nearest_m")
    fixed = measures.fix_sentences(F.col("refusal"), F.col("crossing_deg"), F.col("semi_major_m"), F.col("near.distance_m"), F.col("near.corridor_m"), F.col("cause"))
    why = F.concat(F.coalesce("reasoning", F.array().cast("array<string>")), F.filter(fixed, lambda x: x.isNotNull()))
    return out.select(*own, headline.alias("headline"), why.alias("reasoning"), F.coalesce("n_rays", F.lit(0)).alias("n_rays"), "refusal", "lat", "lon", "residual_m", range_m.alias("range_m"), missed)


def answer_text(outcome: Column, expected: Column, bearing: Column, confidence: Column, frames: Column, reason: Column) -> Column:
    """What a consulted camera says, in a sentence; reason is why it is blind, or why a faint change scored low."""
    off = F.abs(geo.signed_delta(bearing, expected))
    few = (outcome == "silent") & (confidence >= SUSPECT_AT)
    return (
        F.when(outcome == "supported", F.format_string("sees it too, at %.1f degrees (%.1f degrees from predicted), confidence %.2f", bearing, off, confidence))
        .when(outcome == "blind", F.concat(F.lit("cannot answer: "), F.coalesce(reason, F.lit("unusable"))))
        .when(outcome == "off_bearing", F.format_string("saw something at %.1f degrees, which is %.0f degrees from where this candidate should be; that is a different thing", bearing, off))
        .when(outcome == "no_frame", F.lit("no frame available from this camera at that time"))
        .when(few, F.format_string("has something on that bearing at %.2f, but has only seen it in %d frames; not yet a second opinion", confidence, frames))
        .when(confidence.isNotNull(), F.format_string("found a faint change on that bearing but scored it %.2f: %s", confidence, F.coalesce(reason, F.lit("nothing above threshold"))))
        .otherwise(F.format_string("clear at %.1f degrees, where the candidate should have been", expected))
    )
