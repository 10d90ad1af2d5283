"""The escalation against a plain walk of its rules over random sweeps, as a table and as a stream."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.operators import escalation
from vigilframe.plans import stateful
from vigilframe.streaming import escalating

SUSPECT, CONFIRM = 0.45, 0.68
SWEEPS = f"incident long, tick long, at timestamp, camera_id long, track_id long, confidence double, frames long, summary string, blind string, again double, again_frames long, answers {escalation.ANSWER}"


def random_incident(seed: int) -> list[tuple]:
    """Rows (tick, camera, track, confidence, frames, blind, again, again_frames, answers) of up to 40 ticks; seeds differ in
    how often cameras see something, are blind, and agree."""
    rng = np.random.default_rng(seed)
    outcomes = [["supported", "silent"], ["blind", "blind", "no_frame"], ["silent", "off_bearing"], ["supported", "blind", "silent", "off_bearing", "no_frame"]][seed % 4]
    rows, steady = [], seed % 3 == 0  # one track that lasts, and neighbours to ask
    for tick in range(int(rng.integers(1, 40))):
        for camera in range(4):
            kind = rng.random() if not steady or camera else 0.3
            if steady and camera and kind < 0.6:
                kind = 0.2
            if kind < 0.15:
                rows.append((tick, camera, None, None, None, ["fog", "night"][tick % 2], None, None, None))
            elif kind < 0.25:
                rows.append((tick, camera, None, None, None, None, None, None, None))
            elif kind < 0.6:
                c = float(np.round(rng.choice([rng.uniform(0.1, 0.5), rng.uniform(0.4, 0.95)]), 2))
                again = float(np.round(min(1.0, c + rng.uniform(-0.2, 0.3)), 2)) if rng.random() < 0.3 else None
                asked = [(int(x), str(rng.choice(outcomes)), float(np.round(rng.uniform(0, 0.9), 2)), None) for x in rng.permutation(np.arange(10, 14))[: rng.integers(1 if steady else 0, 4)]]
                answers = sorted((x, o, f if o != "blind" else None, f"{o} said {x}") for x, o, f, _ in asked)
                rows.append((tick, camera, 1 if steady else int(rng.integers(0, 3)), max(c, 0.5) if steady else c, int(rng.integers(1, 9)), None, again, None if again is None else int(rng.integers(1, 9)), answers))
    return rows


def walk(rows: list[tuple], keep_watching: bool, most: int) -> list[tuple]:
    """(kind, tick, state, cause, camera, confidence, reasoning) by the rules, one after the other."""
    log, state, rounds, consulted, pursuing = [], "watch", 0, set(), None
    records, flagged, unusable, alerts = [], {}, {}, []
    ticks = sorted({r[0] for r in rows})

    def raised(tick, det, confidence, to, code):
        reasoning, seen = [f"scored {det[1]:.2f}"], set()
        for camera, _, text in records:
            if camera not in seen:
                seen.add(camera)
                reasoning.append(f"camera {camera}: {text}")
        reasoning += [f"camera {c} could not help: {why}" for c, why in unusable.items() if c not in seen]
        alerts.append((det[0], min(confidence, 0.99)))
        log.append(("alert", tick, to, code, det[0][0], min(confidence, 0.99), reasoning))
        log.append(("transition", tick, to, "alert_raised", det[0][0], min(confidence, 0.99), None))

    for tick in ticks:
        found = []
        for _, camera, track, c, frames, blind, again, again_frames, answers in sorted((r for r in rows if r[0] == tick), key=lambda r: r[1]):
            if blind:
                unusable[camera] = blind
                continue
            unusable.pop(camera, None)
            if c is not None:
                found.append(((camera, track), c, frames, again, again_frames, answers or []))
        found = [d for d in found if flagged.get(d[0], 0) < (2 if d[1] >= CONFIRM else 1)]
        if not found:
            continue
        best = found[0]
        for d in found[1:]:
            best = d if d[1] > best[1] else best
        if best[0] != pursuing:
            pursuing, rounds, consulted = best[0], 0, set()
        key, c, frames, again, again_frames, answers = best
        if c < SUSPECT:
            if state != "watch":
                state = "watch"
                log.append(("transition", tick, state, "faded", key[0], c, None))
                rounds, consulted, pursuing = 0, set(), None
            continue
        if state in ("watch", "stood_down"):
            state = "suspect"
            log.append(("transition", tick, state, "weak_detection", key[0], c, None))
        if again is not None and again > c:
            if again - c > 1e-6:
                log.append(("transition", tick, state, "re_examined", key[0], again, None))
            c, frames = again, again_frames
        best = (key, c)
        if frames < 4:
            continue
        before = len(alerts)
        if not answers:
            to = ("confirmed", "single_camera_confident", "alerted") if c >= CONFIRM else ("needs_human", "no_second_view", "needs_human")
            log.append(("transition", tick, to[0], to[1], key[0], c, None))
            raised(tick, best, c, to[2], "NO_SECOND_VIEW")
        else:
            state = "consult"
            log.append(("transition", tick, state, "bearing_selected_cameras", key[0], c, None))
            rounds += 1
            supporting = []
            for camera, outcome, theirs, text in [a for a in answers if a[0] not in consulted] or answers:
                records.append((camera, outcome, text))
                consulted.add(camera)
                if outcome == "blind":
                    unusable[camera] = text
                if outcome == "supported":
                    supporting.append(theirs)
            if supporting and c + 0.5 * sum(supporting) >= CONFIRM:
                joint = 1 - c
                for x in supporting:
                    joint *= 1 - 0.7 * x
                log.append(("transition", tick, "confirmed", "crossed_bearings", key[0], 1 - joint, None))
                raised(tick, best, 1 - joint, "alerted", "crossed_bearings")
            elif rounds >= 3:
                blind = {x for x, o, _ in records if o == "blind" and x in consulted}
                silent = {x for x, o, _ in records if o in ("silent", "off_bearing")}
                if blind and not silent:
                    log.append(("transition", tick, "needs_human", "neighbours_blind", key[0], c, None))
                    raised(tick, best, c, "needs_human", "NEIGHBOURS_BLIND")
                elif c >= CONFIRM:
                    log.append(("transition", tick, "needs_human", "unresolved", key[0], c, None))
                    raised(tick, best, c, "needs_human", "UNRESOLVED")
                else:
                    state, rounds, consulted = "stood_down", 0, set()
                    log.append(("transition", tick, state, "not_corroborated", key[0], c, None))
        if len(alerts) > before:
            if not keep_watching or len(alerts) >= most:
                return log
            flagged[key] = 2 if alerts[-1][1] >= CONFIRM else 1
            state, rounds, consulted, pursuing = "watch", 0, set(), None
            log.append(("transition", tick, state, "kept_watching", key[0], alerts[-1][1], None))
    if ticks:
        log.append(("transition", ticks[-1], "needs_human" if alerts else "watch", "sequence_ended", None, None, None))
    return log


def sweeps(spark, incidents: dict[int, list[tuple]]):
    import datetime

    begin = datetime.datetime(2024, 1, 1)
    rows = [(i, t, begin + datetime.timedelta(minutes=t, days=i), cam, track, c, n, None, blind, again, m, answers) for i, own in incidents.items() for t, cam, track, c, n, blind, again, m, answers in own]
    return spark.createDataFrame(rows, SWEEPS)


def told(df) -> dict[int, list[tuple]]:
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.incident, r.seq)):
        out.setdefault(r.incident, []).append((r.kind, r.tick, r.state, r.cause, r.camera_id, None if r.confidence is None else round(r.confidence, 9), r.reasoning))
    return out


def rounded(log):
    return [(*r[:5], None if r[5] is None else round(r[5], 9), r[6]) for r in log]


@pytest.mark.parametrize(("keep_watching", "most"), [(True, 8), (True, 2), (False, 8)])
def test_escalation_is_the_plain_walk(spark, keep_watching, most):
    incidents = {i: random_incident(i) for i in range(160)}
    got = told(escalation.escalate(sweeps(spark, incidents).drop("at").repartition(5), keep_watching, most))
    want = {i: rounded(walk(own, keep_watching, most)) for i, own in incidents.items() if own}
    assert got == want
    causes = {r[3] for log in want.values() for r in log}
    ends = {"kept_watching", "sequence_ended"} if keep_watching else {"sequence_ended"}
    assert causes >= {"weak_detection", "faded", "re_examined", "bearing_selected_cameras", "crossed_bearings", "single_camera_confident", "no_second_view", "neighbours_blind", "unresolved", "not_corroborated", "alert_raised", *ends}
    assert {r[2] for log in want.values() for r in log} == {"watch", "suspect", "consult", "confirmed", "alerted", "stood_down", "needs_human"}


def test_streamed_escalation_of_shuffled_ticks(spark, tmp_path):
    """Rows in any order, the ticks of an incident over several micro-batches, give what the table gives; rows behind the
    watermark are dropped; an incident that has ended begins anew."""
    incidents = {i: random_incident(i) for i in range(12)}
    table = sweeps(spark, incidents)
    end = sweeps(spark, {300: [(0, 0, None, None, None, None, None, None, None)]})
    late = sweeps(spark, {500: [(0, 0, 1, 0.9, 9, None, None, None, None)]}).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    for k in range(3):
        table.filter(F.pmod(F.xxhash64("incident", "tick", "camera_id"), F.lit(3)) == k).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for _ in range(2):  # rows are late by the watermark that the micro-batch before them knew
        end.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    late.unionByName(end).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    with stateful._rocksdb(spark):
        out = escalating.escalate(stream, late="20 days", idle_s=7200).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        out.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    got = told(spark.read.parquet(f"{tmp_path}/out"))
    assert got == {i: rounded(walk(own, True, 8)) for i, own in incidents.items() if own}


def test_an_incident_that_pauses_begins_anew(spark, tmp_path):
    rows = [(t, 0, 1, 0.9, 9, None, None, None, None) for t in (0, 1, 500, 501)]
    table = sweeps(spark, {1: rows}).unionByName(sweeps(spark, {90: [(0, 0, None, None, None, None, None, None, None)]}))
    table.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    with stateful._rocksdb(spark):
        out = escalating.escalate(stream, idle_s=3600).writeStream.format("parquet").option("path", f"{tmp_path}/out")
        out.option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    log = sorted((r.tick, r.seq, r.cause) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert [c for _, _, c in log].count("sequence_ended") == 2 and (500, 0, "weak_detection") in log


def test_re_examination_takes_the_same_track(spark):
    rows = [(1, t, 7, track, c, t + 1) for t, (track, c) in enumerate([(1, 0.5), (2, 0.9), (1, 0.7), (1, 0.6), (1, 0.4), (1, 0.3), (3, 0.2)])]
    got = escalation.re_examined(spark.createDataFrame(rows, "incident long, tick long, camera_id long, track_id long, confidence double, frames long"), ["incident"], ["tick"])
    assert [(r.again, r.again_frames) for r in got.orderBy("tick").collect()] == [(None, None), (None, None), (0.5, 1), (0.7, 3), (0.7, 3), (0.7, 3), (None, None)]
