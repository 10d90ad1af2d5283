"""The escalation on a stream of sweeps whose rows come in any order: one machine an incident, in keyed state.

A tick's rows wait in a map until the watermark passes the tick; a timer then has the machine take it. Tracks that were
raised and cameras that can't be believed are maps of their own, of which a tick rewrites the entries that it changes. An
incident without ticks for as long as `idle` ends.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import escalation

#: The state store that transformWithState needs.
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Incidents(StatefulProcessor):
    """escalation.Machine on states: machine (a value), flagged, unusable and waiting (maps) of each incident."""

    def __init__(self, keep_watching: bool, most_alerts: int, idle_ms: int):
        self.options, self.idle_ms = (keep_watching, most_alerts), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.machine = handle.getValueState("machine", "known string, closes long")
        self.flagged = handle.getMapState("flagged", "camera_id long, track_id long", "level long")
        self.unusable = handle.getMapState("unusable", "camera_id long", "reason string, place long")
        self.waiting = handle.getMapState("waiting", "tick long", "at_ms long, sweep string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            for (tick, at), part in pdf.groupby(["tick", "at_ms"]):
                tick, at = int(tick), int(at)
                more = escalation.rows_of(part.drop(columns=["incident", "tick", "at_ms", "at"]))
                if self.waiting.containsKey((tick,)):
                    at, before = self.waiting.getValue((tick,))
                    more = json.loads(before) + more
                else:
                    self.handle.registerTimer(at)
                self.waiting.updateValue((tick,), (at, json.dumps(more)))
        yield escalation.said([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """All ticks that the watermark has passed are taken at once; the timers of the later ones then find nothing to do."""
        now, ticks, left = timerValues.getCurrentWatermarkInMs(), [], False
        for (tick,), (at, sweep) in self.waiting.iterator():
            if at <= now:
                ticks.append((tick, at, sweep))
            else:
                left = True
        known, closes = self.machine.get() if self.machine.exists() else (None, None)
        if not ticks and known is None:
            return
        m, rows = self._load(known), []
        for tick, at, sweep in sorted(ticks):
            if closes is not None and at > closes:
                rows += self._ended(m)
                m = escalation.Machine(*self.options)
            m.tick(tick, sorted((r | {"answers": [tuple(a) for a in r["answers"]]} for r in json.loads(sweep)), key=_order))
            closes = at + self.idle_ms
            self.waiting.removeKey((tick,))
        if now >= closes and not left:
            rows += self._ended(m)
            for state in (self.machine, self.flagged, self.unusable):
                state.clear()
        else:
            rows += m.rows
            self._keep(m, closes)
            if ticks:
                self.handle.registerTimer(closes)
        yield escalation.said([(int(key[0]), *row) for row in rows])

    def _ended(self, m: escalation.Machine) -> list[tuple]:
        m.end()
        return m.rows

    def _load(self, known: str | None) -> escalation.Machine:
        m = escalation.Machine(*self.options)
        if known:
            for k, v in json.loads(known).items():
                setattr(m, k, dict(v) if k == "told" else v)
            m.flagged = {(c, t): level for (c, t), (level,) in self.flagged.iterator()}
            found = sorted((place, c, why) for (c,), (why, place) in self.unusable.iterator())
            m.unusable = {c: why for _, c, why in found}
        self.before = dict(m.flagged), list(m.unusable.items())
        return m

    def _keep(self, m: escalation.Machine, closes: int | None) -> None:
        flagged, unusable = self.before
        for k in flagged.keys() - m.flagged.keys():
            self.flagged.removeKey(k)
        for k, level in m.flagged.items():
            if flagged.get(k) != level:
                self.flagged.updateValue(k, (level,))
        if list(m.unusable.items()) != unusable:
            for c, _ in unusable:
                if c not in m.unusable:
                    self.unusable.removeKey((c,))
            for place, (c, why) in enumerate(m.unusable.items()):
                self.unusable.updateValue((c,), (why, place))
        self.machine.update((json.dumps(m.dump() | {"told": list(m.told.items())}), closes))

    def close(self) -> None:
        pass


def _order(r: dict) -> tuple:
    """As sorted by camera and track, nulls first."""
    return tuple((x is not None, x or 0) for x in (r["camera_id"], r["track_id"]))


def escalate(sweeps: DataFrame, late: str = "10 minutes", idle_s: int = 3600, keep_watching: bool = True, most_alerts: int = escalation.MOST_ALERTS) -> DataFrame:
    """escalation.escalate() of a stream of sweeps that also have `at`, the tick's time: the same rows, once the watermark
    has passed a tick. Rows that come after that (more than `late` behind) are dropped; those of a tick are one sweep
    whichever micro-batches brought them. An incident ends, with its last row, when the watermark is idle_s past its last
    tick; a tick after that begins it anew.

    The session's state store must be RocksDB (ROCKSDB).
    """
    timed = sweeps.filter("incident is not null and tick is not null").withWatermark("at", late)
    kept = escalation.prepared(timed, "at").withColumn("at_ms", F.unix_millis("at"))
    processor = Incidents(keep_watching, most_alerts, 1000 * idle_s)
    return kept.groupBy("incident").transformWithStateInPandas(statefulProcessor=processor, outputStructType=escalation.OUT, outputMode="append", timeMode="eventTime")
