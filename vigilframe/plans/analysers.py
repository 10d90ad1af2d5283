"""Analysers by name: functions from a table and options to a table, which others may add to."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators import detection, tracker, tracks

_known: dict[str, Callable[..., DataFrame]] = {"regions": detection.regions, "scenes": detection.scenes, "watched": detection.watched, "tracks": tracker.track, "growth": tracks.growth, "growth_so_far": tracks.growth_so_far}


def register(name: str, analyser: Callable[..., DataFrame]) -> None:
    _known[name] = analyser


def names() -> list[str]:
    return sorted(_known)


def analyse(name: str, table: DataFrame, **options) -> DataFrame:
    """What the named analyser makes of a table; KeyError, naming those there are, for an unknown one."""
    if name not in _known:
        raise KeyError(f"no analyser {name!r}; there are {', '.join(names())}")
    return _known[name](table, **options)
