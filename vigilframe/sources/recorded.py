"""A data source of recorded incidents: bundles (zip archives with a manifest, as sinks.bundles makes them, or unpacked
folders) of one place, read as a table or replayed tick by tick as a stream.

    recorded.register(spark)
    spark.read.format("recorded").option("width", 1024).load("s3://bucket/incidents")
    spark.readStream.format("recorded").load(path)

An archive's tasks read its manifest and then only the frames that filters on incident, camera_id and ts leave; with a
schema without height, width, data and problem no frame is opened at all. Places are whatever pyarrow.fs opens.
"""

from __future__ import annotations

import datetime
import json
import posixpath
import zipfile
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, SimpleDataSourceStreamReader

FRAME = "incident string, camera_id string, frame_index int, ts timestamp, minute double, path string, height int, width int, data binary, problem string"
CONTENTS = {"height", "width", "data", "problem"}
#: An archive larger than this is read by several tasks, each of which takes some of its frames.
SPLIT_BYTES = 64 << 20


def _files(place: str):
    """(file system, path) of a place."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(place) if "://" in place or place.startswith("file:") else (fs.LocalFileSystem(), place)


class _Bundle:
    """A bundle's members by name, whether it is an archive or a folder."""

    def __init__(self, place: str):
        self.files, self.path = _files(place)
        self.zip, self.root = None, ""
        if place.lower().endswith(".zip"):
            opened = self.files.open_input_file(self.path)
            try:
                self.zip = zipfile.ZipFile(opened)
            except (OSError, ValueError) as e:  # it is shorter than what is looked for at its end
                raise zipfile.BadZipFile(place) from e
            found = [n for n in self.zip.namelist() if posixpath.basename(n) == "manifest.json" and n.count("/") < 2]
            if not found:
                raise KeyError("manifest.json")
            self.root = min(found, key=len).removesuffix("manifest.json")

    def read(self, name: str) -> bytes:
        if self.zip is not None:
            return self.zip.read(self.root + name)
        with self.files.open_input_file(f"{self.path}/{name}") as f:
            return f.read()

    def frames(self) -> list[tuple]:
        """(incident, camera_id, frame_index, ts, minute, path, problem) of the manifest: by camera in order of time, numbered
        anew; those of unknown cameras or without a time have a problem and no number."""
        m = json.loads(self.read("manifest.json"))
        known = {c["camera_id"] for c in m.get("network", {}).get("cameras", [])}
        out = []
        for camera, listed in sorted(m.get("sequences", {}).items()):
            timed = sorted(((_time(f.get("timestamp")), f["path"]) for f in listed), key=lambda x: (x[0] is None, x[0] or 0, x[1]))
            first = timed[0][0] if timed else None
            for k, (ts, path) in enumerate(timed):
                problem = "UNKNOWN_CAMERA" if camera not in known else "NO_TIMESTAMP" if ts is None else None
                out.append((str(m.get("name", "incident")), camera, None if problem else k, ts, None if problem else (ts - first).total_seconds() / 60.0, path, problem))
        return out


def _time(text: str | None) -> datetime.datetime | None:
    """A manifest's time; without a zone it is UTC."""
    try:
        t = datetime.datetime.fromisoformat(text)
    except (TypeError, ValueError):
        return None
    return t if t.tzinfo else t.replace(tzinfo=datetime.timezone.utc)


def _decoded(content: bytes, width: int | None) -> tuple:
    """(height, width, grey bytes, problem), scaled to a width if one is given."""
    import numpy as np

    from ..functions import pixels

    image = pixels.from_bmp(content)
    if image is None:
        return None, None, None, "NOT_AN_IMAGE"
    if width and image.shape[1] != width:
        scaled = pixels.resize(image, max(1, round(image.shape[0] * width / image.shape[1])), width)
        image = np.clip(np.rint(scaled), 0, 255).astype(np.uint8)
    return *image.shape, image.tobytes(), None


def _rows(place: str, part: int, parts: int, asked: list[Filter], columns: list[str], width: int | None) -> Iterator[tuple]:
    """A place's rows: what can't be opened is a row with a problem."""
    empty = dict.fromkeys(c.split()[0] for c in FRAME.split(", "))
    try:
        bundle = _Bundle(place)
        listed = bundle.frames()
    except (zipfile.BadZipFile, KeyError, ValueError, OSError) as e:
        if part == 0:
            problem = {zipfile.BadZipFile: "NOT_A_ZIP", KeyError: "NO_MANIFEST"}.get(type(e), "BAD_MANIFEST")
            yield tuple((empty | {"path": place, "problem": problem})[c] for c in columns)
        return
    for incident, camera, index, ts, minute, path, problem in listed:
        row = empty | {"incident": incident, "camera_id": camera, "frame_index": index, "ts": ts, "minute": minute, "path": path, "problem": problem}
        if zlib.crc32(path.encode()) % parts != part or not all(_passes(f, row) for f in asked):
            continue
        if problem is None and CONTENTS & set(columns):
            try:
                row |= dict(zip(("height", "width", "data", "problem"), _decoded(bundle.read(path), width), strict=True))
            except (KeyError, OSError):
                row["problem"] = "NO_FILE"
        yield tuple(row[c] for c in columns)


_COMPARED = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b, IsNotNull: lambda a, b: True}


def _passes(f: Filter, row: dict) -> bool:
    mine, theirs = row[f.attribute[0]], getattr(f, "value", None)
    if isinstance(theirs, datetime.datetime) and theirs.tzinfo is None:
        theirs = theirs.replace(tzinfo=datetime.timezone.utc)
    return mine is not None and _COMPARED[type(f)](mine, theirs)


class _Part(InputPartition):
    def __init__(self, place: str, part: int, parts: int):
        self.place, self.part, self.parts = place, part, parts


def _places(path: str) -> list[tuple[str, int]]:
    """(place, bytes) of the bundles at a path: itself, if it is one, or the archives and folders with a manifest in it."""
    from pyarrow import fs

    files, at = _files(path)
    if path.lower().endswith(".zip"):
        return [(path, files.get_file_info(at).size)]
    if files.get_file_info(f"{at}/manifest.json").type == fs.FileType.File:
        return [(path, 0)]
    out = []
    for info in sorted(files.get_file_info(fs.FileSelector(at)), key=lambda i: i.base_name):
        if info.type == fs.FileType.File and info.extension.lower() == "zip":
            out.append((f"{path.rstrip('/')}/{info.base_name}", info.size))
        elif info.type == fs.FileType.Directory:
            out += [(f"{path.rstrip('/')}/{info.base_name}", 0)] if files.get_file_info(f"{info.path}/manifest.json").type == fs.FileType.File else []
    return out


class _Reader(DataSourceReader):
    """One partition an archive, or several where it is large."""

    def __init__(self, options: dict, columns: list[str]):
        self.path, self.columns, self.asked = options["path"], columns, []
        self.width = int(options["width"]) if "width" in options else None

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if type(f) in _COMPARED and f.attribute in (("incident",), ("camera_id",), ("ts",)):
                self.asked.append(f)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [_Part(place, k, n) for place, size in _places(self.path) for n in [1 + size // SPLIT_BYTES] for k in range(n)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        yield from _rows(partition.place, partition.part, partition.parts, self.asked, self.columns, self.width)


class _Ticks(SimpleDataSourceStreamReader):
    """One distinct time of the incidents a micro-batch, in order; the offset is how many were given. Frames with a problem
    have no place in time and aren't given."""

    def __init__(self, options: dict, columns: list[str]):
        self.options, self.columns = options, columns
        self.width = int(options["width"]) if "width" in options else None
        self.known: list | None = None

    def _timeline(self) -> list:
        if self.known is None:
            self.known = sorted({f[3] for place, _ in _places(self.options["path"]) for f in _Bundle(place).frames() if f[6] is None})
        return self.known

    def initialOffset(self) -> dict:  # noqa: N802
        return {"tick": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        end = {"tick": min(start["tick"] + 1, len(self._timeline()))}
        return self.readBetweenOffsets(start, end), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        times = self._timeline()[start["tick"] : end["tick"]]
        if not times:
            return iter([])
        asked = [GreaterThanOrEqual(("ts",), times[0]), LessThanOrEqual(("ts",), times[-1])]
        at = self.columns.index("problem") if "problem" in self.columns else None
        rows = (r for place, _ in _places(self.options["path"]) for r in _rows(place, 0, 1, asked, self.columns, self.width))
        return iter([r for r in rows if at is None or r[at] not in ("UNKNOWN_CAMERA", "NO_TIMESTAMP")])


class Recorded(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return FRAME

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options), schema.names)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Ticks(dict(self.options), schema.names)


def register(spark) -> None:
    """Makes the format known to the session, whose filters are then handed to Python sources."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recorded)
