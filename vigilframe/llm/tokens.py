"""Token ids in a compact binary format (operator 10).

Format: a folder of Parquet shards, one row per document in ascending doc_id order, and a dictionary `ranks` with the
id of each frequency rank. A document's ids are replaced by their ranks (0 is the most frequent id of the corpus) and
coded byte-aligned: `control` holds two bits per id (bytes - 1, four ids a byte, low bits first), `data` the 1 to 4
little-endian bytes of each rank; a document is filled up with zeros to a multiple of four ids. Both streams are decoded
by numpy table lookup, four ids at a time.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytelevel, store
from .textkit import batches

END_ID = 2

_lengths = np.array([[(c >> 2 * i & 3) + 1 for i in range(4)] for c in range(256)])
_ends = _lengths.cumsum(1)
GROUP_BYTES = _ends[:, 3]
#: For each control byte, the places of four ids' four bytes in the group's data; -1 where a byte is not stored.
PLACES = np.full((256, 16), -1, np.int64)
for _c in range(256):
    for _i in range(4):
        for _j in range(_lengths[_c, _i]):
            PLACES[_c, 4 * _i + _j] = _ends[_c, _i] - _lengths[_c, _i] + _j


def pack(values: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """(control, data) of each run of values below 2**32 that lie behind each other. A run is filled up with zeros to a
    multiple of four values, so that runs can be decoded together."""
    n = np.diff(bounds)
    room = -(-n // 4) * 4
    at = np.concatenate([[0], room.cumsum()])
    v = np.zeros(at[-1], "<u4")
    v[np.arange(bounds[-1] - bounds[0]) + np.repeat(at[:-1] - bounds[:-1] + bounds[0], n)] = values[bounds[0] : bounds[-1]]
    size = 1 + (v > 0xFF).view(np.uint8) + (v > 0xFFFF) + (v > 0xFFFFFF)
    data = v.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) < size[:, None]].tobytes()
    code = (size - 1).astype(np.uint8).reshape(-1, 4)
    control = (code[:, 0] | code[:, 1] << 2 | code[:, 2] << 4 | code[:, 3] << 6).tobytes()
    cut = np.concatenate([[0], size.cumsum(dtype=np.int64)])[at].tolist()
    at = (at // 4).tolist()
    return [control[a:b] for a, b in zip(at, at[1:], strict=False)], [data[a:b] for a, b in zip(cut, cut[1:], strict=False)]


def unpack(control: list[bytes], data: list[bytes], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) that pack() coded."""
    c = np.frombuffer(b"".join(control), np.uint8)
    place = PLACES[c]
    end = GROUP_BYTES[c].cumsum()
    raw = np.frombuffer(b"".join([*data, b"\0"]), np.uint8)  # places not stored read the zero at the end
    place += (end - GROUP_BYTES[c])[:, None]
    place[PLACES[c] < 0] = len(raw) - 1
    v = raw[place].reshape(-1).view("<u4")
    n = np.asarray(n, np.int64)
    room = -(-n // 4) * 4
    at = room.cumsum() - room
    bounds = np.concatenate([[0], n.cumsum()])
    return v[np.arange(bounds[-1]) + np.repeat(at - bounds[:-1], n)], bounds


class Encoder:
    """Ids of whole texts by a tokenizers file. Where it splits texts by the byte-level pattern, pieces are found and
    their ids kept by bytelevel.Pieces; else the library encodes each text. Literals of the tokenizer's added tokens get
    these tokens' ids, as by the library's default (such texts are left to it); with `literal`, those of their characters."""

    def __init__(self, path: str, literal: bool = False):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = literal
        self.added = [] if literal else [t.content for t in self.tok.get_added_tokens_decoder().values()]
        pre = self.tok.pre_tokenizer
        plain = isinstance(pre, pre_tokenizers.ByteLevel) and not pre.add_prefix_space and getattr(pre, "use_regex", True) and self.tok.normalizer is None
        self.pieces = bytelevel.Pieces(self.library) if plain else None

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def slices(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids, bounds of each text's) of the texts, a bounded number of characters at a time."""
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end]) <= bytelevel.SLICE_CHARS):
                size += len(texts[end])
                end += 1
            part = texts[at:end]
            if self.pieces is not None and not any(x in t for x in self.added for t in part):
                yield self.pieces("".join(part), np.concatenate([[0], np.cumsum([len(t) for t in part])]).astype(np.int64))
            else:
                ids = self.library(part)
                yield np.concatenate(ids), np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
            at = end

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        for ids, bounds in self.slices(texts):
            yield from np.split(ids, bounds[1:-1])


@functools.cache
def encoder(path: str, literal: bool = False) -> Encoder:
    return Encoder(path, literal)


CODED = "doc_id long, n long, zipped binary, tally binary"


def encode(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Each document's ids (and end_id) in the tokenizer's numbers, packed and compressed; one row per input row. In some
    rows, tally holds pairs of an id and its count, which add up to all ids of all rows."""

    def run(it):
        enc, z = encoder(path), zstandard.ZstdCompressor(level=1)
        for b in batches(it):
            n, zipped, total = [], [], np.zeros(0, np.int64)
            for ids, bounds in enc.slices([t or "" for t in b.column(1).to_pylist()]):
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                got = np.bincount(ids, minlength=len(total))
                got[: len(total)] += total
                total = got
                zipped += [z.compress(c + d) for c, d in zip(*pack(ids, bounds), strict=True)]
                n += np.diff(bounds).tolist()
            used = np.flatnonzero(total)
            tally = [np.stack([used, total[used]], 1).astype("<i8").tobytes(), *[None] * (len(n) - 1)][: len(n)]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(zipped, pa.binary()), pa.array(tally, pa.binary())], names=["doc_id", "n", "zipped", "tally"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, CODED)


def frequencies(coded: DataFrame) -> DataFrame:
    """(id, count) over all rows of encode(); each task sends one row per id at most."""

    def run(it):
        total: dict[int, int] = {}
        for b in it:
            for t in b.column(0).to_pylist():
                for i, k in np.frombuffer(t, "<i8").reshape(-1, 2).tolist():
                    total[i] = total.get(i, 0) + k
        yield pa.record_batch([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["id", "count"])

    return coded.select("tally").filter("tally is not null").mapInArrow(run, "id long, count long").groupBy("id").agg(F.sum("count").alias("count"))


def _unzipped(n: np.ndarray, zipped: list[bytes], z) -> tuple[np.ndarray, np.ndarray]:
    raw = [z.decompress(x) for x in zipped]
    cut = (-(-n // 4)).tolist()
    return unpack([x[:k] for x, k in zip(raw, cut, strict=True)], [x[k:] for x, k in zip(raw, cut, strict=True)], n)


def write(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, shard_bytes: int = 64 << 20) -> None:
    """Encodes docs (doc_id, text) and writes the format described above into `folder`.

    Null texts count as empty; a null doc_id sorts first; repeated doc_ids stay, in an order that their ids alone decide; an
    empty table gives a folder without documents. Other columns are ignored. The dictionary has a row per used id, so its size
    is bounded by the vocabulary's.
    """
    spark = docs.sparkSession
    coded = store.save(encode(docs, path, end_id), "ids", codec="none")
    counts = frequencies(coded).toPandas().sort_values(["count", "id"], ascending=[False, True])  # at most a vocabulary
    order = counts["id"].to_numpy(np.uint32)
    rank = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank[order] = np.arange(len(order), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(rank)

    def to_file(it):
        z, begin = zstandard.ZstdDecompressor(), 0
        for b in batches(it, 512):
            n = b.column(1).to_numpy()
            ids, bounds = _unzipped(n, b.column(2).to_pylist(), z)
            control, data = pack(shared.value[ids], bounds)
            starts = begin + bounds[:-1]
            begin += int(bounds[-1])
            shard = np.full(len(n), TaskContext.get().partitionId())
            yield pa.record_batch([b.column(0), pa.array(shard, pa.int64()), pa.array(starts, pa.int64()), b.column(1), pa.array(control, pa.binary()), pa.array(data, pa.binary())], names=["doc_id", "shard", "begin", "n", "control", "data"])

    total = coded.agg(F.sum(F.octet_length("zipped"))).first()[0] or 0
    shards = max(spark.sparkContext.defaultParallelism, -(-total // shard_bytes))
    # Ranges are found from a sample of keys, so these hold a hash and not the ids themselves.
    keyed = coded.select("doc_id", "n", "zipped", F.xxhash64("zipped").alias("h"))
    ordered = keyed.repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "zipped").drop("h")
    ordered.mapInArrow(to_file, "doc_id long, shard long, begin long, n long, control binary, data binary").write.option("compression", "zstd").parquet(f"{folder}/shards")
    spark.createDataFrame(counts.assign(rank=np.arange(len(counts))), "id long, count long, rank long").coalesce(1).write.parquet(f"{folder}/ranks")
    store.drop(coded)


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """The format's documents: doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (of the little-endian
    unsigned 32-bit ids) and, with_ids, the ids themselves."""
    order = spark.read.parquet(f"{folder}/ranks").orderBy("rank").select("id").toPandas()["id"].to_numpy(np.uint32)
    shards = spark.read.parquet(f"{folder}/shards")
    sizes = {r.shard: r.n for r in shards.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row per shard of 64 MB
    base, at = {}, 0
    for k in sorted(sizes):
        base[k], at = at, at + sizes[k]
    ids_of, bases = spark.sparkContext.broadcast(order), spark.sparkContext.broadcast(base)

    def run(it):
        for b in batches(it, 512):
            values, bounds = unpack(b.column(4).to_pylist(), b.column(5).to_pylist(), b.column(3).to_numpy())
            ids = np.split(ids_of.value[values].astype("<u4"), bounds[1:-1]) if b.num_rows else []
            start = [bases.value[s] + x for s, x in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            out = {"doc_id": b.column(0), "start": pa.array(start, pa.int64()), "n_tokens": b.column(3), "ids_crc32": pa.array([zlib.crc32(x) for x in ids], pa.int64())}
            if with_ids:
                out["ids"] = pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))
            yield pa.record_batch(out)

    return shards.select("doc_id", "shard", "begin", "n", "control", "data").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
