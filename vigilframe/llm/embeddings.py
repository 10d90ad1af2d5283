"""Near-duplicate embeddings by spherical-cap filters from random product codes (operator 8).

A code is a random rotation and, for each half of the rotated vector, a list of random directions; every pair of one
direction from each half is a filter. A vector is decoded to all filters whose two inner products sum to more than the
cap's height: the directions are sorted by inner product, so that only pairs above it are enumerated. Vectors that share a
filter are compared in blocks by matrix products, in double precision. A pair that shares several filters is counted in
the first of them only, so that counts add up without a list of pairs. For that, a vector brings its earlier filters along:
decoded anew in a block of another size, an inner product at a cap's height could round to its other side.

The number of filters follows the number of vectors (about BUCKET vectors a filter at any size), and CAPS filters are
expected for a vector in each of CODES independent codes; at a cosine of 0.95 two vectors miss each other in all of them
with a probability of about 0.001.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .components import components
from .textkit import forest, runs

COSINE = 0.95
CODES, CAPS, BUCKET, BLOCK = 8, 6, 64, 512
SEED = 8


class Codes:
    """The product codes for vectors of one length."""

    def __init__(self, length: int, directions: int, codes: int = CODES, caps: float = CAPS):
        self.directions, self.codes = directions, codes
        self.height = NormalDist().inv_cdf(1 - min(0.5, caps / directions**2))
        half = (length + 1) // 2
        self.parts = []
        for t in range(codes):
            rng = np.random.default_rng([SEED, t, length])
            turn = np.linalg.qr(rng.normal(size=(length, length)))[0]
            self.parts.append((turn[:, :half] @ rng.normal(size=(directions, half)).T, turn[:, half:] @ rng.normal(size=(directions, length - half)).T))

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """Ascending filter ids of each unit vector."""
        out: list[list[np.ndarray]] = [[] for _ in x]
        for t, (p, q) in enumerate(self.parts):
            a, b = x @ p, x @ q
            order = np.argsort(-b, 1)
            down = -np.take_along_axis(b, order, 1)
            able = a > self.height + down[:, :1]
            for i in np.flatnonzero(able.any(1)).tolist():
                first = np.flatnonzero(able[i])
                ends = np.searchsorted(down[i], a[i, first] - self.height, "left")
                second = order[i, np.concatenate([np.arange(e) for e in ends])]
                out[i].append(np.sort((t * self.directions + np.repeat(first, ends)) * self.directions + second))
        return [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]


def _usable(column: pa.Array) -> tuple[np.ndarray, list]:
    """(usable, vectors) of a column of lists: those of finite numbers that aren't all zero are usable, and given as
    float64; None for the others."""
    size = column.value_lengths().fill_null(0).to_numpy()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(float)  # null is NaN
    ok, ends = np.zeros(len(size), bool), size.cumsum()
    full = np.flatnonzero(size)
    if len(full):
        begin = (ends - size)[full]
        ok[full] = np.logical_and.reduceat(np.isfinite(values), begin) & np.logical_or.reduceat(values != 0, begin)
    return ok, [values[e - n : e] if k else None for k, n, e in zip(ok.tolist(), size.tolist(), ends.tolist(), strict=True)]


def _scaled(x: np.ndarray) -> np.ndarray:
    """Vectors (rows) times a power of two each, so that squares neither over- nor underflow; nothing else changes."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, keepdims=True))[1])


def _packed(x: np.ndarray) -> bytes:
    """Single precision where that loses nothing."""
    short = x.astype("<f4") if 1e-37 < np.abs(x).max() < 1e38 else None
    return short.tobytes() if short is not None and (short == x).all() else x.tobytes()


def _vector(raw: bytes, length: int) -> np.ndarray:
    return np.frombuffer(raw, "<f4" if len(raw) == 4 * length else "<f8").astype(float)


_ends = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _compare(ids: np.ndarray, copies: np.ndarray, x: np.ndarray, early: list[np.ndarray], side: np.ndarray, same: bool, cosine: float) -> tuple[list, list, list]:
    """Links within a block (same) or between two: link counts by vector (b is null), and links that join them (n is 0).
    Pairs that share one of their early filters were counted there."""
    left, right = (np.arange(len(ids)),) * 2 if same else (np.flatnonzero(~side), np.flatnonzero(side))
    norm = np.sqrt((x * x).sum(1))
    near = (x[left] @ x[right].T) / (norm[left][:, None] * norm[right][None]) >= cosine
    if same:
        near &= np.arange(len(ids))[:, None] < np.arange(len(ids))[None]
    if not near.any():
        return [], [], []
    names, column, times = np.unique(np.concatenate(early), return_inverse=True, return_counts=True)
    table = np.zeros((len(ids), len(names)), np.float32)
    table[np.repeat(np.arange(len(ids)), [len(e) for e in early]), column] = 1
    table = table[:, times > 1]
    first = near & ~(table[left] @ table[right].T > 0)
    count = np.zeros(len(ids), np.int64)
    np.add.at(count, left, first @ copies[right])
    np.add.at(count, right, copies[left] @ first)
    i, j = np.nonzero(first)
    a, b = forest(ids, left[i], right[j])
    some = np.flatnonzero(count)
    return [*ids[some].tolist(), *a.tolist()], [*[None] * len(some), *b.tolist()], [*count[some].tolist(), *[0] * len(a)]


def links(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links (other vectors with a cosine of at least `cosine`, as found) and component_id (the smallest vec_id
    reachable by links, itself included) of every row.

    Vectors that are null, empty or zero, or that hold null or non-finite components, link with nothing; neither do
    vectors of different lengths. Equal vectors link with each other and stand for one. A null vec_id links with nothing
    and has a null component. Other columns are ignored; an empty table gives no rows.
    """
    spark, begin = vectors.sparkSession, len(store.made)

    def classes(it):
        for b in it:
            _, rows = _usable(b.column(1))
            digest = [(None, None) if x is None else tuple(np.frombuffer(xxhash.xxh3_128_digest(x.tobytes()), np.int64).tolist()) for x in rows]
            yield pa.record_batch([b.column(0), *(pa.array([d[k] for d in digest], pa.int64()) for k in (0, 1)), pa.array([None if x is None else len(x) for x in rows], pa.int64()), pa.array([None if x is None else _packed(x) for x in rows], pa.binary())], names=["vec_id", "h1", "h2", "length", "raw"])

    rows = store.save(vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(classes, "vec_id long, h1 long, h2 long, length long, raw binary"), "vectors")
    kinds = rows.filter("h1 is not null and vec_id is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("length").alias("length"), F.first("raw").alias("raw"))
    kinds = store.save(kinds, "kinds", compact=True)
    directions = max(16, int(np.ceil((kinds.count() * CAPS / BUCKET) ** 0.5)))
    short = CODES * directions**2 < 2**31
    number, filter_type = ("int", pa.int32()) if short else ("long", pa.int64())
    held: dict[int, Codes] = {}

    def decode(it):
        for b in it:
            rep, copies, lengths, raw = (b.column(k).to_pylist() for k in range(4))
            for length in set(lengths):
                own = [i for i, n in enumerate(lengths) if n == length]
                codes = held.setdefault(length, Codes(length, directions))
                for at in range(0, len(own), 256):
                    part = own[at : at + 256]
                    x = np.stack([_vector(raw[i], length) for i in part])
                    x = _scaled(x)
                    found = codes.decode(x / np.sqrt((x * x).sum(1, keepdims=True)))
                    yield pa.record_batch([pa.array([rep[i] for i in part], pa.int64()), pa.array([copies[i] for i in part], pa.int64()), pa.array([length] * len(part), pa.int64()), pa.array([v.astype(filter_type.to_pandas_dtype()) for v in found], pa.list_(filter_type)), pa.array([raw[i] for i in part], pa.binary())], names=["rep", "copies", "length", "filters", "raw"])

    listed = store.save(kinds.select("rep", "copies", "length", "raw").mapInArrow(decode, f"rep long, copies long, length long, filters array<{number}>, raw binary"), "filters")
    one = listed.select("length", F.posexplode("filters").alias("k", "f"), "rep", "copies", "filters", "raw").withColumn("early", F.slice("filters", F.lit(1), F.col("k"))).drop("k", "filters")
    size = listed.select("length", F.explode("filters").alias("f")).groupBy("length", "f").agg(F.ceil(F.count("*") / F.lit(BLOCK)).alias("blocks"), F.count("*").alias("n")).filter("n > 1").drop("n")
    dealt = one.join(size, ["length", "f"]).withColumn("own", F.pmod(F.xxhash64("rep", F.lit(SEED)), F.col("blocks")))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    paired = paired.select("length", "f", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "rep", "copies", "early", "raw")

    def compare(it):
        out = ([], [], [])
        for key, (own, rep, copies, early, raw) in runs(it, 4):
            if len(rep) > 1:
                x = _scaled(np.stack([_vector(r, key[0]) for r in raw]))
                for o, v in zip(out, _compare(np.array(rep), np.array(copies, np.int64), x, early, np.array(own) == key[3], key[2] == key[3], cosine), strict=True):
                    o.extend(v)
            if len(out[0]) >= 10_000:
                yield pa.record_batch([pa.array(o, pa.int64()) for o in out], schema=_ends)
                out = ([], [], [])
        yield pa.record_batch([pa.array(o, pa.int64()) for o in out], schema=_ends)

    group = ["length", "f", "i", "j"]
    found = store.save(paired.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare, "a long, b long, n long"), "links")
    counts = found.filter("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = store.save(components(found.filter("b is not null").select("a", "b").distinct()), "components", compact=True)
    store.clear(spark, begin, rows, kinds, found, joined)
    of_kind = kinds.select("h1", "h2", "rep", "copies").join(counts, "rep", "left").join(joined, F.col("rep") == F.col("id"), "left").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    return rows.select("vec_id", "h1", "h2").join(of_kind, ["h1", "h2"], "left").select("vec_id", F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("c", "vec_id")).alias("component_id"))


def deduplicate(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """The rows of vectors that are the smallest of their component (those with a null vec_id stay)."""
    gone = links(vectors, cosine).filter("vec_id != component_id").select(F.col("vec_id").alias("__gone")).distinct()
    return vectors.join(gone, F.col("vec_id") == F.col("__gone"), "left_anti")
