"""Codes of vectors by codebooks of their parts (operator 12).

Components become integers, and vectors are cut into equal parts. Equal parts of a position are one weighted row of a table
of distinct parts; a Lloyd round reads that table, whose rows each task assigns to the codebooks it was sent and sums up by
entry, and Spark adds the sums. All is exact: integers throughout. At last the distinct parts' codes and errors are joined
back to the vectors.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Products and sums of integers of at most this size, over all components of a part, are exact in doubles.
EXACT = float(1 << 53)
BLOCK_ROWS = 8192


def integers(vectors: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """row (a number of its own), vec_id, label and v, floor(scale * x) of each component x, of the rows that are kept."""
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    most = F.floor(F.sqrt(F.lit(float(1 << 62)) / F.size(x))).cast("double") / 2
    whole = F.transform(x, lambda c: F.floor(F.least(F.greatest(c * F.lit(float(scale)), -most), most)).cast("int"))
    kept = vectors.filter(x.isNotNull() & (F.size(x) > 0) & (F.size(x) % parts == 0) & finite)
    return kept.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole.alias("v"))


def _slices(parts: int, width: int) -> Column:
    return F.array(*(F.slice("v", 1 + k * width, width) for k in range(parts)))


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest entry, lowest of several; squared distance) of each row of integers."""
    code, error = np.empty(len(x), np.int64), np.empty(len(x), np.int64)
    width, far = x.shape[1], max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))), int(np.abs(book).max(initial=0)))
    for at in range(0, len(x), BLOCK_ROWS):
        part = x[at : at + BLOCK_ROWS]
        if 4.0 * width * far * far < EXACT:
            p, b = part.astype(float), book.astype(float)
            code[at : at + len(part)] = ((b * b).sum(1) - 2 * (p @ b.T)).argmin(1)
        else:  # one entry after the other, in whole numbers
            best = np.full(len(part), np.iinfo(np.int64).max)
            for k, e in enumerate(book):
                d = ((part - e) ** 2).sum(1)
                code[at : at + len(part)][d < best] = k
                best = np.minimum(best, d)
        error[at : at + len(part)] = ((part - book[code[at : at + len(part)]]) ** 2).sum(1)
    return code, error


def _parts(b: pa.RecordBatch, width: int):
    """(position, rows of the batch, their parts) of each position in a batch of (pos, part, ...)."""
    pos, flat = b.column(0).to_numpy(), b.column(1).flatten().to_numpy().astype(np.int64).reshape(-1, width)
    for k in np.unique(pos).tolist():
        rows = np.flatnonzero(pos == k)
        yield k, rows, flat[rows]


def _round(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round over the distinct parts. What comes to the driver is a codebook's size."""
    width, shared = books.shape[2], distinct.sparkSession.sparkContext.broadcast(books)

    def run(it):
        sums = np.zeros(books_shape, np.int64)
        counts = np.zeros(books_shape[:2], np.int64)
        for b in it:
            weight = b.column(2).to_numpy()
            for k, rows, x in _parts(b, width):
                code = nearest(x, shared.value[k])[0]
                order = np.argsort(code, kind="stable")
                used, at = np.unique(code[order], return_index=True)
                w = weight[rows][order]
                sums[k, used] += np.add.reduceat(x[order] * w[:, None], at)
                counts[k, used] += np.add.reduceat(w, at)
        k, e = np.nonzero(counts)
        yield pa.record_batch([pa.array(k), pa.array(e), pa.array(counts[k, e]), pa.array(list(sums[k, e]), pa.list_(pa.int64()))], names=["pos", "entry", "n", "sums"])

    books_shape = books.shape
    partial = distinct.mapInArrow(run, "pos long, entry long, n long, sums array<long>")
    each = partial.select("pos", "entry", "n", F.posexplode("sums").alias("i", "s")).groupBy("pos", "entry", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    got = each.select("pos", "entry", "i", "s", "n").toPandas()  # a row for each component of each entry at most
    shared.destroy()
    out = books.copy()
    out[got["pos"], got["entry"], got["i"]] = got["s"].to_numpy(np.int64) // got["n"].to_numpy(np.int64)
    return out


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(rows, codebooks) of vectors (vec_id, embedding, label): vec_id, label, code (two hex digits a part), error (squared
    distances summed over parts) and label_error (errors summed over equal labels, nulls together) of each vector that is
    kept; codebooks by part, entry and component.

    Dropped are vectors that are null, hold null or non-finite components, are empty or can't be cut into equal parts, and
    those of another size than the kept one with the smallest vec_id. Codebooks start as the vectors of the smallest
    vec_ids (null last, ties by their components), fewer where there are fewer; repeated rows each count. Integers are held
    at a size (about 1.3e8 for 64 components) beyond which squared distances would pass 64 bits. An empty table gives no
    rows and empty codebooks. Other columns are ignored. Up to 7 parts and 256 entries.
    """
    if not 1 <= parts <= 7 or not 1 <= entries <= 256:
        raise ValueError("up to 7 parts of up to 256 entries")
    kept = store.save(integers(vectors, parts, scale), "integers")
    smallest = [F.col("vec_id").asc_nulls_last(), F.size("v"), F.col("v")]
    one = kept.orderBy(*smallest).select(F.size("v").alias("n")).first()
    if one is None:
        return kept.sparkSession.createDataFrame([], "vec_id long, label long, code string, error long, label_error long"), np.zeros((parts, 0, 0), np.int64)
    width = one.n // parts
    alike = kept.filter(F.size("v") == one.n)
    seeds = [r.v for r in alike.orderBy(*smallest).limit(entries).select("v").collect()]  # at most `entries` vectors
    books = np.array(seeds, np.int64).reshape(len(seeds), parts, width).transpose(1, 0, 2).copy()
    cut = alike.select("row", "vec_id", "label", F.posexplode(_slices(parts, width)).alias("pos", "part"))
    distinct = store.save(cut.groupBy("pos", "part").agg(F.count("*").alias("weight")), "parts", compact=True)
    for _ in range(rounds):
        books = _round(distinct, books)
    coded = store.save(_coded(distinct, books), "part-codes", compact=True)
    back = cut.join(coded, ["pos", "part"])
    shifted = F.call_function("shiftleft", F.col("code"), 8 * (parts - 1 - F.col("pos")))
    rows = back.groupBy("row").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.sum(shifted).alias("code"), F.sum("error").alias("error"))
    rows = store.save(rows.select("vec_id", "label", F.lpad(F.lower(F.hex("code")), 2 * parts, "0").alias("code"), "error"), "codes", compact=True)
    by = rows.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    return rows.join(by, F.col("label").eqNullSafe(F.col("of"))).drop("of"), books


def _coded(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    width, shared = books.shape[2], distinct.sparkSession.sparkContext.broadcast(books)

    def run(it):
        for b in it:
            code, error = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for k, rows, x in _parts(b, width):
                code[rows], error[rows] = nearest(x, shared.value[k])
            yield pa.record_batch([b.column(0), b.column(1), pa.array(code), pa.array(error)], names=["pos", "part", "code", "error"])

    return distinct.select("pos", "part").mapInArrow(run, "pos int, part array<int>, code long, error long")


def decompress(rows: DataFrame, books: np.ndarray, scale: int = SCALE) -> DataFrame:
    """vec_id and the vector that each code stands for."""
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def run(it):
        for b in it:
            raw = np.frombuffer(bytes.fromhex("".join(b.column(1).to_pylist())), np.uint8).reshape(b.num_rows, -1)
            v = np.concatenate([shared.value[k][raw[:, k]] for k in range(raw.shape[1])], 1) / scale
            yield pa.record_batch([b.column(0), pa.array(list(v), pa.list_(pa.float64()))], names=["vec_id", "embedding"])

    return rows.select("vec_id", "code").mapInArrow(run, "vec_id long, embedding array<double>")


def digest(books: np.ndarray) -> str:
    """The SHA-256 of all components by part, entry and place, in decimal, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
