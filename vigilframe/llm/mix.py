"""Mixing sources to target weights by pivotal dependent rounding (operator 9).

Every document of a source has the same expected number of copies, its source's target over its size. The whole part is
taken; the fractional parts are rounded in pairs: mass (words) moves at random from one document of a pair to the other
until one's part is 0 or 1, keeping the pair's expected words, and the other meets the next. Documents are dealt into
buckets by a hash of id and text; each bucket leaves one undecided document at most, and these are paired up a tree of buckets until a
source has one, which is drawn. Long documents meet first, so that the last one is short. So a source's taken words
differ from its target by less than one document.
"""

from __future__ import annotations

import hashlib
import random

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store, textkit

WEIGHTS, MOST = (5, 2, 1), 3.0
BUCKET_ROWS, FAN_IN = 2_000, 256
DRIVER_SOURCES = 10_000  # targets of more sources are found by aggregates over a table of them
SEED = 20


def targets(sizes: dict[str | None, int], weights=WEIGHTS, most: float = MOST) -> dict[str | None, float]:
    """Words to take of each source: all words shared by weight (sources by code point, null last, weights repeating);
    no source gives more than `most` times its words, and what is left is shared by weight among the others."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if share * weight[s] > most * sizes[s]}
        for s in over or open_:
            out[s] = most * float(sizes[s]) if over else share * weight[s]
        left -= sum(out[s] for s in sorted(over, key=order.index))
        open_ -= over or open_
    return out


def _facts(by_source: DataFrame, weights, most: float) -> DataFrame:
    """(source, source_size, target, rate) of every source in by_source (source, size), by targets()' rule, in a table.

    Whether a source is above its limit depends on the share of one unit of weight alone, and that only rises from round
    to round; so a round is one aggregate.
    """
    spark = by_source.sparkSession
    numbered = store.save(by_source.repartitionByRange(F.col("source").isNull(), "source").sortWithinPartitions(F.col("source").isNull(), "source").select("source", "size", F.monotonically_increasing_id().alias("at")), "sources")
    part = F.shiftrightunsigned("at", 33)
    counts, offsets, at = numbered.groupBy(part.alias("part")).count().collect(), [], 0  # a row for each partition
    for r in sorted(counts):
        offsets.append((r.part, at))
        at += r["count"]
    offset = F.broadcast(spark.createDataFrame(offsets, "part long, offset long"))
    place = F.col("offset") + F.col("at").bitwiseAND((1 << 33) - 1)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (place % len(weights) + 1).cast("int"))
    listed = numbered.withColumn("part", part).join(offset, "part").select("source", "size", weight.alias("weight"))
    share, over = 0.0, None
    while True:
        above = share * F.col("weight") > most * F.col("size")
        r = listed.agg(F.sum("size").alias("all"), F.sum(F.when(above, F.col("size")).otherwise(0)).alias("capped"), F.sum(F.when(~above, F.col("weight"))).alias("weight"), F.count_if(above).alias("n")).first()
        if r.n == over or not r.weight:
            break
        share, over = (float(r.all) - most * float(r.capped)) / r.weight, r.n
    target = F.when(share * F.col("weight") > most * F.col("size"), most * F.col("size")).otherwise(share * F.col("weight"))
    return store.save(listed.select("source", F.col("size").alias("source_size"), target.alias("target")).withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)), "facts")


def sizes_of(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): size is the number of words, h a hash of the text; null texts have no words."""

    def run(it):
        for b in it:
            yield pa.record_batch([b.column(0), b.column(1), pa.array(textkit.word_counts(b.column(3))), b.column(2)], names=["doc_id", "source", "size", "h"])

    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, "doc_id long, source string, size long, h long")


ROW = "doc_id long, source string, size long, bucket long, whole long, part double, h long"


class _Group:
    """The undecided document of one group, and its random numbers."""

    def __init__(self, key):
        self.key, self.held = key, None
        self.draw = random.Random(int.from_bytes(hashlib.sha256(repr((SEED, key)).encode()).digest()[:8])).random

    def meet(self, row: list, out: list) -> None:
        if row[2] == 0 or not 0 < row[5] < 1:
            out.append(row)
            return
        if self.held is None:
            self.held = row
            return
        a, b = self.held, row
        up = min(a[2] * (1 - a[5]), b[2] * b[5])
        down = min(a[2] * a[5], b[2] * (1 - b[5]))
        move, gain = (up, 1) if self.draw() * (up + down) < down else (down, -1)
        ends_a = move == a[2] * (1 - a[5]) if gain > 0 else move == a[2] * a[5]
        ends_b = move == b[2] * b[5] if gain > 0 else move == b[2] * (1 - b[5])
        a[5] = (1.0 if gain > 0 else 0.0) if ends_a else a[5] + gain * move / a[2]
        b[5] = (0.0 if gain > 0 else 1.0) if ends_b else b[5] - gain * move / b[2]
        self.held = None
        for x in (a, b):
            if not 1e-12 < x[5] < 1 - 1e-12:
                x[5] = float(round(x[5]))
                out.append(x)
            else:
                self.held = x


def _round(rows: DataFrame, last: bool) -> DataFrame:
    """One level of the tree: a group is a bucket of a source; its rows are streamed in a fixed order."""
    names = ["doc_id", "source", "size", "bucket", "whole", "part", "h"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]

    def finish(group, out):
        if group and group.held is not None:
            if last:
                group.held[5] = 1.0 if group.draw() < group.held[5] else 0.0
            out.append(group.held)

    def run(it):
        group = None
        for b in it:
            out = []
            for row in map(list, zip(*(c.to_pylist() for c in b.columns), strict=True)):
                if group is None or group.key != (row[1], row[3]):
                    finish(group, out)
                    group = _Group((row[1], row[3]))
                group.meet(row, out)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types], names=names)
        out = []
        finish(group, out)
        if out:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    order = F.xxhash64(F.lit(SEED), "doc_id")
    return rows.repartition("source", "bucket").sortWithinPartitions("source", "bucket", F.desc("size"), order, "doc_id", "h", "whole", "part").mapInArrow(run, ROW)


def plan(docs: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken (copies * size) and h (a hash of the text) of every document.

    Needs doc_id, source and text; other columns are ignored. Null texts and those without words have size 0, and are
    taken once if their source's documents are on average (rounded down). Null is a source of its own. Repeated rows are
    documents of their own. The same table gives the same result, however it is partitioned. An empty table gives no rows.
    """
    spark = docs.sparkSession
    sized = store.save(sizes_of(docs), "sizes")
    by_source = store.save(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), "by-source", compact=True)
    n_sources, n = by_source.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    few = n_sources <= DRIVER_SOURCES
    if few:
        total = {r.source: r.size for r in by_source.collect()}
        target = targets(total, weights, most)
        facts = spark.createDataFrame([(s, total[s], target[s], target[s] / total[s] if total[s] else 0.0) for s in total], "source string, source_size long, target double, rate double")
    else:
        facts = _facts(by_source, weights, most)
    buckets = max(1, -(-n // BUCKET_ROWS))
    s, f = sized.alias("s"), facts.alias("f")
    bucket = F.pmod(F.xxhash64(F.lit(SEED + 1), "s.doc_id", "s.h"), F.lit(buckets)).alias("bucket")
    dealt = s.join(F.broadcast(f) if few else f, F.col("s.source").eqNullSafe(F.col("f.source")))
    rows = dealt.select("s.doc_id", "s.source", "s.size", bucket, F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("part"), "s.h")
    decided = None
    while True:
        level = store.save(_round(rows, buckets == 1), "mix", compact=True)
        undecided = (F.col("part") > 0) & (F.col("part") < 1) & (F.col("size") > 0)
        done = level if buckets == 1 else level.filter(~undecided)
        decided = done if decided is None else decided.unionByName(done)
        if buckets == 1:
            break
        buckets = -(-buckets // FAN_IN)
        rows = level.filter(undecided).withColumn("bucket", F.floor(F.col("bucket") / FAN_IN))
    d = decided.withColumn("copies", F.col("whole") + F.when(F.col("size") > 0, F.col("part").cast("long")).otherwise(0)).alias("d")
    planned = d.join(F.broadcast(f) if few else f, F.col("d.source").eqNullSafe(F.col("f.source")))
    taken = (F.col("d.copies") * F.col("d.size")).alias("taken")
    return planned.select("d.doc_id", "d.source", "d.size", "f.source_size", "f.target", "d.copies", taken, "d.h")


def mix(docs: DataFrame, weights=WEIGHTS, most: float = MOST) -> DataFrame:
    """The rows of docs, each as often as plan() takes it; a document is known by its doc_id, source and text. Rows that
    share all three share their copies evenly, and which of them take what is left over makes no difference but in other
    columns, by whose hash they are ordered. So many rows without a doc_id are many documents, not one group."""
    own = docs.columns
    key = {f"__{k}": v for k, v in _key(F.col("doc_id"), F.col("source"), F.xxhash64(F.col("text").cast("string"))).items()}
    planned = plan(docs, weights, most)
    planned = planned.withColumns({f"__{k}": v for k, v in _key(F.col("doc_id"), F.col("source"), F.col("h")).items()})
    planned = planned.groupBy(*key).agg(F.sum("copies").alias("__copies"), F.count("*").alias("__rows")).filter("__copies > 0")
    joined = docs.withColumns(key).join(planned.hint("shuffle_hash"), list(key))
    rest = F.xxhash64(*(F.col(c).cast("string") for c in own))
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(rest))  # in the join's partitions
    share = F.floor(F.col("__copies") / F.col("__rows")) + (F.col("__k") <= F.col("__copies") % F.col("__rows")).cast("long")
    dealt = joined.withColumn("__k", rank).withColumn("__copies", share).filter("__copies > 0")
    return dealt.select(*own, F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))).alias("__k")).select(*own)


def _key(doc_id, source, h) -> dict:
    """What a document is known by, without nulls, so that joins and windows on it share a partitioning."""
    source = F.concat(doc_id.isNull().cast("string"), F.coalesce(F.concat(F.lit(" "), source.cast("string")), F.lit("")))
    return {"id": F.coalesce(doc_id.cast("long"), F.lit(0)), "source": source, "h": h}
