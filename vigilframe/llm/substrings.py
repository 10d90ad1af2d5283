"""Exact substring deduplication with a log-structured fingerprint index (operator 4).

A window is WINDOW consecutive words. Its fingerprint is the smallest hash of the GRAM-word runs in it, so that equal
windows have equal fingerprints, while neighbouring windows mostly share theirs: a text has about one fingerprint in
twenty words. The index is a list of runs, immutable tables of fingerprints, bucketed and sorted by fingerprint, and a
list of every document's own fingerprints.

A new batch is merge-joined with every run, bucket by bucket, without a shuffle. Fingerprints that are in a run, or in two
documents of the batch, go into a bit filter of bounded size. Documents none of whose fingerprints pass it aren't looked
at; of earlier batches without such documents not even the files are opened. The others' texts are read again, and windows
whose fingerprint passes are verified by 128-bit hashes of all their words: a window is a repetition if an earlier batch,
or a smaller doc_id of the batch, has the same one. False passes of the filter cost rows, not correctness. Where there are
more than 2**26 repeated fingerprints, a filter of bounded size would let most windows pass: each document is then brought
its own repeated fingerprints by a join instead (the same rows).

Then the batch becomes a run of level 0. FAN runs of a level are compacted into one of the next, so that a fingerprint is
rewritten a number of times that grows with the logarithm of the number of batches.

An index with a folder outlives its session: all that it needs is written there, texts included, and an add ends with a
manifest that names it. FingerprintIndex.open() goes on from the last manifest, so an add that broke off leaves no trace
but files that nothing names.
"""

from __future__ import annotations

import hashlib
import json
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, textkit
from .textkit import U64

WINDOW, GRAM = 50, 10
FAN, BATCHES = 2, 3
MOST_FILTER_BITS = 28
MOST_FILTERED = 1 << 26


def fingerprints(hashes: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """The fingerprint of every window of a sequence of word hashes."""
    out = textkit.gram_hashes(hashes, gram)
    need, span = window - gram + 1, 1
    while 2 * span <= need:
        out = np.minimum(out[:-span], out[span:]) if len(out) > span else out[:0]
        span *= 2
    rest = need - span
    if rest:
        out = np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]
    return out


def _windows(texts: pa.Array, window: int, gram: int):
    """For each slice: first row, a function of a family that hashes all its windows, each text's first word, fingerprints
    of windows and the text they are in (-1 where a window would reach into the next text)."""
    for at, _, buf, offs in textkit.slices(texts):
        starts, ends, first = textkit.words(buf, offs)
        hashes = textkit.word_hashes(buf, starts, ends)
        found = fingerprints(hashes, window, gram)
        text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
        own = text[: len(found)]

        def whole(family, buf=buf, starts=starts, ends=ends):
            return textkit.gram_hashes(textkit.word_hashes(buf, starts, ends, family), window, family)

        yield at, whole, first, found, np.where(own == text[window - 1 : window - 1 + len(found)], own, -1)


def _listed(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """(doc_id, t, fs): every document's different fingerprints; documents without any are left out."""

    def run(it):
        for b in textkit.batches(it):
            for at, _, _, found, text in _windows(b.column(2), window, gram):
                take = np.flatnonzero(text >= 0)
                order = take[np.lexsort((found[take], text[take]))]
                f, text = found[order], text[order]
                new = np.ones(len(f), bool)
                new[1:] = (f[1:] != f[:-1]) | (text[1:] != text[:-1])
                f, text = f[new], text[new]
                head = np.flatnonzero(np.diff(text, prepend=-1))
                row = pa.array(at + text[head])
                lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(f)), pa.int32()), pa.array(f.view(np.int64)))
                yield pa.record_batch([b.column(0).take(row), b.column(1).take(row), lists], names=["doc_id", "t", "fs"])

    return docs.filter("doc_id is not null").select("doc_id", "t", "text").mapInArrow(run, "doc_id long, t long, fs array<long>")


def _by_fingerprint(listed: DataFrame) -> DataFrame:
    """(f, low, high): the least and largest doc_id of each fingerprint in each batch of rows, so that a very frequent one
    is shuffled as few rows."""

    def run(it):
        for b in it:
            f, n = b.column(1).flatten().to_numpy(), b.column(1).value_lengths().to_numpy()
            order = np.argsort(f, kind="stable")
            f, doc = f[order], np.repeat(b.column(0).to_numpy(), n)[order]
            head = np.flatnonzero(np.append(True, f[1:] != f[:-1])) if len(f) else np.zeros(0, np.int64)
            low, high = ((np.minimum.reduceat(doc, head), np.maximum.reduceat(doc, head)) if len(f) else (doc, doc))
            yield pa.record_batch([pa.array(f[head]), pa.array(low), pa.array(high)], names=["f", "low", "high"])

    return listed.select("doc_id", "fs").mapInArrow(run, "f long, low long, high long")


_step = 0x9E3779B97F4A7C15 - (1 << 64)


def _bit_filter(values: DataFrame, n: int) -> np.ndarray:
    """A bit array over the column f, of 16 bits a value, but at most 2**MOST_FILTER_BITS; two bits are set for each."""
    bits = int(np.clip(np.ceil(np.log2(16 * max(n, 1))), 16, MOST_FILTER_BITS))
    place = [f"shiftrightunsigned({x}, {64 - bits})" for x in ("f", f"f ^ shiftrightunsigned(f, 29) ^ {_step} ^ shiftleft(f, 31)")]
    set_ = values.select(F.explode(F.array(*map(F.expr, place))).alias("p")).groupBy(F.expr("shiftright(p, 6)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("bits"))
    got = set_.toPandas()  # bounded by the filter's size
    out = np.zeros(1 << (bits - 6), U64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(U64)
    return out


def _passes(held: np.ndarray, f: np.ndarray) -> np.ndarray:
    shift = U64(64 - (len(held).bit_length() + 5))
    out = np.ones(len(f), bool)
    for x in (f, f ^ (f >> U64(29)) ^ U64(_step & 0xFFFFFFFFFFFFFFFF) ^ (f << U64(31))):
        p = x >> shift
        out &= (held[(p >> U64(6)).astype(np.int64)] >> (p & U64(63)) & U64(1)).astype(bool)
    return out


def _verified(docs: DataFrame, passes, window: int, gram: int) -> DataFrame:
    """(w1, w2, age, doc_id, t, at): windows of docs (age, doc_id, t, text, wanted) that pass; at lists the words where
    one begins in a document, as 32-bit numbers."""
    names = ["w1", "w2", "age", "doc_id", "t", "at"]

    def run(it):
        for b in textkit.batches(it):
            for at, windows, first, found, text in _windows(b.column(3), window, gram):
                take = np.flatnonzero(text >= 0)
                take = take[passes(found[take], b, at + text[take])]
                if not len(take):
                    continue
                whole = [windows(family)[take] for family in (0, 1)]
                order = np.lexsort((take, whole[0], text[take]))
                take, (w1, w2) = take[order], (w[order] for w in whole)
                new = np.ones(len(take), bool)
                new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]) | (text[take][1:] != text[take][:-1])
                head = np.flatnonzero(new)
                places = (take - first[text[take]]).astype("<i4")
                ends = np.append(head, len(places)).astype("<i4") * 4
                lists = pa.Array.from_buffers(pa.binary(), len(head), [None, pa.py_buffer(ends), pa.py_buffer(places)])
                row = pa.array(at + text[take[head]])
                hashes = (pa.array(w[head].view(np.int64)) for w in (w1, w2))
                yield pa.record_batch([*hashes, *(b.column(k).take(row) for k in range(3)), lists], names=names)

    return docs.mapInArrow(run, "w1 long, w2 long, age int, doc_id long, t long, at binary")


def _kept(docs: DataFrame, window: int) -> DataFrame:
    """Of docs (age, doc_id, t, text, at), the words that no window listed in at covers."""

    def run(it):
        for b in textkit.batches(it):
            n, removed, kept = [], [], []
            for text, at in zip(b.column(1).cast(pa.binary()).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or b"").split()
                n.append(len(words))
                if at:
                    starts = np.frombuffer(b"".join(at), "<i4")
                    step = np.zeros(len(words) + 1, np.int64)
                    np.add.at(step, starts, 1)
                    np.add.at(step, starts + window, -1)
                    words = [w for w, inside in zip(words, step.cumsum().tolist(), strict=False) if not inside]
                removed.append(n[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])], names=["doc_id", "n_words", "n_removed", "kept_text", "kept_sha256"])

    return docs.select("doc_id", "text", "at").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string, kept_sha256 string")


def _may_be_in(held):
    """A function of a column of 64-bit hashes: whether they pass the bit filter in the broadcast `held`."""

    @F.pandas_udf("boolean")
    def passes(f: pd.Series) -> pd.Series:
        return pd.Series(_passes(held.value, f.to_numpy(np.int64).view(U64)))

    return passes


def _key() -> Column:
    """Of a document's row."""
    return F.xxhash64("doc_id", "t")


RUN, LISTED, TEXTS = "f long, low long, high long", "doc_id long, t long, fs array<long>", "age int, doc_id long, t long, text string"


class FingerprintIndex:
    """Batches of documents seen so far: runs of fingerprints by level, each batch's documents with their fingerprints,
    and the tables that hold the texts.

    With a folder that executors share, the index is kept there for other sessions (one at a time); without one, it lives
    as long as this object, and earlier batches are read from where they came from."""

    def __init__(self, window: int = WINDOW, gram: int = GRAM, fan: int = FAN, folder: str | None = None):
        self.window, self.gram, self.fan, self.folder = window, min(gram, window), fan, folder
        self.merged: list[DataFrame] = []
        self.runs: list[tuple[int, DataFrame]] = []
        self.listed: list[DataFrame] = []
        self.texts: list[DataFrame] = []
        self.buckets: int | None = None

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> FingerprintIndex:
        """The index that the last finished add left in a folder; an error where there is none."""
        held = max((json.loads(r.value) for r in spark.read.text(f"{folder}/manifest-*").collect()), key=lambda m: len(m["texts"]))  # a row an add
        index = cls(held["window"], held["gram"], held["fan"], folder)
        index.buckets = held["buckets"]
        index.runs = [(k, store.open_sorted(spark, path, RUN, "f", index.buckets)) for k, path in held["runs"]]
        index.listed = [spark.read.schema(LISTED).parquet(path) for path in held["listed"]]
        index.texts = [spark.read.schema(TEXTS).parquet(path) for path in held["texts"]]
        for tables, paths in ((index.listed, held["listed"]), (index.texts, held["texts"])):
            for table, path in zip(tables, paths, strict=True):
                table.stored_at = path
        return index

    def _manifest(self, spark: SparkSession) -> None:
        """Names what the index consists of now; only then do runs that were merged go."""
        if self.folder is not None:
            held = {k: getattr(self, k) for k in ("window", "gram", "fan", "buckets")} | {"runs": [(k, r.stored_at) for k, r in self.runs]}
            held |= {"listed": [x.stored_at for x in self.listed], "texts": [x.stored_at for x in self.texts]}
            one = spark.createDataFrame([(json.dumps(held),)], "value string").coalesce(1)
            one.write.mode("overwrite").text(f"{self.folder}/manifest-{len(self.texts):06d}")
        for r in self.merged:
            store.drop(r)
        self.merged = []

    def add(self, docs: DataFrame) -> DataFrame:
        """doc_id, n_words, n_removed, kept_text (the words left, joined by one space) and kept_sha256 of each row of
        docs (doc_id, text), after removing every word that a window covers whose word sequence also begins in a document
        of an earlier batch or with a smaller doc_id of this one. Windows are judged on texts as they came.

        Null texts have no words. Rows that share a doc_id are one document, so they don't remove each other's words; a
        document with a null doc_id neither loses words nor lets others lose them. Other columns are ignored.
        """
        now = len(self.texts)
        docs = docs.select(F.lit(now).alias("age"), F.col("doc_id").cast("long"), F.xxhash64("text").alias("t"), F.col("text").cast("string"))
        if self.folder is not None:
            docs = store.save(docs, "texts", folder=self.folder)
        listed = store.save(_listed(docs, self.window, self.gram), "listed", codec="none", folder=self.folder)
        own = self._run(_by_fingerprint(listed))
        repeated = [own.filter("low != high").select("f")]
        repeated += [own.select("f").hint("merge").join(r.select("f").hint("merge"), "f") for _, r in self.runs]
        wanted = store.save(reduce(DataFrame.unionByName, repeated), "wanted", compact=True)
        self.texts.append(docs)
        self.listed.append(listed)
        self.runs.append((0, own))
        hit = store.save(self._repetitions(wanted), "repetitions", compact=True)
        store.drop(wanted)
        self.compact()
        self._manifest(docs.sparkSession)
        return self._without(docs, hit)

    def _repetitions(self, wanted: DataFrame) -> DataFrame:
        """(doc_id, t, at) of the last batch: where windows begin that are repetitions."""
        now, n = len(self.texts) - 1, wanted.count()
        parts = self._listed_windows(wanted) if n > MOST_FILTERED else self._filtered_windows(wanted, n)
        every = reduce(DataFrame.unionByName, parts.values()) if parts else _verified(self.texts[now].filter("false"), None, self.window, self.gram)
        at = F.struct("age", "doc_id")
        first = every.groupBy("w1", "w2").agg(F.min(at).alias("first"), F.max(at).alias("last")).filter("first != last").drop("last")
        again = parts.get(now, every.filter("false")).join(first, ["w1", "w2"]).filter((F.col("first.age") < F.col("age")) | (F.col("first.doc_id") < F.col("doc_id")))
        return again.groupBy("doc_id", "t").agg(F.collect_list("at").alias("at"))

    def _texts(self, age: int) -> DataFrame:
        return self.texts[age].filter("doc_id is not null").select("age", "doc_id", "t", "text")

    def _filtered_windows(self, wanted: DataFrame, n: int) -> dict[int, DataFrame]:
        """By batch, _verified() windows whose fingerprints pass a bit filter of those wanted; batches without any are left
        out."""
        spark = wanted.sparkSession
        held = spark.sparkContext.broadcast(_bit_filter(wanted, n))

        def any_wanted(it):
            for b in it:
                yes, sizes = _passes(held.value, b.column(2).flatten().to_numpy().view(U64)), b.column(2).value_lengths().to_numpy()
                some = np.logical_or.reduceat(yes, np.cumsum(sizes) - sizes) if len(sizes) else yes
                yield pa.record_batch([c.filter(pa.array(some)) for c in b.columns[:2]], names=["age", "f"])

        listed = reduce(DataFrame.unionByName, [x.select(F.lit(age).alias("age"), _key().alias("f"), "fs") for age, x in enumerate(self.listed)])
        docs = store.save(listed.mapInArrow(any_wanted, "age int, f long"), "wanted-docs", compact=True)
        counts = {r.age: r["count"] for r in docs.groupBy("age").count().collect()}  # a row a batch
        k = sum(counts.values())
        few = _may_be_in(spark.sparkContext.broadcast(_bit_filter(docs.select("f"), k)))(_key()) if 0 < k <= MOST_FILTERED else F.lit(True)
        store.drop(docs)
        return {age: _verified(self._texts(age).filter(few), lambda f, b, row: _passes(held.value, f), self.window, self.gram) for age in counts}

    def _listed_windows(self, wanted: DataFrame) -> dict[int, DataFrame]:
        """The same where each document is brought its own wanted fingerprints."""

        def asked(f, b, row):
            values, rows = f.view(np.int64), row
            return np.concatenate([np.zeros(0, bool), *(np.isin(values[rows == r], b.column(4)[int(r)].as_py()) for r in np.unique(rows))])

        wanted, out = wanted.distinct(), {}
        for age, listed in enumerate(self.listed):
            by_doc = listed.select("doc_id", "t", F.explode("fs").alias("f")).join(wanted, "f").groupBy("doc_id", "t").agg(F.collect_set("f").alias("wanted"))
            texts = self._texts(age).join(by_doc, ["doc_id", "t"]).select("age", "doc_id", "t", "text", "wanted")
            out[age] = _verified(texts, asked, self.window, self.gram)
        return out

    def _without(self, docs: DataFrame, hit: DataFrame) -> DataFrame:
        """docs without the words of hit; only texts that may have some are brought to it."""
        n = hit.count()
        if n > MOST_FILTERED:
            return _kept(docs.join(hit, ["doc_id", "t"], "left"), self.window)
        may_be_hit = _may_be_in(docs.sparkSession.sparkContext.broadcast(_bit_filter(hit.select(_key().alias("f")), n)))
        rest = docs.filter(~may_be_hit(_key())).withColumn("at", F.lit(None).cast("array<binary>"))
        return _kept(docs.filter(may_be_hit(_key())).join(hit, ["doc_id", "t"], "left"), self.window).unionByName(_kept(rest, self.window))

    def _run(self, rows: DataFrame) -> DataFrame:
        """Writes (f, low, high) as a run: one row a fingerprint, in buckets of f, each a sorted file."""
        if self.buckets is None:
            self.buckets = max(8, rows.sparkSession.sparkContext.defaultParallelism)
        least = rows.repartition(self.buckets, "f").groupBy("f").agg(F.min("low").alias("low"), F.max("high").alias("high"))
        return store.save_sorted(least, "run", "f", self.buckets, self.folder)

    def compact(self) -> None:
        """Merges `fan` runs of a level into one of the next. They are dropped once a manifest no longer names them."""
        level = 0
        while True:
            same = [r for k, r in self.runs if k == level]
            if len(same) >= self.fan:
                merged = self._run(reduce(DataFrame.unionByName, same))
                self.runs = [(k, r) for k, r in self.runs if k != level] + [(level + 1, merged)]
                self.merged += same
            elif all(k <= level for k, _ in self.runs):
                break
            level += 1


def in_batches(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """FingerprintIndex.add() over docs in `batches` parts by ascending doc_id, of about equally many rows."""
    index = FingerprintIndex()
    cuts = docs.approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.02) if batches > 1 else []
    cuts = sorted({int(c) for c in cuts})
    out = []
    for i in range(len(cuts) + 1):
        part = docs
        if i > 0:
            part = part.filter(F.col("doc_id") >= cuts[i - 1])
        if i < len(cuts):
            part = part.filter((F.col("doc_id") < cuts[i]) | (F.col("doc_id").isNull() if i == 0 else F.lit(False)))
        out.append(index.add(part))
    return reduce(DataFrame.unionByName, out)
