"""Language identification by prediction by partial matching (operator 3).

For each language, a tree of byte contexts of up to ORDER bytes is counted on a bounded sample. A byte's probability is
that of the longest context in the tree: c / (n + d) if it was seen there (n bytes, d different ones), else the escape
probability d / (n + d) times the shorter context's, renormalised over the bytes not seen. These statistics are frozen,
so every (context, byte) has a fixed code length per language, and a text's code length is an exact integer sum of them in
1/2048 bits. A tree holds the code lengths of bytes seen in a context and what an escape from it adds; others follow from
the shorter context. Each language has a tree of its own, as large whatever other languages there are, that one task
learns. The language with the shortest code wins.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store, textkit

ORDER = 3
UNIT = 2048  # of code length, a bit
PAD = 0x20
SAMPLE_DOCS, SAMPLE_CHARS = 250, 12_000
CONTEXTS = 60_000  # of two and three bytes, a language


@dataclass
class Tree:
    """Of one language. Level k has contexts of k bytes (sorted, as integers) with what an escape adds, and grams of k + 1
    bytes (sorted, the context and the byte seen there) with their code lengths."""

    contexts: list[np.ndarray]
    escapes: list[np.ndarray]
    grams: list[np.ndarray]
    seen: list[np.ndarray]

    def lengths(self, grams: np.ndarray) -> np.ndarray:
        """Of four-byte grams, the code length of the last byte after the other three."""
        return np.clip(self._lengths(grams, ORDER).astype(np.int64), 0, 65535)

    def _lengths(self, grams: np.ndarray, order: int) -> np.ndarray:
        """The same after the last `order` bytes before it, without bounds."""
        out = np.zeros(len(grams))
        left = np.arange(len(grams))
        for k in range(order, -1, -1):
            gram = grams[left] & ((1 << 8 * (k + 1)) - 1)
            at, ok = _find(self.grams[k], gram)
            out[left[ok]] += self.seen[k][at[ok]]
            left, gram = left[~ok], gram[~ok]
            at, ok = _find(self.contexts[k], gram >> 8)
            out[left[ok]] += self.escapes[k][at[ok]]
        out[left] += 8 * UNIT
        return out


@dataclass
class Model:
    langs: list[str]
    trees: list[Tree]

    @property
    def bits(self) -> Iterator[np.ndarray]:
        """By language, code lengths of all bytes in each of its tree's contexts of three bytes."""
        for t in self.trees:
            yield t.lengths((t.contexts[ORDER].astype(np.int64)[:, None] << 8 | np.arange(256)).reshape(-1))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of wanted in sorted keys, and whether they are there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted.astype(keys.dtype)), len(keys) - 1)
    return at, keys[at] == wanted


def _grams(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Each byte with the three before it, of which those before a text are PAD."""
    out, last = buf.astype(np.uint32), buf
    for k in range(ORDER):
        now = np.empty_like(buf)
        now[1:] = last[:-1]
        now[starts] = PAD
        out |= now.astype(np.uint32) << np.uint32(8 * (k + 1))
        last = now
    return out


def grow(texts: list[bytes], most: int = CONTEXTS) -> Tree:
    """The tree of one language; of contexts of two and three bytes, it holds the most frequent, `most` in all (of three
    bytes, only those seen twice)."""
    texts = [t for t in texts if t]
    buf = np.frombuffer(b"".join(texts), np.uint8)
    starts = np.cumsum([0, *map(len, texts)])[:-1].astype(np.int64)
    every = _grams(buf, starts).astype(np.int64) if len(buf) else np.zeros(0, np.int64)
    tree, room = Tree([], [], [], []), most
    for k in range(ORDER + 1):
        of, n_of = np.unique(every >> 8 & ((1 << 8 * k) - 1), return_counts=True)
        if k >= 2:
            if k == 3:
                of, n_of = of[n_of > 1], n_of[n_of > 1]
            of = np.sort(of[np.argsort(-n_of, kind="stable")][: room // 2 if k == 2 else room])
            room -= len(of)
        grams, c = np.unique(every & ((1 << 8 * (k + 1)) - 1), return_counts=True)
        at, ok = _find(of, grams >> 8)
        grams, c, at = grams[ok], c[ok], at[ok]
        n, d = np.bincount(at, c, len(of)), np.bincount(at, minlength=len(of))
        escape = np.where(d < 256, d / np.maximum(n + d, 1), 0)
        # The shorter context's mass of bytes not seen here; at the root, bytes are equally likely.
        lower = np.exp2(tree._lengths(grams, k - 1) / -UNIT) if k else np.full(len(grams), 1 / 256)
        mass = 1 - np.bincount(at, lower, len(of))
        tree.contexts.append(of.astype(np.uint32))
        tree.escapes.append(-np.log2(np.maximum(escape, 1e-300) / np.maximum(mass, 1e-12)) * UNIT)
        tree.grams.append(grams.astype(np.uint32))
        tree.seen.append(-np.log2(c / n[at] * (1 - escape[at])) * UNIT)
    tree.escapes, tree.seen = ([np.rint(x).astype(np.int32) for x in level] for level in (tree.escapes, tree.seen))
    return tree


def train(samples: dict[str, list[bytes]]) -> Model:
    """From texts by language."""
    langs = sorted(samples)
    return Model(langs, [grow(samples[k]) for k in langs])


def code_lengths(model: Model, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Of each text in each language, in 1/2048 bits."""
    out = np.zeros((len(offs) - 1, len(model.langs)), np.int64)
    full = np.flatnonzero(np.diff(offs) > 0)
    if len(full):
        starts = offs[:-1][full]
        at, grams = pd.factorize(_grams(buf, starts))
        for k, tree in enumerate(model.trees):
            out[full, k] = np.add.reduceat(tree.lengths(grams.astype(np.int64)).astype(np.uint16)[at], starts, dtype=np.int64)
    return out


def fit(docs: DataFrame, docs_per_lang: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS) -> Model:
    """A model from labelled documents (doc_id, text, lang): of every language, the docs_per_lang documents that come first
    by a hash of doc_id, whatever their lengths. A text of more than `chars` characters gives a passage of that length,
    which begins at a place drawn from its whole length by another hash of doc_id.

    Rows without a doc_id, text or lang teach nothing. Rows that share a doc_id and lang are one document: the passage that
    sorts first. A table without labelled rows gives a model of no languages, which predicts `und`.
    """
    rows = docs.select("doc_id", "lang", "text").filter("doc_id is not null and lang is not null and text is not null")
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = rows.select("doc_id", "lang").withColumn("k", F.row_number().over(by_hash)).filter(F.col("k") <= docs_per_lang).select("doc_id", "lang").distinct()
    begin = F.pmod(F.xxhash64("doc_id", F.lit("place")), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1
    passages = rows.join(F.broadcast(ids), ["doc_id", "lang"], "left_semi").withColumn("text", F.substring("text", begin, F.lit(chars)))
    picked = passages.groupBy("lang", "doc_id").agg(F.min("text").alias("text"))

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf.sort_values("doc_id")["text"]
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "tree": [pickle.dumps(grow([t.encode() for t in texts]))]})

    trees = store.save(picked.groupBy("lang").applyInPandas(learn, "lang string, tree binary"), "trees", compact=True)
    got = sorted(((r.lang, pickle.loads(r.tree)) for r in trees.toLocalIterator()), key=lambda x: x[0])  # one tree a language
    store.drop(trees)
    return Model([k for k, _ in got], [t for _, t in got])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred (`und` where text is null or has no letter, or nothing was learned) and score, the probability
    of that language among those learned under equal priors (0 for `und`).

    A tie goes to the language that sorts first. Needs text; other columns stay (columns named like the new ones are
    replaced); repeated rows are each predicted; empty tables give no rows.
    """
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        m = shared.value
        names = np.array([*m.langs, "und"], object)
        for b in it:
            texts = b.column(b.num_columns - 1)
            best, score = np.full(len(texts), len(m.langs)), np.zeros(len(texts))
            for at, end, buf, offs in textkit.slices(texts):
                if not m.langs:
                    continue
                got = code_lengths(m, buf, offs)
                first = got.argmin(1)
                p = 1 / np.exp2(np.maximum(-1000, (got.min(1, keepdims=True) - got) / UNIT)).sum(1)
                ascii_letter = np.concatenate([[0], np.cumsum((buf | 0x20) - 0x61 < 26)])
                ok = ascii_letter[offs[1:]] > ascii_letter[offs[:-1]]
                for i in np.flatnonzero(~ok & (np.diff(offs) > 0)):
                    ok[i] = any(map(str.isalpha, buf[offs[i] : offs[i + 1]].tobytes().decode(errors="replace")))
                best[at:end] = np.where(ok, first, len(m.langs))
                score[at:end] = np.where(ok, p, 0)
            yield pa.record_batch([*b.columns[:-1], pa.array(names[best], pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names[:-1], "lang_pred", "score"])

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + ["lang_pred string", "score double"])
    return docs.select(*kept, F.col("text").cast("string").alias("__text")).mapInArrow(run, ddl)
