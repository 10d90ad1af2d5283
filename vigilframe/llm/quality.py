"""Quality classifier: histogram gradient-boosted trees over document statistics (operator 6).

Statistics are counted from bytes, batch by batch; trees are grown on the driver from a bounded sample of labelled rows
and flattened into complete binary trees in arrays, which numpy walks for all rows of a batch at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit

SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2 = 60, 4, 64, 0.2, 1.0

_classes = ("upper", "lower", "digit", "space", "newline", "high", "stop", "comma", "#", "$", "%", "&", "*", "!", "|", "@", "quote", "bracket", "other")
_class_of = np.full(256, len(_classes) - 1, np.uint8)
for _k, _members in enumerate((range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), (0x20, 0x09, 0x0B, 0x0C, 0x0D), (0x0A,), range(0x80, 0x100), b".?", b",;:", b"#", b"$", b"%", b"&", b"*", b"!", b"|", b"@", b"\"'`", b"()[]{}<>")):
    _class_of[list(_members)] = _k
FEATURES = (*(f"share {c}" for c in _classes), "log bytes", "log words", "bytes a word", "upper share of letters", "words with letters", "words of a letter", "words repeated at once", "different words", "different words by root", "log lines", "different lines", "bytes a line", "symbols a word")


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; zeros for null and empty ones."""
    out = np.zeros((len(texts), len(FEATURES)))
    n_classes = len(_classes)
    for at, end, buf, offs in textkit.slices(texts):
        n, size = end - at, np.diff(offs).astype(float)
        doc = np.repeat(np.arange(n) * n_classes, np.diff(offs))
        counts = np.bincount(doc + _class_of[buf], minlength=n * n_classes).reshape(n, n_classes).astype(float)
        starts, ends, first = textkit.words(buf, offs)
        hashes = textkit.word_hashes(buf, starts, ends)
        letter = np.concatenate([[0], np.cumsum(((buf | 0x20) - 0x61 < 26) | (buf >= 0x80))])
        with_letters = np.concatenate([[0], np.cumsum(letter[ends] > letter[starts])])
        single = np.concatenate([[0], np.cumsum(ends - starts == 1)])
        again = np.zeros(len(hashes) + 1, np.int64)
        if len(hashes):
            same = np.concatenate([[False], hashes[1:] == hashes[:-1]])
            same[first[:-1][first[:-1] < len(hashes)]] = False
            again[1:] = np.cumsum(same)
        lb, le, lfirst = textkit.words(buf, offs, np.arange(256) != 0x0A)
        lines = textkit.word_hashes(buf, lb, le)
        w, ln = np.diff(first).astype(float), np.diff(lfirst).astype(float)
        kinds = np.array([len(np.unique(hashes[a:b])) for a, b in zip(first[:-1], first[1:], strict=True)], float)
        line_kinds = np.array([len(np.unique(lines[a:b])) if b - a > 1 else b - a for a, b in zip(lfirst[:-1], lfirst[1:], strict=True)], float)
        per_word, per_byte, per_line = np.maximum(w, 1), np.maximum(size, 1), np.maximum(ln, 1)
        letters = counts[:, 0] + counts[:, 1]
        out[at:end, :n_classes] = counts / per_byte[:, None]
        rest = (np.log1p(size), np.log1p(w), size / per_word, counts[:, 0] / np.maximum(letters, 1), np.diff(with_letters[first]) / per_word, np.diff(single[first]) / per_word, np.diff(again[first]) / per_word, kinds / per_word, kinds / np.sqrt(per_word), np.log1p(ln), line_kinds / per_line, size / per_line, counts[:, 8:15].sum(1) / per_word)
        out[at:end, n_classes:] = np.stack(rest, 1)
    return out


@dataclass
class Trees:
    base: float
    feature: np.ndarray  # by tree and inner node
    above: np.ndarray  # a value above it goes right
    leaf: np.ndarray  # by tree and leaf

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1 if len(self.leaf) else 0
        for f, a, leaf in zip(self.feature, self.above, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, f[node]] > a[node])
            total += leaf[node - len(f)]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, l2: float = L2) -> Trees:
    """Trees for labels y (0 or 1) by second-order boosting of the logistic loss; without rows, a score of 0.5."""
    inner, n_features = 2**depth - 1, x.shape[1]
    mean = (y.sum() + 1) / (len(y) + 2)
    base = float(np.log(mean / (1 - mean)))
    if not len(y) or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(n_features)]
    binned = np.stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)], 1)
    flat = binned + np.arange(n_features) * bins
    total = np.full(len(y), base)
    found = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        feature, above, node = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            at = ((node - first)[:, None] * n_features * bins + flat).ravel()
            sums = [np.bincount(at, np.repeat(v, n_features), minlength=width * n_features * bins).reshape(width, n_features, bins) for v in (g, h)]
            left = [s.cumsum(2) for s in sums]
            whole = [s[:, :, -1:] for s in left]
            gain = left[0] ** 2 / (left[1] + l2) + (whole[0] - left[0]) ** 2 / (whole[1] - left[1] + l2) - whole[0] ** 2 / (whole[1] + l2)
            gain[(left[1] < 1) | (whole[1] - left[1] < 1)] = 0
            best = gain.reshape(width, -1).argmax(1)
            for k in range(width):
                j, b = divmod(int(best[k]), bins)
                if gain[k, j, b] > 1e-9 and b < len(cuts[j]):
                    feature[first + k], above[first + k] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > above[node])
        node -= inner
        leaf = -rate * np.bincount(node, g, minlength=inner + 1) / (np.bincount(node, h, minlength=inner + 1) + l2)
        total += leaf[node]
        found.append((feature, above, leaf))
    return Trees(base, *(np.stack(v) for v in zip(*found, strict=True)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Trees:
    """From the `rows` labelled documents that come first by a hash of doc_id. Null labels don't count; of several labels
    of a document the mean decides; labels without a document are ignored; rows that share a doc_id count once."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("y"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(ids), "doc_id").select("doc_id", (F.col("y") >= 0.5).cast("double").alias("y"), "text")

    def run(it):
        for b in it:
            x = statistics(b.column(2))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    one = picked.mapInArrow(run, "doc_id long, y double, x array<double>").groupBy("doc_id").agg(F.min(F.struct("y", "x")).alias("r")).select("doc_id", "r.*")
    got = one.toPandas().sort_values("doc_id", kind="stable")
    return grow(np.array(got["x"].tolist()).reshape(-1, len(FEATURES)), got["y"].to_numpy())


def score(docs: DataFrame, model: Trees, keep_text: bool = True) -> DataFrame:
    """docs with score, the probability of label 1. Null and empty texts are scored by statistics of zero; repeated rows
    alike; other columns stay (one named score is replaced; text goes unless keep_text); an empty table gives no rows."""
    kept = [c for c in docs.columns if c != "score" and (keep_text or c != "text")]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it):
        for b in it:
            yield pa.record_batch([*b.columns[:-1], pa.array(shared.value.score(statistics(b.column(b.num_columns - 1))))], names=[*b.schema.names[:-1], "score"])

    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema] + ["score double"])
    return docs.select(*kept, F.col("text").cast("string").alias("__text")).mapInArrow(run, ddl)


def keep(docs: DataFrame, model: Trees, least: float) -> DataFrame:
    """The rows of docs with a score of at least `least`, with their own columns."""
    own = docs.columns
    if "score" not in own:
        return score(docs, model).filter(F.col("score") >= least).select(*own)
    packed = docs.select("text", F.struct(*own).alias("__row"))
    return score(packed, model, keep_text=False).filter(F.col("score") >= least).select("__row.*")
