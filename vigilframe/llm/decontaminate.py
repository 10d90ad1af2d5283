"""Benchmark decontamination by one Aho-Corasick automaton over normalised test items (operator 2).

Texts are normalised byte by byte (A-Z lower-cased, every byte outside digits, letters and 0x80-0xFF a separator), so
places in the normalised text map back to the original. Documents are scanned once, in the task that reads them; nothing
is shuffled.

The automaton holds every SEED-word run of an item that begins at a multiple of STRIDE words, and items shorter than a
window as a whole. Any window of an item holds such a run, so an occurrence of a window shows as a match of one, and only
the windows of a document that hold a match are looked up among the items' windows, by 128-bit hashes. So an automaton
takes fewer nodes than the items have letters, not ten times as many. It is built once by a worker process and kept for
its later tasks. Items of more than AUTOMATON_BYTES are dealt into several automata, each scanned in turn, for the sake of
the workers' memory.
"""

from __future__ import annotations

import uuid

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit
from .textkit import U64

WINDOW = 10
SEED = 3  # words
AUTOMATON_BYTES = 8 << 20
_table = np.where(textkit.ALNUM_OR_HIGH, textkit.LOWER, 0x20).astype(np.uint8).tobytes()


def normalise(text: bytes) -> bytes:
    """The words, each between two single spaces; a single space without words."""
    return b" ".join([b"", *text.translate(_table).split(), b""])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_table).split()


class Index:
    """Of (id, text) items: the automaton, and the windows by hash with the items they occur in."""

    def __init__(self, items: list[tuple[str, bytes]], size: int = WINDOW):
        self.size, self.names = size, sorted({i for i, _ in items})
        number = {n: k for k, n in enumerate(self.names)}
        seed_words = min(SEED, size)
        self.stride = size - seed_words + 1
        seeds: dict[bytes, int] = {}  # normalised run of words -> its number
        self.words, self.short = [], []  # by number: how many, and the short items that it is
        hashed = [(np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64))]

        def seed(part: list[bytes]) -> int:
            k = seeds.setdefault(b" " + b" ".join(part) + b" ", len(seeds))
            if k == len(self.words):
                self.words.append(len(part))
                self.short.append(set())
            return k

        for item, text in items:
            w = words_of(text)
            if len(w) < size:
                if w:
                    self.short[seed(w)].add(item)
                continue
            for i in range(0, len(w) - seed_words + 1, self.stride):
                seed(w[i : i + seed_words])
            hashed.append((*window_hashes(normalise(text), size), np.full(len(w) - size + 1, number[item])))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS) if seeds else None
        for key, k in seeds.items():
            self.automaton.add_word(key.decode("latin-1"), k)
        if seeds:
            self.automaton.make_automaton()
        self.n_words, self.is_short = np.array(self.words, np.int64), np.array([bool(x) for x in self.short], bool)
        self.h1, self.h2, of = (np.concatenate(x) for x in zip(*hashed, strict=True))
        order = np.lexsort((of, self.h2, self.h1))
        self.h1, self.h2, self.of = self.h1[order], self.h2[order], of[order].astype(np.int32)

    def find(self, norm: bytes) -> tuple[list[tuple[int, int]], set[str]]:
        """(word spans of occurring windows, the items they occur in) of a normalised text."""
        hits = list(self.automaton.iter(norm.decode("latin-1"))) if self.automaton else []
        if not hits:
            return [], set()
        end, k = np.array(hits).T
        spaces = np.flatnonzero(np.frombuffer(norm, np.uint8) == 0x20)
        first = np.searchsorted(spaces, end) - self.n_words[k]
        spans, found = [], set()
        for w, s in zip(first[self.is_short[k]].tolist(), k[self.is_short[k]].tolist(), strict=True):
            spans.append((w, w + self.words[s]))
            found |= self.short[s]
        n = len(spaces) - self.size  # windows of the text
        if n > 0 and len(self.h1):
            step = np.zeros(n + 1, np.int64)
            np.add.at(step, np.clip(first - self.stride + 1, 0, n), 1)
            np.add.at(step, np.clip(first + 1, 0, n), -1)
            start = np.flatnonzero(step[:-1].cumsum())
            h1, h2 = (h[start] for h in window_hashes(norm, self.size))
            low, high = np.searchsorted(self.h1, h1), np.searchsorted(self.h1, h1, "right")
            for w, x, a, b in zip(*(v[low < high].tolist() for v in (start, h2, low, high)), strict=True):
                of = self.of[a:b][self.h2[a:b] == x]
                if len(of):
                    spans.append((w, w + self.size))
                    found.update(self.names[i] for i in set(of.tolist()))
        return spans, found


def window_hashes(norm: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every window of a normalised text."""
    buf = np.frombuffer(norm, np.uint8)
    starts, ends, _ = textkit.words(buf, np.array([0, len(buf)]))
    return tuple(textkit.gram_hashes(textkit.word_hashes(buf, starts, ends, f), size, f) for f in (0, 1))


_built: dict[str, Index] = {}


def _index(name: str, items, size: int) -> Index:
    """Of a broadcast's items, built once by a process; those of an earlier call are forgotten."""
    if name not in _built:
        for old in [k for k in _built if k.partition("/")[0] != name.partition("/")[0]]:
            del _built[old]
        _built[name] = Index(items, size)
    return _built[name]


SPANS = "array<struct<begin: long, end: long>>"


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = AUTOMATON_BYTES, keep_text: bool = True) -> DataFrame:
    """docs with n_words, n_hit (words inside any occurrence of a window of `size` consecutive item words), items (sorted
    item ids as strings) and spans (merged character ranges of the original text).

    docs needs text, benchmark item_id and text; other columns of docs stay (columns named like the new ones are
    replaced; text goes unless keep_text). Null or wordless texts have no words and no hits; null or wordless items have
    no windows; a null item_id counts as the empty string; repeated documents and items each count for themselves. Empty
    tables give no rows or no hits.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // most))
    kept = [c for c in docs.columns if c not in ("text", "n_words", "n_hit", "items", "spans", "__spans")]
    out = docs.select(*kept, F.col("text").cast("string").alias("text"))
    own = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema]
    call = uuid.uuid4().hex
    for g in range(groups):
        part = items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(groups)) == g)
        held = spark.sparkContext.broadcast([(r.item, r.text.encode()) for r in part.toLocalIterator()])  # about AUTOMATON_BYTES
        last = g == groups - 1
        new = ["n_words long", "n_hit long", "items array<string>", f"spans {SPANS}"] if last else ["items array<string>", f"__spans {SPANS}"]
        out = out.mapInArrow(_scanner(f"{call}/{g}", held, len(kept), size, g > 0, last, keep_text), ", ".join((own if keep_text or not last else own[:-1]) + new))
    return out


def _scanner(name: str, held, at: int, size: int, later: bool, last: bool, keep_text: bool):
    """Columns in: the kept ones, text and, if later, items and word spans found so far. Out: the same, or if last the
    final ones."""
    names, spans_of = pa.list_(pa.string()), pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(it):
        index = None
        for b in textkit.batches(it):
            index = index or _index(name, held.value, size)
            count, hit, items, spans = ([] for _ in range(4))
            before = [b.column(at + k).to_pylist() for k in (1, 2)] if later else None
            for i, text in enumerate(b.column(at).cast(pa.binary()).to_pylist()):
                norm = normalise(text or b"")
                count.append(norm.count(b" ") - 1)
                own, ids = index.find(norm)
                if later:
                    ids |= set(before[0][i])
                    own += [(s["begin"], s["end"]) for s in before[1][i]]
                own = _merge(own)
                hit.append(sum(y - x for x, y in own))
                items.append(sorted(ids))
                spans.append([{"begin": x, "end": y} for x, y in (_places(text, own) if last and own else own)])
            columns = {n: b.column(k) for k, n in enumerate(b.schema.names[: at + (keep_text or not last)])}
            if last:
                columns |= {"n_words": pa.array(count, pa.int64()), "n_hit": pa.array(hit, pa.int64())}
            yield pa.record_batch(columns | {"items": pa.array(items, names), "spans" if last else "__spans": pa.array(spans, spans_of)})

    return run


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _places(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """From word numbers to characters of the original text."""
    buf = np.frombuffer(text, np.uint8)
    starts, ends, _ = textkit.words(buf, np.array([0, len(buf)]), textkit.ALNUM_OR_HIGH)
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in spans]


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without an occurrence of a window of any item, with their own columns."""
    own = docs.columns
    clash = {c for c in own if c in ("n_words", "n_hit", "items", "spans", "__spans")}
    packed = docs.select("text", F.struct(*own).alias("__row")) if clash else docs
    out = find(packed, benchmark, keep_text=not clash).filter("n_hit = 0")
    return out.select("__row.*") if clash else out.select(*own)
