"""Words and pieces that a polynomial hash modulo a power of two can't tell apart."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from vigilframe.llm import near_duplicates, queries, substrings, textkit, tokens
from vigilframe.llm.textkit import U64


def thue_morse(first: str, length: int) -> str:
    other = {"ab": "ba", "ba": "ab"}
    out = [first]
    while 2 * len(out) < length:
        out += [other[x] for x in out]
    return "".join(out)


SIZES = (1024, 2048, 4096)


@pytest.mark.parametrize("length", SIZES)
def test_words(length):
    a, b = thue_morse("ab", length), thue_morse("ba", length)
    assert len(a) == length and a != b
    sets = [s.tolist() for s in textkit.shingle_sets(pa.array([a, b, a.upper()]), 3)]
    assert sets[0] == sets[2] != sets[1]


@pytest.mark.parametrize("family", [0, 1])
def test_sequences(family):
    """Of words, and of all lengths of words."""
    a, b = (np.frombuffer(thue_morse(x, 4096).encode(), np.uint8).astype(U64) for x in ("ab", "ba"))
    for k in (1, 2, 3, 5, 10, 50, 1024, 4096):
        x, y = textkit.gram_hashes(a, k, family), textkit.gram_hashes(b, k, family)
        want = {tuple(v[i : i + k].tolist()) for v in (a, b) for i in range(len(v) - k + 1)}
        assert len({*x.tolist(), *y.tolist()}) == len(want)
    buf = np.random.default_rng(1).integers(0, 3, 3000).astype(np.uint8)
    ends = np.arange(1, 3001)
    assert len(set(textkit.word_hashes(buf, np.zeros(3000, np.int64), ends, family).tolist())) == 3000
    starts = np.random.default_rng(2).integers(0, 2900, 3000)
    ends = starts + np.random.default_rng(3).integers(0, 100, 3000)
    got = textkit.word_hashes(buf, starts, ends, family).tolist()
    want = {}
    for s, e, h in zip(starts, ends, got, strict=True):
        assert want.setdefault(buf[s:e].tobytes(), h) == h
    assert len(set(want.values())) == len(want)


def test_operators(spark):
    rows = []
    for length in SIZES:
        rows += [(len(rows), thue_morse("ab", length)), (len(rows) + 1, thue_morse("ba", length))]
    one = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates.groups(one).collect()} == {i: i for i, _ in rows}
    tail = " ".join(f"w{i}" for i in range(49))
    got = substrings.in_batches(spark.createDataFrame([(i, f"{t} {tail}") for i, t in rows], "doc_id long, text string")).collect()
    assert {(r.doc_id, r.n_removed) for r in got} == {(i, 0) for i, _ in rows}
    assert {r.kept_sha256 for r in got} == {hashlib.sha256(f"{t} {tail}".encode()).hexdigest() for _, t in rows}


def test_pieces(monkeypatch):
    enc = tokens.Encoder(queries.tokenizer_path())
    texts = [thue_morse(x, n) for n in SIZES for x in ("ab", "ba")]
    assert [x.tolist() for x in enc(texts)] == [x.tolist() for x in enc.library(texts)]
    from vigilframe.llm import bytelevel

    # Hashes that can't tell anything but lengths apart: pieces are still told apart by their characters.
    monkeypatch.setattr(bytelevel, "word_hashes", lambda buf, s, e: (e - s).astype(U64) * U64(8) + U64(8))
    enc = tokens.Encoder(queries.tokenizer_path())
    texts += ["the cat and the dog", "abc def", "", "cat the"]
    assert [x.tolist() for x in enc(texts)] == [x.tolist() for x in enc.library(texts)]
    assert [x.tolist() for x in enc(texts)] == [x.tolist() for x in enc.library(texts)]
