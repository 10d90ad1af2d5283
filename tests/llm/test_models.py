"""Trained models held against plain versions of what they compute."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from vigilframe.llm import langid, quality


def ppm(texts):
    """Bits of a byte after the three before it, by the definition: the longest context that was seen (of three bytes,
    twice), else its escape and the shorter context without the bytes seen in this one."""
    seen = [defaultdict(Counter) for _ in range(4)]
    for t in texts:
        padded = b"   " + t
        for i, byte in enumerate(t):
            for k in range(4):
                seen[k][padded[i + 3 - k : i + 3]][byte] += 1
    known = [{c: n for c, n in level.items() if k < 3 or n.total() > 1} for k, level in enumerate(seen)]

    def probability(context, byte):
        k = len(context)
        shorter = (lambda b: probability(context[1:], b)) if k else (lambda b: 1 / 256)
        if context not in known[k]:
            return shorter(byte)
        counts = known[k][context]
        n, d = counts.total(), len(counts)
        escape = d / (n + d) if d < 256 else 0.0
        if byte in counts:
            return counts[byte] / n * (1 - escape)
        return escape * shorter(byte) / (1 - sum(map(shorter, counts)))

    return lambda t: sum(-math.log2(probability((b"   " + t)[i : i + 3], b)) for i, b in enumerate(t))


def test_code_lengths_are_those_of_plain_ppm():
    said = {"a": [b"the cat sat on the mat", b"the dog and the cat", "naïve café the".encode()], "b": [b"le chat et la souris", b"la maison et le chien"]}
    model = langid.train(said)
    texts = [b"the cat", b"le chat", b"zzz", b"\xff\xfe", "café".encode(), b"t"]
    offs = np.cumsum([0, *map(len, texts)])
    got = langid.code_lengths(model, np.frombuffer(b"".join(texts), np.uint8), offs)
    for k, lang in enumerate(model.langs):
        bits = ppm(said[lang])
        for i, t in enumerate(texts):
            assert got[i, k] == pytest.approx(bits(t) * langid.UNIT, abs=2.5 * len(t))


def test_language_of_empty_tables_ties_and_long_texts(spark):
    model = langid.train({"x": [b"abc abd abe"], "y": [b"abc abd abe"], "z": [b"qrs qrt qru"]})
    long = "qrs " * 200_000  # several slices
    df = spark.createDataFrame([(1, "abc"), (2, long), (3, "123"), (4, None)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.predict(df, model).collect()}
    assert got[1][0] == "x" and got[1][1] == pytest.approx(0.5, abs=0.01)
    assert got[2] == ("z", 1.0) and got[3] == got[4] == ("und", 0.0)
    assert langid.predict(df.filter("false"), model).count() == 0


MARKS = (b"#", b"$", b"%", b"&", b"*", b"!", b"|")


def statistics(text):
    b = (text or "").encode()
    classes = [
        (lambda c: 0x41 <= c <= 0x5A), (lambda c: 0x61 <= c <= 0x7A), (lambda c: 0x30 <= c <= 0x39), (lambda c: c in b" \t\x0b\x0c\r"),
        (lambda c: c == 10), (lambda c: c >= 0x80), (lambda c: c in b".?"), (lambda c: c in b",;:"), *((lambda c, m=m: c in m) for m in MARKS),
        (lambda c: c in b"@"), (lambda c: c in b"\"'`"), (lambda c: c in b"()[]{}<>"),
    ]
    n = [sum(map(f, b)) for f in classes]
    n.append(len(b) - sum(n))
    words, lines = re.findall(rb"[^\x20\x09-\x0D]+", b), [x for x in b.split(b"\n") if x]
    w, per_word, per_line = len(words), max(len(words), 1), max(len(lines), 1)
    letters = sum(bool(re.search(rb"[A-Za-z\x80-\xff]", x)) for x in words)
    again = sum(x == y for x, y in zip(words, words[1:], strict=False))
    kinds = len(set(words))
    rest = [math.log1p(len(b)), math.log1p(w), len(b) / per_word, n[0] / max(n[0] + n[1], 1), letters / per_word, sum(len(x) == 1 for x in words) / per_word, again / per_word]
    rest += [kinds / per_word, kinds / math.sqrt(per_word), math.log1p(len(lines)), len(set(lines)) / per_line, len(b) / per_line, sum(n[8:15]) / per_word]
    return [x / max(len(b), 1) for x in n] + rest


def test_statistics_are_those_of_plain_python():
    texts = ["Hello, World! a a a\nline two\n\nline two", None, "", " \n\t", "### $$$ %% && ** !! || @x \"q\" (b) {c}", "été 12.5? ok", "x" * 300 + " x", "w " * 400_000]
    got = quality.statistics(pa.array(texts))
    assert got.shape[1] == len(quality.FEATURES)
    for row, t in zip(got, texts, strict=True):
        assert row.tolist() == pytest.approx(statistics(t), rel=1e-12)


def test_scores_are_those_of_a_plain_walk():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 5)).round(1)  # ties at the cuts
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] > 0)).astype(float)
    trees = quality.grow(x, y, trees=12, depth=3)
    for row, got in zip(x, trees.score(x), strict=True):
        total = trees.base
        for feature, above, leaf in zip(trees.feature, trees.above, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > above[node] else 1)
            total += leaf[node - len(feature)]
        assert got == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-12)
    assert ((trees.score(x) > 0.5) == y).mean() > 0.95
