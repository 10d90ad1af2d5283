"""Token counts, vector codes and the prefix trie against the library and plain Python, on small tables with odd rows."""

import hashlib
import math
import zlib
from collections import defaultdict

import numpy as np
import pytest
import sentencepiece
from conftest import DATA
from pyspark.sql import functions as F

from vigilframe.llm import prefixes, queries, store, tokencounts, vectorcodes

DOC = "doc_id long, text string, digest string, place string, n_tokens string"
MODEL = queries.tokenizer_path("piece_bpe_32k.model")


def odd_texts():
    texts = ["one two  three", None, "", " ", "<s>x</s> <unk>", "a▁b", "a b", "naïve ﬁ \x00   \U0001f600", "word " * 200_000, "x" * 50_000, "\n\n\t", "one two  three", "▁▁a", "  a"]
    return [(i * 3 if i % 5 else None, t, "d", "p", "n") for i, t in enumerate(texts)] + [(3, None, "d", "p", "n")] * 2 + [(21, "repeated row", None, None, None)] * 3


def test_counts_are_the_library_s(spark, monkeypatch):
    docs = spark.createDataFrame(odd_texts(), DOC).repartition(3)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = sorted((i is None, i or 0, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, *_ in odd_texts())
    for size in (tokencounts.ROW_BYTES, 1 << 40):  # missing digests are broadcast, or shuffled
        monkeypatch.setattr(tokencounts, "ROW_BYTES", size)
        got = tokencounts.count(docs, store.fresh_path(spark, "counts"), MODEL).collect()
        assert sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want


def test_cache_is_asked_first_and_added_to(spark):
    docs = spark.createDataFrame(odd_texts(), DOC)
    cache = store.fresh_path(spark, "counts")
    first = tokencounts.count(docs.filter("doc_id > 9"), cache, MODEL)
    kept = {r.digest: r.n_tokens for r in tokencounts.stored(spark, cache, tokencounts.version(MODEL)).collect()}
    assert len(kept) == len({(t or "").replace("▁", " ") for i, t, *_ in odd_texts() if i is not None and i > 9}) and first.count() == sum(i is not None and i > 9 for i, *_ in odd_texts())
    # A stored count is what documents get: one made up shows that its text isn't encoded again.
    known = hashlib.sha256(b"repeated row").digest()
    own = store.fresh_path(spark, "counts")
    spark.createDataFrame([(known, 77, tokencounts.version(MODEL)), (known, 5, "another tokenizer")], tokencounts.CACHE).write.partitionBy("version").parquet(own)
    got = tokencounts.count(docs, own, MODEL).collect()
    assert {r.n_tokens for r in got if r.doc_id == 21 and r.n_bytes == 12} == {77}
    assert spark.read.parquet(own).count() == 2 + len({(t or "").replace("▁", " ") for _, t, *_ in odd_texts()}) - 1
    before = spark.read.parquet(own).count()
    assert sorted(map(str, tokencounts.count(docs, own, MODEL).collect())) == sorted(map(str, got))
    assert spark.read.parquet(own).count() == before  # nothing was missing
    # Digests that two jobs have added are read once; another tokenizer has counts of its own.
    spark.createDataFrame([(known, 77, tokencounts.version(MODEL))], tokencounts.CACHE).write.mode("append").partitionBy("version").parquet(own)
    assert tokencounts.count(docs, own, MODEL).count() == len(odd_texts())
    bpe = queries.tokenizer_path()
    assert tokencounts.version(bpe) != tokencounts.version(MODEL)
    other = {(r.doc_id, r.n_bytes): r.n_tokens for r in tokencounts.count(docs, own, bpe).collect()}
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe)
    assert all(other[i, len((x or "").encode())] == len(t.encode(x or "", add_special_tokens=False).ids) for i, x, *_ in odd_texts() if i is not None)


def test_counts_of_no_documents(spark):
    cache = store.fresh_path(spark, "counts")
    assert tokencounts.count(spark.createDataFrame([], DOC), cache, MODEL).count() == 0
    assert not store.exists(spark, cache)


def test_registered_counts(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    docs = {r.doc_id: r.text or "" for r in store.table(spark, DATA, "documents").collect()}
    got = queries.op11_token_counts(spark, DATA).collect()
    assert len(got) == len(docs)
    for r in got:
        n = len(sp.encode(docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 4096)


def plain_codes(rows, parts, entries, rounds, scale=1024):
    """Whole numbers of Python, one vector after the other."""
    good = [(i, lab, v) for i, v, lab in rows if v and len(v) % parts == 0 and all(x is not None and math.isfinite(x) for x in v)]
    good = [(i, lab, [math.floor(x * scale) for x in v]) for i, lab, v in good]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, len(r[2]), r[2]))
    if not good:
        return {}, []
    width = len(good[0][2]) // parts
    good = [r for r in good if len(r[2]) == parts * width]
    cut = [[r[2][k * width : (k + 1) * width] for r in good] for k in range(parts)]
    books = [list(map(list, c[:entries])) for c in cut]

    def assign(k):
        return [min((sum((a - b) ** 2 for a, b in zip(p, e, strict=True)), j) for j, e in enumerate(books[k])) for p in cut[k]]

    for _ in range(rounds):
        for k in range(parts):
            of = defaultdict(list)
            for p, (_, j) in zip(cut[k], assign(k), strict=True):
                of[j].append(p)
            for j, ps in of.items():
                books[k][j] = [sum(c) // len(ps) for c in zip(*ps, strict=True)]
    last = [assign(k) for k in range(parts)]
    by = defaultdict(int)
    out = []
    for n, (i, lab, _) in enumerate(good):
        error = sum(last[k][n][0] for k in range(parts))
        by[lab] += error
        out.append((i, lab, "".join(f"{last[k][n][1]:02x}" for k in range(parts)), error))
    return sorted(((*r, by[r[1]]) for r in out), key=str), books


def vectors():
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(9, 8))
    rows = [(i, (centre[i % 9] + 0.3 * rng.integers(-2, 3, 8)).tolist(), i % 3 if i % 4 else None) for i in range(150)]
    rows += [(i, [0.5] * 8, 1) for i in range(150, 200)]  # copies
    return rows + [(200, None, 1), (201, [], 1), (202, [None] + [1.0] * 7, 1), (203, [float("nan")] * 8, 1), (204, [float("inf")] * 8, 1), (205, [1.0] * 4, 1), (206, [1.0] * 5, 1), (None, rows[3][1], None), rows[7], rows[7], (207, [-0.0001] * 8, 7)]


@pytest.mark.parametrize("entries", [16, 256])
def test_codes(spark, entries):
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<double>, label int").withColumns({c: F.lit("mine") for c in ("row", "v", "pos", "part", "code", "error")}).repartition(3)
    got, books = vectorcodes.compress(df, entries=entries)
    want, plain_books = plain_codes(vectors(), 4, entries, 4)
    assert sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in got.collect()), key=str) == want
    assert books.tolist() == plain_books
    assert vectorcodes.digest(books) == hashlib.sha256(",".join(str(x) for b in plain_books for e in b for x in e).encode()).hexdigest()
    back = {r.vec_id: r.embedding for r in vectorcodes.decompress(got, books).collect()}
    assert back[150] == [x / 1024 for k in range(4) for x in plain_books[k][int(next(w[2] for w in want if w[0] == 150)[2 * k : 2 * k + 2], 16)]]


def test_codes_of_large_components_and_none(spark):
    rows = [(1, [1e30, 1.0, 2.0, 3.0], 1), (2, [-1e300, 1.0, 2.0, 4.0], 1), (3, [100_000.0, 1.0, -2.0, 3.0], None), (4, [100_000.5, 1.5, 2.0, 3.0], 2)]
    got = vectorcodes.compress(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"), entries=2)[0].collect()
    most = (math.isqrt((1 << 62) // 4) // 2) / 1024
    held = [(i, [min(max(x, -most), most) for x in v], lab) for i, v, lab in rows]
    assert sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in got), key=str) == plain_codes(held, 4, 2, 4)[0]
    none, books = vectorcodes.compress(spark.createDataFrame([(1, None, 1)], "vec_id long, embedding array<float>, label int"))
    assert none.count() == 0 and books.size == 0


TURN = "conv_id long, turn long, role string, text string, id string, place string, depth string"


def talk():
    """Families with shared heads, copies, ties, nulls, a long conversation, one without the one that lends its head."""
    rng = np.random.default_rng(8)
    rows = []
    for c in [*range(60), 103, 104, 207]:
        n = int(rng.integers(1, 12))
        rows += [(c, t if t else None, ["user", "assistant", None][t % 3], f"text {rng.integers(0, 3)} of {t}" if rng.random() < 0.9 else None) for t in range(n)]
    for c in range(300, 360):
        rows += [(c, t, "user", f"the same {t} é") for t in range(12)]
    rows += [(c, 12, "user", f"own {c % 7}") for c in range(330, 350)]
    rows += [(400, t, "user", str(t)) for t in range(700)] + [(401, 5, "b", "x"), (401, 5, "a", "y"), (401, 5, "a", "y"), (None, 1, "user", "nobody's")]
    return [(*r, "i", "p", "d") for r in rows]


def plain_trie(rows, every=5, most=9):
    own = defaultdict(list)
    for c, t, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            said = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            own[c].append((t is not None, t or 0, said, role, text))
    turns = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    made = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % most
        made[c] = turns.get(c - c % every, [])[:h] + turns[c][h:]
    members = defaultdict(list)
    for c, s in sorted(made.items()):
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    n_children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for k in members:
        if k:
            n_children[k[:-1]] += 1
    for k, m in sorted(members.items(), key=lambda x: -len(x[0])):
        leaves[k] += not n_children[k]
        saved[k] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
        if k:
            leaves[k[:-1]] += leaves[k]
            saved[k[:-1]] += saved[k]
    ends = {k: hashlib.sha256(",".join(str(c) for c in m if len(made[c]) == len(k)).encode()).hexdigest() for k, m in members.items()}
    return sorted((m[0], len(k), members[k[:-1]][0] if k else None, len(m), n_children[k], leaves[k], saved[k], ends[k]) for k, m in members.items())


@pytest.mark.parametrize("local_rows", [1, 40, 100_000])
def test_trie(spark, local_rows, monkeypatch):
    """However many levels are dealt out before buckets are local."""
    monkeypatch.setattr(prefixes, "CHUNK_IDS", 7)
    rows = talk() if local_rows > 1 else [r for r in talk() if r[0] is None or r[0] < 30 or 300 <= r[0] < 304 or 330 <= r[0] < 335]
    got = prefixes.nodes(spark.createDataFrame(rows, TURN).repartition(5), local_rows=local_rows).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[:2]) == plain_trie(rows)


def test_trie_of_few(spark):
    assert prefixes.nodes(spark.createDataFrame([], TURN)).count() == 0
    assert prefixes.nodes(spark.createDataFrame([(None, 1, "user", "x", "", "", "")], TURN)).count() == 0
    # 100 lends nothing and crc32 drops turns: conversations may be left without any.
    rows = [(c, 0, "user", "x", "", "", "") for c in (101, 102, 103, 104)]
    assert sorted(tuple(r) for r in prefixes.nodes(spark.createDataFrame(rows, TURN)).collect()) == plain_trie(rows)


def test_numbering_goes_on_across_partitions(spark):
    rows = [(7, i, "user", str(i)) for i in range(500)] + [(c, 0, "user", "x") for c in range(5)] + [(9, 1, None, None)]
    got = prefixes.numbered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(r.place for r in got if r.conv_id == 7) == list(range(1, 501)) and len({r.id for r in got}) == 502
