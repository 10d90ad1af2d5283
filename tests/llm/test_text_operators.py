"""Operators over documents against plain Python, on small tables with odd rows."""

import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from vigilframe.llm import bytelevel, chat, decontaminate, langid, mix, near_duplicates, quality, queries, store, substrings, textkit, tokens

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] + str(j % 7) for i, j in zip(rng.integers(0, len(WORDS), n), rng.integers(0, 50, n), strict=True))


def documents():
    base = prose(1, 120)
    near = base.split()
    near[60] = "changed"
    texts = [base, base.upper().lower(), " ".join(near), None, "", " \t\n", "two words", "Two  Words", "x", prose(2, 400), prose(2, 400) + " tail", prose(3, 55), "La straße ÉTÉ \x1c sep\u00a0nbsp", prose(4, 60) + " " + base, "word " * 300, prose(5, 8), base]
    rows = [(10 * i + 3, t, ["en", "fr", None][i % 3], ["b", "a", None, "a"][i % 4], len(t or "")) for i, t in enumerate(texts)]
    return [*rows, rows[0], (None, base, "en", "a", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), DOC).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def by_brute_force(rows, k, percent):
    sets = defaultdict(set)
    for i, t, *_ in rows:
        if i is not None:
            sets[i].add(shingles(t, k))
    part = {i: i for i in sets}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x

    for i in sets:
        for j in sets:
            if any(a and b and 100 * len(a & b) >= percent * len(a | b) for a in sets[i] for b in sets[j]):
                a, b = sorted((root(i), root(j)))
                part[b] = a
    return {i: root(i) for i in sets}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, percent):
    got = near_duplicates.groups(docs, k, percent).collect()
    want = by_brute_force(documents(), k, percent)
    assert len(got) == len(documents())
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert {(r.doc_id, r.n_shingles) for r in got} == {(i, len(shingles(t, k))) for i, t, *_ in documents()}


@pytest.mark.parametrize("block", [256, 8])
def test_near_duplicates_of_a_family(spark, monkeypatch, block):
    """A chain of edits, and many copies that differ from one text in other places: no link may get lost, in families
    compared whole or key by key."""
    monkeypatch.setattr(near_duplicates, "BLOCK", block)
    rng, base = np.random.default_rng(7), prose(9, 200).split()
    rows, now = [], list(base)
    for i in range(40):
        rows.append((i, " ".join(now)))
        now[int(rng.integers(200))] = f"edit{i}"
    for i in range(40, 120):
        copy = list(base)
        for at in rng.integers(0, 200, int(rng.integers(1, 40))):
            copy[at] = f"own{i % 9}"
        rows.append((i, " ".join(copy)))
    got = {r.doc_id: r.component_id for r in near_duplicates.groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85).collect()}
    assert got == by_brute_force(rows, 3, 85)


def test_families_are_dealt_the_cheaper_way(spark):
    """A chain of keys of two documents key by key, documents that share all keys as a family."""
    n = 3 * near_duplicates.BLOCK
    chain = [(k, r, r, 0) for k in range(n) for r in (k, k + 1)]
    dense = [(n + k, 10**6 + r, r, 1) for k in range(5) for r in range(n)]
    keyed = spark.createDataFrame(chain + dense, "key long, rep long, c long, family long")
    got = near_duplicates._dealt(keyed.select("rep", "c", "family").distinct(), keyed).groupBy("by_key").agg(F.count("*").alias("n"), F.max("blocks").alias("blocks"))
    assert {(r.by_key, r.n, r.blocks) for r in got.collect()} == {(True, 2 * n, 1), (False, n, 3)}


def test_keys_hold_the_pigeonhole_promise():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (200, near_duplicates.CHUNKS * near_duplicates.WIDTH)).astype(np.uint64)
    b = a.copy()
    for row in b:
        row[rng.choice(a.shape[1], 2 * near_duplicates.CHUNKS - 1, replace=False)] += np.uint64(1)
    ka, kb = near_duplicates.keys(a), near_duplicates.keys(b)
    assert all(set(x) & set(y) for x, y in zip(ka.tolist(), kb.tolist(), strict=True))


def item_windows(text, size=10):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return [tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))] if w else []


@pytest.mark.parametrize("most", [10**6, 200])
def test_decontamination(spark, docs, most):
    items = [(1, prose(2, 400)[100:400]), (2, "two-words"), (3, None), (4, "..."), (None, "x"), (12, "Straße été, sep nbsp"), (2, prose(5, 8)), (7, "no such text at all")]
    got = {(r.doc_id, r.text): r for r in decontaminate.find(docs, spark.createDataFrame(items, "item_id long, text string"), most=most).collect()}
    for i, t, *_ in documents():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
        hit, names = set(), set()
        for item, text in items:
            for win in item_windows(text):
                for k in range(len(w) - len(win) + 1):
                    if tuple(w[k : k + len(win)]) == win:
                        hit |= set(range(k, k + len(win)))
                        names.add("" if item is None else str(item))
        r = got[i, t]
        assert (r.n_words, r.n_hit, r.items) == (len(w), len(hit), sorted(names))
        assert sum(len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t[s.begin : s.end])) for s in r.spans) == len(hit)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 10])
def test_index_against_all_windows(size):
    """Texts of few different words, so that windows overlap, repeat and are shared by items."""
    rng = np.random.default_rng(size)
    text = lambda n: " ".join(rng.choice(["a", "bb", "Ccc", "d"], n))
    items = [(f"i{k % 17}", text(rng.integers(0, 25)).encode()) for k in range(40)]
    index = decontaminate.Index(items, size)
    for _ in range(300):
        w = decontaminate.words_of(text(rng.integers(0, 40)).encode())
        w[len(w) // 2 : len(w) // 2] = decontaminate.words_of(items[rng.integers(40)][1])
        spans, found = index.find(decontaminate.normalise(b" ".join(w)))
        hit, names = set(), set()
        for name, t in items:
            for win in item_windows(t.decode(), size):
                win = [x.encode() for x in win]
                for k in range(len(w) - len(win) + 1):
                    if w[k : k + len(win)] == win:
                        hit |= set(range(k, k + len(win)))
                        names.add(name)
        assert (set().union(*(range(a, b) for a, b in spans)), found) == (hit, names)


def test_decontamination_keeps_columns(spark, docs):
    clash = docs.withColumn("items", F.lit("mine")).withColumn("n_hit", F.lit(5))
    out = decontaminate.decontaminate(clash, spark.createDataFrame([(1, "two words")], "item_id long, text string"))
    assert out.columns == clash.columns
    assert {r.items for r in out.collect()} == {"mine"}
    assert out.count() == len(documents()) - 2


def test_substrings(spark, docs):
    got = {(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.in_batches(docs).collect()}
    rows, first = documents(), {}
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows]
    for i, w in words:
        for k in range(len(w) - 49):
            key = tuple(w[k : k + 50])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    want = set()
    for i, w in words:
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if i is not None and first[tuple(w[k : k + 50])] < i:
                gone[k : k + 50] = [True] * 50
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.add((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert got == want
    assert any(r[2] for r in got)


def test_substring_index_over_many_batches(spark, monkeypatch):
    """Runs are compacted, and the way without a bit filter gives the same rows."""
    rows = [(i, prose(i % 3, 90) + f" end{i}") for i in range(14)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, substrings.in_batches(df, 1).select("doc_id", "n_removed", "kept_sha256").collect()))
    assert sorted(map(tuple, substrings.in_batches(df, 7).select("doc_id", "n_removed", "kept_sha256").collect())) == want
    monkeypatch.setattr(substrings, "MOST_FILTERED", 0)
    assert sorted(map(tuple, substrings.in_batches(df, 2).select("doc_id", "n_removed", "kept_sha256").collect())) == want


def test_substring_index_of_several_sessions(spark, tmp_path):
    """An index is opened from its folder by a session whose catalogue knows nothing of it, also after an add broke off."""
    rows = [(i, prose(i % 3, 90) + f" end{i}") for i in range(14)] + [(14, None), (None, prose(0, 90))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    parts = [df.filter("doc_id < 5"), df.filter("doc_id >= 5 and doc_id < 9"), df.filter("doc_id >= 9 or doc_id is null")]
    folder = f"file://{tmp_path}/index"
    index, got = substrings.FingerprintIndex(folder=folder), []
    for part in parts:
        before = set(os.listdir(f"{tmp_path}/index")) if got else set()
        got += map(tuple, index.add(part).select("doc_id", "n_removed", "kept_sha256").collect())
        for name in set(os.listdir(f"{tmp_path}/index")) - before:
            if name.startswith("run-"):
                spark.sql(f"DROP TABLE IF EXISTS {name.replace('-', '_')}")
        os.mkdir(f"{tmp_path}/index/run-left{len(got)}")
        index = substrings.FingerprintIndex.open(spark, folder)
        assert sum(r.count() for _, r in index.runs) > 0 and len(index.texts) == len(index.listed)
        plan = index.runs[0][1].hint("merge").join(index.runs[-1][1].select("f").hint("merge"), "f")._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
    want = substrings.in_batches(df, 1).select("doc_id", "n_removed", "kept_sha256").collect()
    assert sorted(got, key=str) == sorted(map(tuple, want), key=str)
    assert len(index.runs) == 2  # of three adds: two were merged


def test_language_is_learned_from_whole_texts(spark):
    """What tells two languages apart lies behind the first `chars` characters of long documents, shorter ones have none."""
    rng = np.random.default_rng(8)
    noise = ["".join(map(chr, rng.integers(97, 123, 3000))) for _ in range(60)]
    rows = [(i, t[:200] + said * 400, lang) for i, t in enumerate(noise[:40]) for lang, said in [[("aa", "the cat sat on the mat "), ("bb", "le chat et la souris ")][i % 2]]]
    rows += [(100 + i, t[:100], ["aa", "bb"][i % 2]) for i, t in enumerate(noise[40:])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df, docs_per_lang=15, chars=150)
    new = spark.createDataFrame([(1, "on the mat the cat sat"), (2, "et la souris le chat"), (3, "the cat"), (3, "the cat")], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(new, model).orderBy("doc_id").collect()] == ["aa", "bb", "aa", "aa"]
    again = langid.fit(df.repartition(5), docs_per_lang=15, chars=150)
    assert all(np.array_equal(x, y) for a, b in zip(model.trees, again.trees, strict=True) for x, y in zip(a.grams + a.seen, b.grams + b.seen, strict=True))


def test_language(spark, docs):
    other = [(1000 + i, t, l, "s", 1) for i, (t, l) in enumerate([("the cat sat on the mat and the dog ran", "en"), ("le chat et la souris dans la maison", "fr")] * 20)]
    model = langid.fit(spark.createDataFrame(other, DOC))
    assert model.langs == ["en", "fr"]
    for bits in model.bits:  # probabilities of a context sum to one
        assert np.allclose((2.0 ** (bits.reshape(-1, 256) / -langid.UNIT)).sum(1), 1, atol=0.01)
    got = {(r.doc_id, r.text): r for r in langid.predict(docs.withColumn("score", F.lit("x")), model).collect()}
    for (_, t), r in got.items():
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or ""))
        assert 0 <= r.score <= 1
    assert next(iter(langid.predict(spark.createDataFrame([(1, "the dog and the cat")], "doc_id long, text string"), model).collect())).lang_pred == "en"
    nothing = langid.fit(docs.filter("false"))
    assert {r.lang_pred for r in langid.predict(docs, nothing).collect()} == {"und"}


def test_many_languages(spark):
    """Each language is learned, with the same tree whatever others there are, and from longer documents where it must be."""
    said = {"en": "the cat sat on the mat and the dog ran ", "zz": "le chat et la souris dans la maison "}
    rng = np.random.default_rng(5)
    rows = [(i, "".join(map(chr, rng.integers(97, 123, 400))), f"l{i:03}") for i in range(300)]
    rows += [(1000 + i, said["en"] * 20, "en") for i in range(3)] + [(2000, said["zz"] * 400, "zz")]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.langs == sorted({r[2] for r in rows})
    levels = lambda t: [x.tolist() for x in [*t.contexts, *t.escapes, *t.grams, *t.seen]]
    mine = {lang: levels(model.trees[model.langs.index(lang)]) for lang in said}
    assert mine["en"] == levels(langid.grow([(said["en"] * 20).encode()] * 3))
    passages = {(said["zz"] * 400)[k : k + langid.SAMPLE_CHARS] for k in range(len(said["zz"]))}  # one of them, wherever it begins
    assert mine["zz"] in [levels(langid.grow([t.encode()])) for t in passages]
    new = spark.createDataFrame([(1, said["zz"]), (2, said["en"]), (3, rows[7][1])], "doc_id long, text string")
    assert [r.lang_pred for r in langid.predict(new, model).orderBy("doc_id").collect()] == ["zz", "en", "l007"]


def test_quality(spark, docs):
    rows = [(i, prose(i, 60) if i % 2 else "### $$$ %%% " * 20, "en", "s", 1) for i in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(3, None), (None, 1), (9999, 1)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, DOC)
    model = quality.fit(df, labels)
    got = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert all((got[i] > 0.5) == bool(i % 2) for i in range(150, 200))
    scored = quality.score(docs.withColumn("score", F.lit("clash")), model).collect()
    assert len(scored) == len(documents()) and all(0 <= r.score <= 1 for r in scored)
    assert {r.score for r in quality.score(docs, quality.fit(df, labels.filter("false"))).collect()} == {0.5}
    kept = quality.keep(df.withColumn("score", F.lit("mine")), model, 0.3)
    assert {r.score for r in kept.collect()} == {"mine"} and kept.count() == 100


def test_mix_targets():
    t = mix.targets({"a": 10, "b": 100, None: 30, "c": 20})
    assert sum(t.values()) == pytest.approx(160)
    assert t["a"] == 30 and all(t[s] <= 3 * n + 1e-9 for s, n in {"a": 10, "b": 100, None: 30, "c": 20}.items())
    assert mix.targets({}) == {} and mix.targets({"a": 0}) == {"a": 0.0}


def exact_targets(sizes):
    """By the rule, in fractions: weights 5, 2, 1 repeat; while a source is above three times its size, it stops there and
    the rest is shared anew."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    capped = {}
    while True:
        rest = [s for s in order if s not in capped]
        left = sum(sizes.values()) - sum(capped.values())
        now = {s: Fraction(left * weight[s], sum(weight[x] for x in rest)) for s in rest}
        above = [s for s in rest if now[s] > 3 * sizes[s]]
        if not above:
            return {**capped, **now}
        capped |= {s: Fraction(3 * sizes[s]) for s in above}


@pytest.mark.parametrize("most_sources", [10_000, 0])
def test_targets_and_sizes(spark, monkeypatch, most_sources):
    """Both ways of finding targets against fractions, sizes against the pattern."""
    monkeypatch.setattr(mix, "DRIVER_SOURCES", most_sources)
    rng = np.random.default_rng(4)
    names = [None, "", "a", "B", "b", "é", "中", *(f"s{i}" for i in range(20))]
    rows = [(i, None if i % 50 == 0 else " \t".join(["w"] * int(rng.integers(0, 40) ** 2 // 20)) + "\x1c x\u00a0y ", None, names[int(rng.integers(len(names)) ** 1.2) % len(names)], 0) for i in range(500)]
    got = mix.plan(spark.createDataFrame(rows, DOC)).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in rows}
    assert {r.doc_id: r["size"] for r in got} == size
    by_source = defaultdict(int)
    for i, _, _, s, _ in rows:
        by_source[s] += size[i]
    want = exact_targets(by_source)
    assert any(want[s] == 3 * n for s, n in by_source.items())
    for r in got:
        assert r.source_size == by_source[r.source] and r.target == pytest.approx(float(want[r.source]), rel=1e-12)


def test_special_tokens(spark):
    """As by the library's default, in token files; as characters in chats."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    added = [t.content for t in tok.get_added_tokens_decoder().values()]
    texts = ["plain text", *(f"a{x}b {x}{x} c" for x in added), "<|endoftext", "", "a<|endoftext|>b"]
    enc = tokens.encoder(PATH)
    assert [x.tolist() for x in enc(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]
    tok.encode_special_tokens = True
    assert [x.tolist() for x in tokens.encoder(PATH, literal=True)(texts)] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_mix(spark, docs):
    rows = [(i, prose(i, 1 + i % 40), None, f"s{i % 4}" if i % 9 else None, 0) for i in range(600)]
    df = spark.createDataFrame(rows, DOC)
    got = mix.plan(df.repartition(5)).collect()
    again = mix.plan(df.repartition(2, "source")).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    want = mix.targets({s: sum(r.size for r in got if r.source == s) for s in {r.source for r in got}})
    for s, target in want.items():
        assert abs(sum(r.taken for r in got if r.source == s) - target) <= 40
    assert all(r.taken <= 3 * r.size and r.taken % max(r.size, 1) == 0 for r in got)
    assert sorted(r.doc_id for r in mix.mix(df).collect()) == sorted(r.doc_id for r in got for _ in range(r.copies))
    odd = mix.plan(docs.withColumn("size", F.lit("clash"))).collect()
    assert len(odd) == len(documents()) and all(r.taken == 0 for r in odd if r.size == 0)
    assert mix.mix(docs).columns == docs.columns


def test_mix_of_rows_that_share_ids(spark):
    """Null and repeated ids: each text is there as often as the plan takes it, not another of its id."""
    rows = [(None if i % 3 else i % 5, prose(i % 50, 1 + i % 50), None, "ab"[i % 2] if i % 7 else None, 0) for i in range(300)]
    df = spark.createDataFrame(rows, DOC)
    planned = Counter()
    for r in mix.plan(df).collect():
        planned[r.doc_id, r.source, r.size] += r.copies
    mixed = mix.mix(df.repartition(4).withColumn("copies", F.lit("clash")).withColumn("h", F.lit(0))).collect()
    got = Counter((r.doc_id, r.source, len(r.text.split())) for r in mixed)
    assert got == +planned and any(r.doc_id is None for r in mixed)


def test_rounding_tree(spark, monkeypatch):
    monkeypatch.setattr(mix, "BUCKET_ROWS", 20)
    monkeypatch.setattr(mix, "FAN_IN", 3)
    df = spark.createDataFrame([(i, prose(i, 1 + i % 30), None, "ab"[i % 2], 0) for i in range(400)], DOC)
    got = mix.plan(df).collect()
    assert len(got) == 400
    for s in "ab":
        assert abs(sum(r.taken for r in got if r.source == s) - next(r.target for r in got if r.source == s)) <= 30


PATH = queries.tokenizer_path()


def test_pieces_are_the_librarys():
    rng = np.random.default_rng(5)
    odd = [*"ab's  t'rev'llmd\n\t 12.,!<|>", "é", "中", "٣", "\u00a0", "\u3000", "\u0085", "\x1c", "\U0001f600", "\u0301", "'s", "'re", " 's", "\r\n", "<|endoftext|>", "½"]
    texts = ["".join(rng.choice(odd, rng.integers(0, 50))) for _ in range(3000)]
    enc = tokens.Encoder(PATH)
    assert [x.tolist() for x in enc(texts)] == [x.tolist() for x in enc.library(texts)]
    enc.pieces.n = bytelevel.MOST_ENTRIES  # full: it starts again
    assert [x.tolist() for x in enc(texts[:50])] == [x.tolist() for x in enc.library(texts[:50])]


def test_packing_round_trip():
    v = (np.random.default_rng(1).integers(0, 1 << 32, 300, dtype=np.uint64) >> np.random.default_rng(2).integers(0, 32, 300).astype(np.uint64)).astype(np.uint32)
    bounds = np.array([0, 0, 1, 5, 5, 9, 13, 14, 300])
    values, back = tokens.unpack(*tokens.pack(v, bounds), np.diff(bounds))
    assert (values == v).all() and (back == bounds).all()


def test_token_files(spark, docs, none):
    folder = store.fresh_path(spark, "t")
    tokens.write(docs, folder, PATH)
    got = tokens.read(spark, folder).orderBy("start").collect()
    enc = tokens.Encoder(PATH)
    assert [r.doc_id for r in got] == sorted((i for i, *_ in documents()), key=lambda i: (i is not None, i))
    want = defaultdict(list)
    for i, t, *_ in documents():
        want[i].append([*enc.library([t or ""])[0].tolist(), 2])
    at = 0
    for r in got:
        assert r.ids in want[r.doc_id] and r.start == at and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    ranks = spark.read.parquet(f"{folder}/ranks").orderBy("rank").collect()
    assert [r["count"] for r in ranks] == sorted((r["count"] for r in ranks), reverse=True)
    empty = store.fresh_path(spark, "t")
    tokens.write(none, empty, PATH)
    assert tokens.read(spark, empty).count() == 0


def test_chat(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    rows = [(1, 0, "user", "hi <|x|>"), (1, 1, "assistant", said), (1, 1, "assistant", said), (2, 5, "assistant", None), (2, 4, None, "<\\|<\\\\|"), (None, 0, "user", "é"), (3, 0, "sys<|im_sep|>tem", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash"))
    got = {r.conv_id: r for r in chat.read_back(chat.conversations(chat.format_turns(df, PATH)), PATH).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv in got:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: r[1])
        loss = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        r = got[conv]
        assert r.n_turns == len(turns) and r.loss_chars == len(loss)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    for t in (said, "<\\|", "<|", "<\\\\|x", "a<b|c", ""):
        assert chat.unescape(chat.escape(t)) == t and not any(m in chat.escape(t) for m in chat.MARKERS)


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert near_duplicates.groups(none).count() == 0
    assert decontaminate.find(none, bench).count() == 0
    assert substrings.in_batches(none).count() == 0
    assert mix.plan(none).count() == 0
    assert quality.score(none, quality.fit(none, spark.createDataFrame([], "doc_id long, quality int"))).count() == 0
    turns = chat.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"), PATH)
    assert chat.read_back(chat.conversations(turns), PATH).count() == 0


def test_long_text(spark):
    """One text larger than a slice."""
    text = " ".join(prose(i, 4000) for i in range(30))
    assert len(text) > textkit.SLICE_BYTES
    df = spark.createDataFrame([(1, text), (2, "short one"), (3, text)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates.groups(df).collect()} == {1: 1, 2: 2, 3: 1}
    assert {r.doc_id: r.n_removed for r in substrings.in_batches(df).collect()} == {1: 0, 2: 0, 3: 120_000}


def test_long_texts_of_other_operators(spark):
    """The same for decontamination, chat, mixing and token files: what counts lies at the text's end."""
    from tokenizers import Tokenizer

    text = " ".join(prose(i, 4000) for i in range(30)) + " end marker"
    assert len(text) > textkit.SLICE_BYTES
    df = spark.createDataFrame([(1, text, "a"), (2, "short one", "a"), (3, text, "b")], "doc_id long, text string, source string")
    item = " ".join(text.split()[-12:])
    found = decontaminate.find(df, spark.createDataFrame([("q", item), ("none", prose(99, 12))], "item_id string, text string")).collect()
    begin = text.rindex(item)
    assert [(r.n_words, r.n_hit, r.items, [tuple(s) for s in r.spans]) for r in sorted(found, key=lambda r: r.doc_id)] == [
        (120_002, 12, ["q"], [(begin, len(text))]), (2, 0, [], []), (120_002, 12, ["q"], [(begin, len(text))]),
    ]
    turns = spark.createDataFrame([(1, 0, "user", text), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string")
    chatted = chat.read_back(chat.conversations(chat.format_turns(turns, PATH)), PATH).first()
    assert chatted.loss_chars == len(text) and chatted.loss_sha256 == hashlib.sha256(text.encode()).hexdigest()
    mixed = {r.doc_id: r for r in mix.plan(df).collect()}
    assert mixed[1]["size"] == mixed[3]["size"] == 120_002 and mixed[3].taken <= 3 * 120_002
    folder = store.fresh_path(spark, "long-tokens")
    tokens.write(df, folder, PATH)
    rows = sorted(tokens.read(spark, folder, with_ids=False).collect(), key=lambda r: r.doc_id)
    library = Tokenizer.from_file(PATH)
    ids = [[*library.encode(t, add_special_tokens=False).ids, 2] for t in (text, "short one", text)]
    assert [(r.n_tokens, r.ids_crc32) for r in rows] == [(len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for x in ids]
    assert [r.start for r in rows] == [0, len(ids[0]), len(ids[0]) + len(ids[1])]


def test_stages_on_odd_rows(spark, docs, none):
    """Nulls, empty and repeated rows, extra columns with the operators' own names; and an empty table."""
    import corpus_pipeline

    clash = {c: F.lit("mine") for c in ("score", "copies", "n_hit", "items", "component_id", "size", "taken", "rep", "t")}
    for now in (docs.withColumns(clash), none):
        columns = now.columns
        for name, stage in corpus_pipeline.STAGES:
            now = store.save(stage(spark, now, DATA), name.replace(" ", "-"))
            if stage is not corpus_pipeline.write_tokens:
                assert now.columns == columns
        rows = now.orderBy("start").collect()
        assert [r.start for r in rows] == np.cumsum([0, *(r.n_tokens for r in rows)])[:-1].tolist()
