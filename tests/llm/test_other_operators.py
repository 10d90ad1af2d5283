"""Vectors, urls, components, registered queries with SQL, and the pipeline."""

import numpy as np
import pytest
from conftest import DATA, matches
from pyspark.sql import functions as F

import corpus_pipeline
from vigilframe.llm import components, embeddings, near_duplicates, queries, store, urls


def test_components(spark):
    rng = np.random.default_rng(3)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    part = {}
    for a, b in links:
        part.setdefault(a, a), part.setdefault(b, b)
    for _ in range(100):
        for a, b in links:
            part[a] = part[b] = min(part[a], part[b])
    got = {r.id: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: v for k, v in part.items() if any(k in e and e[0] != e[1] for e in links)}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(12, 16))
    rows = [(i, (centre[i % 12] + rng.normal(size=16) * 0.05 * (i % 7)).tolist()) for i in range(400)]
    rows += [(400, rows[5][1]), (401, [2 * x for x in rows[5][1]]), (402, None), (403, [0.0] * 16), (404, [float("nan")] + [1.0] * 15), (405, [None] + [1.0] * 15), (406, [1.0] * 5), (407, []), (None, rows[5][1]), (408, [float("inf")] * 16)]
    got = {r.vec_id: r for r in embeddings.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert len(got) == len(rows)
    good = [(i, np.array(v)) for i, v in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    x = np.stack([v for _, v in good])
    near = (x @ x.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(x, axis=1) >= embeddings.COSINE
    np.fill_diagonal(near, False)
    n = {i: int(k) for (i, _), k in zip(good, near.sum(1), strict=True)}
    found = sum(got[i].n_links for i in n)
    assert all(got[i].n_links <= n[i] for i in n) and found >= 0.99 * sum(n.values())
    for i in (402, 403, 404, 405, 406, 407, 408):
        assert (got[i].n_links, got[i].component_id) == (0, i)
    assert got[None].n_links == 0 and got[None].component_id is None
    assert embeddings.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_odd_vectors(spark):
    """Of any size that is finite and not zero; repeated ids; clashing columns; ties."""
    v = np.random.default_rng(3).normal(size=8)
    rows = [(1, (v * 1e-200).tolist()), (2, (v * 1e200).tolist()), (3, v.tolist()), (4, (-v).tolist()), (5, [5e-324] * 8), (6, [1e308] * 8), (3, v.tolist()), (7, [1e-200, float("inf")] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("mine") for c in ("rep", "copies", "n_links", "raw", "length")})
    got = embeddings.links(df).collect()
    assert len(got) == len(rows)
    part = {r.vec_id: r.component_id for r in got}
    assert part == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5, 7: 7}
    assert {r.n_links for r in got if r.vec_id in (1, 2)} == {3} and {r.n_links for r in got if r.vec_id in (4, 7)} == {0}


def test_codes_list_every_filter_above_the_cap():
    codes = embeddings.Codes(10, 16, codes=2)
    x = np.random.default_rng(2).normal(size=(30, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for v, got in zip(x, codes.decode(x), strict=True):
        want = [(t * 16 + i) * 16 + j for t, (p, q) in enumerate(codes.parts) for i in range(16) for j in range(16) if (v @ p)[i] + (v @ q)[j] > codes.height]
        assert sorted(got.tolist()) == want


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "verdict"),
    [
        ("https://A.Example.org/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
        ("http://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"),
        ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
        ("x://notorg/", "notorg", "/", None, "allow"),
        ("http://x.com/fr/", "x.com", "/fr/", "com/fr/", "allow"),
        ("http://x.com/de/1", "x.com", "/de/1", "com/de/", "block"),
        ("http://org", "org", "", None, "allow"),
        ("http://u.org?x/y", "u.org", "", None, "allow"),
        ("no scheme", "", "", None, "allow"),
        (None, "", "", None, "allow"),
    ],
)
def test_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url, None)], "page_id long, url string, html string")
    r = urls.judge(pages, factor=1e9).first()
    assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict)


def test_link_graph(spark):
    """Distrust flows back to hosts that link to blocked ones; trust flows on."""
    link = lambda *hosts: "".join(f'<a HREF="https://{h}/p">x</a>' for h in hosts)
    rows = [(1, "http://bad.com/de/", link("farm.net")), (2, "http://farm.net/", link("bad.com", "bad.com")), (3, "http://good.org/", link("fine.net")), (4, "http://fine.net/", "<a href='/own'>"), (5, "http://lone.net/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: r.verdict for r in urls.judge(pages).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow", 5: "allow"}
    edges = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 0.5), ("b", "c", 0.5)], "src string, dst string, weight double")
    score = {r.host: r.score for r in urls.rank(edges, spark.createDataFrame([("a", 1.0)], "host string, score double"), rounds=100, tolerance=1e-12).collect()}
    p, seed = np.array([[0, 1, 0], [0.5, 0, 0.5], [1, 0, 0]]), np.array([1.0, 0, 0])
    want = seed.copy()
    for _ in range(300):
        want = 0.85 * want @ p + 0.15 * seed
    assert [score[k] for k in "abc"] == pytest.approx(want.tolist(), abs=1e-6)
    assert urls.judge(pages.filter("false")).count() == 0


def test_pages_that_repeat_and_name_columns_alike(spark):
    """Each row is judged for itself; a column with a new one's name doesn't disturb; very long pages give their last link."""
    link = lambda h: f'<a href="https://{h}/p">x</a>'
    rows = [(1, "http://farm.net/", "y" * 3_000_000 + link("bad.com")), (1, "http://farm.net/", "y" * 3_000_000 + link("bad.com")), (None, None, None), (2, "http://bad.com/de/", ""), (3, "http://other.net/", link("fine.net"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted([(1, "farm.net", None, "block")] * 2 + [(2, "bad.com", "com/de/", "block"), (3, "other.net", None, "allow"), (None, "", None, "allow")], key=str)
    clash = {c: F.lit("mine") for c in ("host", "path", "rule", "said", "verdict", "trust", "distrust", "score", "weight", "src", "dst")}
    for df in (pages, pages.withColumns(clash)):
        got = urls.judge(df).select("page_id", "host", "rule", "verdict").collect()
        assert sorted(map(tuple, got), key=str) == want


def test_distrust_of_many_hosts_that_link_to_one(spark):
    """Backwards, a blocked host's weights sum to 1 however many hosts link to it; scores are those of a plain iteration."""
    link = lambda *hosts: "".join(f'<a href="https://{h}/p">x</a>' for h in hosts)
    farms = [f"farm{i}.net" for i in range(10)]
    rows = [(0, "http://bad.com/de/", link(farms[0])), (1, "http://good.org/", link("fine.net", "fine.net", farms[1]))]
    rows += [(2 + i, f"http://{f}/", link("bad.com", *farms[:i:4], *["fine.net"] * (i % 3))) for i, f in enumerate(farms)] + [(20, "http://fine.net/", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = urls.shares(urls.counts(pages), backwards=True)
    hosts = sorted({*farms, "bad.com", "good.org", "fine.net"})
    p = np.zeros((len(hosts), len(hosts)))
    for _, url, html in rows:
        for h in (html or "").split("https://")[1:]:
            p[hosts.index(h.split("/")[0]), hosts.index(url.split("/")[2])] += url.split("/")[2] != h.split("/")[0]

    def plain(p, seed):
        p = np.where(p.sum(1, keepdims=True) > 0, p / np.maximum(p.sum(1, keepdims=True), 1), seed)
        out = seed
        for _ in range(300):
            out = 0.85 * out @ p + 0.15 * seed
        return out

    bad, good = (np.array([float(h == x) for h in hosts]) for x in ("bad.com", "good.org"))
    want, trust = plain(p, bad), plain(p.T, good)
    got = {r.host: r.score for r in urls.rank(edges, spark.createDataFrame([("bad.com", 1.0)], "host string, score double")).collect()}
    assert [got.get(h, 0.0) for h in hosts] == pytest.approx(want.tolist(), abs=1e-5)
    said = {r.host: r.verdict for r in urls.judge(pages).collect()}
    assert said == {h: "block" if h == "bad.com" or h != "good.org" and d > 2 * t else "allow" for h, d, t in zip(hosts, want, trust, strict=True)}
    assert sum(said[f] == "block" for f in farms) >= 8


def test_rounds_reach_every_host_or_fail(spark):
    chain = spark.createDataFrame([(f"h{i:02}", f"h{i + 1:02}", 1.0) for i in range(33)], "src string, dst string, weight double")
    seed = spark.createDataFrame([("h00", 1.0)], "host string, score double")
    got = {r.host: r.score for r in urls.rank(chain, seed).collect()}
    assert [got[f"h{i:02}"] / got["h00"] for i in range(34)] == pytest.approx([0.85**i for i in range(34)], rel=1e-5)
    with pytest.raises(RuntimeError):
        urls.rank(chain, seed, rounds=3)
    with pytest.raises(RuntimeError):
        components.components(spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long"), rounds=1)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, duck, name):
    assert matches(spark, duck, queries.queries()[name], queries.oracle_sql()[name])


def test_held_out_accuracy(spark):
    larger = DATA.replace("0.001", "0.01")  # enough labelled documents to learn from
    docs = store.table(spark, larger, "documents")
    r = queries.op3_language(spark, larger).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out and lang is not null").toPandas()
    assert (r.lang == r.lang_pred).mean() > 0.9
    q = queries.op6_quality(spark, larger).join(store.table(spark, larger, "labels"), "doc_id").filter("held_out").toPandas()
    assert (q.quality == q.predicted).mean() > 0.9


def test_pipeline(spark):
    docs = store.table(spark, DATA, "documents")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        seen.append(store.save(stage(spark, seen[-1], DATA), name.replace(" ", "-")))
    assert all(d.columns == columns for d in seen[:-1])
    assert len(corpus_pipeline.STAGES) == 5
    ids = [[r.doc_id for r in d.select("doc_id").collect()] for d in seen]
    assert set(ids[1]) < set(ids[0]) and set(ids[2]) < set(ids[1]) and set(ids[3]) <= set(ids[2])
    labels = {r.doc_id: r.quality for r in store.table(spark, DATA, "labels").collect()}
    assert all(labels.get(i) != 0 for i in ids[1]) and all(i in set(ids[1]) for i in ids[0] if labels.get(i) == 1)
    assert set(ids[2]) == {r.component_id for r in near_duplicates.groups(seen[1]).collect()}
    assert sorted(ids[5]) == sorted(ids[4])
    assert corpus_pipeline.run(spark, DATA).count() == len(ids[5])
