"""Near-duplicate documents by MinHash signatures and a multi-index Hamming join (operator 1).

A signature has CHUNKS * WIDTH values of 16 bits. Two signatures that differ in fewer than 2 * CHUNKS values differ, by
the pigeonhole principle, in at most one value of some chunk. So each chunk is indexed under WIDTH keys, each leaving one
value out (the allowed error): documents that share no key differ in 2 * CHUNKS values or more. Documents that share a
key are candidates, and links are confirmed on the full shingle sets.

Documents with equal sets are brought together first and stand for one. Within a key, all are first compared with the
smallest id only; once these links' components are known, what is left are the pairs of one key that lie in different
components, and all of them are compared, in blocks. So no link between components is lost, and a group of many near
copies isn't expanded into all its pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textkit
from .components import components
from .textkit import U64, mix

CHUNKS, WIDTH = 8, 5
SHINGLE, PERCENT = 5, 80
BLOCK = 256
_seeds = mix(np.arange(1, CHUNKS * WIDTH + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def signature(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The 16-bit MinHash values of non-empty sets that lie behind each other in `hashes`."""
    out = np.empty((len(bounds) - 1, len(_seeds)), U64)
    for k, seed in enumerate(_seeds):
        x = hashes ^ seed
        x *= U64(0xFF51AFD7ED558CCD)
        x ^= x >> U64(32)
        x *= U64(0xC4CEB9FE1A85EC53)
        out[:, k] = np.minimum.reduceat(x, bounds[:-1])
    return mix(out) & U64(0xFFFF)


def keys(signatures: np.ndarray) -> np.ndarray:
    """The index keys of each signature: for each chunk and value left out, a hash of the others."""
    n = len(signatures)
    by_chunk = signatures.reshape(n, CHUNKS, WIDTH)
    out = np.empty((n, CHUNKS, WIDTH), U64)
    for gone in range(WIDTH):
        key = np.broadcast_to(np.arange(CHUNKS, dtype=U64) * U64(WIDTH) + U64(gone + 1), (n, CHUNKS)).copy()
        for j in range(WIDTH):
            if j != gone:
                key = mix(key * U64(0x9E3779B97F4A7C15) + by_chunk[:, :, j])
        out[:, :, gone] = key
    return out.reshape(n, -1).view(np.int64)


def _signed(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, n_shingles, h1, h2, keys): two hashes of the whole set, and the index keys (none for an empty set)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def run(it):
        for b in textkit.batches(it):
            sets = list(textkit.shingle_sets(b.column(1), shingle))
            size = np.array([len(s) for s in sets], np.int64)
            whole = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), np.int64).reshape(-1, 2)
            full = np.flatnonzero(size)
            found = [None] * len(sets)
            if len(full):
                every = np.concatenate([sets[i] for i in full])
                for at, k in zip(full.tolist(), keys(signature(every, np.concatenate([[0], size[full].cumsum()]))), strict=True):
                    found[at] = k
            yield pa.record_batch([b.column(0), pa.array(size), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, keys array<long>")


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """(id, hashes) of the documents named in ids: their sorted shingle hashes."""

    def run(it):
        for b in textkit.batches(it):
            sets = [s.tobytes() for s in textkit.shingle_sets(b.column(1), shingle)]
            yield pa.record_batch([b.column(0), pa.array(sets, pa.binary())], names=["id", "hashes"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(ids, "id", "left_semi").select("id", "text").mapInArrow(run, "id long, hashes binary").filter(F.octet_length("hashes") > 0)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets' intersection is at least `percent` of their union."""

    def run(it):
        for b in textkit.batches(it, 512):
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, U64), np.frombuffer(y, U64)
                both = np.concatenate([x, y])
                both.sort(kind="stable")
                common = int((both[1:] == both[:-1]).sum())
                ok.append(100 * common >= percent * (len(both) - common))
            yield pa.record_batch([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x, y = (sets.select(F.col("id").alias(n), F.col("hashes").alias(f"set_{n}")) for n in "ab")
    joined = pairs.join(x, "a").join(y, "b")
    near = F.octet_length("set_a") * 100 >= F.octet_length("set_b") * percent, F.octet_length("set_b") * 100 >= F.octet_length("set_a") * percent
    return joined.filter(near[0] & near[1]).select("a", "b", "set_a", "set_b").mapInArrow(run, "a long, b long")


def _between(buckets: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame | None:
    """Links (a, b) between documents that share a key and lie in different components of `found`; as many as join them.

    Documents that keys connect are a family. Sets are compared in blocks, by products of their incidence matrices, so that
    pairs don't become rows: those of a family, or where that copies fewer sets, as in a chain of templates, those of each
    of its keys.
    """
    placed = buckets.join(found, F.col("rep") == F.col("id"), "left").select("key", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = placed.groupBy("key").agg(F.min("c").alias("x"), F.max("c").alias("y"), F.min("rep").alias("hub")).filter("x != y").select("key", "hub")
    placed = store.save(placed.join(mixed, "key"), "placed", compact=True)
    if placed.isEmpty():
        return None
    family = components(placed.select(F.col("rep").alias("a"), F.col("hub").alias("b")).filter("a != b").distinct())
    own = family.select(F.col("id").alias("rep"), F.col("component").alias("family"))
    member = store.save(placed.select("rep", "c").distinct().join(own, "rep"), "families", compact=True)
    dealt = _dealt(member, placed.select("key", "rep", "c").join(member.select("rep", "family"), "rep"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    paired = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    i, j = F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")
    paired = paired.join(sets, F.col("rep") == F.col("id")).select("by_key", "group", i, j, "own", "rep", "c", "hashes")

    def compare(it):
        a, b = [], []
        for (_, _, i, j), (own, rep, c, hashes) in textkit.runs(it, 4):
            side, c = np.array(own) == j, np.array(c)
            left, right = (np.arange(len(rep)),) * 2 if i == j else (np.flatnonzero(~side), np.flatnonzero(side))
            if len(left) and len(right) and c.min() != c.max():
                size, common = _overlaps([np.frombuffer(h, U64) for h in hashes], left, right)
                near = 100 * common >= percent * (size[left][:, None] + size[right][None] - common)
                x, y = np.nonzero(near & (c[left][:, None] != c[right][None]))
                for o, v in zip((a, b), textkit.forest(np.array(rep), left[x], right[y]), strict=True):
                    o.extend(v.tolist())
        yield pa.record_batch([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    group = ["by_key", "group", "i", "j"]
    more = store.save(paired.repartition(*group).sortWithinPartitions(*group).mapInArrow(compare, "a long, b long"), "links")
    return None if more.isEmpty() else more


def _dealt(member: DataFrame, keyed: DataFrame) -> DataFrame:
    """(by_key, group, blocks, rep, c): of each family in member (rep, c, family) its members, or of each of its keys in
    keyed (key, rep, c, family) those, whichever makes fewer copies of sets."""
    n, blocks = F.count("*"), F.ceil(F.count("*") / F.lit(BLOCK))
    whole = member.groupBy("family").agg(blocks.alias("blocks"), (n * blocks).alias("copies"))
    keys = keyed.groupBy("key").agg(blocks.alias("blocks"), (n * blocks).alias("copies"), F.first("family").alias("family"))
    parts = keys.groupBy("family").agg(F.sum("copies").alias("key_copies"))
    chosen = whole.join(parts, "family").withColumn("by_key", F.col("key_copies") < F.col("copies")).select("family", "blocks", "by_key")
    by_family = member.join(chosen.filter("not by_key"), "family").select("by_key", F.col("family").alias("group"), "blocks", "rep", "c")
    by_key = keyed.join(chosen.filter("by_key").select("family", "by_key"), "family").join(keys.select("key", "blocks"), "key")
    return by_family.unionByName(by_key.select("by_key", F.col("key").alias("group"), "blocks", "rep", "c"))


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of all sets, and of the intersections of those at left with those at right."""
    size = np.array([len(s) for s in sets])
    names, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, shared = np.repeat(np.arange(len(sets)), size), times[column] > 1
    row, column = row[shared], (np.cumsum(times > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(left), len(right)))
    for at in range(0, int((times > 1).sum()), 8192):
        a, b = np.searchsorted(column, (at, at + 8192))
        table = np.zeros((len(sets), 8192), np.float32)
        table[row[a:b], column[a:b] - at] = 1
        common += table[left] @ table[right].T
    return size, np.rint(common).astype(np.int64)


def groups(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links, itself included) of every document.

    Linked are documents whose sets of `shingle`-word shingles (of all words, if fewer) have an intersection of at least
    `percent` of their union. Documents without words are linked with nothing. Rows that share a doc_id are one document
    to the links; a null doc_id is linked with nothing and has a null component. Other columns are ignored; an empty
    table gives no rows.
    """
    begin = len(store.made)
    signed = store.save(_signed(docs, shingle), "signatures")
    by_set = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("keys").alias("keys"))
    by_set = store.save(by_set, "sets", compact=True)
    listed = by_set.select("rep", F.explode("keys").alias("key"))
    shared = listed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("other")).filter("hub != other").select("key", "hub")
    buckets = store.save(listed.join(shared, "key"), "buckets", compact=True)
    first = store.save(buckets.filter("rep != hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "pairs", compact=True)
    ids = buckets.select(F.col("rep").alias("id")).distinct()
    sets = store.save(_sets(docs, ids, shingle), "sets", codec="none")
    links = store.save(_confirmed(first, sets, percent).distinct(), "links", compact=True)
    found = store.save(components(links), "components", compact=True)
    more = _between(buckets, found, sets, percent)
    if more is not None:
        found = store.save(components(links.unionByName(more)), "components", compact=True)
    store.clear(docs.sparkSession, begin, signed, by_set, found)
    many = by_set.filter("n > 1").select("h1", "h2", "rep")
    own = signed.select("doc_id", "n_shingles", "h1", "h2").join(many, ["h1", "h2"], "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id")).alias("rep"))
    return own.join(found, F.col("rep") == F.col("id"), "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep")).alias("component_id"))


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of docs whose document is the smallest of its component (those with a null doc_id stay)."""
    gone = groups(docs, shingle, percent).filter("doc_id != component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__gone"), "left_anti")
