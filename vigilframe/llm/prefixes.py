"""The prefix trie of conversations (operator 13).

Turns become ids of a dictionary. A bucket holds the conversations that share their first turns, so it is a node of the
trie. Large buckets are dealt out by their next turn's id, level by level, as rows (conversation, place, id): no bucket and
no conversation is ever one task's or one row's. A bucket of one conversation is a chain, written down as it is; one of at
most LOCAL_ROWS conversations and turns is finished by one task with multikey quicksort, whose equal parts are nodes. Sums
over subtrees are taken bottom up, in that task or level by level.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import store
from .textkit import batches

LOCAL_ROWS = 2_000
CHUNK_IDS = 50_000  # conversation ids that are joined to one text before they meet those before and after
EMPTY = hashlib.sha256(b"").hexdigest()
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, place from 1, id, n_bytes) of conversations (conv_id, turn, role, text) in order of turn.

    Rows are sorted by range, so that a conversation of any length is dealt out, and numbered within a partition; the few
    that go on from one partition to the next are counted on. A null turn comes first; rows of one turn are ordered by a
    hash of role and text; null role or text is empty; rows without a conv_id belong to none. id stands for role and text.
    """
    spark = rows.sparkSession
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("said")
    keyed = rows.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said, F.octet_length(text).cast("long").alias("n_bytes"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "said"]

    def run(it):
        part, last, k = TaskContext.get().partitionId(), None, 0
        for b in batches(it, 10_000):
            conv = b.column(0).to_numpy()
            if not len(conv):
                continue
            starts = np.concatenate([[0], np.flatnonzero(np.diff(conv)) + 1])
            sizes = np.diff(np.append(starts, len(conv)))
            place = 1 + np.arange(len(conv)) - np.repeat(starts, sizes)
            if conv[0] == last:
                place[: sizes[0]] += k
            last, k = conv[-1], int(place[-1])
            yield pa.record_batch([b.column(0), pa.array(np.full(len(conv), part)), pa.array(place), b.column(2), b.column(3)], names=["conv_id", "part", "place", "said", "n_bytes"])

    ordered = store.save(keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, "conv_id long, part long, place long, said binary, n_bytes long"), "turns")
    edges = ordered.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place")).alias("last")).collect()  # a row a partition
    carried, conv, n = [], None, 0
    for e in sorted(edges):
        before = n if e.first == conv else 0
        if before:
            carried.append((e.part, e.first, before))
        conv, n = e.last.conv_id, e.last.place + (before if e.last.conv_id == e.first else 0)
    if carried:
        more = F.broadcast(spark.createDataFrame(carried, "part long, conv_id long, before long"))
        ordered = ordered.join(more, ["part", "conv_id"], "left").withColumn("place", F.col("place") + F.coalesce("before", F.lit(0)))
    words = store.save(ordered.select("said").distinct().withColumn("id", F.monotonically_increasing_id()), "dictionary", compact=True)
    return store.save(ordered.join(words, "said").select("conv_id", "place", "id", "n_bytes"), "encoded")


def rebuilt(rows: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(conversations (conv_id, n_turns), turns (conv_id, pos, id, n_bytes)): of numbered() rows, each conversation c with its
    first h turns exchanged for those of conversation c - c % every, h being crc32 of c in decimal modulo `most`."""
    c = F.col("conv_id")
    h = F.crc32(c.cast("string").cast("binary")) % most
    heads = rows.filter(F.col("place") < most)
    there = heads.groupBy(c.alias("base")).agg(F.max("place").alias("there"))
    own = rows.groupBy("conv_id").agg(F.max("place").alias("n")).select(c, (c - c % every).alias("base"), h.alias("h"), "n")
    taken = F.least("h", F.coalesce("there", F.lit(0)))
    convs = own.join(there, "base", "left").select(c, "base", "h", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n_turns"))
    convs = store.save(convs, "conversations", compact=True)
    lent = heads.select(F.col("conv_id").alias("base"), "place", "id", "n_bytes")
    begin = convs.filter("taken > 0").select("conv_id", "base", "taken").join(lent, "base").filter("place <= taken").select("conv_id", F.col("place").alias("pos"), "id", "n_bytes")
    rest = rows.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("taken")).alias("pos"), "id", "n_bytes")
    return convs.select("conv_id", "n_turns"), store.save(begin.unionByName(rest), "rebuilt")


def trie(convs: DataFrame, turns: DataFrame, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, n_turns) with turns (conv_id, pos from 1 to n_turns, id, n_bytes):
    conv_id (the smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256. Equal conversations are members of the same nodes, those without turns of the root alone. Without
    conversations there is no node.
    """
    spark = convs.sparkSession
    total = convs.agg(F.count("*").alias("n"), F.min("conv_id").alias("root"), F.sum("n_turns").alias("rest")).first()
    if not total.n:
        return spark.createDataFrame([], _NODES)
    # depth, parent, conv_id, n, n_bytes (of the last text), rest (turns below), large
    large = total.n > 1 and total.n + total.rest > local_rows
    levels = [spark.createDataFrame([(0, None, total.root, total.n, 0, total.rest, large)], "depth int, parent long, conv_id long, n long, n_bytes long, rest long, large boolean")]
    members = convs.select("conv_id", "n_turns", F.lit(total.root).alias("bucket"), F.lit(0).alias("depth"), F.lit(total.n).alias("n"))
    done, going = ([], members) if large else ([members], None)
    ends = []
    while going is not None:
        depth = len(levels) - 1
        ends.append(going.filter(F.col("n_turns") == depth).select(F.col("bucket").alias("node"), F.lit(depth).alias("depth"), "conv_id"))
        dealt = turns.filter(F.col("pos") == depth + 1).select("conv_id", "id", "n_bytes").join(going.select("conv_id", "n_turns", "bucket"), "conv_id")
        count, rest = F.count("*"), F.sum(F.col("n_turns") - (depth + 1))
        group = dealt.groupBy(F.col("bucket").alias("parent"), "id").agg(F.min("conv_id").alias("conv_id"), count.alias("n"), F.first("n_bytes").alias("n_bytes"), rest.alias("rest"))
        group = store.save(group.withColumn("large", (F.col("n") > 1) & (F.col("n") + F.col("rest") > local_rows)), "buckets", compact=True)
        levels.append(group.select(F.lit(depth + 1).alias("depth"), "parent", "conv_id", "n", "n_bytes", "rest", "large"))
        to = group.select("parent", "id", F.col("conv_id").alias("to"), "n", "large")
        moved = dealt.withColumnRenamed("bucket", "parent").join(to, ["parent", "id"])
        moved = store.save(moved.select("conv_id", "n_turns", F.col("to").alias("bucket"), F.lit(depth + 1).alias("depth"), "n", "large"), "members")
        done.append(moved.filter("not large").drop("large"))
        going = moved.filter("large").drop("large") if group.filter("large").limit(1).count() else None
    return _finished(levels, done, ends, turns)


_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_FOUND = f"{_NODES}, top boolean"


def _finished(levels: list[DataFrame], done: list[DataFrame], ends: list[DataFrame], turns: DataFrame) -> DataFrame:
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    # A bucket of one conversation is a chain of its turns.
    single, last = placed.filter("n = 1").select("conv_id", "n_turns", F.col("depth").alias("top")), F.col("pos") == F.col("n_turns")
    own = F.sha2(F.col("conv_id").cast("string"), 256)
    chain = turns.join(single, "conv_id").filter("pos > top")
    chains = chain.select("conv_id", F.col("pos").cast("long").alias("depth"), F.col("conv_id").alias("parent_conv_id"), F.lit(1).cast("long").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"), F.when(last, own).otherwise(EMPTY).alias("ends_sha256"))
    # Others are sorted in one task each; a row of place 0 stands for each conversation.
    several = placed.filter("n > 1").select("bucket", F.col("depth").alias("top"), "conv_id")
    below = turns.join(several, "conv_id").filter("pos > top").select("bucket", "top", "conv_id", F.col("pos").cast("long").alias("pos"), "id", "n_bytes")
    start = several.select("bucket", "top", "conv_id", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("n_bytes"))
    found = store.save(below.unionByName(start).repartition("bucket").sortWithinPartitions("bucket", "conv_id", "pos").mapInArrow(_sorted_buckets, _FOUND), "sorted-buckets", compact=True)
    # Nodes of the levels: buckets finished above, chains' tops, and large ones, whose children are the next level's.
    hashed = _ends(ends)
    tops = found.filter("top").select("conv_id", "n_children", "n_leaves", F.col("saved_tokens").alias("below"), "ends_sha256")
    out, nodes = found.filter("not top").drop("top").unionByName(chains), None
    for depth in reversed(range(len(levels))):
        level = levels[depth].alias("l")
        children = nodes.groupBy(F.col("parent_conv_id").alias("of")).agg(F.count("*").alias("k"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")) if nodes is not None else None
        few = level.filter("not large").join(tops.alias("t"), F.col("l.conv_id") == F.col("t.conv_id"), "left")
        end = F.coalesce("t.ends_sha256", F.when(F.col("l.rest") == 0, F.sha2(F.col("l.conv_id").cast("string"), 256)).otherwise(EMPTY))
        columns = lambda k, leaves, saved, end: [F.col("l.conv_id").alias("conv_id"), F.col("l.depth").cast("long").alias("depth"), F.col("l.parent").alias("parent_conv_id"), F.col("l.n").alias("n_convs"), k.cast("long").alias("n_children"), leaves.cast("long").alias("n_leaves"), ((F.col("l.n") - 1) * F.col("l.n_bytes") + saved).cast("long").alias("saved_tokens"), end.alias("ends_sha256")]
        zero, one = F.lit(0), F.lit(1)
        now = few.select(*columns(F.coalesce("t.n_children", (F.col("l.rest") > 0).cast("int")), F.coalesce("t.n_leaves", one), F.coalesce("t.below", zero), end))
        if hashed is not None:
            more = level.filter("large")
            mine = hashed.filter(F.col("depth") == depth).select(F.col("node"), F.col("ends_sha256").alias("all_ends"))
            more = more.join(mine, F.col("l.conv_id") == F.col("node"), "left")
            if children is not None:
                more = more.join(children, F.col("l.conv_id") == F.col("of"), "left")
            k, leaves, saved = (F.col("k"), F.col("leaves"), F.col("saved")) if children is not None else (F.lit(None), F.lit(None), F.lit(None))
            now = now.unionByName(more.select(*columns(F.coalesce(k, zero), F.coalesce(leaves, one), F.coalesce(saved, zero), F.coalesce("all_ends", F.lit(EMPTY)))))
        nodes = store.save(now, "nodes", compact=True)
        out = out.unionByName(nodes)
    return out.select(*NODE)


def _ends(ends: list[DataFrame]) -> DataFrame | None:
    """(node, depth, ends_sha256) of large buckets in which conversations end. A digest needs its ids one after the other;
    they are sorted and joined to texts by range first, so that a bucket in which very many end is CHUNK_IDS a row."""
    if not ends:
        return None
    every = ends[0]
    for e in ends[1:]:
        every = every.unionByName(e)

    def chunks(it):
        held = None  # (node, depth, ids)
        for b in batches(it, CHUNK_IDS):
            out, node, depth, conv = [], *(b.column(i).to_numpy() for i in range(3))
            cut = np.flatnonzero((np.diff(node) != 0) | (np.diff(depth) != 0)) + 1
            for ids in np.split(np.arange(len(conv)), cut) if len(conv) else []:
                key = (int(node[ids[0]]), int(depth[ids[0]]))
                if held and (held[0] != key or len(held[1]) >= CHUNK_IDS):
                    out.append((*held[0], held[1][0], ",".join(map(str, held[1]))))
                    held = None
                held = (key, (held[1] if held else []) + conv[ids].tolist())
            yield _batch(out, _chunk)
        yield _batch([(*held[0], held[1][0], ",".join(map(str, held[1])))] if held else [], _chunk)

    def digests(it):
        key, said = None, None
        for b in batches(it, 100):
            out = []
            for node, depth, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).to_pylist(), strict=True):
                if key == (node, depth):
                    said.update(b",")
                else:
                    out += [(*key, said.hexdigest())] if key else []
                    key, said = (node, depth), hashlib.sha256()
                said.update(text.encode())
            yield _batch(out, _digest)
        yield _batch([(*key, said.hexdigest())] if key else [], _digest)

    order = ["node", "depth", "conv_id"]
    chunked = every.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "node long, depth int, first long, ids string")
    hashed = chunked.repartition("node", "depth").sortWithinPartitions("node", "depth", "first").mapInArrow(digests, "node long, depth int, ends_sha256 string")
    return store.save(hashed, "ends", compact=True)


_chunk = [("node", pa.int64()), ("depth", pa.int32()), ("first", pa.int64()), ("ids", pa.string())]
_digest = [("node", pa.int64()), ("depth", pa.int32()), ("ends_sha256", pa.string())]
_found = [*((c, pa.int64()) for c in NODE[:-1]), ("ends_sha256", pa.string()), ("top", pa.bool_())]


def _batch(rows: list[tuple], columns: list[tuple]) -> pa.RecordBatch:
    each = zip(*rows, strict=True) if rows else [[]] * len(columns)
    return pa.record_batch([pa.array(c, t) for c, (_, t) in zip(each, columns, strict=True)], names=[n for n, _ in columns])


def _sorted_buckets(it):
    """Nodes of each bucket in rows (bucket, top, conv_id, pos, id, n_bytes) sorted by bucket, conv_id and pos."""
    held: list[pa.RecordBatch] = []
    for b in batches(it, 10_000):
        bucket = b.column(0).to_numpy()
        cut = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for at, end in zip(cut, cut[1:], strict=False):
            if held and at < end and held[-1].column(0)[0] != b.column(0)[at]:
                yield _batch(_nodes(held), _found)
                held = []
            if at < end:
                held.append(b.slice(at, end - at))
    if held:
        yield _batch(_nodes(held), _found)


def _nodes(held: list[pa.RecordBatch]) -> list[tuple]:
    """The nodes of one bucket, its top first, by multikey quicksort."""
    top, conv, pos, ids, size = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(1, 6))
    start = np.flatnonzero(pos == 0)
    conv, length, depth = conv[start], np.diff(np.append(start, len(pos))) - 1, int(top[0])
    nodes, parents = [], []

    def add(members: np.ndarray, k: int, parent: int) -> int:
        ending = conv[members[length[members] == k]].tolist()
        last = int(size[start[members[0]] + k]) if k else 0
        nodes.append([int(conv[members[0]]), depth + k, nodes[parent][0] if parent >= 0 else None, len(members), 0, 0, (len(members) - 1) * last, hashlib.sha256(",".join(map(str, ending)).encode()).hexdigest()])
        parents.append(parent)
        return len(nodes) - 1

    every = np.arange(len(conv))
    waiting = [(every[length > 0], 1, add(every, 0, -1))]
    while waiting:
        members, k, parent = waiting.pop()
        if not len(members):
            continue
        key = ids[start[members] + k]
        pivot = np.partition(key, len(key) // 2)[len(key) // 2]
        same = members[key == pivot]
        waiting += [(members[key < pivot], k, parent), (members[key > pivot], k, parent)]
        waiting.append((same[length[same] > k], k + 1, add(same, k, parent)))
    for i in range(len(nodes) - 1, -1, -1):
        node, parent = nodes[i], parents[i]
        node[5] = node[5] or 1
        if parent >= 0:
            nodes[parent][4] += 1
            nodes[parent][5] += node[5]
            nodes[parent][6] += node[6]
    return [(*n, i == 0) for i, n in enumerate(nodes)]


def nodes(rows: DataFrame, every: int = 5, most: int = 9, local_rows: int = LOCAL_ROWS) -> DataFrame:
    """trie() of conversations (conv_id, turn, role, text) that rebuilt() gives their heads.

    Null turns come first, ties are ordered by a hash of role and text, null role or text is empty, rows without a conv_id
    are left out, repeated rows are turns of their own, an empty table gives no rows, other columns are ignored.
    """
    return trie(*rebuilt(numbered(rows), every, most), local_rows)
