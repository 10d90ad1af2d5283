"""Vectorised byte-level text primitives on Arrow string arrays: words, hashes, n-grams.

Everything works on UTF-8 bytes in slices of bounded size, so that a batch's memory doesn't depend on how many
long texts it holds (a text longer than a slice makes a slice of its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 1 << 19
U64 = np.uint64
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
NOT_WHITE = ~WHITE
ALNUM_OR_HIGH = np.zeros(256, bool)  # digits, letters, every byte above 0x7F
ALNUM_OR_HIGH[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    _, offs, data = texts.buffers()
    offsets = np.frombuffer(offs, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    return offsets, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of rows with about `most` bytes."""
    offsets, data = buffers(texts)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        end = min(n, max(at + 1, end))
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def words(buf: np.ndarray, offs: np.ndarray, member: np.ndarray = NOT_WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words (maximal runs of `member` bytes within a text), and each text's first word's index."""
    n = len(buf)
    inside = np.zeros(n + 1, bool)
    inside[:n] = member[buf]
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    before = np.zeros(n, bool)
    before[1:] = inside[: n - 1]
    before[offs[:-1][offs[:-1] < n]] = False
    after = inside[1:].copy()
    after[offs[1:][offs[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside[:n] & ~before)
    ends = np.flatnonzero(inside[:n] & ~after) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_counts(texts: pa.Array) -> np.ndarray:
    out = np.zeros(len(texts), np.int64)
    for at, end, buf, offs in slices(texts):
        out[at:end] = np.diff(words(buf, offs)[2])
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


#: Multipliers of independent families of hashes.
FAMILIES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)
LONG_WORD = 64  # bytes; longer words are hashed one by one


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, family: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes: its 8-byte pieces are taken in one after the other, each mixed with all before
    it; words of more than LONG_WORD bytes are hashed by xxh3."""
    step, size = U64(FAMILIES[family]), ends - starts
    out = size.astype(U64) * step
    if not len(out):
        return out
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    pieces = np.ndarray(len(buf) + 1, "<u8", padded.data, strides=(1,))  # the eight bytes from each place
    for at in range(0, min(int(size.max()), LONG_WORD), 8):
        now = np.flatnonzero((size > at) & (size <= LONG_WORD)) if at else np.flatnonzero(size <= LONG_WORD)
        piece = pieces[starts[now] + at] & _low_bytes[np.minimum(size[now] - at, 8)]
        out[now] = mix((out[now] ^ piece) * step + U64(at + 1))
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]].tobytes(), FAMILIES[family])
    return out


_low_bytes = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)


def joined(left: np.ndarray, right: np.ndarray, family: int = 0) -> np.ndarray:
    """Hashes of two sequences behind each other, from those of each."""
    return mix(mix(left * U64(FAMILIES[family])) + (right ^ (right >> U64(31))) * U64(0x2545F4914F6CDD1D))


def gram_hashes(hashes: np.ndarray, k: int, family: int = 0) -> np.ndarray:
    """Hashes of all runs of k words of one sequence (none if it is shorter): runs of doubled length are joined."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out, done, part, span = None, 0, hashes, 1
    while True:
        if k & span:
            out = part[:n] if out is None else joined(out, part[done : done + n], family)
            done += span
        if done == k:
            return mix(out + U64(k))
        part = joined(part[:-span], part[span:], family)
        span *= 2


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct hashes of k-word shingles of its A-Z-lower-cased words; with fewer words, one of the
    whole sequence; without words, none."""
    for at, end, buf, offs in slices(texts):
        low = LOWER[buf]
        starts, ends, first = words(low, offs)
        hashes = word_hashes(low, starts, ends)
        grams = gram_hashes(hashes, k)
        for i in range(end - at):
            a, b = first[i], first[i + 1]
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield gram_hashes(hashes[a:b], int(b - a))
            else:
                yield np.zeros(0, U64)


def batches(it: Iterator[pa.RecordBatch], most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most `most` rows."""
    for b in it:
        for at in range(0, b.num_rows, most):
            yield b.slice(at, most)


def _lists(column: pa.Array) -> list:
    if not pa.types.is_list(column.type):
        return column.to_pylist()
    values, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().to_numpy())
    return np.split(values, ends[:-1]) if len(column) else []


def runs(it: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[list, list[list]]]:
    """(key, columns) of each run of rows with equal first `keys` columns; columns are the others (lists as arrays)."""
    key, part = None, []
    for b in it:
        for row in zip(*map(_lists, b.columns), strict=True):
            if key is None or list(row[:keys]) != key:
                if key is not None:
                    yield key, part
                key, part = list(row[:keys]), [[] for _ in row[keys:]]
            for p, v in zip(part, row[keys:], strict=True):
                p.append(v)
    if key is not None:
        yield key, part


def forest(ids: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (id, smaller id) that join what the links between places left and right of ids join: each place's id with
    the smallest of its component, where that is another."""
    order = np.argsort(ids, kind="stable")
    mark = np.empty_like(order)
    mark[order] = np.arange(len(ids))
    rank = mark.copy()
    while len(left):
        new = mark.copy()
        low = np.minimum(mark[left], mark[right])
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = np.minimum(new, new[order[new]])
        if (new == mark).all():
            break
        mark = new
    joined = np.flatnonzero(mark != rank)
    return ids[joined], ids[order[mark[joined]]]
