"""Chat formatting at token level (operator 7).

A turn is `<|im_start|>role<|im_sep|>text<|im_end|>`. Role and text are encoded separately and the three markers are
spliced in as reserved ids above the vocabulary, so no content can produce them. In the text form, content is escaped
reversibly: every `<`, backslashes and `|` in a row get one more backslash, so a marker can't occur there either. The
loss mask is the prefix sum of +1 where an assistant's text begins and -1 where it ends.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import batches
from .tokens import encoder

MARKERS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>")
_control = re.compile(r"<(\\*)\|")
_escaped = re.compile(r"<(\\*)\\\|")


def escape(text: str) -> str:
    return _control.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _escaped.sub(r"<\1|", text)


def assemble(roles: list[str], texts: list[str], path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, loss mask, first id of each turn and the end) of turns in a row."""
    enc = encoder(path, literal=True)
    base = enc.tok.get_vocab_size()
    coded = list(enc([escape(x) for pair in zip(roles, texts, strict=True) for x in pair]))
    parts, sizes = [], []
    for role, text in zip(coded[::2], coded[1::2], strict=True):
        parts += [[base], role, [base + 1], text, [base + 2]]
        sizes.append((len(role), len(text)))
    ids = np.concatenate([*parts, []]).astype("<u4")
    size = np.array(sizes, np.int64).reshape(-1, 2)
    bounds = np.concatenate([[0], (size.sum(1) + 3).cumsum()])
    step = np.zeros(len(ids) + 1, np.int64)
    learnt = np.array([r == "assistant" for r in roles], bool)
    begin = bounds[:-1] + size[:, 0] + 2
    np.add.at(step, begin[learnt], 1)
    np.add.at(step, (begin + size[:, 1])[learnt], -1)
    return ids, step.cumsum()[:-1].astype(np.uint8), bounds


def format_turns(rows: DataFrame, path: str) -> DataFrame:
    """conv_id, turn, ids and mask (little-endian unsigned 32-bit ids, one byte a mask value) of every row.

    A conversation's output is its rows' in order of turn; rows that tie are ordered by role, then text, each by their
    ids. Null role or text counts as empty, null conv_id is a conversation of its own, a null turn comes first. Repeated
    rows are turns of their own; extra columns are ignored; an empty table gives no rows.
    """

    def run(it):
        for b in batches(it, 512):
            roles, texts = ([x or "" for x in b.column(i).to_pylist()] for i in (2, 3))
            ids, mask, bounds = assemble(roles, texts, path)
            cut = list(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True))
            yield pa.record_batch([b.column(0), b.column(1), pa.array([ids[x:y].tobytes() for x, y in cut], pa.binary()), pa.array([mask[x:y].tobytes() for x, y in cut], pa.binary())], names=["conv_id", "turn", "ids", "mask"])

    return rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string")).mapInArrow(run, "conv_id long, turn long, ids binary, mask binary")


class _Reader:
    """Takes a conversation's ids and mask piece by piece; what it keeps doesn't grow with the conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def take(self, ids: np.ndarray, mask: np.ndarray, tok) -> None:
        base = tok.get_vocab_size()
        marks = np.flatnonzero(ids >= base)
        assert (ids[marks] - base == np.tile([0, 1, 2], len(marks) // 3)).all(), "markers out of order"
        for a, s, e in marks.reshape(-1, 3).tolist():
            raw = tok.decode_batch([ids[a + 1 : s].tolist(), ids[s + 1 : e].tolist()], skip_special_tokens=False)
            role, text = map(unescape, raw)
            self.turns += 1
            self.chars += sum(map(len, raw)) + sum(map(len, MARKERS))
            self.all.update(f"{role}\n{text}\n".encode())
        edges = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]]).astype(np.int8)))
        for a, e in edges.reshape(-1, 2).tolist():
            text = unescape(tok.decode(ids[a:e].tolist(), skip_special_tokens=False))
            self.loss_chars += len(text)
            self.loss.update(text.encode())

    def row(self) -> tuple:
        return self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def conversations(turns: DataFrame) -> DataFrame:
    """format_turns() brought together by conversation, in order, for training: rows of one conversation are neighbours
    in one partition, and are streamed, so that one of any length needs little memory."""
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "ids")


def read_back(ordered: DataFrame, path: str) -> DataFrame:
    """What conversations() says, decoded from ids and masks alone: a row per conversation."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def run(it):
        tok, now = encoder(path, literal=True).tok, None
        for b in batches(it, 512):
            done = []
            for conv, ids, mask in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if now is None or now.conv_id != conv:
                    done += [now.row()] if now else []
                    now = _Reader(conv)
                now.take(np.frombuffer(ids, "<u4"), np.frombuffer(mask, np.uint8), tok)
            if done:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names=names)
        if now:
            yield pa.record_batch([pa.array([c], t) for c, t in zip(now.row(), types, strict=True)], names=names)

    return ordered.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
