"""Token counts through a cache of digests (operator 11).

A text is known by the SHA-256 of its normalised content, a tokenizer by that of its file, its library's version and its
settings. Counts are stored by both digests. Texts are joined to the stored counts by digest; of those without, one
occurrence of each is encoded and its count appended, and then every document finds its count in the cache. Texts move in
one shuffle, and only where many of them are missing.
"""

from __future__ import annotations

import functools
import hashlib
import importlib.metadata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store, tokens
from .textkit import batches

CACHE = "digest binary, n_tokens long, version string"
SLICE_CHARS = 1 << 20  # characters that go to the library at once
ROW_BYTES = 64  # of a missing digest; where all together are below the session's limit of broadcasts, texts aren't shuffled


class Counter:
    """Numbers of tokens by a tokenizer file: sentencepiece for .model, tokenizers for .json; without begin, end or other
    added tokens, special strings inside texts as by the library's default."""

    def __init__(self, path: str):
        self.model = path.endswith(".model")
        if self.model:
            import sentencepiece

            self.pieces = sentencepiece.SentencePieceProcessor(model_file=path)
        else:
            self.encoder = tokens.encoder(path)

    def __call__(self, texts: list[str]) -> list[int]:
        if not self.model:
            return [len(ids) for ids in self.encoder(texts)]
        return [len(ids) for part in _portions(texts) for ids in self.pieces.encode(part, add_bos=False, add_eos=False, num_threads=1)]

    def marks_are_spaces(self) -> bool:
        """Whether the library takes its own mark of a space, U+2581, in a text for a space."""
        told = ("a  b", " a", "a ", "   ", "a b  c d")
        return self.model and all(self.pieces.encode(t) == self.pieces.encode(t.replace(" ", "▁")) for t in told)


def _portions(texts: list[str]) -> Iterator[list[str]]:
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= SLICE_CHARS):
            size += len(texts[end])
            end += 1
        yield texts[at:end]
        at = end


@functools.cache
def counter(path: str) -> Counter:
    return Counter(path)


def version(path: str) -> str:
    """The digest of what decides a text's count: the file, the library's version and how it is asked."""
    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    said = hashlib.sha256(f"{library} {importlib.metadata.version(library)} without added tokens\n".encode())
    with open(path, "rb") as f:
        while block := f.read(1 << 20):
            said.update(block)
    return said.hexdigest()


def normalised(path: str, text: Column | None = None) -> Column:
    """Content that decides the count: null counts as empty, and where the tokenizer takes U+2581 for a space, so it is."""
    text = F.coalesce((F.col("text") if text is None else text).cast("string"), F.lit(""))
    return F.translate(text, "▁", " ") if counter(path).marks_are_spaces() else text


def stored(spark: SparkSession, cache: str, of: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version, a row a digest whoever has appended it."""
    if not store.exists(spark, cache):
        return spark.createDataFrame([], "digest binary, n_tokens long")
    kept = spark.read.schema(CACHE).parquet(cache).filter(F.col("version") == of)
    return kept.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def count(docs: DataFrame, cache: str, path: str) -> DataFrame:
    """doc_id, n_bytes (UTF-8) and n_tokens of every row of docs (doc_id, text); counts that `cache`, a folder in shared
    storage, doesn't hold are added to it.

    Null texts count as empty: no bytes and what the library gives for an empty text. Repeated rows and rows with null or
    shared doc_ids each have their row; an empty table gives none and adds nothing; other columns are ignored, whatever
    their names. Whole texts go to the library, however long. Jobs that append at a time may both add a digest: it is
    then read once.
    """
    spark, of = docs.sparkSession, version(path)
    content = normalised(path)
    digest = F.unhex(F.sha2(content, 256)).alias("digest")
    place = F.xxhash64(F.col("doc_id").cast("string")).alias("place")  # copies of a text lie in as many places as they have ids
    size = F.octet_length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long").alias("n_bytes")
    keyed = store.save(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size, digest, place), "digests")
    first = keyed.groupBy("digest").agg(F.min("place").alias("place"))
    missing = store.save(first.join(stored(spark, cache, of), "digest", "left_anti"), "misses", compact=True)
    n = missing.count()
    if n:
        # Digest and place spread the copies of one text; the sorting of texts that a merge join would need is spared.
        few = n * ROW_BYTES <= spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
        wanted = F.broadcast(missing) if few else missing.hint("shuffle_hash")
        texts = docs.select(digest, place, content.alias("content")).join(wanted, ["digest", "place"])
        counted = texts.select("digest", "content").mapInArrow(_counts(path), "digest binary, n_tokens long")
        counted = counted.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))  # rows repeated in full may have met different tasks
        counted.withColumn("version", F.lit(of)).write.mode("append").partitionBy("version").parquet(cache)
    counts = store.save(first.select("digest").join(stored(spark, cache, of), "digest"), "counts", compact=True)
    return keyed.join(counts, "digest").select("doc_id", "n_bytes", "n_tokens")  # between two tables, so that a hot digest is split


def _counts(path: str):
    def run(it):
        counted = counter(path)
        for b in batches(it):
            digests = b.column(0).to_pylist()
            at = np.sort(np.unique(np.array([d.hex() for d in digests], "U64"), return_index=True)[1])  # rows repeated in full come together
            texts = b.column(1).take(pa.array(at)).to_pylist()
            yield pa.record_batch([pa.array([digests[i] for i in at], pa.binary()), pa.array(counted(texts), pa.int64())], names=["digest", "n_tokens"])

    return run
