"""From raw documents to token ids: five stages, each written to the shared folder and read again by the next.

All stages but the last return the columns they were given, whatever their names. Null, empty and very long texts, nulls in
any column, ties, repeated rows and empty tables are defined in each stage; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigilframe.llm import decontaminate, mix, near_duplicates, quality, queries, store, tokens


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that trees grown on all labels score at queries.QUALITY or more. Null and empty texts are scored by
    statistics of zero; a score equal to the threshold stays; repeated rows are scored alike; without labels all score 0.5
    and stay."""
    return quality.keep(docs, quality.fit(docs, store.table(spark, sf_dir, "labels")), queries.QUALITY)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of 0.8 or more on five-word shingles connect, the one with the smallest doc_id. Texts
    without words (null, empty) are linked with nothing and stay; so do rows with a null doc_id; rows that share a doc_id
    are one document and stay or go together."""
    return near_duplicates.deduplicate(docs)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without ten consecutive words of a benchmark item (or all words of a shorter one). Null and
    wordless texts have none and stay, null and wordless items match nothing; repeated rows stay or go alike."""
    return decontaminate.decontaminate(docs, store.table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them. Null is a source of its own; texts without words have size 0 and are taken
    as often as their source's documents are at least; rows that share a doc_id share its copies in order of source and
    text; the same table gives the same copies."""
    return mix.mix(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the files of token ids say of each document: doc_id, start, n_tokens and ids_crc32, a row a document. Null and
    empty texts have the end id alone; a null doc_id comes first; repeated doc_ids each have their rows."""
    folder = store.fresh_path(spark, "tokens")
    tokens.write(docs, folder, queries.tokenizer_path())
    return tokens.read(spark, folder, with_ids=False)


STAGES = [
    ("quality classifier", reject_low_quality),
    ("near-duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixing sources", mix_sources),
    ("token output", write_tokens),
]

#: The trained classifier, random rounding and tokenizer can't be expressed in SQL; tests/llm holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own tables, and the last one's documents, go once it is written; the files of token
    ids stay."""
    docs = store.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        begin, last = len(store.made), docs
        docs = store.save(stage(spark, last, sf_dir), name.replace(" ", "-"))
        store.clear(spark, begin, docs)
        if hasattr(last, "stored_at"):
            store.drop(last)
    return docs
