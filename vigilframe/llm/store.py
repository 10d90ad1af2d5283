"""Tables in the shared folder: they cut lineage and outlive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..sources.scratch import delete, exists, fresh_path, shared_folder

__all__ = ["clear", "drop", "exists", "fresh_path", "made", "open_sorted", "save", "save_sorted", "shared_folder", "table"]


def save(df: DataFrame, name: str, codec: str = "zstd", compact: bool = False, folder: str | None = None) -> DataFrame:
    """Writes df as Parquet in the shared folder, or for good in a folder given, and returns the reread table (its path is
    in .stored_at).

    compact is for what comes out of a shuffle and is small: it is written by four tasks a core at most, so that many
    shuffle partitions don't become as many tiny files. Scans of texts keep a task, and a file, for each split.
    """
    spark = df.sparkSession
    path = _place(spark, name, folder)
    out = df.coalesce(4 * spark.sparkContext.defaultParallelism) if compact else df
    out.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    if folder is None:
        made.append(path)
    return out


def _place(spark: SparkSession, name: str, folder: str | None) -> str:
    return fresh_path(spark, name) if folder is None else f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _named(path: str) -> str:
    """The catalogue's name of a table written by save_sorted()."""
    return path.rpartition("/")[2].replace("-", "_")


def save_sorted(df: DataFrame, name: str, by: str, buckets: int, folder: str | None = None) -> DataFrame:
    """Writes df, which is partitioned by hash of `by` into as many partitions, in buckets of that column, each one sorted
    file: such tables are joined on it without a shuffle. In a folder given, for good: another session reads it by
    open_sorted()."""
    spark = df.sparkSession
    path = _place(spark, name, folder)
    table = _named(path)
    df.write.bucketBy(buckets, by).sortBy(by).option("compression", "zstd").option("path", path).saveAsTable(table)
    out = spark.table(table)
    out.stored_at, out.stored_as = path, table
    if folder is None:
        made.append(path)
        named[path] = table
    return out


def open_sorted(spark: SparkSession, path: str, ddl: str, by: str, buckets: int) -> DataFrame:
    """A table that save_sorted() wrote, in whatever session: the catalogue learns its columns and buckets anew."""
    table = _named(path)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({ddl}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'")
    out = spark.table(table)
    out.stored_at, out.stored_as = path, table
    return out


#: Paths that save() and save_sorted() wrote in this process, in order, and the names of those that are tables of the catalogue.
made: list[str] = []
named: dict[str, str] = {}


def clear(spark: SparkSession, since: int, *keep: DataFrame) -> None:
    """Deletes what save() wrote since made had `since` paths, but for the tables to keep: for use once those are written."""
    kept = [k.stored_at for k in keep]
    for path in made[since:]:
        if path not in kept:
            if path in named:
                spark.sql(f"DROP TABLE IF EXISTS {named.pop(path)}")
            delete(spark, path)
    made[since:] = [p for p in made[since:] if p in kept]


def drop(df: DataFrame) -> None:
    """Deletes a table written by save() or save_sorted()."""
    if hasattr(df, "stored_as"):
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {df.stored_as}")
        named.pop(df.stored_at, None)
    delete(df.sparkSession, df.stored_at)


BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table. Unless the session sets a size, Arrow batches hold BATCH_ROWS rows: texts are long."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
