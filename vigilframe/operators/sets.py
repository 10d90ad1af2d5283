"""Set operations over observations: first and last of their kind, what overlaps nothing, what was asked for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import measures


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in the order they came, numbered in that order within the first key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    one = rows.withColumn("__k", F.row_number().over(w)).filter("__k = 1").drop("__k")
    return one.withColumn("place", F.row_number().over(Window.partitionBy(keys[0]).orderBy(*order)))


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def clear_of(boxes: DataFrame, others: DataFrame, key: str, pad: float = 16, cell: float = 256.0) -> DataFrame:
    """Boxes (key, box, x, y, w, h) that touch none of the others of their key, each padded: an anti-join over the cells
    of a grid that padded boxes cover."""
    a, b = (tuple(F.col(f"{p}_{c}") for c in ("x", "y", "w", "h")) for p in "ab")

    def in_cells(df: DataFrame, p: str) -> DataFrame:
        span = lambda o, n: F.sequence(F.floor((F.col(o) - pad) / cell), F.floor((F.col(o) + F.col(n) + pad) / cell))
        wide = df.withColumn("ci", F.explode(span("x", "w"))).withColumn("cj", F.explode(span("y", "h")))
        return wide.select(F.col(key), "ci", "cj", F.col("box").alias(f"{p}_box"), *(F.col(c).alias(f"{p}_{c}") for c in ("x", "y", "w", "h")))

    hit = in_cells(boxes, "a").join(in_cells(others, "b"), [key, "ci", "cj"]).filter(measures.overlaps(a, b, pad)).select(key, F.col("a_box").alias("box")).distinct()
    return boxes.join(hit, [key, "box"], "left_anti")


def only(rows: DataFrame, named: DataFrame, key: str) -> DataFrame:
    """Rows whose key is among the named."""
    return rows.join(named.select(key).distinct(), key, "left_semi")


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Sets of sequences behind each other; columns that one of them lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def merged(early: Column, late: Column) -> Column:
    """Two maps as one; where both have a key, the later map's value counts."""
    return F.map_concat(F.map_filter(early, lambda k, v: ~F.array_contains(F.map_keys(late), k)), late)


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: counts of the four outcomes, accuracy, precision and recall (0 where they have no base)."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    out = rows.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(t & ~p).alias("fn"), F.count_if(~t & ~p).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn, tn = map(F.col, ("tp", "fp", "fn", "tn"))
    return out.withColumns({"accuracy": ratio(tp + tn, tp + fp + fn + tn), "precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn)})


def once(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """rows with the values as columns, each worked out once a row. As plain columns, expressions are repeated in every
    filter and column that uses them, which is dear for trigonometry on pairs."""
    return rows.select("*", F.inline(F.array(F.struct(*(v.alias(n) for n, v in values.items())))))
