"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

SAMPLE_ROWS = 20_000  # most labelled rows that a classifier is fitted on


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % folds, F.lit(0))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, id_col: str, text_col: str, learn: Column, limit: int = SAMPLE_ROWS
) -> DataFrame:
    """``(id, text, y)`` of at most ``limit`` labelled ids, the first by a hash of the id.

    ``learn`` is a condition on ``id_col``. An id with several labels counts
    with the largest, one with several texts with the least, so the bound holds
    for rows too; null labels and null ids do not count. The side that is
    broadcast has at most ``limit`` rows of two numbers.
    """
    some = labels.where(F.col(target).isNotNull() & F.col(id_col).isNotNull() & learn)
    some = some.groupBy(id_col).agg(F.max(target).cast("int").alias("__y"))
    some = some.orderBy(F.xxhash64(id_col), id_col).limit(limit)
    some = some.select(F.col(id_col).alias("__id"), "__y")
    rows = docs.select(F.col(f"`{id_col}`").alias("__doc"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__text"))
    joined = rows.join(F.broadcast(some), F.col("__doc") == F.col("__id"))
    single = joined.groupBy("__id", "__y").agg(F.min("__text").alias("__text"))
    return single.select(F.col("__id").alias("id"), F.col("__text").alias("text"), F.col("__y").alias("y"))
