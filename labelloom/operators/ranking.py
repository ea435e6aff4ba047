"""Exact ranks and cut-offs inside classes, without one task per class.

Rows are put in a fixed pseudo-random order by ``md5("seed:id")``. The first
hex digits of that key make order-preserving buckets: counts per bucket give
each bucket's offset, so only a bucket, never a class, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.plans.staging import stage

# Rows that one task may sort, and the least and most hex digits of a bucket: 4096
# to 1,048,576 buckets per class.
ROWS_PER_BUCKET = 1_000_000
BUCKET_DIGITS = (3, 4, 5)
# Bits of the place in a partition in Spark's increasing ids.
RANGE_BITS = 33


def order_key(id_col: str, seed: int) -> Column:
    """The pseudo-random sort key of a row."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")).cast("binary"))


def bucket_digits(df: DataFrame) -> int:
    """Digits enough for buckets of at most ROWS_PER_BUCKET rows, even if all are of one class."""
    rows = df.count()
    return next((d for d in BUCKET_DIGITS if rows <= ROWS_PER_BUCKET * 16**d), BUCKET_DIGITS[-1])


def bucket_of(key: Column | str, digits: int) -> Column:
    return F.substring(F.col(key) if isinstance(key, str) else key, 1, digits)


def bucket_counts(df: DataFrame, id_col: str, label: str, seed: int, digits: int) -> DataFrame:
    """Staged ``(label, bucket, n, before)``: rows per bucket and in earlier buckets.

    At most ``16 ** digits`` rows per class.
    """
    bucket = bucket_of(order_key(id_col, seed), digits).alias("bucket")
    counts = df.groupBy(F.col(label), bucket).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(label).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return stage(counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))))


def ranked(df: DataFrame, buckets: DataFrame, id_col: str, label: str, seed: int, digits: int) -> DataFrame:
    """Adds ``rank`` (0-based, dense over the class) to the rows of ``df``."""
    keyed = df.withColumn("_key", order_key(id_col, seed)).withColumn("_bucket", bucket_of("_key", digits))
    offsets = buckets.select(label, F.col("bucket").alias("_bucket"), "before")
    inside = Window.partitionBy(label, "_bucket").orderBy("_key", id_col)
    return (
        keyed.join(offsets, [label, "_bucket"])
        .withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
        .drop("_key", "_bucket", "before")
    )


def numbered(df: DataFrame, order: str, output: str = "idx") -> DataFrame:
    """``df`` with the place, from 0, of each row by ``order``, which must be unique.

    Rows are dealt into ranges of equal size by sampled quantiles, whatever the
    values look like, sorted there and written with their place in the range. One count for each range
    then says how many rows come before it.
    """
    dealt = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id())
    dealt = stage(dealt).withColumn("_range", F.shiftright("_m", RANGE_BITS))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_size"), F.min("_m").alias("_first"))
    sizes = sizes.select("_range", "_first", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    place = (F.col("_before") + F.col("_m") - F.col("_first")).alias(output)
    return dealt.join(F.broadcast(sizes), "_range").select(*df.columns, place)  # a row for each partition
