"""Counts that describe a labelled corpus and its terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from labelloom.operators.columns import drop_null_labels

SLICE = 1 << 18  # terms that a task counts at a time
BUCKETS = 16  # groups of terms, for each shuffle partition, whose counts a task adds up at a time


def _is_empty(text: str) -> Column:
    return F.trim(F.coalesce(F.col(text), F.lit(""))) == ""


def _share(count: str) -> Column:
    """Percent of the total, over the few rows that are left per class."""
    return F.round(F.col(count) * 100.0 / F.sum(count).over(Window.partitionBy()), 6)


def class_distribution(df: DataFrame, label: str, first_seen_by: str | None = None) -> DataFrame:
    """Rows and share (percent) per non-null label.

    Sorted by label, or, given a row order, by where each label comes up first.
    """
    labelled = drop_null_labels(df, label)
    counts = [F.count("*").alias("n")]
    if first_seen_by:
        counts.append(F.min(first_seen_by).alias("first_seen"))
    out = labelled.groupBy(label).agg(*counts).withColumn("share_pct", _share("n"))
    return out.orderBy("first_seen") if first_seen_by else out.orderBy(label)


def empty_text_rate(df: DataFrame, text: str = "text_clean") -> DataFrame:
    """How many cleaned texts are empty, of how many, and the fraction."""
    empty = F.count_if(_is_empty(text))
    return df.agg(
        F.count("*").alias("n"),
        empty.alias("n_empty"),
        F.when(F.count("*") > 0, F.round(empty / F.count("*"), 6)).alias("empty_rate"),
    )


def row_counts(df: DataFrame, split: str = "split") -> DataFrame:
    """Rows per part and, as part ``all``, in total: one pass over the frame."""
    return (
        df.rollup(split)
        .agg(F.count("*").alias("n"), F.grouping(split).alias("is_total"))
        .select(F.when(F.col("is_total") == 1, "all").otherwise(F.col(split)).alias(split), "n")
    )


def label_text_profile(df: DataFrame, label: str, text_clean: str, tokens: str) -> DataFrame:
    """Rows, share, empty cleaned texts and mean token count per non-null label."""
    labelled = drop_null_labels(df, label)
    empty = F.count_if(_is_empty(text_clean))
    return (
        labelled.groupBy(label)
        .agg(
            F.count("*").alias("n"),
            empty.alias("n_empty"),
            F.round(empty / F.count("*"), 6).alias("empty_rate"),
            F.round(F.avg(F.size(tokens)), 6).alias("mean_tokens"),
        )
        .withColumn("share_pct", _share("n"))
        .orderBy(label)
    )


def distinct_labels(df: DataFrame, label: str) -> DataFrame:
    """The labels in use, sorted."""
    return drop_null_labels(df.select(label), label).distinct().orderBy(label)


def slice_counts(lists: pa.Array, step: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """``(terms, cf, df)`` of a batch of rows, ``step`` terms at a time: each distinct term once in a slice, nulls not at all.

    A row that a slice cuts counts for the ``df`` of a term in the first slice that has it.
    """
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    flat = lists.flatten()
    for first in range(0, len(flat), step):
        part = flat.slice(first, step)
        row = np.searchsorted(ends, np.arange(first, first + len(part)), "right")
        if part.null_count:
            row, part = row[part.is_valid().to_numpy(zero_copy_only=False)], part.drop_null()
        # A row that the slice before began has counted some of its terms for ``df`` already.
        begun = flat.slice(max(int(ends[row[0] - 1]), 0), first - int(ends[row[0] - 1])) if len(row) and ends[row[0] - 1] < first else None
        coded = part.dictionary_encode()
        codes, n = coded.indices.to_numpy().astype(np.int64), max(len(coded.dictionary), 1)
        once = np.sort(row * n + codes)
        once = once[np.diff(once, prepend=-1) > 0]
        if begun is not None:
            again = pc.index_in(pc.unique(begun).drop_null(), coded.dictionary).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            once = np.setdiff1d(once, row[0] * n + again, assume_unique=True)
        yield coded.dictionary, np.bincount(codes, minlength=n)[: len(coded.dictionary)], np.bincount(once % n, minlength=n)[: len(coded.dictionary)]


def term_stats(df: DataFrame, terms: str, among: DataFrame | None = None) -> DataFrame:
    """Per term: ``cf`` (occurrences) and ``df`` (rows with the term).

    ``among`` is a column of the terms that count, small enough to copy to every
    executor; others go before anything is shuffled.

    Terms are counted inside their Arrow batch, ``SLICE`` at a time: each distinct
    term of a slice once, whatever fills the corpus. What a slice has for one
    bucket of terms goes through the shuffle as one row, and the task that gets a
    bucket adds up its counts, so there is no (row, term) shuffle and no row for
    each term either. A null among the terms counts for ``cf`` alone.
    """
    step, names = SLICE, ["term", "cf", "df"]

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            for found, cf, rows in slice_counts(lists, step):
                yield pa.RecordBatch.from_arrays([found, pa.array(cf, pa.int64()), pa.array(rows, pa.int64())], names=names)
            if nulls := lists.flatten().null_count:
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([nulls], pa.int64()), pa.array([0], pa.int64())], names=names)

    if among is not None:
        found = df.select(terms).mapInArrow(counts, "term string, cf long, df long")
        found = found.join(F.broadcast(among.toDF("term")), "term", "left_semi")
        return found.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))
    buckets = BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in counts(batches):
            bucket = (pd.util.hash_array(part["term"].to_numpy(zero_copy_only=False), categorize=False) % buckets).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            part, bucket = part.take(pa.array(order)), bucket[order]
            starts = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = pa.array([*starts, len(bucket)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), *(pa.ListArray.from_arrays(ends, c) for c in part.columns)], names=["bucket", *names])

    def added(bucket: pa.Table) -> pa.Table:
        flat = pa.table({c: pc.list_flatten(bucket[c]) for c in names})
        summed = flat.group_by("term", use_threads=False).aggregate([("cf", "sum"), ("df", "sum")])
        return pa.table({"term": summed["term"], "cf": summed["cf_sum"], "df": summed["df_sum"]})

    lists = df.select(terms).mapInArrow(dealt, "bucket int, term array<string>, cf array<long>, df array<long>")
    return lists.groupBy("bucket").applyInArrow(added, "term string, cf long, df long")
