"""The most frequent terms of a corpus, without shuffling all its terms.

Most distinct terms of a large corpus (bigrams above all) are rare. A task
therefore keeps a summary of fixed size in place of a count for every term, and
knows by how much its counts may fall short. Terms that may be among the most
frequent ones are then counted exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from labelloom.operators.profile import slice_counts, term_stats
from labelloom.plans.staging import fits_in_memory, stage

# Rows one task may merge to find the top terms, and groups of partitions beyond.
MAX_MERGED_ROWS = 5_000_000
MERGE_GROUPS = 64
SLICE = 1 << 17  # terms that a task counts at a time
CAPACITY = 16  # entries of a task's summary for each term that is asked for


def top_terms(stats: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of highest ``cf``, ties to the smaller term, without a full sort.

    Each partition keeps its own top ``k`` and one task merges them. With so many
    partitions that the merge would be long, they are merged in groups first.
    """
    partitions = int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = [F.desc("cf"), F.col("term")]
    if partitions * k > MAX_MERGED_ROWS:
        group = stats.withColumn("_group", F.spark_partition_id() % MERGE_GROUPS)
        place = F.row_number().over(Window.partitionBy("_group").orderBy(*first))
        stats = group.withColumn("_place", place).filter(F.col("_place") <= k).select(*stats.columns)
    return stats.orderBy(*first).limit(k)


class Summary:
    """Counts of at most ``2 * capacity`` terms; every count falls short by ``lost`` at most.

    When it is full, the count of the ``capacity + 1``-th term is taken off all
    and what is left without a count goes (Misra and Gries). So a term that is
    not held has occurred at most ``lost`` times.
    """

    def __init__(self, capacity: int):
        self.capacity, self.lost = capacity, 0
        self.counts: dict[str, tuple[int, int]] = {}

    def add(self, terms: list[str], cf: list[int], df: list[int]) -> None:
        held = self.counts
        for term, c, d in zip(terms, cf, df):
            was = held.get(term)
            held[term] = (c, d) if was is None else (was[0] + c, was[1] + d)
        if len(held) > 2 * self.capacity:
            found = np.fromiter((c for c, _ in held.values()), dtype=np.int64, count=len(held))
            cut = int(np.partition(found, len(found) - self.capacity - 1)[len(found) - self.capacity - 1])
            self.counts = {t: (c - cut, d) for t, (c, d) in held.items() if c > cut}
            self.lost += cut


def summaries(docs: DataFrame, terms: str, capacity: int) -> DataFrame:
    """Staged ``(term, cf, df)`` summed over the tasks' summaries; the row without a term has what they lost as ``cf``.

    ``cf`` is at least the true count less what was lost in all. Where nothing
    was lost, ``cf`` and ``df`` are the true counts of all terms.
    """
    step = SLICE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary = Summary(capacity)
        for batch in batches:
            for found, cf, rows in slice_counts(batch.column(0), step):
                summary.add(found.to_pylist(), cf.tolist(), rows.tolist())
        names = ["term", "cf", "df"]
        terms_, pairs = list(summary.counts), list(summary.counts.values())
        found = [pa.array([None, *terms_], pa.string()), pa.array([summary.lost, *(c for c, _ in pairs)], pa.int64()), pa.array([0, *(d for _, d in pairs)], pa.int64())]
        yield pa.RecordBatch.from_arrays(found, names=names)

    made = docs.select(terms).mapInArrow(run, "term string, cf long, df long")
    return stage(made.groupBy("term").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df")))


def frequent_terms(docs: DataFrame, terms: str, k: int, capacity: int | None = None) -> DataFrame:
    """``(term, cf, df)`` of the ``k`` terms with the highest ``cf``, ties to the smaller term, and maybe others.

    One pass summarises the corpus. With the k-th largest count as a bar, a term
    whose count and all that was lost stay below it cannot be among the ``k``; if
    the bar is above all that was lost, no term outside the summaries can be
    either. A second pass counts just the terms left, known to every task. Where
    the bar does not separate, or too many terms are left, all terms are counted.
    """
    merged = summaries(docs, terms, capacity or CAPACITY * k)
    lost = merged.where("term IS NULL").agg(F.sum("cf")).first()[0] or 0
    held = merged.where("term IS NOT NULL")
    if not lost:
        return held
    bar = top_terms(held, k).agg(F.count("*").alias("n"), F.min("cf").alias("cf")).first()
    if bar["n"] < k or bar["cf"] <= lost:
        return term_stats(docs, terms)
    left = held.where(F.col("cf") + lost >= bar["cf"]).select("term")
    if not fits_in_memory(left):
        return term_stats(docs, terms)
    return term_stats(docs, terms, stage(left))
