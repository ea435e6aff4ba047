"""Vocabulary, idf and TF-IDF.

Terms are an ``array<string>`` column (see ``functions.ngrams``) of a staged
frame. A vocabulary is a small table, so documents become vectors in place, by
Spark ML transformers and without a shuffle. A vocabulary too large to copy to
every executor is joined instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from labelloom.operators.profile import term_stats
from labelloom.operators.ranking import numbered
from labelloom.operators.vocabulary import frequent_terms, top_terms
from labelloom.plans.staging import MAX_SHARED_BYTES, MAX_SHARED_ROWS, fits_in_memory, stage

# Occurrences from which on a vocabulary is fitted by summaries of fixed size.
SUMMARY_TERMS = 200_000_000
# Documents of one term that one task joins, and the most terms that have more.
ROWS_PER_SALT = 200_000
MAX_HOT_TERMS = 100_000
# Bits of the filter for foreign terms: for each term, at most, and the hashes.
FILTER_BITS_PER_TERM, MAX_FILTER_BITS, FILTER_HASHES = 16, 1 << 28, 4
FILTER_SLICE = 1 << 18  # terms that a worker tests at a time


def idf(df_count: Column | str, n_docs: Column | int) -> Column:
    """Smoothed inverse document frequency ``ln((1 + n) / (1 + df)) + 1``."""
    found = F.col(df_count) if isinstance(df_count, str) else df_count
    total = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return F.log((total + 1.0) / (found + 1.0)) + 1.0


def fit_vocabulary(
    docs: DataFrame, terms: str, max_features: int = 10_000, summary_from: int = SUMMARY_TERMS, capacity: int | None = None
) -> DataFrame:
    """Staged ``(term, idx, cf, df, idf)`` of the most frequent terms.

    Keeps the ``max_features`` terms with the highest ``cf``, ties to the smaller
    term, and numbers them alphabetically. Documents without any term count
    for the idf too. A corpus of ``summary_from`` occurrences or more is
    summarised first (``vocabulary.frequent_terms``, with ``capacity``); the result is the same.
    """
    size = docs.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size(terms).cast("long")), F.lit(0)).alias("terms")).first()
    large = size["terms"] >= summary_from
    stats = frequent_terms(docs, terms, max_features, capacity) if large else term_stats(docs, terms)
    weighed = top_terms(stats, max_features).withColumn("idf", idf("df", size["n"]))
    if max_features <= MAX_SHARED_ROWS:
        place = F.row_number().over(Window.orderBy("term")) - 1
        return stage(weighed.select("term", place.alias("idx"), "cf", "df", "idf"))
    return stage(numbered(weighed, "term").select("term", F.col("idx").cast("int").alias("idx"), "cf", "df", "idf"))


def vectorizer(vocabulary: DataFrame, terms: str, output: str = "features") -> PipelineModel:
    """Spark ML stages that turn a terms column into L2-normalised TF-IDF vectors.

    The vocabulary comes to the driver, as ML models do; its size is checked.
    """
    if not fits_in_memory(vocabulary):
        raise ValueError("vocabulary too large for stages on one machine; vectorize() joins it")
    rows = vocabulary.select("term", "idf").orderBy("idx").toPandas()
    counts = CountVectorizerModel.from_vocabulary(rows["term"].tolist(), terms, f"{output}_counts")
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense(rows["idf"].tolist()), inputCol=f"{output}_counts", outputCol=f"{output}_weighted"
    )
    norm = Normalizer(p=2.0, inputCol=f"{output}_weighted", outputCol=output)
    return PipelineModel([counts, weigh, norm])


def vectorize(
    docs: DataFrame,
    vocabulary: DataFrame,
    terms: str,
    output: str = "features",
    id_col: str | None = None,
    max_rows: int = MAX_SHARED_ROWS,
    max_bytes: int = MAX_SHARED_BYTES,
) -> DataFrame:
    """Adds the TF-IDF vector of each document; the zero vector when it has no term (null included).

    A vocabulary beyond the bounds is joined: by a unique ``id_col``, else by row
    numbers that are written down first.
    """
    if fits_in_memory(vocabulary, max_rows, max_bytes):
        given = docs.withColumn("_terms", F.coalesce(terms, F.array().cast("array<string>")))
        return vectorizer(vocabulary, "_terms", output).transform(given).drop("_terms", f"{output}_counts", f"{output}_weighted")
    return _vectors_joined(docs, vocabulary, terms, output, id_col)


def tfidf(
    docs: DataFrame,
    vocabulary: DataFrame,
    id_col: str,
    terms: str,
    max_rows: int = MAX_SHARED_ROWS,
    max_bytes: int = MAX_SHARED_BYTES,
) -> DataFrame:
    """The long form ``(id, term, idx, tfidf)``; documents without terms give no rows."""
    if fits_in_memory(vocabulary, max_rows, max_bytes):
        vectors = vectorize(docs.select(id_col, terms), vocabulary, terms, "_v", max_rows=max_rows, max_bytes=max_bytes)
        parts = vectors.select(id_col, F.unwrap_udt("_v").alias("_v"))
        pairs = parts.select(
            id_col, F.inline(F.arrays_zip(F.col("_v.indices").alias("idx"), F.col("_v.values").alias("tfidf")))
        )
        names = F.broadcast(vocabulary.select("idx", "term"))
        return pairs.join(names, "idx").select(id_col, "term", "idx", "tfidf")
    return _tfidf_joined(docs, vocabulary, id_col, terms)


def term_filter(vocabulary: DataFrame) -> np.ndarray:
    """A Bloom filter of the terms, as 64-bit words.

    It has ``FILTER_BITS_PER_TERM`` for each term and ``MAX_FILTER_BITS`` at most.
    """
    n = vocabulary.count()
    bits = 1 << min(max(n * FILTER_BITS_PER_TERM, 64).bit_length(), MAX_FILTER_BITS.bit_length() - 1)
    places = F.array(*[_filter_place(F.xxhash64("term"), j, bits) for j in range(FILTER_HASHES)])
    found = vocabulary.select(F.explode(places).alias("at"))
    words = found.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(at & 63 AS INT))")).alias("bits"))
    rows = words.toPandas()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def _filter_place(hashed: Column, j: int, bits: int) -> Column:
    """The ``j``-th place of a 64-bit hash: its halves, one times ``j``."""
    low, high = hashed.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(hashed, 32)
    return (low + high * F.lit(j)).bitwiseAND(F.lit(bits - 1))


def maybe_known(docs: DataFrame, vocabulary: DataFrame, terms: str) -> Column:
    """For each term whether it may be in the vocabulary (column ``term``), from a filter; no terms for a null array.

    Terms are tested ``FILTER_SLICE`` at a time, so a worker's memory is bounded by the batch that Spark sends.
    """
    shared = docs.sparkSession.sparkContext.broadcast(term_filter(vocabulary))
    step = FILTER_SLICE

    def tested(h: np.ndarray, words: np.ndarray) -> np.ndarray:
        low, high, inside = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32), np.ones(len(h), dtype=bool)
        for j in range(FILTER_HASHES):
            at = (low + high * np.uint64(j)) & np.uint64(64 * len(words) - 1)
            inside &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)
        return inside

    @F.arrow_udf("array<boolean>")
    def maybe(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = shared.value
        for lists in batches:
            h = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
            inside = np.empty(len(h), dtype=bool)
            for first in range(0, len(h), step):
                inside[first : first + step] = tested(h[first : first + step], words)
            ends = np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(inside))

    return maybe(F.coalesce(F.transform(terms, lambda t: F.xxhash64(t)), F.array().cast("array<bigint>")))


def _known_terms(docs: DataFrame, vocabulary: DataFrame, terms: str) -> Column:
    """The terms without those that are surely not in the vocabulary."""
    maybe = maybe_known(docs, vocabulary, terms)
    return F.filter(F.arrays_zip(F.col(terms).alias("t"), maybe.alias("m")), lambda e: e["m"])["t"]


def _postings(docs: DataFrame, vocabulary: DataFrame, id_col: str, terms: str) -> DataFrame:
    """``(id, term, idx, weight)`` of every term of the vocabulary in every document: one join on the term.

    Foreign terms go by a filter first. A document's terms are counted inside its
    row, as runs of the sorted terms. A term of more than ``ROWS_PER_SALT``
    documents is joined by as many tasks as its ``df`` asks for; these terms
    are few, as their ``df`` add up, and known to every task.
    """
    known = docs.select(id_col, _known_terms(docs, vocabulary, terms).alias("_k"))
    ordered = known.select(id_col, F.sort_array("_k").alias("_t"), F.size("_k").alias("_n")).filter("_n > 0")
    begins = F.filter(
        F.sequence(F.lit(0), F.col("_n") - 1), lambda i: (i == 0) | (F.get("_t", i) != F.get("_t", i - 1))
    )
    ends = F.concat(F.slice("_at", F.lit(2), F.col("_n")), F.array("_n"))
    runs = F.zip_with("_at", ends, lambda a, b: F.struct(F.get("_t", a).alias("term"), (b - a).alias("tf")))
    counted = ordered.withColumn("_at", begins).select(id_col, F.inline(runs))
    most = vocabulary.agg(F.sum("df").alias("all"), F.max("df").alias("one")).first()
    share = max(ROWS_PER_SALT, -(-(most["all"] or 0) // MAX_HOT_TERMS))
    known = vocabulary.select("term", "idx", "idf", F.ceil(F.col("df") / share).cast("int").alias("_salts"))
    if (most["one"] or 0) > share:
        hot = F.broadcast(known.where("_salts > 1").select("term", "_salts"))
        salt = F.pmod(F.xxhash64(id_col), F.coalesce("_salts", F.lit(1))).cast("int")
        counted = counted.join(hot, "term", "left").withColumn("_salt", salt).drop("_salts")
        known = known.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.greatest("_salts", F.lit(1)) - 1)))
    weighted = counted.join(known.hint("merge"), [c for c in ("term", "_salt") if c in counted.columns])
    return weighted.select(id_col, "term", "idx", (F.col("tf") * F.col("idf")).alias("weight"))


def _tfidf_joined(docs: DataFrame, vocabulary: DataFrame, id_col: str, terms: str) -> DataFrame:
    """Any vocabulary size: a join on the term, then one shuffle by document."""
    weighted = _postings(docs, vocabulary, id_col, terms)
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy(id_col)))
    return weighted.select(id_col, "term", "idx", (F.col("weight") / length).alias("tfidf"))


def _vector_form(entries: Column, size: int, value: str = "value") -> Column:
    """The storage form of a sparse vector, from sorted entries with ``idx`` and ``value``."""
    return F.struct(
        F.lit(0).cast("byte").alias("type"),
        F.lit(size).alias("size"),
        F.transform(entries, lambda e: e["idx"].cast("int")).alias("indices"),
        F.transform(entries, lambda e: e[value]).alias("values"),
    )


def _vectors_joined(docs: DataFrame, vocabulary: DataFrame, terms: str, output: str, id_col: str | None) -> DataFrame:
    """Vectors for any vocabulary size: a join on the term, then one grouping that brings the rows along."""
    if id_col is None:
        docs = stage(docs.withColumn("_row", F.monotonically_increasing_id()))
    else:
        docs = docs.withColumn("_row", F.col(id_col))
    others = [f for f in docs.schema.fields if f.name not in ("_row", output)]
    weighted = _postings(docs, vocabulary, "_row", terms)
    whole = docs.select("_row", F.struct(*[f.name for f in others]).alias("_own"))
    entry = F.struct("idx", "weight").alias("_entry")
    both = whole.select("_row", "_own", F.lit(None).cast(weighted.select(entry).schema[0].dataType).alias("_entry"))
    both = both.union(weighted.select("_row", F.lit(None).cast(whole.schema["_own"].dataType), entry))
    grouped = both.groupBy("_row").agg(F.first("_own", ignorenulls=True).alias("_own"), F.sort_array(F.collect_list("_entry")).alias("_e"))
    length = F.sqrt(F.aggregate("_e", F.lit(0.0), lambda acc, e: acc + e["weight"] * e["weight"]))
    scaled = F.transform("_e", lambda e: F.struct(e["idx"].alias("idx"), (e["weight"] / F.col("_length")).alias("value")))
    stored = grouped.withColumn("_length", length).select("_own.*", _vector_form(scaled, vocabulary.count()).alias(output))
    return stage(stored, T.StructType([*others, T.StructField(output, VectorUDT())]))


def to_vectors(long: DataFrame, id_col: str, size: int, output: str = "features") -> DataFrame:
    """Staged sparse vectors from the long form, one per document that has any term.

    They are written in the storage form of a sparse vector and read back as vectors.
    """
    entries = F.sort_array(F.collect_list(F.struct("idx", "tfidf")))
    stored = long.groupBy(id_col).agg(entries.alias("_e")).select(id_col, _vector_form(F.col("_e"), size, "tfidf").alias(output))
    return stage(stored, T.StructType([stored.schema[id_col], T.StructField(output, VectorUDT())]))
