"""Dropping lines that repeat across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from labelloom.plans.staging import stage

# --- Fixed values: white space stripped from a line's ends, letters lower-cased ---
STRIPPED = " \t\n\u000b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# ------------------------------------------------------------------------------
MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: Column) -> Column:
    """The line stripped at both ends, A-Z lower-cased and nothing else."""
    bare = F.btrim(line, F.lit(STRIPPED))
    ascii_only = F.length(bare) == F.octet_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``docs`` with the repeated lines taken out of ``text_col``, and ``n_lines``, ``n_dropped``.

    A key (see ``line_key``) of at least ``min_chars`` code points that at least
    ``min_docs`` documents hold loses all its lines but those of the largest id.
    Lines stay in order, joined by a line feed.

    Lines become 128-bit hashes in their row. Documents per hash are counted on
    distinct (hash, id) rows, then per hash with partial sums, so a line that
    every document holds is a sum of partial counts and never one task's rows.
    The hashes over the limit are staged: small, they are broadcast by their
    known size; large, they are merge-joined, where AQE splits a hot hash.
    Positions come back per document, and one join puts the texts together.

    Null and empty texts count as one empty line. Rows that repeat an id with
    the same text get the same result and count as one document; rows of one id
    with different texts are each treated by their own lines. A null id is a
    document below every other. A column of the input called ``n_lines`` or
    ``n_dropped`` is replaced; an empty table gives an empty table.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    keys = [F.col(f"`{id_col}`").alias("__id"), F.xxhash64(text).alias("__fp")]
    lines = docs.select(*keys, F.posexplode(F.split(text, "\n")).alias("__pos", "__line"))
    lines = lines.select("__id", "__fp", "__pos", line_key(F.col("__line")).alias("__key"))
    lines = lines.where(F.length("__key") >= min_chars).select(
        "__id", "__fp", "__pos", F.xxhash64("__key").alias("__h1"), F.xxhash64(F.lit(1), "__key").alias("__h2")
    )
    holders = lines.select("__h1", "__h2", "__id").distinct()
    repeated = stage(
        holders.groupBy("__h1", "__h2")
        .agg(F.count(F.lit(1)).alias("__docs"), F.max("__id").alias("__keeper"))
        .where(F.col("__docs") >= min_docs)
        .select("__h1", "__h2", "__keeper")
    )
    dropped = (
        lines.join(repeated, ["__h1", "__h2"])
        .where(~F.col("__id").eqNullSafe(F.col("__keeper")))
        .groupBy("__id", "__fp")
        .agg(F.collect_set("__pos").alias("__drop"))
    )
    others = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    parts = docs.select(*[f"`{c}`" for c in others], *keys, F.split(text, "\n").alias("__lines")).alias("d")
    cut = dropped.select(F.col("__id").alias("__id2"), F.col("__fp").alias("__fp2"), "__drop")
    joined = parts.join(cut, F.col("__id").eqNullSafe(F.col("__id2")) & (F.col("__fp") == F.col("__fp2")), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__drop"))
    kept = F.when(F.col("__drop").isNull(), F.array_join("__lines", "\n")).otherwise(
        F.array_join(F.transform(stay, lambda i: F.element_at(F.col("__lines"), i + 1)), "\n")
    )
    return joined.select(
        *[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in others],
        F.size("__lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("__drop"), F.lit(0)).cast("long").alias("n_dropped"),
    )
