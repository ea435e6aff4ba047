"""Finding, projecting and checking the columns of a labelled corpus."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

from labelloom.functions.text import ENGLISH_STOP_WORDS, clean_text, content_tokens, join_tokens

# --- Fixed values -----------------------------------------------------------
# Column names taken as text and as label, per profile; display names of the
# classes; the three vote columns, in class order; fewest annotators per row.
TEXT_NAMES = {"wide": ("tweet", "text", "message", "comment", "body"), "narrow": ("tweet", "text", "message")}
LABEL_NAMES = {"wide": ("class", "label", "category", "hate_category"), "narrow": ("class", "label", "category")}
CLASS_NAMES = {0: "Hate Speech", 1: "Offensive", 2: "Neutral"}
VOTE_COLUMNS = ("hate_speech", "offensive_language", "neither")
MIN_ANNOTATORS = 3
# ----------------------------------------------------------------------------


def resolve_columns(df: DataFrame, profile: str = "wide") -> tuple[str, str]:
    """``(text column, label column)`` found from the schema alone, without a job.

    A known name wins, in any case, the first in column order. Otherwise the
    text is the first string column and the label the first numeric one; the
    wide profile takes the last column as label when nothing is numeric.
    """
    fields = df.schema.fields

    def pick(names: tuple[str, ...], kind: type, what: str, last_resort: str | None = None) -> str:
        known = [f.name for f in fields if f.name.lower() in names]
        typed = [f.name for f in fields if isinstance(f.dataType, kind)]
        found = known or typed or ([last_resort] if last_resort else [])
        if not found:
            raise ValueError(f"no {what} column among {[f.name for f in fields]}")
        return found[0]

    last = fields[-1].name if fields and profile == "wide" else None
    return (
        pick(TEXT_NAMES[profile], T.StringType, "text"),
        pick(LABEL_NAMES[profile], T.NumericType, "label", last),
    )


def to_text_label(df: DataFrame, profile: str = "narrow", keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns ``text`` and ``label`` (int), rows with a null in either dropped.

    ``keep`` names further columns to carry along, such as the row id.
    """
    text, label = resolve_columns(df, profile)
    pair = df.select(*keep, F.col(f"`{text}`").alias("text"), F.col(f"`{label}`").alias("label"))
    return pair.na.drop(subset=["text", "label"]).withColumn("label", F.col("label").cast("int"))


def drop_null_labels(df: DataFrame, label: str) -> DataFrame:
    """Rows whose label is neither null nor NaN."""
    known = F.col(label).isNotNull()
    if isinstance(df.schema[label].dataType, (T.FloatType, T.DoubleType)):
        known = known & ~F.isnan(label)
    return df.filter(known)


def reuse_or_clean(
    df: DataFrame,
    text: str,
    force: bool = False,
    stop: tuple[str, ...] | list[str] = ENGLISH_STOP_WORDS,
) -> DataFrame:
    """Adds ``text_clean`` unless the frame has it already and not ``force``."""
    if "text_clean" in df.columns and not force:
        return df
    cleaned = clean_text(F.col(text))
    return df.withColumn("text_clean", join_tokens(content_tokens(cleaned, stop)))


def keep_columns(df: DataFrame, wanted: tuple[str, ...] | list[str]) -> DataFrame:
    """Only the wanted columns, in the frame's order; absent ones are ignored."""
    return df.select([c for c in df.columns if c in set(wanted)])


def label_names(labels: DataFrame, label: str = "label", names: dict[int, str] | None = None) -> DataFrame:
    """Adds ``name``: the display name of a label, its own text when unknown."""
    known = CLASS_NAMES if names is None else names
    table = F.create_map(*[F.lit(part) for pair in known.items() for part in pair])
    return labels.withColumn("name", F.coalesce(F.try_element_at(table, F.col(label)), F.col(label).cast("string")))


def vote_majority(df: DataFrame, votes: tuple[str, ...] = VOTE_COLUMNS) -> DataFrame:
    """Adds ``majority`` (class with most votes, null on a tie) and ``tied``."""
    counts = F.array(*[F.coalesce(F.col(v), F.lit(0)) for v in votes])
    top = F.array_max(counts)
    tied = F.size(F.filter(counts, lambda n: n == top)) > 1
    first = (F.array_position(counts, top) - 1).cast("int")
    return df.withColumn("tied", tied).withColumn("majority", F.when(~tied, first))


def vote_check(
    df: DataFrame, label: str = "class", total: str = "count", votes: tuple[str, ...] = VOTE_COLUMNS
) -> DataFrame:
    """Adds one flag per broken rule: wrong class, wrong sum, too few annotators."""
    cast = sum((F.coalesce(F.col(v), F.lit(0)) for v in votes), F.lit(0))
    return (
        vote_majority(df, votes)
        .withColumn("label_differs", F.coalesce(F.col("majority") != F.col(label), F.lit(False)))
        .withColumn("votes_differ", cast != F.col(total))
        .withColumn("few_annotators", F.col(total) < MIN_ANNOTATORS)
    )
