"""Replacing the elements of a token array by a dictionary table.

A dictionary proven small is copied to the executors and applied to whole Arrow
batches, so the documents are not shuffled. A larger one is joined, salted
because a common token may make up a third of all tokens; a filter keeps tokens
that are not in it out of the join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from labelloom.functions.text import coarse_pos
from labelloom.operators.features import maybe_known
from labelloom.plans.staging import MAX_SHARED_BYTES, MAX_SHARED_ROWS, fits_in_memory, stage

JOIN_SALTS = 32
# --- Fixed values: endings that a lemma's forms take, and what stands in their place, by part of speech ---
DETACHMENTS = {
    "n": (("s", ""), ("ses", "s"), ("ves", "f"), ("xes", "x"), ("zes", "z"), ("ches", "ch"), ("shes", "sh"), ("men", "man"), ("ies", "y")),
    "v": (("s", ""), ("ies", "y"), ("es", "e"), ("es", ""), ("ed", "e"), ("ed", ""), ("ing", "e"), ("ing", "")),
    "a": (("er", ""), ("est", ""), ("er", "e"), ("est", "e")),
    "r": (),
}
# ----------------------------------------------------------------------------------------------------------


def lookup_array(
    df: DataFrame,
    keys: str,
    dictionary: DataFrame,
    id_col: str | None,
    fallback: str | Column,
    output: str,
    max_rows: int = MAX_SHARED_ROWS,
    max_bytes: int = MAX_SHARED_BYTES,
) -> DataFrame:
    """Adds ``output``: ``dictionary`` (``key``, ``value``) per element.

    A key with several values counts with the least. Elements not found take the
    ``fallback``: a constant Column, or the name of an array column of the same
    length. A null array stays null. Large dictionaries are joined, by a unique
    ``id_col`` where there is one; all ways give the same result. A stream can
    only be joined batch by batch (``streaming.scoring.score_batches``).
    """
    dictionary = dictionary.groupBy("key").agg(F.min("value").alias("value"))
    if not fits_in_memory(dictionary, max_rows, max_bytes):
        return _lookup_joined(df, keys, dictionary, id_col, fallback, output)
    value_type = dictionary.schema["value"].dataType.simpleString()
    table = dictionary.select("key", "value").toArrow().combine_chunks()
    shared = df.sparkSession.sparkContext.broadcast(
        (pa.array(table["key"].to_pylist(), pa.string()), table["value"].combine_chunks())
    )

    @F.arrow_udf(f"array<{value_type}>")
    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, values = shared.value
        index = pd.Index(known.to_numpy(zero_copy_only=False))  # hashed once in a task
        for lists in batches:
            sizes = pc.fill_null(pc.list_value_length(lists), 0)
            ends = pc.cumulative_sum(sizes).cast(pa.int32())
            starts = pa.concat_arrays([pa.array([0], pa.int32()), ends])
            place = index.get_indexer(lists.flatten().cast(pa.string()).to_numpy(zero_copy_only=False))
            yield pa.ListArray.from_arrays(starts, values.take(pa.array(place, mask=np.less(place, 0))))

    hits = df.withColumn("_hits", found(F.col(keys)))
    return hits.withColumn(output, F.when(F.col(keys).isNotNull(), _merged(fallback))).drop("_hits")


def _merged(fallback: str | Column) -> Column:
    """The values found, ``_hits``, and the fallback where there is none."""
    if isinstance(fallback, str):
        return F.zip_with("_hits", fallback, lambda hit, own: F.coalesce(hit, own))
    return F.transform("_hits", lambda hit: F.coalesce(hit, fallback))


def _lookup_joined(
    df: DataFrame, keys: str, dictionary: DataFrame, id_col: str | None, fallback: str | Column, output: str
) -> DataFrame:
    """The same for a dictionary of any size; rows without a unique ``id_col`` are numbered and written down first.

    Only elements that pass a filter of the dictionary's keys are joined. What
    is found comes back to its row with its place, and the rest is there already.
    """
    if id_col is None:
        numbered = stage(df.withColumn("_row", F.monotonically_increasing_id()))
        return _lookup_joined(numbered, keys, dictionary, "_row", fallback, output).drop("_row")
    if not df.groupBy(id_col).count().where(F.col(id_col).isNull() | (F.col("count") > 1)).isEmpty():
        return _lookup_by_group(df, keys, dictionary, id_col, fallback, output)
    dictionary = stage(dictionary.select("key", "value").where("key IS NOT NULL"))
    maybe = maybe_known(df, dictionary.select(F.col("key").alias("term")), keys)
    entries = df.select(id_col, F.posexplode(F.arrays_zip(F.col(keys).alias("key"), maybe.alias("maybe"))).alias("pos", "e"))
    entries = entries.where("e.maybe").select(id_col, "pos", F.col("e.key").alias("key"))
    salted, known = _salted(entries, id_col, dictionary)
    lists = salted.join(known, ["key", "_salt"]).groupBy(id_col).agg(F.collect_list(F.struct("pos", "value")).alias("_list"))
    value_type = dictionary.schema["value"].dataType.simpleString()

    @F.arrow_udf(f"array<{value_type}>")
    def placed(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for places, values, sizes in batches:
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            counts = pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False)
            found = np.full(ends[-1], -1, dtype=np.int64)
            found[np.repeat(ends[:-1], counts) + places.flatten().to_numpy(zero_copy_only=False)] = np.arange(counts.sum())
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values.flatten().take(pa.array(found, mask=found < 0)))

    kept = [c for c in df.columns if c != output]
    sized = df.withColumn("_size", F.when(F.col(keys).isNotNull(), F.size(keys)))
    both = sized.join(lists.hint("merge"), id_col, "left")
    hits = both.withColumn("_hits", placed(F.col("_list.pos"), F.col("_list.value"), F.col("_size")))
    return hits.withColumn(output, F.when(F.col("_size").isNotNull(), _merged(fallback))).select(*kept, output)


def _salted(entries: DataFrame, id_col: str, dictionary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries dealt over salts, and the dictionary with each of them, for a merge join."""
    shares = F.explode(F.sequence(F.lit(0), F.lit(JOIN_SALTS - 1)))
    known = dictionary.select("key", "value").withColumn("_salt", shares).hint("merge")
    return entries.withColumn("_salt", F.pmod(F.xxhash64(id_col, "pos"), F.lit(JOIN_SALTS)).cast("int")), known


def _lookup_by_group(
    df: DataFrame, keys: str, dictionary: DataFrame, id_col: str, fallback: str | Column, output: str
) -> DataFrame:
    """The same where ids repeat or are null: all elements of an id make one list, that its rows share; without id it is empty."""
    own = F.col(fallback) if isinstance(fallback, str) else F.transform(keys, lambda _: fallback)
    entries = df.select(id_col, F.posexplode(F.arrays_zip(F.col(keys).alias("key"), own.alias("own"))).alias("pos", "e"))
    entries = entries.select(id_col, "pos", F.col("e.key").alias("key"), F.col("e.own").alias("own"))
    salted, known = _salted(entries, id_col, dictionary)
    joined = salted.join(known, ["key", "_salt"], "left")
    value = F.coalesce("value", "own").alias("value")
    lists = joined.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("pos", value))).alias("_list"))
    values = F.transform("_list", lambda e: e["value"])
    value_type = dictionary.schema["value"].dataType.simpleString()
    nothing = F.array().cast(f"array<{value_type}>")
    kept = [c for c in df.columns if c != output]
    whole = F.when(F.col(keys).isNotNull(), F.coalesce(values, nothing))
    return df.join(lists.hint("merge"), id_col, "left").withColumn(output, whole).select(*kept, output)


def lemmatize(
    df: DataFrame,
    tokens: str,
    lemmas: DataFrame,
    id_col: str | None,
    tags: str | None = None,
    output: str = "lemmas",
    **bounds: int,
) -> DataFrame:
    """Adds the lemma of each token, from a table ``(surface, pos, lemma)``.

    ``pos`` is one of ``a v n r``. ``tags`` names an array of part-of-speech tags;
    without it every token is looked up as a noun. Unknown tokens stay as they are.
    """
    pos = F.transform(tags, lambda tag: coarse_pos(tag)) if tags else F.transform(tokens, lambda _: F.lit("n"))
    keyed = df.withColumn("_keys", F.zip_with(tokens, pos, lambda word, p: F.concat_ws("\t", word, p)))
    dictionary = lemmas.select(F.concat_ws("\t", "surface", "pos").alias("key"), F.col("lemma").alias("value"))
    return lookup_array(keyed, "_keys", dictionary, id_col, tokens, output, **bounds).drop("_keys")


def word_tags(
    df: DataFrame, tokens: str, tagged: DataFrame, id_col: str | None, output: str = "tags", **bounds: int
) -> DataFrame:
    """Adds the part-of-speech tag of each token, from a table ``(surface, tag)``; ``NN`` for unknown ones."""
    dictionary = tagged.select(F.col("surface").alias("key"), F.col("tag").alias("value"))
    return lookup_array(df, tokens, dictionary, id_col, F.lit("NN"), output, **bounds)


def lemmatize_by_rule(
    df: DataFrame,
    tokens: str,
    known: DataFrame,
    exceptions: DataFrame | None,
    id_col: str | None,
    tags: str | None = None,
    output: str = "lemmas",
    **bounds: int,
) -> DataFrame:
    """Adds the lemma of each token by taking off endings, as far as that gives a lemma that is known.

    ``known`` is a table ``(lemma, pos)``, ``exceptions`` one of irregular forms
    ``(surface, pos, lemma)``, for which no ending is taken off. Candidates are the
    token itself, then what each ending of its part of speech leaves (see
    ``DETACHMENTS``). The shortest known one counts, of equal ones the first; a
    token without any stays. On a stream, all candidates of a row are looked up at once. ``pos`` is
    one of ``a v n r``; ``tags`` as in ``lemmatize``.
    """
    slots = 2 + max(len(rules) for rules in DETACHMENTS.values())

    def candidates(word: Column, pos: Column) -> Column:
        def detached(j: int) -> Column:
            found = F.lit(None).cast("string")
            for name, rules in DETACHMENTS.items():
                if j < len(rules):
                    ending, by = rules[j]
                    stem = F.substring(word, F.lit(1), F.length(word) - len(ending))
                    found = F.when((pos == name) & word.endswith(ending), F.concat(stem, F.lit(by))).otherwise(found)
            return found

        tried = [word, *[detached(j) for j in range(slots - 2)]]
        return F.array(F.concat(F.lit("form\t"), word, F.lit("\t"), pos), *[F.concat(F.lit("lemma\t"), c, F.lit("\t"), pos) for c in tried])

    pos = F.transform(tags, lambda tag: coarse_pos(tag)) if tags else F.transform(tokens, lambda _: F.lit("n"))
    dictionary = known.select(F.concat(F.lit("lemma\t"), "lemma", F.lit("\t"), "pos").alias("key"), F.col("lemma").alias("value"))
    if exceptions is not None:
        dictionary = dictionary.union(exceptions.select(F.concat(F.lit("form\t"), "surface", F.lit("\t"), "pos"), "lemma"))
    if not df.isStreaming:
        return _lemmatize_forms(df, tokens, pos, candidates, dictionary, id_col, output, **bounds)
    keyed = df.withColumn("_keys", F.flatten(F.zip_with(tokens, pos, candidates)))
    found = lookup_array(keyed, "_keys", dictionary, id_col, F.lit(None).cast("string"), "_found", **bounds)

    def chosen(word: Column, i: Column) -> Column:
        own = F.slice("_found", i * slots + 1, F.lit(slots))
        tried = F.when(F.get(own, F.lit(0)).isNotNull(), F.slice(own, 1, 2)).otherwise(own)
        ranked = F.filter(F.transform(tried, lambda value, at: F.struct(F.length(value).alias("size"), at.alias("at"), value.alias("value"))), lambda e: e["value"].isNotNull())
        return F.coalesce(F.array_min(ranked)["value"], word)

    return found.withColumn(output, F.transform(tokens, chosen)).drop("_keys", "_found")


def _lemmatize_forms(
    df: DataFrame,
    tokens: str,
    pos: Column,
    candidates: Callable[[Column, Column], Column],
    dictionary: DataFrame,
    id_col: str | None,
    output: str,
    **bounds: int,
) -> DataFrame:
    """The same for a table: candidates are looked up once for each form in use, by a join, and each token once for its form.

    Only forms that change are in the dictionary of the tokens.
    """
    used = df.select(F.explode(F.arrays_zip(F.col(tokens).alias("word"), pos.alias("pos"))).alias("e")).select("e.word", "e.pos")
    forms = stage(used.where("word IS NOT NULL AND pos IS NOT NULL").distinct())
    tried = forms.select("word", "pos", F.posexplode(candidates(F.col("word"), F.col("pos"))).alias("at", "key")).where("key IS NOT NULL")
    known = dictionary.where("key IS NOT NULL").groupBy("key").agg(F.min("value").alias("value")).where("value IS NOT NULL")
    hits = tried.join(known.hint("merge"), "key").groupBy("word", "pos").agg(
        F.min(F.struct(F.length("value").alias("size"), "at", "value")).alias("any"),
        F.min(F.when(F.col("at") < 2, F.struct(F.length("value").alias("size"), "at", "value"))).alias("irregular"),
        F.min("at").alias("first"),
    )  # place 0 is an irregular form's lemma, 1 the word itself
    lemma = F.when(F.col("first") == 0, F.col("irregular.value")).otherwise(F.col("any.value"))
    changed = hits.select(F.concat("word", F.lit("\t"), "pos").alias("key"), lemma.alias("value"), "word").where("value <> word")
    pairs = F.zip_with(tokens, F.coalesce(pos, F.array().cast("array<string>")), lambda word, p: F.concat(word, F.lit("\t"), p))
    keyed = df.withColumn("_keys", F.slice(pairs, F.lit(1), F.size(tokens)))
    return lookup_array(keyed, "_keys", stage(changed.select("key", "value")), id_col, tokens, output, **bounds).drop("_keys")


def remove_stopwords_table(
    df: DataFrame, tokens: str, stop: DataFrame, id_col: str, output: str = "kept", **bounds: int
) -> DataFrame:
    """Adds the tokens that are not in the one-column table ``stop``."""
    listed = stop.select(F.col(stop.columns[0]).alias("key"), F.lit("").alias("value")).distinct()
    found = lookup_array(df, tokens, listed, id_col, tokens, output, **bounds)
    return found.withColumn(output, F.filter(output, lambda word: word != ""))


def encode_fixed_length(
    df: DataFrame, tokens: str, vocabulary: DataFrame, id_col: str, max_length: int = 128, **bounds: int
) -> DataFrame:
    """Adds ``input_ids`` and ``attention_mask``, both of length ``max_length``.

    Word ids are the vocabulary's ``idx`` + 2; 0 pads and 1 stands for an unknown
    word. A null array counts as an empty one. Longer texts are cut at ``max_length``, which is the operator's purpose.
    """
    words = F.coalesce(F.col(tokens), F.array().cast("array<string>"))
    cut = df.withColumn("_cut", F.slice(words, 1, max_length))
    ids = vocabulary.select(F.col("term").alias("key"), (F.col("idx") + 2).cast("int").alias("value"))
    found = lookup_array(cut, "_cut", ids, id_col, F.lit(1), "_ids", **bounds)
    padding = F.array_repeat(F.lit(0), F.lit(max_length) - F.size("_ids"))
    ones = F.array_repeat(F.lit(1), F.size("_ids"))
    return (
        found.withColumn("input_ids", F.concat("_ids", padding))
        .withColumn("attention_mask", F.concat(ones, padding))
        .drop("_cut", "_ids")
    )
