"""One query per operator over the given tables, at their whole size.

The labelled corpus is ``documents`` joined with ``labels``: class 0 when toxic,
1 when of low quality, else 2. The tables hold no predictions, so three simple
rules on the text length stand in for models where a check needs predictions.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

import numpy as np
from pyspark.ml import Model
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from labelloom.functions import (
    argmax,
    clean_text,
    content_tokens,
    join_tokens,
    light_clean,
    min_token_length,
    ngrams,
    null_text_to_empty,
    remove_stopwords,
    round_metrics,
    softmax_nll,
    tokenize,
    vectorizer_tokens,
)
from labelloom.operators import columns, evaluate, features, lookup, models, profile, sampling
from labelloom.plans.staging import stage, staging_path
from labelloom.plans.workflow import (
    evaluate_and_compare,
    prepare_documents,
    prepare_fixed_length,
    train_and_compare,
    write_run_config,
)
from labelloom.sources import tables
from labelloom.sources.models import TextModel, load_model, publish_model, save_model
from labelloom.sources.paths import first_existing, run_path
from labelloom.sources.quoted import read_quoted_csv
from labelloom.streaming.scoring import clean_stream, score_batches, score_stream, write_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

CLASS = "CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 WHEN quality IS NOT NULL THEN 2 END"
STAND_IN = {
    "ByLength": "CASE WHEN n_chars % 5 = 0 THEN 0 WHEN n_chars % 3 = 0 THEN 1 ELSE 2 END",
    "AlwaysTwo": "2",
    "Mostly": "CASE WHEN n_chars % 4 = 0 THEN (class + 1) % 3 ELSE class END",
}


def query(build: Query) -> Query:
    QUERIES[build.__name__.removesuffix("_query")] = build
    return build


def read(spark: SparkSession, sf: str, name: str, key: str, *cols: str) -> DataFrame:
    return tables.read_table(spark, f"{sf}/{name}.parquet", key, cols or None)


def documents(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    return read(spark, sf, "documents", "doc_id", "doc_id", *(cols or ("text",)))


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


def corpus(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """The labelled documents: id, the given columns (text) and class."""
    kept = cols or ("text",)
    joined = documents(spark, sf, *kept).join(labels(spark, sf), "doc_id")
    return joined.select("doc_id", *kept, F.expr(CLASS).alias("class"))


def partly_labelled(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """All documents; class is null where there is no label."""
    joined = documents(spark, sf, *cols).join(labels(spark, sf), "doc_id", "left")
    return joined.select("doc_id", *cols, F.expr(CLASS).alias("class"))


def cleaned(df: DataFrame) -> DataFrame:
    return df.withColumn("t", clean_text("text")).drop("text")


def corpus_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Staged corpus with class, content tokens and uni- and bigram terms."""
    docs = prepare_documents(corpus(spark, sf), "doc_id").withColumnRenamed("label", "class")
    return docs.withColumn("terms", ngrams("tokens"))


def labelled_ids(spark: SparkSession, sf: str) -> DataFrame:
    return corpus(spark, sf, "n_chars").select("doc_id", "class")


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """One row per document and stand-in model."""
    rules = [
        F.struct(F.lit(name).alias("model"), F.lit(i).alias("ordinal"), F.expr(rule).alias("pred"))
        for i, (name, rule) in enumerate(STAND_IN.items())
    ]
    every = corpus(spark, sf, "n_chars").select("doc_id", "class", F.explode(F.array(*rules)).alias("m"))
    return every.select("doc_id", "class", "m.model", "m.ordinal", "m.pred")


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """The components of each embedding stand in for class scores."""
    scores = F.col("embedding").cast("array<double>").alias("z")
    return read(spark, sf, "embeddings", "vec_id", "vec_id", "embedding", "label").select("vec_id", "label", scores)


def arriving_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The documents as a stream of files, whether the table is one file or a folder of them.

    A stream refuses the plain path of one file, but not a pattern that matches it.
    """
    shape = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").schema
    return spark.readStream.schema(shape).parquet(f"{sf}/documents.parque[t]")


# --- sources, projections, filters -----------------------------------------


@query
def label_text_profile(spark: SparkSession, sf: str) -> DataFrame:
    docs = cleaned(corpus(spark, sf)).withColumn("tokens", content_tokens("t"))
    return profile.label_text_profile(docs, "class", "t", "tokens")


@query
def resolve_columns(spark: SparkSession, sf: str) -> DataFrame:
    renamed = corpus(spark, sf, "n_chars", "text").withColumnsRenamed({"text": "Tweet", "class": "Class"})
    frames = {
        "corpus": renamed,
        "conversations": spark.read.parquet(f"{sf}/conversations.parquet"),
        "pages": spark.read.parquet(f"{sf}/pages.parquet"),
    }
    out = []
    for source, df in frames.items():
        for kind in ("wide", "narrow"):
            text, label = columns.resolve_columns(df, kind)
            named = {"source": source, "profile": kind, "text_column": text, "label_column": label}
            out.append(
                df.agg(
                    *[F.lit(v).alias(k) for k, v in named.items()],
                    F.count("*").alias("n"),
                    F.sum(F.length(text)).cast("long").alias("text_chars"),
                    F.sum(label).cast("long").alias("label_sum"),
                )
            )
    total = out[0]
    for part in out[1:]:
        total = total.unionByName(part)
    return total


@query
def to_text_label(spark: SparkSession, sf: str) -> DataFrame:
    return columns.to_text_label(partly_labelled(spark, sf, "text"), keep=("doc_id",))


@query
def drop_null_labels(spark: SparkSession, sf: str) -> DataFrame:
    kept = columns.drop_null_labels(partly_labelled(spark, sf, "source"), "class")
    return kept.groupBy("source").agg(F.count("*").alias("n"))


@query
def null_text_to_empty_query(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select(F.col("conv_id").alias("doc_id"), "turn", "text")
    answered = documents(spark, sf, "n_chars").join(turns, "doc_id", "left")
    return answered.select("doc_id", "turn", null_text_to_empty("text").alias("text"))


@query
def reuse_or_clean(spark: SparkSession, sf: str) -> DataFrame:
    has_it = documents(spark, sf).withColumn("text_clean", F.lower("text"))
    reused = columns.reuse_or_clean(has_it, "text").withColumnRenamed("text_clean", "reused")
    both = columns.reuse_or_clean(reused, "text", force=True)
    return both.select("doc_id", "reused", F.col("text_clean").alias("recomputed"))


@query
def keep_columns(spark: SparkSession, sf: str) -> DataFrame:
    return columns.keep_columns(spark.read.parquet(f"{sf}/documents.parquet"), ("doc_id", "lang", "n_chars", "absent"))


@query
def label_names(spark: SparkSession, sf: str) -> DataFrame:
    used = profile.distinct_labels(spark.read.parquet(f"{sf}/embeddings.parquet"), "label")
    return columns.label_names(used)


@query
def vote_check(spark: SparkSession, sf: str) -> DataFrame:
    votes = documents(spark, sf, "n_chars").join(labels(spark, sf), "doc_id").select(
        "doc_id",
        F.expr("toxic * 3").alias("hate_speech"),
        F.expr("(1 - quality) * 2").alias("offensive_language"),
        F.expr("quality * CAST(n_chars % 4 AS INT)").alias("neither"),
        F.expr(CLASS).alias("class"),
        F.expr("CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END").alias("more"),
    )
    counted = votes.withColumn("count", F.expr("hate_speech + offensive_language + neither + more"))
    flags = columns.vote_check(counted)
    return flags.select("doc_id", "tied", "majority", "label_differs", "votes_differ", "few_annotators")


@query
def csv_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    rows = corpus(spark, sf).select("doc_id", "class", F.col("text").alias("tweet"))
    path = tables.write_table(rows, staging_path(spark), "corpus", "csv")
    back = tables.read_labeled_csv(spark, path, rows.schema)
    text, label = columns.resolve_columns(back)
    return back.select("doc_id", F.col(text).alias("text"), F.col(label).alias("class"))


@query
def csv_quoted_split(spark: SparkSession, sf: str) -> DataFrame:
    """The same from files that line breaks in quotes do not keep whole; every task writes one of its own."""
    rows = corpus(spark, sf).select("doc_id", "text", "class")
    path = tables.write_table(rows, staging_path(spark), "corpus", "csv")
    return read_quoted_csv(spark, path, rows.schema)


@query
def first_existing_query(spark: SparkSession, sf: str) -> DataFrame:
    found = first_existing(spark, f"{sf}/missing.parquet", (f"{sf}/absent.parquet", f"{sf}/documents.parquet"))
    return spark.read.parquet(found).agg(F.count("*").alias("n"))


@query
def head_sample(spark: SparkSession, sf: str) -> DataFrame:
    return tables.head_sample(labelled_ids(spark, sf), 50, "doc_id")


@query
def artifact_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    run = run_path(spark, "run", base=staging_path(spark, "artifacts"))
    counts = profile.class_distribution(labelled_ids(spark, sf), "class").select("class", "n")
    shape = counts.schema
    parts = []
    for fmt in ("csv", "json", "parquet"):
        path = tables.write_table(counts, run, f"class_distribution_{fmt}", fmt)
        back = spark.read.schema(shape).option("header", True).format(fmt).load(path)
        parts.append(back.select(F.lit(fmt).alias("format"), "class", "n"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def read_metrics(spark: SparkSession, sf: str) -> DataFrame:
    metrics = evaluate.weighted_metrics(predictions(spark, sf), "class", "pred", by=("model",))
    path = tables.write_table(tables.metrics_document(metrics), staging_path(spark), "metrics_summary", "text")
    return tables.read_metrics(spark, path).select("model", *round_metrics(*tables.METRICS))


# --- text ------------------------------------------------------------------


@query
def clean_text_query(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", clean_text("text").alias("text_clean"))


@query
def clean_text_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages", "page_id", "page_id", "html", "url")
    return pages.select("page_id", clean_text("html").alias("html_clean"), clean_text("url").alias("url_clean"))


@query
def light_clean_query(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select("doc_id", light_clean("text").alias("text_light"))


@query
def light_clean_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = read(spark, sf, "pages", "page_id", "page_id", "html", "url")
    return pages.select("page_id", light_clean("html").alias("html_light"), light_clean("url").alias("url_light"))


@query
def tokenize_query(spark: SparkSession, sf: str) -> DataFrame:
    words = cleaned(documents(spark, sf)).withColumn("w", tokenize("t"))
    return words.select("doc_id", F.size("w").cast("long").alias("n_tokens"), join_tokens("w").alias("tokens"))


@query
def remove_stopwords_query(spark: SparkSession, sf: str) -> DataFrame:
    words = cleaned(documents(spark, sf)).withColumn("w", tokenize("t"))
    return words.select("doc_id", join_tokens(remove_stopwords("w")).alias("kept"))


@query
def remove_stopwords_table(spark: SparkSession, sf: str) -> DataFrame:
    listed = cleaned(read(spark, sf, "benchmark", "item_id", "item_id", "text")).select(
        F.explode(tokenize("t")).alias("word")
    )
    stop = stage(listed.distinct())
    words = cleaned(documents(spark, sf)).select("doc_id", tokenize("t").alias("w"))
    kept = lookup.remove_stopwords_table(words, "w", stop, "doc_id")
    return kept.select("doc_id", join_tokens("kept").alias("kept"))


@query
def min_token_length_query(spark: SparkSession, sf: str) -> DataFrame:
    words = cleaned(documents(spark, sf)).withColumn("w", tokenize("t"))
    return words.select("doc_id", join_tokens(min_token_length("w", 4)).alias("kept"))


@query
def content_tokens_query(spark: SparkSession, sf: str) -> DataFrame:
    return cleaned(documents(spark, sf)).select("doc_id", join_tokens(content_tokens("t")).alias("text_clean"))


def _lemma_inputs(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Content tokens with made-up tags, and a lemma table from the words in use."""
    words = stage(cleaned(documents(spark, sf)))
    surface = words.select(F.explode(tokenize("t")).alias("surface")).filter(F.length("surface") > 3)
    pos = F.when(F.col("surface").endswith("ing"), "v").when(F.col("surface").endswith("s"), "n")
    cut = F.when(F.col("surface").endswith("ing"), 3).otherwise(1)
    lemma = F.substr("surface", F.lit(1), F.length("surface") - cut).alias("lemma")
    lemmas = stage(surface.select("surface", pos.alias("pos"), lemma).filter("pos IS NOT NULL").distinct())
    kept = words.select("doc_id", content_tokens("t").alias("tokens"))
    tags = F.transform("tokens", lambda w: F.when(w.endswith("ing"), "VBG").otherwise("NN"))
    return kept.withColumn("tags", tags), lemmas


@query
def lemmatize(spark: SparkSession, sf: str) -> DataFrame:
    kept, lemmas = _lemma_inputs(spark, sf)
    return lookup.lemmatize(kept, "tokens", lemmas, "doc_id", "tags").select("doc_id", join_tokens("lemmas").alias("lemmas"))


@query
def lemmatize_nouns(spark: SparkSession, sf: str) -> DataFrame:
    """No tags, and the join that dictionaries beyond the size check take."""
    kept, lemmas = _lemma_inputs(spark, sf)
    found = lookup.lemmatize(kept, "tokens", lemmas, "doc_id", max_rows=0)
    return found.select("doc_id", join_tokens("lemmas").alias("lemmas"))


@query
def lemmatize_by_rule(spark: SparkSession, sf: str) -> DataFrame:
    """Endings taken off where that leaves a word of the corpus; words in -ses are listed as irregular."""
    kept, _ = _lemma_inputs(spark, sf)
    seen = stage(kept.select(F.explode("tokens").alias("lemma")).distinct())
    known = seen.where("length(lemma) > 2").select("lemma", F.explode(F.array(F.lit("n"), F.lit("v"))).alias("pos"))
    irregular = seen.where("lemma LIKE '%ses'").select(F.col("lemma").alias("surface"), F.lit("n").alias("pos"), F.expr("left(lemma, 3)").alias("lemma"))
    found = lookup.lemmatize_by_rule(kept, "tokens", known, irregular, "doc_id", "tags")
    return found.select("doc_id", join_tokens("lemmas").alias("lemmas"))


@query
def prepare_documents_tagged(spark: SparkSession, sf: str) -> DataFrame:
    """The full cleaning job with lemmas looked up by the tags of a word table."""
    kept, lemmas = _lemma_inputs(spark, sf)
    verbs = stage(kept.select(F.explode("tokens").alias("surface")).distinct()).where("surface LIKE '%ing'")
    docs = prepare_documents(documents(spark, sf).withColumn("class", F.lit(1)), "doc_id", lemmas=lemmas, tags=verbs.withColumn("tag", F.lit("VBG")))
    return docs.select("doc_id", F.col("text_clean").alias("lemmas"))


@query
def ngrams_query(spark: SparkSession, sf: str) -> DataFrame:
    words = cleaned(documents(spark, sf)).withColumn("w", content_tokens("t")).withColumn("g", ngrams("w"))
    return words.select("doc_id", F.size("g").cast("long").alias("n_terms"), F.array_join("g", "|").alias("terms"))


def _ids_as_text(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("doc_id", *cols, *[F.array_join(c, " ").alias(c) for c in ("input_ids", "attention_mask")])


@query
def encode_fixed_length(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus_terms(spark, sf)
    vocabulary = features.fit_vocabulary(docs, "tokens")
    return _ids_as_text(lookup.encode_fixed_length(docs.select("doc_id", "tokens"), "tokens", vocabulary, "doc_id"))


@query
def clean_stream_query(spark: SparkSession, sf: str) -> DataFrame:
    arriving = arriving_documents(spark, sf)
    target, checkpoint = staging_path(spark, "stream"), staging_path(spark, "progress")
    write_stream(clean_stream(arriving, "text").drop("text"), target, checkpoint, once=True).awaitTermination()
    return spark.read.parquet(target)


# --- aggregations and evaluation -------------------------------------------


@query
def class_distribution(spark: SparkSession, sf: str) -> DataFrame:
    return profile.class_distribution(partly_labelled(spark, sf, "n_chars"), "class")


@query
def class_distribution_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return profile.class_distribution(spark.read.parquet(f"{sf}/conversations.parquet"), "role", first_seen_by="conv_id")


@query
def empty_text_rate(spark: SparkSession, sf: str) -> DataFrame:
    turns = cleaned(read(spark, sf, "conversations", "conv_id", "conv_id", "turn", "text"))
    return profile.empty_text_rate(turns.withColumn("text_clean", join_tokens(content_tokens("t"))))


@query
def row_counts(spark: SparkSession, sf: str) -> DataFrame:
    return profile.row_counts(sampling.stratified_split(stage(labelled_ids(spark, sf)), "doc_id", "class"))


@query
def term_stats(spark: SparkSession, sf: str) -> DataFrame:
    words = cleaned(documents(spark, sf)).select(content_tokens("t").alias("w"))
    return profile.term_stats(words.select(ngrams("w").alias("terms")), "terms")


@query
def confusion_matrix(spark: SparkSession, sf: str) -> DataFrame:
    own = predictions(spark, sf).filter("model = 'AlwaysTwo'")
    return evaluate.confusion_matrix(own, "class", "pred")


@query
def confusion_wide(spark: SparkSession, sf: str) -> DataFrame:
    own = predictions(spark, sf).filter("model = 'ByLength'")
    return evaluate.confusion_wide(evaluate.confusion_matrix(own, "class", "pred"))


@query
def per_class_report(spark: SparkSession, sf: str) -> DataFrame:
    report = evaluate.per_class_report(predictions(spark, sf), "class", "pred", by=("model",))
    return report.select("model", "ordinal", "name", *round_metrics("precision", "recall", "f1"), "support")


@query
def report_text(spark: SparkSession, sf: str) -> DataFrame:
    own = predictions(spark, sf).filter("model = 'Mostly'")
    return evaluate.report_text(evaluate.per_class_report(own, "class", "pred"))


@query
def weighted_metrics(spark: SparkSession, sf: str) -> DataFrame:
    metrics = evaluate.weighted_metrics(predictions(spark, sf), "class", "pred", by=("model",))
    return metrics.select("model", *round_metrics(*tables.METRICS))


@query
def distinct_labels(spark: SparkSession, sf: str) -> DataFrame:
    return profile.distinct_labels(spark.read.parquet(f"{sf}/conversations.parquet"), "role")


@query
def argmax_query(spark: SparkSession, sf: str) -> DataFrame:
    return logits(spark, sf).select("vec_id", argmax("z").alias("pred"))


@query
def softmax_nll_query(spark: SparkSession, sf: str) -> DataFrame:
    return logits(spark, sf).select("vec_id", F.round(softmax_nll("z", "label"), 6).alias("nll"))


@query
def weighted_cross_entropy(spark: SparkSession, sf: str) -> DataFrame:
    rows = logits(spark, sf)
    weights = sampling.inverse_frequency_weights(rows, "label")
    plain = evaluate.weighted_cross_entropy(rows, "z", "label").withColumn("kind", F.lit("plain"))
    weighted = evaluate.weighted_cross_entropy(rows, "z", "label", weights).withColumn("kind", F.lit("weighted"))
    return plain.unionByName(weighted).select("kind", F.round("loss", 6).alias("loss"))


@query
def logit_metrics(spark: SparkSession, sf: str) -> DataFrame:
    scored = logits(spark, sf).withColumn("pred", argmax("z"))
    return evaluate.weighted_metrics(scored, "label", "pred").select(*round_metrics(*tables.METRICS))


@query
def compare_models(spark: SparkSession, sf: str) -> DataFrame:
    """The first two stand-ins as baselines, the third one appended."""
    metrics = stage(evaluate.weighted_metrics(predictions(spark, sf), "class", "pred", by=("model", "ordinal")))
    table = evaluate.compare_models(metrics.filter("model <> 'Mostly'"), metrics.filter("model = 'Mostly'"))
    return table.orderBy("ordinal").drop("ordinal")


@query
def select_best(spark: SparkSession, sf: str) -> DataFrame:
    metrics = evaluate.weighted_metrics(predictions(spark, sf), "class", "pred", by=("model", "ordinal"))
    return evaluate.select_best(metrics).select("model", F.round("f1", 6).alias("f1"))


# --- features, sampling ----------------------------------------------------


@query
def vectorizer_tokens_query(spark: SparkSession, sf: str) -> DataFrame:
    words = documents(spark, sf).select("doc_id", vectorizer_tokens("text").alias("w"))
    return words.select("doc_id", F.size("w").cast("long").alias("n_tokens"), join_tokens("w").alias("tokens"))


@query
def reused_text_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Word counts of texts that come cleaned already, whatever their case, spaces and signs."""
    given = corpus(spark, sf).withColumn("text_clean", F.concat(F.lit("Two  SPACES a u, "), "text"))
    docs = prepare_documents(given, "doc_id")
    return profile.term_stats(docs, "tokens").select("term", "cf", "df")


@query
def fit_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return features.fit_vocabulary(corpus_terms(spark, sf), "terms").select("term", "idx", "cf", "df")


@query
def vocabulary_summary(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 most frequent terms by summaries of 1,000 terms a task and a recount."""
    found = features.fit_vocabulary(corpus_terms(spark, sf), "terms", 50, summary_from=0, capacity=1_000)
    return found.select("term", "idx", "cf", "df")


@query
def fit_idf(spark: SparkSession, sf: str) -> DataFrame:
    return features.fit_vocabulary(corpus_terms(spark, sf), "terms").select("term", F.round("idf", 6).alias("idf"))


def _rounded(long: DataFrame) -> DataFrame:
    return long.select("doc_id", "term", "idx", F.round("tfidf", 6).alias("tfidf"))


@query
def tfidf(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus_terms(spark, sf)
    return _rounded(features.tfidf(docs, features.fit_vocabulary(docs, "terms"), "doc_id", "terms"))


@query
def tfidf_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the join that vocabularies beyond the size check take."""
    docs = corpus_terms(spark, sf)
    return _rounded(features.tfidf(docs, features.fit_vocabulary(docs, "terms"), "doc_id", "terms", max_rows=0))


@query
def tfidf_train_fit(spark: SparkSession, sf: str) -> DataFrame:
    docs = sampling.stratified_split(corpus_terms(spark, sf), "doc_id", "class")
    vocabulary = features.fit_vocabulary(docs.filter("split = 'train'"), "terms")
    return _rounded(features.tfidf(docs, vocabulary, "doc_id", "terms"))


def _terms_and_norm(vectors: DataFrame) -> DataFrame:
    unpacked = vectors.select("doc_id", F.unwrap_udt("features").alias("v"))
    squares = F.aggregate("v.values", F.lit(0.0), lambda acc, x: acc + x * x)
    return unpacked.select(
        "doc_id", F.size("v.indices").cast("long").alias("n_terms"), F.round(F.sqrt(squares), 6).alias("norm")
    )


@query
def vectorize(spark: SparkSession, sf: str) -> DataFrame:
    docs = corpus_terms(spark, sf)
    return _terms_and_norm(features.vectorize(docs, features.fit_vocabulary(docs, "terms"), "terms"))


@query
def vectorize_joined(spark: SparkSession, sf: str) -> DataFrame:
    """The same by joins with the vocabulary, rows being numbered on the way."""
    docs = corpus_terms(spark, sf)
    return _terms_and_norm(features.vectorize(docs, features.fit_vocabulary(docs, "terms"), "terms", max_rows=0))


@query
def to_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors put together from the long form."""
    docs = corpus_terms(spark, sf)
    vocabulary = features.fit_vocabulary(docs, "terms")
    long = features.tfidf(docs, vocabulary, "doc_id", "terms")
    return _terms_and_norm(features.to_vectors(long, "doc_id", vocabulary.count()))


@query
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return sampling.stratified_split(stage(labelled_ids(spark, sf)), "doc_id", "class")


def _train(spark: SparkSession, sf: str) -> DataFrame:
    return stage(stratified_split(spark, sf)).filter("split = 'train'").drop("split")


@query
def balanced_weights(spark: SparkSession, sf: str) -> DataFrame:
    weights = sampling.balanced_weights(_train(spark, sf), "class")
    return weights.select("class", "n", F.round("weight", 6).alias("weight"))


@query
def inverse_frequency_weights(spark: SparkSession, sf: str) -> DataFrame:
    weights = sampling.inverse_frequency_weights(_train(spark, sf), "class")
    return weights.select("class", "n", F.round("weight", 6).alias("weight"))


@query
def random_oversample(spark: SparkSession, sf: str) -> DataFrame:
    more = sampling.random_oversample(_train(spark, sf), "doc_id", "class")
    return more.groupBy("doc_id", "class").agg(F.count("*").alias("copies"))


@query
def dense_label_index(spark: SparkSession, sf: str) -> DataFrame:
    indexed, _ = sampling.dense_label_index(documents(spark, sf, "source"), "source")
    return indexed


@query
def fixed_length_job(spark: SparkSession, sf: str) -> DataFrame:
    return _ids_as_text(prepare_fixed_length(corpus(spark, sf), "doc_id").data, "split", "label")


@query
def fixed_length_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows per part and per class of the fixed-length job."""
    made = prepare_fixed_length(corpus(spark, sf), "doc_id")
    parts = made.counts.select(F.lit("split").alias("kind"), F.col("split").alias("name"), "n")
    return parts.unionByName(made.distribution.select(F.lit("label").alias("kind"), F.col("label").cast("string").alias("name"), "n"))


# --- runs ------------------------------------------------------------------


@query
def run_path_query(spark: SparkSession, sf: str) -> DataFrame:
    """The names that runs get when the first one has written the class counts."""
    base, now = staging_path(spark, "artifacts"), datetime(2024, 1, 2, 3, 4, 5, tzinfo=timezone.utc)
    given = run_path(spark, "run", base=base)
    counts = profile.class_distribution(labelled_ids(spark, sf), "class").select("class", "n")
    back = spark.read.schema(counts.schema).parquet(tables.write_table(counts, given, "class_distribution"))
    names = {
        "free": given,
        "taken": run_path(spark, "run", base=base, now=now),
        "forced": run_path(spark, "run", base=base, force=True, now=now),
        "shared": run_path(spark, "run", base=base, reuse=True, now=now),
        "unnamed": run_path(spark, base=base, now=now),
    }
    shown = [F.struct(F.lit(k).alias("kind"), F.lit(v.removeprefix(f"{base}/")).alias("name")) for k, v in names.items()]
    return back.select("class", "n", F.inline(F.array(*shown)))


@query
def run_config(spark: SparkSession, sf: str) -> DataFrame:
    run = run_path(spark, "run", base=staging_path(spark, "artifacts"))
    write_run_config(labelled_ids(spark, sf), run, {"max_length": 128, "seed": 42}, "class")
    return spark.read.schema("max_length string, seed string, num_labels long").json(f"{run}/run_config")


@query
def evaluate_and_compare_query(spark: SparkSession, sf: str) -> DataFrame:
    """The third stand-in against a metrics file of the first two; the table as it is saved."""
    found = stage(predictions(spark, sf))
    run = run_path(spark, "run", base=staging_path(spark, "artifacts"))
    first = evaluate.weighted_metrics(found.filter("model <> 'Mostly'"), "class", "pred", by=("model", "ordinal"))
    baseline = tables.write_table(tables.metrics_document(first), run, "metrics_summary", "text")
    own = found.filter("model = 'Mostly'").select(F.col("class").alias("label"), "pred")
    names = columns.label_names(profile.distinct_labels(own, "label"))
    evaluate_and_compare(own, names, run, baseline, "Mostly")
    shape = ", ".join(["model string", *[f"{m} double" for m in tables.METRICS]])
    return spark.read.schema(shape).option("header", True).csv(f"{run}/comparison_table")


# --- models ----------------------------------------------------------------


@query
def score_with(spark: SparkSession, sf: str) -> DataFrame:
    """One-hot scores from the text length stand in for a user's own model."""

    def length_rule():
        def predict(batch):
            n = batch["n_chars"].to_numpy()
            return np.eye(3)[np.where(n % 5 == 0, 0, np.where(n % 3 == 0, 1, 2))]

        return predict

    scored = models.score_with(corpus(spark, sf, "n_chars"), length_rule, ["n_chars"])
    return scored.select("doc_id", "pred")


def _training_data(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Staged vectors with split and label index, the vocabulary, and the label table."""
    docs = sampling.stratified_split(corpus_terms(spark, sf), "doc_id", "class")
    vocabulary = features.fit_vocabulary(docs, "terms")
    indexed, classes = sampling.dense_label_index(docs, "class")
    vectors = features.vectorize(indexed, vocabulary, "terms")
    return stage(vectors.select("doc_id", "class", "label_idx", "split", "features")), vocabulary, classes


def _class_shares(rows: DataFrame, model: Model) -> DataFrame:
    """Rows and share of the predicted probability per class.

    With a free intercept, the optimum gives every class its share of the weight.
    """
    scored = model.transform(rows).select("weight", F.posexplode(vector_to_array("probability")).alias("label_idx", "p"))
    mass = scored.groupBy("label_idx").agg(F.sum(F.col("weight") * F.col("p")).alias("mass"))
    sizes = rows.groupBy("class", "label_idx").agg(F.count("*").alias("n"))
    share = F.col("mass") / F.sum("mass").over(Window.partitionBy())
    return sizes.join(mass, "label_idx").select("class", "n", F.round(share, 2).alias("share"))


@query
def train_logistic(spark: SparkSession, sf: str) -> DataFrame:
    train = _training_data(spark, sf)[0].filter("split = 'train'")
    weights = sampling.balanced_weights(train, "label_idx")
    return _class_shares(sampling.with_weights(train, weights, "label_idx"), models.train_logistic(train))


@query
def train_oversampled_logistic(spark: SparkSession, sf: str) -> DataFrame:
    train = _training_data(spark, sf)[0].filter("split = 'train'")
    more = stage(sampling.random_oversample(train, "doc_id", "label_idx")).withColumn("weight", F.lit(1.0))
    return _class_shares(more, models.train_oversampled_logistic(more))


@query
def train_linear_svm(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows, classes, and whether more rows are right than the largest class has."""
    train = _training_data(spark, sf)[0].filter("split = 'train'")
    right = F.count_if(F.col("prediction") == F.col("label_idx"))
    scored = models.train_linear_svm(train).transform(train)
    found = scored.groupBy("label_idx").agg(F.count("*").alias("rows"), right.alias("right"))
    return found.agg(
        F.sum("rows").alias("n"),
        F.count("*").alias("classes"),
        (F.sum("right") > F.max("rows")).alias("beats_majority"),
    )


@query
def logistic_optimum(spark: SparkSession, sf: str) -> DataFrame:
    """Training rows and classes, and whether the returned model is where the gradient vanishes."""
    train = _training_data(spark, sf)[0].filter("split = 'train'")
    rows = stage(sampling.with_weights(train, sampling.balanced_weights(train, "label_idx"), "label_idx"))
    ratio = models.gradient_ratio(rows, models.train_logistic(train), weight="weight")
    return rows.agg(F.count("*").alias("n"), F.countDistinct("label_idx").alias("classes"), F.lit(ratio < 1e-4).alias("at_optimum"))


@query
def svm_optimum(spark: SparkSession, sf: str) -> DataFrame:
    """The same of the support vector machines."""
    train = _training_data(spark, sf)[0].filter("split = 'train'")
    ratio = models.gradient_ratio(train, models.train_linear_svm(train))
    return train.agg(F.count("*").alias("n"), F.countDistinct("label_idx").alias("classes"), F.lit(ratio < 1e-4).alias("at_optimum"))


@query
def train_and_compare_query(spark: SparkSession, sf: str) -> DataFrame:
    """Facts of the full job that hold whatever the fitted numbers are."""
    result = train_and_compare(corpus(spark, sf), "doc_id")
    sizes = result.predictions.groupBy("model").agg(F.count("*").alias("rows"))
    is_best = F.col("model") == result.best
    return result.metrics.join(sizes, "model").agg(
        F.count("*").alias("models"),
        F.sum("rows").alias("predictions"),
        F.count_if(is_best).alias("best"),
        F.count_if(F.abs(F.col("accuracy") - F.col("recall")) < 1e-9).alias("recall_is_accuracy"),
        (F.max(F.when(is_best, F.col("f1"))) > F.max("f1") - 1e-9).alias("best_has_top_f1"),
    )


def _text_model(spark: SparkSession, sf: str) -> tuple[TextModel, DataFrame, DataFrame]:
    """A logistic model for raw texts, its vocabulary, and its vectors."""
    data, vocabulary, classes = _training_data(spark, sf)
    fitted = models.train_logistic(data.filter("split = 'train'"))
    return TextModel(features.vectorizer(vocabulary, "terms"), fitted, classes), vocabulary, data


def _differences(found: DataFrame, direct: DataFrame) -> DataFrame:
    """Rows scored both ways, and how many of them differ."""
    both = found.select("doc_id", "pred").join(direct.select("doc_id", F.col("pred").alias("direct")), "doc_id")
    return both.agg(F.count("*").alias("n"), F.count_if(~F.col("pred").eqNullSafe(F.col("direct"))).alias("differing"))


@query
def score(spark: SparkSession, sf: str) -> DataFrame:
    """The test part, from its vectors and from its raw texts."""
    model, _, data = _text_model(spark, sf)
    test = models.score(data.filter("split = 'test'"), model.classifier, model.classes)
    return _differences(test, model.predict(documents(spark, sf), "text"))


@query
def save_and_load_model(spark: SparkSession, sf: str) -> DataFrame:
    """Every document labelled from its raw text, by the saved model and by the one in memory."""
    model, vocabulary, _ = _text_model(spark, sf)
    path = save_model(model, vocabulary, staging_path(spark, "model"))
    docs = documents(spark, sf)
    return _differences(load_model(spark, path).predict(docs, "text"), model.predict(docs, "text"))


@query
def score_stream_query(spark: SparkSession, sf: str) -> DataFrame:
    """Every document labelled on a stream and as a table."""
    model, _, _ = _text_model(spark, sf)
    target, checkpoint = staging_path(spark, "stream"), staging_path(spark, "progress")
    scored = score_stream(arriving_documents(spark, sf), model, "text").select("doc_id", "pred")
    write_stream(scored, target, checkpoint, once=True).awaitTermination()
    return _differences(spark.read.parquet(target), model.predict(documents(spark, sf), "text"))


@query
def score_batches_query(spark: SparkSession, sf: str) -> DataFrame:
    """Every document labelled as it arrives, in two parts with a new model between them."""
    model, vocabulary, _ = _text_model(spark, sf)
    arriving, models_, target, progress = (staging_path(spark, k) for k in ("arriving", "models", "stream", "progress"))
    docs = documents(spark, sf).select("doc_id", "text")
    for half in (0, 1):
        docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == half).write.mode("append").parquet(arriving)
        publish_model(model, vocabulary, models_)
        stream = spark.readStream.schema(docs.schema).parquet(arriving)
        score_batches(stream, models_, "text", target, progress, once=True).awaitTermination()
    found = spark.read.parquet(target)
    facts = found.agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("model_version").alias("versions")).first()
    return _differences(found, model.predict(docs, "text")).select("*", *[F.lit(facts[c]).alias(c) for c in ("docs", "versions")])
