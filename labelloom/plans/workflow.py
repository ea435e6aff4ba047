"""The two complete jobs: compare linear models, and prepare fixed-length input."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, functions as F

from labelloom.functions.text import (
    ENGLISH_STOP_WORDS,
    clean_text,
    content_tokens,
    join_tokens,
    light_clean,
    ngrams,
    vectorizer_tokens,
)
from labelloom.operators.columns import keep_columns, label_names, resolve_columns, to_text_label
from labelloom.operators.evaluate import (
    compare_models,
    confusion_matrix,
    per_class_report,
    report_text,
    select_best,
    weighted_metrics,
)
from labelloom.operators.features import fit_vocabulary, vectorize, vectorizer
from labelloom.operators.lookup import encode_fixed_length, lemmatize, word_tags
from labelloom.operators.models import score, train_linear_svm, train_logistic, train_oversampled_logistic
from labelloom.operators.profile import class_distribution, distinct_labels, empty_text_rate, row_counts
from labelloom.operators.sampling import (
    dense_label_index,
    inverse_frequency_weights,
    random_oversample,
    stratified_split,
)
from labelloom.plans.staging import MAX_SHARED_ROWS, fits_in_memory, stage
from labelloom.sources.models import TextModel, save_model
from labelloom.sources.tables import head_sample, metrics_document, read_metrics, write_table

# --- Fixed values -----------------------------------------------------------
# Model names, in the order they are listed and break ties; rows of the samples;
# defaults of a run.
MODEL_NAMES = ("LogisticRegression", "LinearSVC", "LR_oversampled")
RAW_SAMPLE_ROWS = 50
CLEAN_SAMPLE_ROWS = 200
MAX_FEATURES = 10_000
TEST_SIZE = 0.2
SEED = 42
MAX_LENGTH = 128
# ----------------------------------------------------------------------------


@dataclass
class Comparison:
    """What ``train_and_compare`` returns."""

    metrics: DataFrame
    predictions: DataFrame
    best: str
    model: TextModel
    vocabulary: DataFrame
    documents: DataFrame


def prepare_documents(
    df: DataFrame,
    id_col: str,
    force: bool = False,
    stop: Iterable[str] = ENGLISH_STOP_WORDS,
    lemmas: DataFrame | None = None,
    tags: DataFrame | None = None,
) -> DataFrame:
    """``(id, label, text_clean, tokens)``, staged: every text is cleaned once.

    ``lemmas`` is a table ``(surface, pos, lemma)``; without it words stay as they are.
    ``tags`` is one of ``(surface, tag)``, the part of speech that each word is looked up as; without it all are nouns.

    An existing ``text_clean`` column is used as it is unless ``force``; its tokens
    follow the vectorizer's rule, as those of lemmas do. Otherwise only the tokens are written; joining them back is cheap.
    """
    text, label = resolve_columns(df, "wide")
    base = [F.col(id_col), F.col(f"`{label}`").alias("label")]
    if "text_clean" in df.columns and not force:
        given = stage(df.select(*base, "text_clean"))
        return given.withColumn("tokens", vectorizer_tokens("text_clean"))
    cleaned = df.select(*base, clean_text(F.col(f"`{text}`")).alias("_clean"))
    words = cleaned.select(id_col, "label", content_tokens("_clean", stop).alias("tokens"))
    if lemmas is not None:
        if tags is not None:
            words = word_tags(words, "tokens", tags, id_col, "_tags")
        words = lemmatize(words, "tokens", lemmas, id_col, "_tags" if tags is not None else None, output="tokens")
        clean = stage(words.select(id_col, "label", join_tokens("tokens").alias("text_clean")))
        return clean.withColumn("tokens", vectorizer_tokens("text_clean"))
    return stage(words).select(id_col, "label", join_tokens("tokens").alias("text_clean"), "tokens")


def train_and_compare(
    df: DataFrame,
    id_col: str,
    run: str | None = None,
    max_features: int = MAX_FEATURES,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
    fit_on: str = "all",
    force: bool = False,
    stop: Iterable[str] = ENGLISH_STOP_WORDS,
    lemmas: DataFrame | None = None,
    tags: DataFrame | None = None,
    max_rows: int = MAX_SHARED_ROWS,
) -> Comparison:
    """Train the three linear models on one split, evaluate them and keep the best.

    ``fit_on="all"`` fits vocabulary and idf on the whole corpus before the split,
    ``"train"`` on the train part only. Words are filtered by ``stop`` and, given a
    table ``(surface, pos, lemma)``, replaced by their lemmas, as the part of speech that ``tags`` gives. A vocabulary of more than ``max_rows`` terms
    (or too many bytes) is joined in place of copied. With ``run`` all artifacts are written under that path.
    """
    if fit_on not in ("all", "train"):
        raise ValueError("fit_on is 'all' or 'train'")
    stop = list(stop)
    docs = prepare_documents(df, id_col, force, stop, lemmas, tags)
    terms = docs.withColumn("terms", ngrams("tokens"))
    split = stratified_split(terms, id_col, "label", test_size, seed)
    vocabulary = fit_vocabulary(terms if fit_on == "all" else split.filter("split = 'train'"), "terms", max_features)
    indexed, classes = dense_label_index(split, "label")
    data = stage(vectorize(indexed, vocabulary, "terms", id_col=id_col, max_rows=max_rows).select(id_col, "label", "label_idx", "split", "features"))
    train, test = data.filter("split = 'train'"), data.filter("split = 'test'")

    oversampled = stage(random_oversample(train, id_col, "label_idx", seed))
    trainings = (
        lambda: train_logistic(train),
        lambda: train_linear_svm(train),
        lambda: train_oversampled_logistic(oversampled),
    )
    # Each iteration is a short job, so the three trainings share the cluster.
    with ThreadPool(len(trainings)) as pool:
        fitted = pool.map(lambda fit: fit(), [inheritable_thread_target(df.sparkSession)(fit) for fit in trainings])
    scored = [
        score(test.select(id_col, "label", "features"), model, classes).select(
            F.lit(name).alias("model"), F.lit(place).alias("ordinal"), id_col, "label", "pred"
        )
        for place, (name, model) in enumerate(zip(MODEL_NAMES, fitted))
    ]
    predictions = stage(scored[0].unionByName(scored[1]).unionByName(scored[2]))
    metrics = stage(weighted_metrics(predictions, "label", "pred", by=("model", "ordinal")))
    best = select_best(metrics).first()["model"]
    classifier = fitted[MODEL_NAMES.index(best)]
    stages = vectorizer(vocabulary, "terms") if fits_in_memory(vocabulary, max_rows) else None
    model = TextModel(stages, classifier, classes, stop, lemmas=lemmas, vocabulary=vocabulary, tags=tags)
    result = Comparison(metrics, predictions, best, model, vocabulary, docs)
    if run:
        _save_run(df, id_col, result, data, run)
    return result


def _save_run(df: DataFrame, id_col: str, result: Comparison, data: DataFrame, run: str) -> None:
    text, _ = resolve_columns(df, "wide")
    flat = [f.name for f in df.schema.fields if f.dataType.typeName() not in ("array", "struct", "map")]
    write_table(head_sample(df.select(flat), RAW_SAMPLE_ROWS, id_col), run, "dataset_head", "csv")
    write_table(class_distribution(result.documents, "label", first_seen_by=id_col), run, "class_distribution", "json")
    write_table(empty_text_rate(result.documents), run, "empty_text_rate", "json")
    write_table(row_counts(data), run, "row_counts", "json")
    sample = head_sample(result.documents.select(id_col, "text_clean"), CLEAN_SAMPLE_ROWS, id_col)
    texts = df.select(id_col, text).join(sample, id_col).orderBy(id_col).select(text, "text_clean")
    write_table(texts, run, "sample_cleaned_texts", "csv")
    write_table(result.vocabulary, run, "tfidf_vocab", "json")
    for name in MODEL_NAMES:
        own = result.predictions.filter(F.col("model") == name)
        report = per_class_report(own, "label", "pred")
        write_table(report_text(report).coalesce(1), run, f"classification_report_{name}", "text")
        write_table(confusion_matrix(own, "label", "pred"), run, f"confusion_{name}", "json")
    write_table(metrics_document(result.metrics.orderBy("ordinal")), run, "metrics_summary", "text")
    save_model(result.model, result.vocabulary, f"{run}/best_model")


@dataclass
class FixedLengthData:
    """What ``prepare_fixed_length`` returns."""

    data: DataFrame
    names: DataFrame
    weights: DataFrame
    vocabulary: DataFrame
    distribution: DataFrame
    counts: DataFrame


def prepare_fixed_length(
    df: DataFrame,
    id_col: str,
    max_length: int = MAX_LENGTH,
    max_features: int = MAX_FEATURES,
    test_size: float = TEST_SIZE,
    seed: int = SEED,
) -> FixedLengthData:
    """Lightly cleaned text as word ids of fixed length, split, with class weights.

    ``data`` has the id, ``split`` and just the columns a sequence model reads:
    ``input_ids``, ``attention_mask`` and ``label``.
    """
    pairs = to_text_label(df, "narrow", keep=(id_col,)).withColumn("text", light_clean("text"))
    words = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split(F.lower("text"), " "))
    docs = stage(pairs.select(id_col, "label", words.alias("tokens")))
    split = stratified_split(docs, id_col, "label", test_size, seed)
    train = split.filter("split = 'train'")
    vocabulary = fit_vocabulary(train, "tokens", max_features)
    encoded = encode_fixed_length(split, "tokens", vocabulary, id_col, max_length)
    wanted = (id_col, "split", "input_ids", "attention_mask", "label")
    return FixedLengthData(
        data=keep_columns(encoded, wanted),
        names=label_names(distinct_labels(split, "label")),
        weights=inverse_frequency_weights(train, "label"),
        vocabulary=vocabulary,
        distribution=class_distribution(split, "label"),
        counts=row_counts(split),
    )


def evaluate_and_compare(
    predictions: DataFrame, names: DataFrame, run: str | None = None, baseline: str | None = None, model: str = "Transformer"
) -> DataFrame:
    """Evaluate one more model and list it after the baselines, if there are any.

    ``predictions`` has ``label`` and ``pred``; ``baseline`` is the path of a
    ``metrics_summary``. With ``run``, report, confusion matrix, metrics and the
    comparison table are written there.
    """
    spark = predictions.sparkSession
    own = stage(weighted_metrics(predictions, "label", "pred").withColumn("model", F.lit(model)))
    known = read_metrics(spark, baseline) if baseline else None
    table = compare_models(known, own)
    if run:
        report = per_class_report(predictions, "label", "pred")
        tag = model.lower()
        write_table(report_text(report, 4, names).coalesce(1), run, f"classification_report_{tag}", "text")
        write_table(confusion_matrix(predictions, "label", "pred"), run, f"confusion_{tag}", "json")
        rounded = compare_models(own, digits=6).drop("ordinal", "model")
        write_table(rounded, run, f"metrics_{tag}", "json")
        write_table(table.orderBy("ordinal").drop("ordinal").coalesce(1), run, "comparison_table", "csv")
    return table


def write_run_config(df: DataFrame, run: str, options: dict[str, object], label: str = "label") -> None:
    """Save the options of a run, as text, with the number of labels."""
    labels = distinct_labels(df, label).agg(F.count("*").alias("num_labels"))
    shown = [F.lit(str(v)).alias(k) for k, v in options.items()]
    write_table(labels.select(*shown, "num_labels"), run, "run_config", "json")
