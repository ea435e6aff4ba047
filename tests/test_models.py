"""Trained models against a brute-force optimum, and the two complete jobs."""

import json
import math
import os

import numpy as np
import pytest
from pyspark import RDD
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from labelloom.operators import models, sampling, solver
from labelloom.plans import catalog, workflow
from labelloom.sources.models import load_model, publish_model, published, save_model
from labelloom.sources.tables import read_metrics
from labelloom.streaming.scoring import clean_stream, score_batches, score_stream, write_stream


def points(n=90, seed=3):
    rng = np.random.default_rng(seed)
    y = np.array([0] * 15 + [1] * 25 + [2] * (n - 40))
    centres = np.array([[1.0, 0.0, 0.5, 0.0], [0.0, 1.0, 0.0, 0.5], [0.4, 0.4, 1.0, 1.0]])
    return centres[y] + rng.normal(0, 0.5, (n, 4)), y


@pytest.fixture(scope="module")
def train(spark):
    x, y = points()
    rows = [(i, int(c), Vectors.dense(v.tolist())) for i, (v, c) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, ["id", "label_idx", "features"])
    return df.withColumn("label_idx", F.col("label_idx").cast("int"))


def logistic_objective(coef, bias, x, y, w):
    z = x @ coef.T + bias
    z = z - z.max(axis=1, keepdims=True)
    nll = np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(y)), y]
    return float((w * nll).sum() + 0.5 * (coef**2).sum())


def logistic_optimum(x, y, w, steps=20000, rate=0.01):
    """Plain gradient descent on the summed loss plus half the squared norm."""
    k, onehot = y.max() + 1, np.eye(y.max() + 1)[y]
    coef, bias = np.zeros((k, x.shape[1])), np.zeros(k)
    for _ in range(steps):
        z = x @ coef.T + bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = w[:, None] * (p - onehot)
        coef, bias = coef - rate * (d.T @ x + coef), bias - rate * d.sum(axis=0)
    return coef, bias


@pytest.mark.parametrize("balanced", [True, False])
def test_logistic_reaches_the_usual_optimum(train, balanced):
    x, y = points()
    counts = np.bincount(y)
    w = (len(y) / (len(counts) * counts))[y] if balanced else np.ones(len(y))
    best = logistic_objective(*logistic_optimum(x, y, w), x, y, w)
    model = models.train_logistic(train, balanced=balanced)
    ours = logistic_objective(model.coefficientMatrix.toArray(), model.interceptVector.toArray(), x, y, w)
    assert best - 1e-6 <= ours <= best * 1.002


def squared_hinge_optimum(x, sign, c, rounds=60):
    """Newton steps with the dense matrix of the active rows; the intercept is a penalised feature."""
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        active = sign * (a @ w) < 1
        hessian = np.eye(len(w)) + 2 * (a[active] * c[active][:, None]).T @ a[active]
        w = np.linalg.solve(hessian, 2 * a[active].T @ (c[active] * sign[active]))
    return w


def test_svm_reaches_the_optimum_of_the_squared_hinge(train):
    x, y = points()
    own = len(y) / (3 * np.bincount(y))
    model = models.train_linear_svm(train, tolerance=1e-9)
    for k, m in enumerate(model.models):
        best = squared_hinge_optimum(x, np.where(y == k, 1.0, -1.0), np.where(y == k, own[k], 1.0))
        assert np.allclose([*m.coefficients, m.intercept], best, atol=1e-7)
    assert models.gradient_ratio(train, model) < 1e-8
    assert model.transform(train).filter("prediction = label_idx").count() > 60


@pytest.mark.parametrize("balanced", [True, False])
def test_logistic_gradient_vanishes(train, balanced):
    x, y = points()
    w = (len(y) / (3 * np.bincount(y)))[y] if balanced else np.ones(len(y))
    model = models.train_logistic(train, balanced=balanced, tolerance=1e-9)
    coef, bias = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    p = np.exp(x @ coef.T + bias)
    d = w[:, None] * (p / p.sum(axis=1, keepdims=True) - np.eye(3)[y])
    assert np.abs(d.T @ x + coef).max() < 1e-6 and np.abs(d.sum(axis=0)).max() < 1e-6 and abs(bias.sum()) < 1e-9


def test_sparse_and_dense_rows_and_rows_without_entries_are_the_same(spark):
    dense = [(0, Vectors.dense([1.0, 0.0, 2.0])), (1, Vectors.dense([0.0, 0.0, 0.0])), (1, Vectors.dense([0.0, 3.0, 0.0])), (0, Vectors.dense([1.0, 1.0, 0.0]))]
    sparse = [(y, Vectors.sparse(3, [(i, v) for i, v in enumerate(x) if v])) for y, x in dense]
    found = [models.train_logistic(spark.createDataFrame(rows, ["label_idx", "features"]).repartition(3)) for rows in (dense, sparse)]
    assert np.allclose(found[0].coefficientMatrix.toArray(), found[1].coefficientMatrix.toArray(), atol=1e-6)


def test_training_refuses_nulls_and_no_rows(train):
    with pytest.raises(ValueError):
        models.train_logistic(train.filter("false"), balanced=False)
    with pytest.raises(ValueError):
        models.train_logistic(train.withColumn("features", F.when(F.col("id") > 0, F.col("features"))), balanced=False)


def test_a_class_without_rows_stays_at_its_penalty(train):
    gap = train.filter("label_idx <> 1")
    model = models.train_logistic(gap, balanced=False)
    assert model.numClasses == 3 and gap.count() == model.transform(gap).filter("prediction <> 1").count()


def test_oversampled(spark, train):
    more = sampling.random_oversample(train, "id", "label_idx")
    model = models.train_oversampled_logistic(more)
    assert model.numClasses == 3


WORDS = {4: "good nice lovely sunny", 7: "bad awful dreadful rainy", 9: "train ticket station platform"}


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(120):
        label = (4, 7, 9, 9)[i % 4]
        words = rng.choice(WORDS[label].split() + ["the", "day", "http://t.co/x"], 6)
        rows.append((i, label, " ".join(words)))
    return spark.createDataFrame(rows, "row int, class int, tweet string")


@pytest.fixture(scope="module")
def compared(corpus, tmp_path_factory):
    run = str(tmp_path_factory.mktemp("artifacts") / "run")
    return workflow.train_and_compare(corpus, "row", run=run, max_features=40), run


def test_comparison(compared):
    result, _ = compared
    metrics = {r["model"]: r for r in result.metrics.collect()}
    assert set(metrics) == set(workflow.MODEL_NAMES)
    assert all(math.isclose(r["accuracy"], r["recall"]) and r["f1"] > 0.8 for r in metrics.values())
    assert result.predictions.count() == 3 * 24
    assert {r["pred"] for r in result.predictions.collect()} <= {4, 7, 9}
    assert metrics[result.best]["f1"] == max(r["f1"] for r in metrics.values())


def test_artifacts(spark, compared):
    result, run = compared
    names = set(os.listdir(run))
    assert {"dataset_head", "class_distribution", "sample_cleaned_texts", "tfidf_vocab", "metrics_summary", "best_model"} <= names
    assert {f"classification_report_{m}" for m in workflow.MODEL_NAMES} <= names
    counts = spark.read.json(f"{run}/class_distribution").collect()
    assert {(r["label"], r["n"]) for r in counts} == {(4, 30), (7, 30), (9, 60)}
    back = read_metrics(spark, f"{run}/metrics_summary").orderBy("ordinal").collect()
    assert {r["model"]: r["f1"] for r in back} == {r["model"]: r["f1"] for r in result.metrics.collect()}
    report = spark.read.text(f"{run}/classification_report_LinearSVC").collect()
    assert "precision    recall  f1-score   support" in report[0][0]


def test_saved_model_scores_raw_text(spark, compared, corpus, tmp_path):
    result, run = compared
    loaded = load_model(spark, f"{run}/best_model")
    rows = loaded.predict(corpus, "tweet").collect()
    assert sum(r["pred"] == r["class"] for r in rows) > 100
    same = {r["row"]: r["pred"] for r in result.predictions.filter(F.col("model") == result.best).collect()}
    assert all(r["pred"] == same[r["row"]] for r in rows if r["row"] in same)
    with pytest.raises(Exception):
        save_model(loaded, result.vocabulary, f"{run}/best_model")


def test_streams(spark, compared, corpus, tmp_path):
    result, _ = compared
    corpus.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(corpus.schema).parquet(str(tmp_path / "in"))
    both = clean_stream(score_stream(stream, result.model, "tweet"), "tweet")
    write_stream(both, str(tmp_path / "out"), str(tmp_path / "progress"), once=True).awaitTermination()
    got = {r["row"]: r["pred"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {r["row"]: r["pred"] for r in result.model.predict(corpus, "tweet").collect()}


def test_a_growing_stream_is_scored_by_the_newest_model(spark, compared, corpus, tmp_path):
    result, _ = compared
    folder, models_, out, progress = (str(tmp_path / x) for x in ("in", "models", "out", "progress"))
    corpus.where("row < 50").write.mode("append").parquet(folder)
    stream = spark.readStream.schema(corpus.schema).parquet(folder)
    run = lambda: score_batches(stream, models_, "tweet", out, progress, once=True).awaitTermination()
    with pytest.raises(Exception, match="no model is published"):
        run()
    assert published(spark, models_) is None and publish_model(result.model, result.vocabulary, models_) == 1
    run()
    os.makedirs(f"{models_}/version=2")  # begun and not completed
    assert published(spark, models_) == 1
    other = type(result.model)(None, result.model.classifier, result.model.classes, result.model.stop, vocabulary=result.vocabulary)
    assert publish_model(other, result.vocabulary, models_) == 2  # written over
    corpus.where("row >= 50").write.mode("append").parquet(folder)
    run()
    last = max(int(n) for n in os.listdir(f"{progress}/commits") if n.isdigit())
    for name in (f"{last}", f".{last}.crc"):
        os.remove(f"{progress}/commits/{name}")  # as if the run had ended before it noted the batch
    run()
    got = spark.read.parquet(out).collect()
    expected = {r["row"]: r["pred"] for r in result.model.predict(corpus, "tweet").collect()}
    assert len(got) == 120 and {r["row"]: r["pred"] for r in got} == expected
    assert {r["row"]: r["model_version"] for r in got} == {i: 1 if i < 50 else 2 for i in expected}


def test_vocabularies_beyond_memory_give_the_same_models(spark, compared, corpus, tmp_path):
    result, _ = compared
    joined = workflow.train_and_compare(corpus, "row", max_features=40, max_rows=0)
    assert joined.model.vectors is None and joined.best == result.best
    key = lambda c: {(r["model"], r["row"]): r["pred"] for r in c.predictions.collect()}
    assert key(joined) == key(result)
    loaded = load_model(spark, save_model(joined.model, joined.vocabulary, str(tmp_path / "model")))
    expected = {r["row"]: r["pred"] for r in result.model.predict(corpus, "tweet").collect()}
    assert {r["row"]: r["pred"] for r in loaded.predict(corpus, "tweet").collect()} == expected


def test_tags_go_through_the_job_and_with_the_model(spark, compared, corpus, tmp_path):
    result, _ = compared
    lemmas = spark.createDataFrame([("lovely", "v", "good"), ("sunny", "n", "good")], "surface string, pos string, lemma string")
    tags = spark.createDataFrame([("lovely", "VBD")], "surface string, tag string")
    docs = workflow.prepare_documents(corpus, "row", lemmas=lemmas, tags=tags)
    assert not {w for r in docs.collect() for w in r["tokens"]} & {"lovely", "sunny"}
    model = type(result.model)(result.model.vectors, result.model.classifier, result.model.classes, lemmas=lemmas, tags=tags, vocabulary=result.vocabulary)
    loaded = load_model(spark, save_model(model, result.vocabulary, str(tmp_path / "model")))
    one = spark.createDataFrame([("lovely sunny",)], "t string")
    assert loaded.tags.count() == 1 and [r["pred"] for r in loaded.predict(one, "t").collect()] == [4]


def test_lemmas_go_with_the_model(spark, compared, corpus, tmp_path):
    result, _ = compared
    lemmas = spark.createDataFrame([("lovely", "n", "good"), ("sunny", "n", "good")], "surface string, pos string, lemma string")
    docs = workflow.prepare_documents(corpus, "row", stop=["day"], lemmas=lemmas)
    words = {w for r in docs.collect() for w in r["tokens"]}
    assert "the" in words and not words & {"lovely", "sunny", "day"}
    model = result.model
    model = type(model)(model.vectors, model.classifier, model.classes, ["day"], lemmas=lemmas)
    path = save_model(model, result.vocabulary, str(tmp_path / "model"))
    loaded = load_model(spark, path)
    assert loaded.stop == ["day"] and loaded.lemmas.count() == 2
    one = spark.createDataFrame([("lovely sunny",), ("train station",)], "t string")
    assert [r["pred"] for r in loaded.predict(one, "t").collect()] == [4, 9]


def test_fit_on_train_keeps_the_vocabulary_of_the_train_part(corpus):
    docs = workflow.prepare_documents(corpus, "row")
    assert set(docs.columns) == {"row", "label", "text_clean", "tokens"}
    with pytest.raises(ValueError):
        workflow.train_and_compare(corpus, "row", fit_on="test")


def test_existing_clean_text_is_used(corpus):
    given = corpus.withColumn("text_clean", F.lit("one two"))
    assert workflow.prepare_documents(given, "row").first()["tokens"] == ["one", "two"]
    fresh = workflow.prepare_documents(given, "row", force=True).select("text_clean").distinct()
    assert fresh.count() > 1


def test_score_with(spark):
    df = spark.createDataFrame([(1, 3), (2, 4)], "id int, n int")

    def load():
        return lambda batch: [[0.0, 1.0] if n % 2 else [1.0, 1.0] for n in batch["n"]]

    rows = models.score_with(df, load, ["n"]).orderBy("id").collect()
    assert [(r["logits"], r["pred"]) for r in rows] == [([0.0, 1.0], 1), ([1.0, 1.0], 0)]


def test_fixed_length_job(spark, tmp_path):
    rows = [(i, i % 3, f"Word{i % 5} http://x.y @you #tag") for i in range(30)] + [(99, None, "dropped"), (98, 1, None)]
    df = spark.createDataFrame(rows, "id int, label int, text string")
    made = workflow.prepare_fixed_length(df, "id", max_length=4)
    data = made.data.collect()
    assert set(made.data.columns) == {"id", "split", "input_ids", "attention_mask", "label"}
    assert len(data) == 30 and sum(r["split"] == "test" for r in data) == 6
    assert all(len(r["input_ids"]) == 4 and r["attention_mask"] == [1, 1, 0, 0] for r in data)
    assert [r["name"] for r in made.names.collect()] == ["Hate Speech", "Offensive", "Neutral"]
    assert math.isclose(sum(r["weight"] for r in made.weights.collect()), 3)

    run = str(tmp_path / "run")
    preds = made.data.filter("split = 'test'").withColumn("pred", F.lit(2))
    baseline = tmp_path / "metrics_summary.json"
    baseline.write_text(json.dumps({"LinearSVC": {"accuracy": 0.87654, "precision": 0.5, "recall": 0.5, "f1": 0.5}}))
    table = workflow.evaluate_and_compare(preds, made.names, run, str(baseline)).orderBy("ordinal").collect()
    assert [(r["model"], r["accuracy"]) for r in table] == [("LinearSVC", 0.8765), ("Transformer", 0.3333)]
    saved = spark.read.option("header", True).csv(f"{run}/comparison_table").collect()
    assert [r["model"] for r in saved] == ["LinearSVC", "Transformer"]
    text = "\n".join(r[0] for r in spark.read.text(f"{run}/classification_report_transformer").collect())
    assert "Offensive     0.0000" in text
    alone = workflow.evaluate_and_compare(preds, made.names, baseline=str(tmp_path / "none.json"))
    assert [r["model"] for r in alone.collect()] == ["Transformer"]
    workflow.write_run_config(made.data, run, {"max_length": 4, "seed": 42})
    config = spark.read.json(f"{run}/run_config").first()
    assert (config["max_length"], config["num_labels"]) == ("4", 3)


@pytest.mark.parametrize("folder", [False, True])
def test_documents_arrive_from_a_file_and_from_a_folder(spark, tmp_path, folder):
    rows = spark.createDataFrame([(i, f"Some words {i}") for i in range(6)], "doc_id long, text string")
    rows.repartition(3 if folder else 1).write.parquet(str(tmp_path / "written"))
    if folder:
        (tmp_path / "written").rename(tmp_path / "documents.parquet")
    else:
        next((tmp_path / "written").glob("part-*")).rename(tmp_path / "documents.parquet")
    found = catalog.QUERIES["clean_stream"](spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text_clean"]) for r in found) == [(i, "words") for i in range(6)]


@pytest.mark.parametrize("tasks", [1, 3, 9, 24])
def test_the_driver_gets_the_sums_once(spark, train, monkeypatch, tasks):
    sent = []
    collect = RDD.collect
    monkeypatch.setattr(RDD, "collect", lambda self: sent.append(collect(self)) or sent[-1])
    batches = solver.sparse_batches(train.repartition(tasks, "id"), "label_idx", "features", None).repartition(tasks)
    size = train.first()["features"].size + 1
    passes = solver.Passes(batches, solver.Softmax(), size, 3)
    value, gradient, diagonal = passes.at(np.zeros((size, 3)))
    numbers = sum(np.size(piece) for part in sent for _, piece in part)
    assert numbers == (2 * size + 1) * 3
    x, y = points()
    assert np.allclose(gradient[:-1], x.T @ (1 / 3 - np.eye(3)[y])) and np.allclose(value.sum(), len(y) * np.log(3))
    whole = passes.sample(10_000)
    assert np.isclose(whole.weights.sum(), len(y)) and len(whole.labels) == len(y) and len(passes.sample(7).labels) == 7
    assert sum(len(part) for part in sent[-2:]) <= 2 * solver.DIRECT_SUMS
    passes.rdd.unpersist()


@pytest.mark.parametrize("tasks", [1, 4])
def test_a_step_of_the_svm_sees_rows_with_curvature_only(train, tasks):
    x, y = points()
    batches = solver.sparse_batches(train.repartition(tasks, "id"), "label_idx", "features", None).repartition(tasks)
    passes = solver.Passes(batches, solver.SquaredHinge(np.ones(3)), x.shape[1] + 1, 3)
    rng = np.random.default_rng(2)
    w, v = rng.normal(size=(x.shape[1] + 1, 3)), rng.normal(size=(x.shape[1] + 1, 3))
    a = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    active = np.where(y[:, None] == np.arange(3), 1.0, -1.0) * (a @ w) < 1
    assert 0 < active.sum() < active.size
    for most in (7, 10_000):
        for k, sample in enumerate(passes.samples(most, w)):
            assert len(sample.labels) == min(most, active[:, k].sum()) and np.isclose(sample.weights.sum(), active[:, k].sum())
            own = np.where(sample.labels == k, 1.0, -1.0)
            assert (own * sample.margins(w)[:, k] < 1).all()
    bent = passes.bent(w)
    assert sum(len(batch.labels) for batch, _ in bent.collect()) == active.any(axis=1).sum()
    whole = np.stack([v[:, k] + 2 * a[active[:, k]].T @ (a[active[:, k]] @ v[:, k]) for k in range(3)], axis=1)
    assert np.allclose(passes.product(bent, v, np.array([True] * 3)), whole)
    assert np.allclose(passes.product(bent, v, np.array([True, False, True]))[:, [0, 2]], whole[:, [0, 2]])
    bent.unpersist()
    passes.rdd.unpersist()


def uneven_points(spark, n=900, features=60):
    """Points whose features lean on each other and differ in scale by 100: hard for conjugate gradients."""
    rng = np.random.default_rng(11)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, features)) @ rng.normal(size=(features, features)) * np.logspace(0, 2, features) / 10
    x[np.arange(n), y] += 2
    rows = [(i, int(c), Vectors.dense(v.tolist())) for i, (v, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["id", "label_idx", "features"]), x, y


def test_few_passes_reach_the_optimum_of_an_uneven_problem(spark, monkeypatch):
    monkeypatch.setattr(solver, "SAMPLE_CELLS", 30)
    rows, x, _ = uneven_points(spark)
    batches = solver.sparse_batches(rows.repartition(4, "id"), "label_idx", "features", None)
    fit = solver.minimise(batches, solver.Softmax(), x.shape[1], 3)
    assert fit.ratio <= solver.TOLERANCE and fit.passes < 100


@pytest.mark.parametrize("cells, lists, share", [(1 << 22, 1, 1.0), (20_000, 3, 1 / 3), (5_400, 4, 0.1)])
def test_tasks_solve_a_step_for_rows_of_their_own(spark, monkeypatch, cells, lists, share):
    monkeypatch.setattr(solver, "LOCAL_CELLS", cells)
    monkeypatch.setattr(solver, "BATCH_CELLS", 600)
    rows, x, y = uneven_points(spark)
    batches = solver.sparse_batches(rows.repartition(5, "id"), "label_idx", "features", None).repartition(5)
    passes = solver.Passes(batches, solver.Softmax(), x.shape[1] + 1, 3)
    w = np.zeros((x.shape[1] + 1, 3))
    bent = passes.bent(w)
    local, found_share = passes.drawn(bent)
    found = local.collect()
    assert len(found) == lists and math.isclose(found_share, share)
    assert all(len(batch.values) <= 600 and len(batch.labels) == len(bend) for parts in found for batch, bend in parts)
    firsts = [tuple(batch.values[s : s + 60]) for parts in found for batch, _ in parts for s in batch.starts[:-1]]
    assert len(set(firsts)) == len(firsts) and set(firsts) <= set(map(tuple, x))
    assert len(firsts) == len(y) if lists * share > 0.99 else abs(len(firsts) - 360) < 90

    diagonal = passes.at(w)[2]
    closer = spark.sparkContext.broadcast(solver._preconditioners(passes, w, diagonal, [passes.sample(100)]))
    rest = np.random.default_rng(5).normal(size=w.shape)
    rest -= rest.mean(axis=1, keepdims=True)
    answer = passes.solved(local, found_share, closer, rest)
    assert answer.shape == w.shape and (answer * rest).sum() > 0
    if lists == 1:  # these are all the rows
        left = passes.product(bent, answer, np.array([True] * 3)) - rest
        assert (closer.value(left) * left).sum() <= 1.01 * solver.LOCAL_LEFT**2 * (closer.value(rest) * rest).sum()
    local.unpersist()
    bent.unpersist()
    passes.rdd.unpersist()


def test_the_products_of_logistic_regression_take_a_class_less():
    rng = np.random.default_rng(4)
    x, w, v, weights = rng.normal(size=(7, 5)), rng.normal(size=(6, 3)), rng.normal(size=(6, 3)), rng.random(7)
    batch = solver.Batch(np.arange(0, 36, 5), np.tile(np.arange(5), 7), x.ravel(), np.zeros(7, np.int32), weights)
    a = np.concatenate([x, np.ones((7, 1))], axis=1)
    p = np.exp(a @ w) / np.exp(a @ w).sum(axis=1, keepdims=True)
    bends = [r * (np.diag(q) - np.outer(q, q)) for q, r in zip(p, weights)]
    whole = sum(np.outer(row, bend @ (row @ v)) for row, bend in zip(a, bends))
    assert np.allclose(solver._curved(solver.Softmax(), batch, p, v), whole)
    assert solver._curved(solver.Softmax(), batch, np.ones((7, 1)), v[:, :1]).tolist() == [[0.0]] * 6
