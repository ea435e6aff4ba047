import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.functions import argmax, softmax_nll
from labelloom.operators import evaluate, profile


@pytest.fixture(scope="module")
def pairs(spark):
    # class 3 is never true, class 2 is never predicted
    rows = [(0, 0), (0, 0), (0, 1), (1, 1), (1, 0), (2, 0), (2, 3)]
    return spark.createDataFrame(rows, "label int, pred int")


def test_confusion_matrix_is_filled(pairs):
    matrix = {(r["label"], r["pred"]): r["n"] for r in evaluate.confusion_matrix(pairs, "label", "pred").collect()}
    assert len(matrix) == 16 and sum(matrix.values()) == 7
    assert matrix[0, 0] == 2 and matrix[2, 3] == 1 and matrix[3, 3] == 0
    wide = evaluate.confusion_wide(evaluate.confusion_matrix(pairs, "label", "pred")).collect()
    assert [tuple(r) for r in wide] == [(0, 2, 1, 0, 0), (1, 1, 1, 0, 0), (2, 1, 0, 0, 1), (3, 0, 0, 0, 0)]


def test_report_by_hand(pairs):
    report = {r["name"]: r for r in evaluate.per_class_report(pairs, "label", "pred").collect()}
    assert set(report) == {"0", "1", "2", "3", "accuracy", "macro avg", "weighted avg"}
    zero = report["0"]
    assert (zero["precision"], zero["support"]) == (0.5, 3) and math.isclose(zero["recall"], 2 / 3)
    assert [report["2"][m] for m in ("precision", "recall", "f1")] == [0, 0, 0]
    assert [report["3"][m] for m in ("precision", "recall", "f1", "support")] == [0, 0, 0, 0]
    assert report["accuracy"]["precision"] is None and math.isclose(report["accuracy"]["f1"], 3 / 7)
    f0 = 2 * 0.5 * (2 / 3) / (0.5 + 2 / 3)
    assert math.isclose(report["macro avg"]["f1"], (f0 + 0.5) / 4)
    assert math.isclose(report["weighted avg"]["f1"], (3 * f0 + 2 * 0.5) / 7)
    assert report["weighted avg"]["support"] == 7


def test_weighted_recall_is_accuracy(pairs):
    row = evaluate.weighted_metrics(pairs, "label", "pred").first()
    assert math.isclose(row["accuracy"], row["recall"]) and math.isclose(row["accuracy"], 3 / 7)


def test_report_text(spark, pairs):
    lines = [r[0] for r in evaluate.report_text(evaluate.per_class_report(pairs, "label", "pred")).collect()]
    assert lines == [
        "              precision    recall  f1-score   support",
        "",
        "           0       0.50      0.67      0.57         3",
        "           1       0.50      0.50      0.50         2",
        "           2       0.00      0.00      0.00         2",
        "           3       0.00      0.00      0.00         0",
        "",
        "    accuracy                           0.43         7",
        "   macro avg       0.25      0.29      0.27         7",
        "weighted avg       0.36      0.43      0.39         7",
    ]
    names = spark.createDataFrame([(0, "A class with a long name"), (1, "B")], "label int, name string")
    named = [r[0] for r in evaluate.report_text(evaluate.per_class_report(pairs, "label", "pred"), 4, names).collect()]
    assert named[2].startswith("A class with a long name     0.5000    0.6667")
    assert named[4].startswith("                       2 ")


def test_argmax_and_loss(spark):
    df = spark.createDataFrame([([1.0, 3.0, 3.0], 1), ([1000.0, 0.0, 0.0], 1)], "z array<double>, label int")
    assert [r[0] for r in df.select(argmax("z")).collect()] == [1, 0]
    nll = [r[0] for r in df.select(softmax_nll("z", "label")).collect()]
    assert math.isclose(nll[0], -math.log(math.exp(3) / (math.exp(1) + 2 * math.exp(3)))) and nll[1] == 1000.0


def test_weighted_cross_entropy(spark):
    df = spark.createDataFrame([([0.0, 0.0], 0), ([0.0, 2.0], 1), ([3.0, 0.0], 1)], "z array<double>, label int")
    weights = spark.createDataFrame([(0, 3.0), (1, 0.5)], "label int, weight double")
    losses = [math.log(2), math.log(1 + math.exp(-2)), math.log(1 + math.exp(3))]
    got = evaluate.weighted_cross_entropy(df, "z", "label", weights).first()["loss"]
    assert math.isclose(got, (3 * losses[0] + 0.5 * losses[1] + 0.5 * losses[2]) / 4)
    assert math.isclose(evaluate.weighted_cross_entropy(df, "z", "label").first()["loss"], sum(losses) / 3)


def test_compare_and_select(spark):
    ddl = "model string, ordinal int, accuracy double, precision double, recall double, f1 double"
    base = spark.createDataFrame([("B", 0, 0.5, 0.5, 0.5, 0.70000000000000007), ("A", 1, 0.5, 0.5, 0.5, 0.7)], ddl)
    new = spark.createDataFrame([("T", 0.123456, 0.2, 0.3, 0.4)], "model string, accuracy double, precision double, recall double, f1 double")
    table = evaluate.compare_models(base, None, new).orderBy("ordinal").collect()
    assert [r["model"] for r in table] == ["B", "A", "T"] and table[2]["accuracy"] == 0.1235
    assert evaluate.select_best(base).first()["model"] == "B"
    assert [r["model"] for r in evaluate.compare_models(None, new).collect()] == ["T"]


def test_profiles(spark):
    df = spark.createDataFrame([(2, "", 5), (0, "a b", 6), (2, " c ", 7), (None, "x", 1)], "c int, t string, pos int")
    rows = profile.class_distribution(df, "c").collect()
    assert [(r["c"], r["n"], r["share_pct"]) for r in rows] == [(0, 1, 33.333333), (2, 2, 66.666667)]
    assert [r["c"] for r in profile.class_distribution(df, "c", first_seen_by="pos").collect()] == [2, 0]
    assert tuple(profile.empty_text_rate(df, "t").first()) == (4, 1, 0.25)
    assert [r[0] for r in profile.distinct_labels(df, "c").collect()] == [0, 2]


def test_term_stats(spark):
    df = spark.createDataFrame([(["b", "a", "b"],), ([],), (["b"],)], "t array<string>")
    assert {tuple(r) for r in profile.term_stats(df, "t").collect()} == {("a", 1, 1), ("b", 3, 2)}
    plan = profile.term_stats(df, "t")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_report_text_prints_long_supports_whole(spark):
    from labelloom.operators import evaluate

    report = spark.createDataFrame(
        [(0, 0, "0", 1.0, 1.0, 1.0, 12_345_678_901), (1, None, "accuracy", None, None, 1.0, 12_345_678_901)],
        "ordinal int, label int, name string, precision double, recall double, f1 double, support long",
    )
    lines = [r["value"] for r in evaluate.report_text(report).collect()]
    assert sum(line.endswith(" 12345678901") for line in lines) == 2


@pytest.mark.parametrize("step", [2, 3, 1 << 20])
def test_term_stats_makes_no_row_for_each_occurrence(spark, monkeypatch, step):
    rng = random.Random(5)
    rows = [([rng.choice(["a", "b", "c", "", "é", None]) for _ in range(rng.randrange(9))] if i % 7 else None,) for i in range(60)]
    df = spark.createDataFrame(rows, "t array<string>").coalesce(2)
    monkeypatch.setattr(profile, "SLICE", step)
    plan = profile.term_stats(df, "t")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and plan.count("Exchange") == 1
    cf, n_rows = Counter(t for (ts,) in rows for t in ts or []), Counter(t for (ts,) in rows for t in set(ts or []) if t is not None)
    assert {tuple(r) for r in profile.term_stats(df, "t").collect()} == {(t, n, n_rows[t]) for t, n in cf.items()}
    among = spark.createDataFrame([("a",), ("é",), ("z",)], "term string")
    assert {tuple(r) for r in profile.term_stats(df, "t", among).collect()} == {(t, cf[t], n_rows[t]) for t in ("a", "é")}
