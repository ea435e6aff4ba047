import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelloom.operators import ranking, sampling


def frame(spark, sizes):
    rows = [(f"{label}-{i}", label) for label, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, label int")


def split_counts(df):
    return Counter((r["label"], r["split"]) for r in df.collect())


def test_remainders(spark):
    # 21 rows: 5 test, 16 train; shares 3.81, 5.33, 6.86
    df = sampling.stratified_split(frame(spark, {0: 5, 1: 7, 2: 9}), "id", "label")
    assert split_counts(df) == {(0, "train"): 4, (0, "test"): 1, (1, "train"): 5, (1, "test"): 2, (2, "train"): 7, (2, "test"): 2}


def test_remainder_ties_go_to_the_smaller_label(spark):
    # 12 rows: 3 test, 9 train; shares 4.5 and 4.5
    df = sampling.stratified_split(frame(spark, {7: 6, 3: 6}), "id", "label")
    assert split_counts(df)[3, "train"] == 5 and split_counts(df)[7, "train"] == 4


@pytest.mark.parametrize("rows_per_bucket,digits", [(1_000_000, 3), (0.05, 4), (0.0001, 5)])
def test_buckets_follow_the_row_count(spark, monkeypatch, rows_per_bucket, digits):
    source = frame(spark, {0: 40, 1: 400})
    plain = sorted(sampling.stratified_split(source, "id", "label").collect())
    copies = sampling.random_oversample(source, "id", "label").groupBy("id").count()
    copies_before = sorted(copies.collect())
    monkeypatch.setattr(ranking, "ROWS_PER_BUCKET", rows_per_bucket)
    assert ranking.bucket_digits(source) == digits
    assert sorted(sampling.stratified_split(source, "id", "label").collect()) == plain
    assert sorted(sampling.random_oversample(source, "id", "label").groupBy("id").count().collect()) == copies_before


def test_split_is_a_partition_in_hash_order(spark):
    import hashlib

    source = frame(spark, {0: 40, 1: 400})
    rows = sampling.stratified_split(source, "id", "label", 0.25, seed=7).collect()
    assert len(rows) == len({r["id"] for r in rows}) == 440
    for label, train in ((0, 30), (1, 300)):
        order = sorted((hashlib.md5(f"7:{label}-{i}".encode()).hexdigest(), f"{label}-{i}") for i in range(40 if label == 0 else 400))
        assert {i for _, i in order[:train]} == {r["id"] for r in rows if r["label"] == label and r["split"] == "train"}


def test_split_errors(spark):
    with pytest.raises(Exception, match="fewer than 2 rows"):
        sampling.stratified_split(frame(spark, {0: 1, 1: 9}), "id", "label").collect()
    with pytest.raises(Exception, match="fewer rows than there are classes"):
        sampling.stratified_split(frame(spark, {0: 2, 1: 2, 2: 2}), "id", "label", 0.2).collect()
    nulls = spark.createDataFrame([("a", 0), ("b", None)], "id string, label int")
    with pytest.raises(Exception, match="null label"):
        sampling.stratified_split(nulls, "id", "label").collect()
    same = spark.createDataFrame([("x", 0)] * 10, "id string, label int")
    with pytest.raises(Exception, match="not unique"):
        sampling.stratified_split(same, "id", "label").collect()


def test_split_does_not_shuffle_the_payload(spark):
    df = sampling.stratified_split(frame(spark, {0: 20, 1: 30}), "id", "label")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_weights(spark):
    df = frame(spark, {0: 2, 1: 3, 2: 5})
    balanced = {r["label"]: r["weight"] for r in sampling.balanced_weights(df, "label").collect()}
    assert math.isclose(balanced[0], 10 / 6) and math.isclose(balanced[2], 10 / 15)
    rows = sampling.with_weights(df, sampling.balanced_weights(df, "label"), "label").collect()
    assert math.isclose(sum(r["weight"] for r in rows), 10)
    inverse = {r["label"]: r["weight"] for r in sampling.inverse_frequency_weights(df, "label").collect()}
    assert math.isclose(sum(inverse.values()), 3) and math.isclose(inverse[0] / inverse[2], 2.5)
    with pytest.raises(Exception, match="not 0..k-1"):
        sampling.inverse_frequency_weights(frame(spark, {0: 2, 2: 3}), "label").collect()


def test_oversample(spark):
    df = frame(spark, {0: 3, 1: 50, 2: 20})
    rows = sampling.random_oversample(df, "id", "label").collect()
    assert Counter(r["label"] for r in rows) == {0: 50, 1: 50, 2: 50}
    assert {r["id"] for r in rows if r["copy"] == 0} == {r["id"] for r in df.collect()}
    assert len({(r["id"], r["copy"]) for r in rows}) == 150
    assert sorted(map(tuple, rows)) == sorted(map(tuple, sampling.random_oversample(df, "id", "label").collect()))


def test_oversample_spreads_a_row_drawn_very_often(spark, monkeypatch):
    monkeypatch.setattr(sampling, "COPIES_PER_STEP", 10)
    df = frame(spark, {0: 2, 1: 301})
    rows = sampling.random_oversample(df, "id", "label").collect()
    assert Counter(r["label"] for r in rows) == {0: 301, 1: 301}
    assert len({(r["id"], r["copy"]) for r in rows}) == 602


@pytest.mark.parametrize("draws", [0, 1, 59, 60, 61, 959, 960, 961, 100_000])
def test_fair_draws(spark, draws):
    keys = spark.range(400).withColumn("m", F.lit(draws).cast("long"))
    got = [r[0] for r in keys.select(sampling.fair_draws(F.col("m"), F.lit("7"), F.col("id"))).collect()]
    assert min(got) >= 0 and max(got) <= draws
    assert abs(sum(got) / 400 - draws / 2) <= 5 * math.sqrt(draws / 1600)
    spread = sum((g - draws / 2) ** 2 for g in got) / 400
    assert abs(spread - draws / 4) <= 0.4 * draws / 4


@pytest.mark.parametrize("part,whole", [(1, 2), (1, 3), (64, 65), (8, 13), (2**40, 2**40 + 1)])
@pytest.mark.parametrize("draws", [1, 50, 5000])
def test_share_draws(spark, part, whole, draws):
    keys = spark.range(300).select("id", *(F.lit(v).cast("long").alias(c) for c, v in (("m", draws), ("p", part), ("w", whole))))
    got = [r[0] for r in keys.select(sampling.share_draws(*map(F.col, "mpw"), F.lit("7"), F.col("id"))).collect()]
    p = part / whole
    assert min(got) >= 0 and max(got) <= draws
    assert abs(sum(got) / 300 - draws * p) <= 5 * math.sqrt(draws * p * (1 - p) / 300) + 1e-3


def test_draws_reach_all_rows_alike(spark):
    df = frame(spark, {0: 13, 1: 13_013})
    copies = Counter(r["id"] for r in sampling.random_oversample(df, "id", "label").filter("label = 0 and copy > 0").collect())
    assert sum(copies.values()) == 13_000 and len(copies) == 13
    assert sum((c - 1000) ** 2 / 1000 for c in copies.values()) < 40  # chi-square of 12 degrees


def test_few_draws_of_a_large_class(spark):
    df = frame(spark, {0: 1000, 1: 1003})
    assert sampling.random_oversample(df, "id", "label").filter("copy > 0").count() == 3


def test_oversample_of_equal_classes_adds_nothing(spark):
    assert sampling.random_oversample(frame(spark, {0: 4, 1: 4}), "id", "label").count() == 8


def test_dense_index(spark):
    df, classes = sampling.dense_label_index(frame(spark, {9: 2, 4: 3}), "label")
    assert {(r["label"], r["label_idx"]) for r in df.collect()} == {(4, 0), (9, 1)}
    assert classes.count() == 2
