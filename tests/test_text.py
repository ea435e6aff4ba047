"""Text functions against Python's own regexes and hand-made rows."""

import re

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from labelloom.functions import (
    clean_text,
    coarse_pos,
    content_tokens,
    join_tokens,
    light_clean,
    min_token_length,
    ngrams,
    null_text_to_empty,
    remove_stopwords,
    tokenize,
)

HAND_ROWS = [
    ("RT @User_1: Look http://t.co/a1 #BadDay!!", "rt look badday", "RT : Look BadDay!!"),
    ("visit www.x.y/z now, ok?", "visit now ok", "visit www.x.y/z now, ok?"),
    ("a@b.com isn't it 2day", "a com isn t it day", "a.com isn't it 2day"),
    ("@über²x hi", "hi", "hi"),
    ("a\x1cb https://q\x1cz", "a b z", "a b z"),
    ("httpfoo bar", "bar", "httpfoo bar"),
    ("#", "", ""),
    ("  Two\n lines\t here ", "two lines here", "Two lines here"),
    ("gonna &amp; don't", "gonna amp don t", "gonna &amp; don't"),
    ("", "", ""),
]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame([(r[0],) for r in HAND_ROWS], "text string")


def collect(df, column):
    return [r[0] for r in df.select(column).collect()]


def test_clean_text_hand_rows(texts):
    assert collect(texts, clean_text("text")) == [r[1] for r in HAND_ROWS]


def test_light_clean_hand_rows(texts):
    assert collect(texts, light_clean("text")) == [r[2] for r in HAND_ROWS]


def test_null_text(spark):
    df = spark.createDataFrame([(None,)], "text string")
    row = df.select(clean_text("text"), null_text_to_empty("text"), light_clean("text")).first()
    assert tuple(row) == ("", "", None)


def python_clean(text):
    text = re.sub(r"http\S+|www\.[^\s]+", " ", text.lower())
    text = re.sub(r"[^a-z\s]", " ", re.sub(r"@\w+", " ", text))
    return re.sub(r"\s+", " ", text).strip()


def python_light(text):
    text = re.sub(r"#", "", re.sub(r"@\w+", "", re.sub(r"https?://\S+", "", text)))
    return re.sub(r"\s+", " ", text).strip()


PIECES = st.sampled_from(
    ["http", "https://", "www.", "@", "#", " ", "\n", "\t", "\x1c", "\x85", " ", " ", "a", "Bc", "é", "ß", "_", "7", ".", "&"]
)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=40, max_size=40))
def test_cleaners_follow_python(spark, rows):
    df = spark.createDataFrame([(r,) for r in rows], "text string")
    out = df.select("text", clean_text("text").alias("c"), light_clean("text").alias("l")).collect()
    for row in out:
        assert row["c"] == python_clean(row["text"])
        assert row["l"] == python_light(row["text"])


def test_tokens(spark):
    df = spark.createDataFrame([("i cannot go gonna see cannotx a bb",), ("",)], "t string")
    assert collect(df, tokenize("t")) == [["i", "can", "not", "go", "gon", "na", "see", "cannotx", "a", "bb"], []]
    assert collect(df, tokenize("t", split_fused=False))[0][1] == "cannot"
    assert collect(df, content_tokens("t")) == [["go", "gon", "na", "see", "cannotx", "bb"], []]
    two_steps = min_token_length(remove_stopwords(tokenize("t")))
    assert collect(df, two_steps) == collect(df, content_tokens("t"))
    assert collect(df, join_tokens(content_tokens("t"))) == ["go gon na see cannotx bb", ""]
    assert collect(df, content_tokens("t", stop=[], min_length=1))[0][0] == "i"


def test_ngrams(spark):
    df = spark.createDataFrame([([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)], "t array<string>")
    assert collect(df, ngrams("t")) == [[], ["a"], ["a", "b", "a b"], ["a", "b", "c", "a b", "b c"]]
    assert collect(df, ngrams("t", 2, 3)) == [[], [], ["a b"], ["a b", "b c", "a b c"]]
    with pytest.raises(ValueError):
        ngrams("t", 2, 1)


def test_coarse_pos(spark):
    df = spark.createDataFrame([("JJ",), ("VBD",), ("NNS",), ("RB",), ("IN",)], "tag string")
    assert collect(df, coarse_pos("tag")) == ["a", "v", "n", "r", "n"]


def test_cleaning_stays_in_generated_code(texts):
    plan = texts.select(clean_text(F.col("text")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
