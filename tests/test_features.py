import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.functions import ngrams
from labelloom.operators import features, lookup, vocabulary
from labelloom.plans.staging import stage

DOCS = [(1, ["a", "b", "a"]), (2, []), (3, ["c", "b"]), (4, ["z"]), (5, ["b", "b", "c", "a"])]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(DOCS, "id int, tokens array<string>")
    return df.withColumn("terms", ngrams("tokens"))


def brute_force(k):
    grams = {i: t + [f"{x} {y}" for x, y in zip(t, t[1:])] for i, t in DOCS}
    cf = Counter(g for gs in grams.values() for g in gs)
    df = Counter(g for gs in grams.values() for g in set(gs))
    kept = sorted(sorted(cf, key=lambda t: (-cf[t], t))[:k])
    idf = {t: math.log((1 + len(DOCS)) / (1 + df[t])) + 1 for t in kept}
    out = {}
    for i, gs in grams.items():
        weights = {t: n * idf[t] for t, n in Counter(gs).items() if t in idf}
        norm = math.sqrt(sum(w * w for w in weights.values()))
        out.update({(i, t): w / norm for t, w in weights.items()})
    return kept, out


@pytest.mark.parametrize("k", [3, 100])
def test_tfidf_both_ways(docs, k):
    kept, expected = brute_force(k)
    vocabulary = features.fit_vocabulary(docs, "terms", k)
    assert [r["term"] for r in vocabulary.orderBy("idx").collect()] == kept
    for bounds in ({}, {"max_rows": 0}):
        got = {(r["id"], r["term"]): r["tfidf"] for r in features.tfidf(docs, vocabulary, "id", "terms", **bounds).collect()}
        assert got.keys() == expected.keys()
        assert all(math.isclose(got[key], expected[key]) for key in got)


def test_large_vocabularies_are_numbered_the_same(docs, monkeypatch):
    small = features.fit_vocabulary(docs, "terms", 6).orderBy("idx").collect()
    monkeypatch.setattr(features, "MAX_SHARED_ROWS", 1)
    assert features.fit_vocabulary(docs, "terms", 6).orderBy("idx").collect() == small


def test_top_terms_merged_in_groups(spark, monkeypatch):
    stats = spark.range(0, 5000, 1, 16).selectExpr("CAST(id % 700 AS STRING) || 'x' || id AS term", "id % 37 AS cf", "1L AS df")
    plain = vocabulary.top_terms(stats, 900).collect()
    monkeypatch.setattr(vocabulary, "MAX_MERGED_ROWS", 1)
    grouped = vocabulary.top_terms(stats, 900)
    assert "WindowGroupLimit" in grouped._jdf.queryExecution().executedPlan().toString()
    assert grouped.collect() == plain and len(plain) == 900


def test_vectors(docs):
    vocabulary = features.fit_vocabulary(docs, "terms", 4)
    vectors = {r["id"]: r["features"] for r in features.vectorize(docs, vocabulary, "terms").collect()}
    assert vectors[2].numNonzeros() == 0 and vectors[4].numNonzeros() == 0
    assert math.isclose(vectors[1].norm(2), 1)
    long = features.tfidf(docs, vocabulary, "id", "terms")
    joined = {r["id"]: r["features"] for r in features.to_vectors(long, "id", 4).collect()}
    assert joined.keys() == {1, 3, 5}
    for i, v in joined.items():
        assert v.indices.tolist() == vectors[i].indices.tolist()
        assert all(math.isclose(x, y) for x, y in zip(v.values, vectors[i].values))


def zipf(spark, n=400):
    """Few frequent terms, many that occur once."""
    words = F.transform(F.sequence(F.lit(1), F.lit(30)), lambda j: F.concat(F.lit("t"), F.floor(F.pow(F.pmod(F.xxhash64("id", j), F.lit(100_003)) / 1_000, F.lit(2))).cast("string")))
    return stage(spark.range(0, n, 1, 6).select("id", words.alias("terms")))


@pytest.mark.parametrize("k, capacity", [(1, 5), (3, 40), (10, 100), (40, 200), (100, 150), (5_000, 6_000), (9_000, 10)])
def test_summaries_give_the_same_vocabulary(spark, k, capacity):
    docs = zipf(spark)
    plain = features.fit_vocabulary(docs, "terms", k).orderBy("idx").collect()
    assert features.fit_vocabulary(docs, "terms", k, summary_from=0, capacity=capacity).orderBy("idx").collect() == plain


def test_a_summary_falls_short_by_what_it_lost():
    rng, summary, true = random.Random(1), vocabulary.Summary(20), Counter()
    for _ in range(50):
        part = Counter(str(int(rng.paretovariate(0.6))) for _ in range(100))
        true.update(part)
        summary.add(list(part), list(part.values()), [1] * len(part))
        assert len(summary.counts) <= 40
    assert summary.lost > 0
    for term, n in true.items():
        assert n - summary.lost <= summary.counts.get(term, (0, 0))[0] <= n


def test_a_summarised_vocabulary_shuffles_summaries_only(spark):
    docs = zipf(spark)
    rows = vocabulary.summaries(docs, "terms", 30)
    assert rows.count() <= 6 * 60 + 1 and rows.where("term IS NULL").first()["cf"] > 0
    assert vocabulary.frequent_terms(docs, "terms", 3, 400).count() < docs.selectExpr("explode(terms) t").distinct().count() / 4


def test_awkward_terms_are_summarised(spark):
    docs = spark.createDataFrame([(1, None), (2, []), (3, ["a", None, "a", "b"]), (4, [""])], "id int, terms array<string>")
    got = {r["term"]: (r["cf"], r["df"]) for r in vocabulary.frequent_terms(docs, "terms", 5).collect()}
    assert got == {"a": (2, 1), "b": (1, 1), "": (1, 1)}


@pytest.mark.parametrize("id_col, salt", [("id", 1), (None, 1), (None, 1_000)])
def test_joined_vectors_equal_those_of_the_stages(spark, monkeypatch, id_col, salt):
    monkeypatch.setattr(features, "ROWS_PER_SALT", salt)
    docs = zipf(spark, 60).unionByName(spark.createDataFrame([(900, None), (901, []), (902, ["foreign"])], "id long, terms array<string>"))
    vocab = features.fit_vocabulary(docs, "terms", 50)
    plain = {r["id"]: r["features"] for r in features.vectorize(docs, vocab, "terms").collect()}
    joined = features.vectorize(docs, vocab, "terms", id_col=id_col, max_rows=0)
    assert joined.columns == ["id", "terms", "features"]
    got = {r["id"]: r["features"] for r in joined.collect()}
    assert got.keys() == plain.keys() and len(got) == 63
    for i, v in got.items():
        assert v.size == plain[i].size and v.indices.tolist() == plain[i].indices.tolist() and np.allclose(v.values, plain[i].values)


def test_the_filter_keeps_all_terms_and_few_others(spark):
    vocab = spark.range(2_000).selectExpr("CAST(id AS STRING) AS term")
    docs = spark.range(40).selectExpr("id", "transform(sequence(0, 99), i -> CAST(id * 100 + i AS STRING)) AS terms")
    kept = docs.select(features._known_terms(docs, vocab, "terms").alias("k")).selectExpr("explode(k) AS t").collect()
    known = {r["t"] for r in kept}
    assert {str(i) for i in range(2_000)} <= known and len(known) < 2_100


def test_vectorizing_needs_no_shuffle_and_no_python(docs):
    vocabulary = features.fit_vocabulary(docs, "terms", 4)
    plan = features.vectorize(docs, vocabulary, "terms")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_beyond_the_bound_nothing_is_broadcast(docs):
    vocabulary = features.fit_vocabulary(docs, "terms", 4)
    joined = features.tfidf(docs, vocabulary, "id", "terms", max_rows=0)
    lemmas = vocabulary.selectExpr("term AS surface", "'n' AS pos", "term AS lemma")
    looked_up = lookup.lemmatize(docs, "tokens", lemmas, "id", max_rows=0)
    for df in (joined, looked_up):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


BOUNDS = [{}, {"max_rows": 0}]


@pytest.mark.parametrize("bounds", BOUNDS)
def test_lemmatize(spark, bounds):
    df = spark.createDataFrame(
        [(1, ["dogs", "running", "leaves"], ["NNS", "VBG", "VBZ"]), (2, [], []), (3, ["leaves", "xs"], ["NNS", "RB"])],
        "id int, tokens array<string>, tags array<string>",
    )
    lemmas = spark.createDataFrame(
        [("dogs", "n", "dog"), ("running", "v", "run"), ("leaves", "v", "leave"), ("leaves", "n", "leaf")],
        "surface string, pos string, lemma string",
    )
    tagged = {r["id"]: r["lemmas"] for r in lookup.lemmatize(df, "tokens", lemmas, "id", "tags", **bounds).collect()}
    assert tagged == {1: ["dog", "run", "leave"], 2: [], 3: ["leaf", "xs"]}
    nouns = {r["id"]: r["lemmas"] for r in lookup.lemmatize(df, "tokens", lemmas, "id", **bounds).collect()}
    assert nouns == {1: ["dog", "running", "leaf"], 2: [], 3: ["leaf", "xs"]}


@pytest.mark.parametrize("bounds", BOUNDS)
@pytest.mark.parametrize("id_col", ["id", None])
def test_lemmas_by_rule(spark, bounds, id_col):
    words = ["dogs", "boxes", "wolves", "wives", "running", "baking", "larger", "mice", "men", "glass", "xyzs", "s", ""]
    df = spark.createDataFrame([(1, words, ["NNS"] * 4 + ["VBG", "VBG", "JJR"] + ["NN"] * 6), (2, [], []), (3, None, None), (4, ["dogs", "mice"], ["VBZ", "RB"])],
                               "id int, tokens array<string>, tags array<string>")
    known = [("dog", "n"), ("box", "n"), ("boxe", "n"), ("wolf", "n"), ("wive", "n"), ("run", "v"), ("runn", "v"), ("bake", "v"), ("large", "a"), ("man", "n"), ("men", "n"), ("glass", "n"), ("glas", "v")]
    irregular = [("mice", "n", "mouse"), ("wives", "n", "wife"), ("wives", "n", "wifes")]
    found = lookup.lemmatize_by_rule(
        df, "tokens", spark.createDataFrame(known, "lemma string, pos string"), spark.createDataFrame(irregular, "surface string, pos string, lemma string"), id_col, "tags", **bounds
    )
    assert found.columns == ["id", "tokens", "tags", "lemmas"]
    got = {r["id"]: r["lemmas"] for r in found.collect()}
    assert got[1] == ["dog", "box", "wolf", "wife", "runn", "bake", "large", "mouse", "men", "glass", "xyzs", "s", ""]
    assert got[2] == [] and got[3] is None and got[4] == ["dogs", "mice"]
    nouns = lookup.lemmatize_by_rule(df, "tokens", spark.createDataFrame(known, "lemma string, pos string"), None, id_col, **bounds)
    assert {r["id"]: r["lemmas"] for r in nouns.collect()}[4] == ["dog", "mice"]


def test_word_tags(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (2, None)], "id int, tokens array<string>")
    tagged = spark.createDataFrame([("a", "VBG")], "surface string, tag string")
    assert {r["id"]: r["tags"] for r in lookup.word_tags(df, "tokens", tagged, "id").collect()} == {1: ["VBG", "NN"], 2: None}


def test_numbering_follows_the_order_of_any_script(spark):
    from labelloom.operators.ranking import numbered

    terms = sorted({chr(c) * n + str(c % 7) for c in [*range(97, 110), *range(0x4E00, 0x4E60), *range(0x430, 0x440)] for n in (1, 2, 5)}, key=lambda t: t.encode())
    df = spark.createDataFrame([(t,) for t in terms], "term string").repartition(7)
    assert [r["term"] for r in numbered(df, "term").orderBy("idx").collect()] == terms
    assert sorted(r["idx"] for r in numbered(df, "term").collect()) == list(range(len(terms)))
    assert numbered(df.where("false"), "term").count() == 0


@pytest.mark.parametrize("bounds", BOUNDS)
def test_stopword_table(spark, bounds):
    df = spark.createDataFrame([(1, ["a", "b", "a", "c"]), (2, ["a"])], "id int, tokens array<string>")
    stop = spark.createDataFrame([("a",), ("c",), ("a",)], "word string")
    out = {r["id"]: r["kept"] for r in lookup.remove_stopwords_table(df, "tokens", stop, "id", **bounds).collect()}
    assert out == {1: ["b"], 2: []}


@pytest.mark.parametrize("bounds", BOUNDS)
@pytest.mark.parametrize("size", [0, 1, 2, 128, 129])
def test_fixed_length(spark, bounds, size):
    words = ["x", "q"] * size
    df = spark.createDataFrame([(1, words[:size])], "id int, tokens array<string>")
    vocabulary = spark.createDataFrame([("w", 0), ("x", 1)], "term string, idx int")
    row = lookup.encode_fixed_length(df, "tokens", vocabulary, "id", **bounds).first()
    n = min(size, 128)
    assert row["input_ids"] == [3 if i % 2 == 0 else 1 for i in range(n)] + [0] * (128 - n)
    assert row["attention_mask"] == [1] * n + [0] * (128 - n)


def test_lookup_many_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = spark.range(100).select("id", F.transform(F.sequence(F.lit(1), F.col("id") % 5 + 1), lambda i: i.cast("string")).alias("t"))
        table = spark.createDataFrame([("2", "two"), ("4", "four")], "key string, value string")
        out = lookup.lookup_array(df, "t", table, "id", "t", "o").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    names = {"2": "two", "4": "four"}
    assert len(out) == 100 and all(r["o"] == [names.get(x, x) for x in r["t"]] for r in out)


@pytest.mark.parametrize("max_rows", [1_000_000, 0])
def test_lookup_is_the_same_by_copy_and_by_join(spark, max_rows):
    df = spark.createDataFrame([(1, ["cats", "dogs"]), (2, None), (3, [])], "id long, t array<string>")
    lemmas = spark.createDataFrame(
        [("cats", "n", "kitty"), ("cats", "n", "cat"), ("dogs", "v", "dog")], "surface string, pos string, lemma string"
    )
    found = lookup.lemmatize(df, "t", lemmas, "id", max_rows=max_rows)
    assert {r["id"]: r["lemmas"] for r in found.collect()} == {1: ["cat", "dogs"], 2: None, 3: []}


def test_vectorizer_tokens(spark):
    from labelloom.functions.text import vectorizer_tokens

    df = spark.createDataFrame([("Two  Spaces a u, cat_1 É é2",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(vectorizer_tokens("t")).collect()] == [["two", "spaces", "cat_1", "é2"], [], []]


def test_a_large_dictionary_joins_only_what_it_may_hold(spark):
    df = spark.range(50).select("id", F.split(F.concat_ws(" ", F.lit("cats and the"), F.col("id")), " ").alias("t"))
    lemmas = spark.createDataFrame([("cats", "n", "cat")], "surface string, pos string, lemma string")
    found = lookup.lemmatize(df, "t", lemmas, "id", max_rows=0)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Join Inner, .*key#\d+ = key#\d+", plan) and not re.search(r"Join LeftOuter, .*key#\d+ = key#\d+", plan)
    assert {r["id"]: r["lemmas"] for r in found.collect()} == {i: ["cat", "and", "the", str(i)] for i in range(50)}


def test_ids_that_repeat_share_a_list_in_the_join(spark):
    df = spark.createDataFrame([(1, ["cats"]), (1, ["cats"]), (2, ["x"]), (None, ["cats"])], "id int, t array<string>")
    lemmas = spark.createDataFrame([("cats", "n", "cat")], "surface string, pos string, lemma string")
    found = lookup.lemmatize(df, "t", lemmas, "id", max_rows=0).collect()
    assert sorted((r["id"] or 0, r["lemmas"]) for r in found) == [(0, []), (1, ["cat", "cat"]), (1, ["cat", "cat"]), (2, ["x"])]


def test_rules_look_up_each_token_once(spark, monkeypatch):
    slots, plain = [], lookup.lookup_array
    monkeypatch.setattr(lookup, "lookup_array", lambda df, keys, *a, **b: slots.append(df.select(F.max(F.size(keys))).first()[0]) or plain(df, keys, *a, **b))
    df = spark.createDataFrame([(1, ["dogs", "men", "x"])], "id int, t array<string>")
    known = spark.createDataFrame([("dog", "n"), ("man", "n")], "lemma string, pos string")
    found = lookup.lemmatize_by_rule(df, "t", known, None, "id")
    assert found.first()["lemmas"] == ["dog", "man", "x"] and slots == [3]


def test_summaries_count_a_row_once_whatever_the_slices(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(i, [rng.choice(["a", "b", "c", "d", None]) for _ in range(rng.randrange(9))] if i % 7 else None) for i in range(40)]
    docs = spark.createDataFrame(rows, "id int, terms array<string>").coalesce(2)
    monkeypatch.setattr(vocabulary, "SLICE", 3)
    monkeypatch.setattr(vocabulary, "stage", lambda df: df)
    found = {r["term"]: (r["cf"], r["df"]) for r in vocabulary.summaries(docs, "terms", 50).collect() if r["term"]}
    cf, df = Counter(t for _, ts in rows for t in ts or [] if t), Counter(t for _, ts in rows for t in set(ts or []) if t)
    assert found == {t: (cf[t], df[t]) for t in cf}


def test_the_filter_tests_terms_in_slices(spark, monkeypatch):
    monkeypatch.setattr(features, "FILTER_SLICE", 2)
    docs = spark.createDataFrame([(1, ["a", "b", "x", "a", "b"]), (2, None), (3, ["b"])], "id int, terms array<string>").coalesce(1)
    known = spark.createDataFrame([("a",), ("b",)], "term string")
    found = {r["id"]: r["m"] for r in docs.select("id", features.maybe_known(docs, known, "terms").alias("m")).collect()}
    assert found[1][:2] == found[1][3:] == [True, True] and len(found[1]) == 5 and found[2] == [] and found[3] == [True]
