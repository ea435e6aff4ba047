"""Language identification with error-correcting output codes."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

UNKNOWN = "und"
BUCKETS = 1 << 15
DOCS_PER_LANGUAGE = 2_000  # expected number of documents of each language that n-grams are counted in
AMBIGUOUS = 0.35  # a gap of weighted losses below this is flagged
SHARPNESS = 4.0
CHUNK = 1 << 19
_LETTER = re.compile(r"[^\W\d_]")
_NOT_LETTERS = re.compile(r"[\W\d_]+")


def trigrams(text: str) -> np.ndarray:
    """Buckets of the byte trigrams of the lower-cased text, other signs than letters being one space."""
    plain = " " + _NOT_LETTERS.sub(" ", text.lower()).strip() + " "
    b = np.frombuffer(plain.encode("utf-8", "replace"), dtype=np.uint8).astype(np.uint32)
    code = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return ((code * np.uint32(2654435761)) >> np.uint32(17)).astype(np.int64)


def codewords(n: int, seed: int = 7) -> np.ndarray:
    """One row of -1 / +1 per language: every split of up to six languages, else the best of many random codes."""
    if n <= 6:
        columns = [c for c in itertools.product((-1, 1), repeat=n) if c[:1] == (1,) and len(set(c)) == 2]
        return np.array(columns, dtype=np.float64).T.reshape(n, len(columns))
    rng, width = np.random.default_rng(seed), int(10 * np.ceil(np.log2(n)))
    best, most = None, -1
    for _ in range(100):
        code = rng.choice((-1.0, 1.0), size=(n, width))
        code[0, np.abs(code.sum(axis=0)) == n] *= -1  # a bit on which all agree says nothing
        apart = ((width - code @ code.T) / 2 + width * np.eye(n)).min()
        if apart > most:
            best, most = code, apart
    return best


@dataclass
class CodeModel:
    """Languages, their codewords, and a linear trigram classifier for each bit."""

    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bit_weight: np.ndarray

    def margins(self, text: str) -> np.ndarray:
        grams = trigrams(text)
        total = np.zeros(self.weights.shape[1])
        for at in range(0, len(grams), CHUNK):
            part = grams[at : at + CHUNK]
            if len(part) > BUCKETS:
                total += np.bincount(part, minlength=BUCKETS) @ self.weights
            else:
                total += self.weights[part].sum(axis=0, dtype=np.float64)
        return total / max(len(grams), 1)

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        """``(language, score, ambiguous)`` of a whole text."""
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        loss = np.log1p(np.exp(-SHARPNESS * self.code * np.clip(self.margins(text), -4, 4))) @ self.bit_weight
        order = np.argsort(loss, kind="stable")
        share = np.exp(-SHARPNESS * (loss - loss[order[0]]))
        gap = loss[order[1]] - loss[order[0]] if len(order) > 1 else np.inf
        return self.languages[order[0]], float(share[order[0]] / share.sum()), bool(gap < AMBIGUOUS)


def fit_from_counts(languages: list[str], counts: np.ndarray) -> CodeModel:
    """Bit classifiers from the trigram counts of each language.

    A bit's classifier is the log-odds of a trigram between the languages whose
    codewords have +1 and those with -1, each language weighing the same. Its
    margin is centred between the two sides and scaled so that the nearest
    language lies at 1; a bit counts by how far its sides are apart.
    """
    code = codewords(len(languages))
    share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
    weights, bit_weight = np.zeros((BUCKETS, code.shape[1])), np.zeros(code.shape[1])
    for b, bits in enumerate(code.T):
        w = np.log(share[bits > 0].mean(axis=0)) - np.log(share[bits < 0].mean(axis=0))
        expected = share @ w
        high, low = expected[bits > 0].min(), expected[bits < 0].max()
        half = max((high - low) / 2, 1e-3)
        weights[:, b] = (w - (high + low) / 2) / half
        bit_weight[b] = half
    return CodeModel(languages, code, weights.astype(np.float32), bit_weight / max(bit_weight.sum(), 1e-9))


def fit_language(docs: DataFrame, learn: Column, lang_col: str = "lang", id_col: str = "doc_id", text_col: str = "text") -> CodeModel:
    """The model from documents with a language for which ``learn`` holds.

    Every language gives an expected ``DOCS_PER_LANGUAGE`` documents, chosen by a
    hash of the id; one whose documents hold no letters has nothing to be known
    by and is never predicted. Trigrams are counted on the executors and summed;
    the driver gets ``BUCKETS`` numbers at most for each language, a language at
    a time, whatever the number of documents.
    """
    spark = docs.sparkSession
    known = docs.where(F.col(f"`{lang_col}`").isNotNull() & learn).select(
        F.col(f"`{lang_col}`").cast("string").alias("lang"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), F.xxhash64(f"`{id_col}`").alias("h")
    )
    sizes = known.groupBy("lang").count().collect()
    if not sizes:
        return CodeModel([], np.zeros((0, 0)), np.zeros((BUCKETS, 0)), np.zeros(0))
    rates = spark.createDataFrame([(r["lang"], float(min(1.0, DOCS_PER_LANGUAGE / r["count"]))) for r in sizes], "lang string, rate double")
    sample = known.join(F.broadcast(rates), "lang").where(F.pmod(F.col("h"), F.lit(1_000_000)) < F.col("rate") * 1_000_000)

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[str, np.ndarray] = {}
        for part in parts:
            for lang, text in zip(part["lang"], part["text"]):
                totals[lang] = totals.get(lang, 0) + np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in totals.items():
            found = np.flatnonzero(n)
            yield pd.DataFrame({"lang": lang, "bucket": found, "n": n[found]})

    counts = sample.select("lang", "text").mapInPandas(counted, "lang string, bucket int, n long")
    summed = counts.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    listed = summed.groupBy("lang").agg(F.collect_list("bucket").alias("buckets"), F.collect_list("n").alias("n")).orderBy("lang")
    languages, rows = [], []
    for r in listed.toLocalIterator():
        row = np.zeros(BUCKETS)
        row[r["buckets"]] = r["n"]
        languages.append(r["lang"])
        rows.append(row)
    table = np.array(rows).reshape(len(rows), BUCKETS)
    return fit_from_counts(languages, table)


def identify_language(docs: DataFrame, model: CodeModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``ambiguous``, from the whole text alone.

    A null text or one without a letter is ``und`` with score 0. Input columns
    of these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, ambiguous boolean")
    def decoded(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([shared.value.decode(t) for t in part], columns=["lang_pred", "score", "ambiguous"])

    others = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]
    marked = docs.select(*[f"`{c}`" for c in others], decoded(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("__found"))
    return marked.select(*[f"`{c}`" for c in others], "__found.lang_pred", "__found.score", "__found.ambiguous")
