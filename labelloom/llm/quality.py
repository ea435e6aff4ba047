"""Document quality: a generalised additive model with pairwise interactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame

from labelloom.llm.labels import SAMPLE_ROWS, labelled_sample
from labelloom.llm.words import chunk_shingles, chunk_words, chunks

# --- Fixed values: the characters whose shares are features ---------------------
SIGNS = ("!", "?", ".", ",", "%", "&", "$", "#", "*", "|", "=", "<", "{", "/", "-", '"')
# ------------------------------------------------------------------------------
FEATURES = (
    "log_bytes", "lower", "upper", "digit", "space", "line_feed", "non_ascii", "other_sign", *(f"sign_{c}" for c in SIGNS),
    "word_length", "words_per_line", "distinct_words", "repeated_shingles", "repeated_lines", "log_longest_line",
)
BINS = 32
PAIR_BINS = 8
PAIRS = 12


def _range(*spans: tuple[str, str]) -> np.ndarray:
    mask = np.zeros(256, dtype=bool)
    for first, last in spans:
        mask[ord(first) : ord(last) + 1] = True
    return mask


_LOWER, _UPPER, _DIGIT = _range(("a", "z")), _range(("A", "Z")), _range(("0", "9"))
_SPACE = _range((" ", " "), ("\t", "\r"))
_HIGH = _range(("\x80", "\xff"))
_SIGN = ~(_LOWER | _UPPER | _DIGIT | _SPACE | _HIGH)


def _byte_shares(text: str) -> list[float]:
    counts = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    n = max(int(counts.sum()), 1)
    kinds = [counts[m].sum() / n for m in (_LOWER, _UPPER, _DIGIT, _SPACE)]
    signs = [counts[ord(c)] / n for c in SIGNS]
    rest = counts[_SIGN].sum() / n - sum(signs)
    return [np.log1p(counts.sum()), *kinds, counts[10] / n, counts[_HIGH].sum() / n, rest, *signs]


def features(texts: list[str | None]) -> np.ndarray:
    """One row of ``FEATURES`` per whole text; null counts as empty."""
    out = np.zeros((len(texts), len(FEATURES)))
    shared = len(FEATURES) - 6
    for first, last, held in chunks(texts):
        hashes, at = chunk_words(held)
        shingles, sat = chunk_shingles(hashes, at)
        for i in range(first, last):
            text, j = texts[i] or "", i - first
            words, grams = hashes[at[j] : at[j + 1]], shingles[sat[j] : sat[j + 1]]
            lines = text.split("\n")
            out[i, :shared] = _byte_shares(text)
            letters = out[i, 1] + out[i, 2] + out[i, 3] + out[i, 6]
            out[i, shared:] = (
                letters * len(held[j]) / max(len(words), 1),
                len(words) / len(lines),
                len(np.unique(words)) / max(len(words), 1),
                1 - len(np.unique(grams)) / max(len(grams), 1),
                1 - len(set(lines)) / len(lines),
                np.log1p(max(map(len, lines))),
            )
    return out


@dataclass
class AdditiveModel:
    """A lookup table per feature and per chosen pair of features, summed to a log-odds."""

    bias: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, by looking up bins and adding."""
        total = np.full(len(x), self.bias)
        if self.tables:
            b = self.bins(x)
            for j, table in enumerate(self.tables):
                total += table[b[:, j]]
            coarse = b * PAIR_BINS // BINS
            for (i, j), table in zip(self.pairs, self.pair_tables):
                total += table[coarse[:, i], coarse[:, j]]
        return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def _best_step(g: np.ndarray, h: np.ndarray, rate: float, least: float = 1.0) -> np.ndarray:
    """A tree of three leaves over ordered bins: two cuts, the second in the better side."""

    def cut(lo: int, hi: int) -> tuple[float, int]:
        gs, hs = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        if not len(gs):
            return 0.0, hi
        ga, ha = g[lo:hi].sum(), h[lo:hi].sum()
        gain = gs**2 / (hs + least) + (ga - gs) ** 2 / (ha - hs + least) - ga**2 / (ha + least)
        at = int(np.argmax(gain))
        return float(gain[at]), lo + at + 1

    _, first = cut(0, len(g))
    parts = [(0, first), (first, len(g))]
    found = [cut(*p) for p in parts]
    side = int(found[1][0] > found[0][0])
    spans = [parts[1 - side], (parts[side][0], found[side][1]), (found[side][1], parts[side][1])]
    step = np.zeros(len(g))
    for lo, hi in spans:
        if hi > lo:
            step[lo:hi] = -rate * g[lo:hi].sum() / (h[lo:hi].sum() + least)
    return step


def _best_quarters(g: np.ndarray, h: np.ndarray, rate: float, least: float = 1.0) -> np.ndarray:
    """A tree of depth two over a grid: one cut on each axis, four leaves."""
    gs, hs = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    ends = np.arange(1, len(g))

    def corner(s: np.ndarray) -> list[np.ndarray]:
        a = s[:-1, :-1]
        top, left = s[:-1, -1:] - a, s[-1:, :-1] - a
        return [a, top, left, s[-1, -1] - a - top - left]

    gain = sum(x**2 / (y + least) for x, y in zip(corner(gs), corner(hs)))
    i, j = (ends[k] for k in np.unravel_index(int(np.argmax(gain)), gain.shape))
    step = np.zeros_like(g)
    for r, c in ((slice(0, i), slice(0, j)), (slice(0, i), slice(j, None)), (slice(i, None), slice(0, j)), (slice(i, None), slice(j, None))):
        step[r, c] = -rate * g[r, c].sum() / (h[r, c].sum() + least)
    return step


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 150, pair_rounds: int = 60, rate: float = 0.15) -> AdditiveModel:
    """Cyclic boosting: every round gives each feature, then each pair, one shallow tree.

    Pairs are the ``PAIRS`` whose grid explains most of what the single features
    leave. Without rows the model is 0.5 everywhere; with one class it is the
    smoothed share of that class.
    """
    share = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(bias=float(np.log(share / (1 - share))))
    if not 0 < y.sum() < len(y):
        return model
    model.edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    model.tables = [np.zeros(BINS) for _ in model.edges]
    b = model.bins(x)
    total = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = _best_step(np.bincount(b[:, j], g, BINS), np.bincount(b[:, j], h, BINS), rate)
            table += step
            total += step[b[:, j]]
    coarse, size = b * PAIR_BINS // BINS, PAIR_BINS * PAIR_BINS
    cells = {(i, j): coarse[:, i] * PAIR_BINS + coarse[:, j] for i in range(x.shape[1]) for j in range(i)}
    g, h = slopes()
    gain = {p: (np.bincount(c, g, size) ** 2 / (np.bincount(c, h, size) + 1)).sum() for p, c in cells.items()}
    model.pairs = sorted(gain, key=lambda p: (-gain[p], p))[:PAIRS]
    model.pair_tables = [np.zeros((PAIR_BINS, PAIR_BINS)) for _ in model.pairs]
    for _ in range(pair_rounds):
        for p, table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            grids = (np.bincount(cells[p], v, size).reshape(PAIR_BINS, PAIR_BINS) for v in (g, h))
            step = _best_quarters(*grids, rate)
            table += step
            total += step.ravel()[cells[p]]
    return model


def fit_quality(
    docs: DataFrame, labels: DataFrame, target: str, learn: Column, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE_ROWS
) -> AdditiveModel:
    """The model of ``target`` from at most ``limit`` labelled documents for which ``learn`` holds.

    Features are computed on the executors; the driver sees one row of numbers
    per sampled document. Only the text is an input.
    """

    def numbers(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"y": part["y"], "id": part["id"], "x": list(features(part["text"].tolist()))})

    sample = labelled_sample(docs, labels, target, id_col, text_col, learn, limit)
    rows = sample.mapInPandas(numbers, "y int, id long, x array<double>").toPandas()
    if not len(rows):
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0))
    rows = rows.sort_values(["id", "y"], kind="stable")
    return fit(np.stack(rows["x"]), rows["y"].clip(0, 1).to_numpy(dtype=float))


def score_quality(docs: DataFrame, model: AdditiveModel, text_col: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is of label 1; an input column named ``output`` is replaced.

    Null and empty texts are scored as a text of no characters.
    """
    from pyspark.sql import functions as F

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model.score(features(part.tolist())))

    return docs.withColumn(output, scored(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
