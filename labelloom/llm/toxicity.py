"""Toxicity of texts, scored after a noisy-channel decoding of disguised words."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from labelloom.llm.labels import SAMPLE_ROWS, labelled_sample

# --- Fixed values: signs that stand for letters, and the letters they may stand for ---
DISGUISES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¥": "y",
}
SEPARATORS = " .-_*~'/\\,"
ACCENTED = "àâäáãåæçèéêëìíîïñòóôöõøœùúûüýÿß"
# ------------------------------------------------------------------------------
LETTERS = "abcdefghijklmnopqrstuvwxyz" + ACCENTED
BOUNDARY, OTHER, SYMBOLS = 0, 62, 64
SWAP, DROP, DROP_SIGN = 1.0, 0.7, 8.0  # costs of reading a sign as a letter, of dropping a repeat or separator, of dropping a sign
MAX_TERMS = 5_000
LEAST_DOCS = 5
PREFIXES = (4, 5, 6)
LEAST_EVIDENCE = 22.0  # of a log-likelihood ratio, so that of a million terms none passes by chance

_CODE = np.full(0x250, BOUNDARY, dtype=np.int64)
for _c in range(0x250):
    if chr(_c).isalpha():
        _CODE[_c] = OTHER
for _i, _letter in enumerate(LETTERS):
    _CODE[ord(_letter)] = _i + 1
_SIGNS = re.escape("".join(DISGUISES))
_CARRIER = _CODE > 0  # what may be a letter of a disguised word
for _sign in DISGUISES:
    if ord(_sign) < 0x250:
        _CARRIER[ord(_sign)] = True
# Words with signs inside or before their letters, as a whole piece and within one; single letters pulled apart; a letter three times or more.
_MIXED = re.compile(rf"[^\W\d_{_SIGNS}]*(?:[^\W\d_][{_SIGNS}]+|[{_SIGNS}]+[^\W\d_])(?:[^\W\d_]|[{_SIGNS}])*")
_SIGN = re.compile(rf"[{_SIGNS}]")
_SPAN = re.compile(rf"(?:[^\W\d_]|[{_SIGNS}])+")
_APART = re.compile(
    rf"(?<![\w{_SIGNS}])(?:[^\W\d_]|[{_SIGNS}])(?:[{re.escape(SEPARATORS)}]{{1,2}}(?:[^\W\d_]|[{_SIGNS}])){{2,}}(?![\w{_SIGNS}])"
)
_WORDS = re.compile(r"[^\W\d_]+")
OPENING, CLOSING = "(<!|+¡", ".,;:!?)]\"'…"


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)


def _without_signs(text: str, single: str) -> str:
    """The text less the signs at its front: any of ``single``, and others that stand twice or more. One walk over it."""
    at = 0
    while at < len(text):
        c, end = text[at], at + 1
        while end < len(text) and text[end] == c:
            end += 1
        if c.isalnum() or c == "_" or c.isspace() or (end == at + 1 and c not in single):
            break
        at = end
    return text[at:]


def headless(text: str) -> str:
    """The text without the signs that open a phrase."""
    return _without_signs(text, OPENING)


def tailless(text: str) -> str:
    """The text without the signs that close a phrase."""
    return _without_signs(text[::-1], CLOSING)[::-1]


def pulled_apart(points: np.ndarray) -> bool:
    """Whether three single letters or signs follow each other with one or two characters between."""
    carrier = np.concatenate([[False], np.where(points < 0x250, _CARRIER[np.minimum(points, 0x24F)], True), [False]])
    single = np.flatnonzero(carrier[1:-1] & ~carrier[:-2] & ~carrier[2:])
    close = np.diff(single) <= 3
    return bool((close[:-1] & close[1:]).any())


def tripled(text: str, points: np.ndarray) -> set[str]:
    """The words of any script in which a letter comes three times or more."""
    same = points[1:] == points[:-1]
    found, seen = set(), 0
    for at in np.flatnonzero(same[:-1] & same[1:]).tolist():
        if at < seen or not text[at].isalpha():
            continue
        low, seen = at, at
        while low and text[low - 1].isalpha():
            low -= 1
        while seen < len(text) and text[seen].isalpha():
            seen += 1
        found.add(text[low:seen])
    return found


def disguised(text: str, odd: list[str]) -> set[str]:
    """The words of a lower-cased text that may hide another one.

    ``odd`` are its space-separated pieces that are not letters alone. A word is
    disguised when signs stand inside or before its letters, in whatever quotes,
    brackets or compound it stands, when a letter comes three times or more, or
    when three or more single letters are pulled apart (of four and more, also
    without the first or the last, which may be words of one letter; three need a
    letter among them, as figures come in threes). Signs that also open a phrase
    are read both ways.
    """
    found = set()
    for piece in odd:
        bare = tailless(piece)
        if bare.isalpha() or not _SIGN.search(bare):
            continue
        whole = [bare] if _MIXED.fullmatch(bare) else [tailless(x) for x in _SPAN.findall(piece)]
        for word in whole:
            for reading in {word, headless(word)}:
                if not reading.isalpha() and _MIXED.fullmatch(reading):
                    found.add(reading)
    points = _points(text)
    found |= tripled(text, points)
    if pulled_apart(points):
        for m in _APART.finditer(text):
            run = m.group()
            n = sum(c not in SEPARATORS for c in run)
            if n == 3 and not any(c.isalpha() for c in run):
                continue
            tight = [x for x in run.split() if len(x) > 4]  # another separator than the space around it
            ends = (0, 2) if n > 3 else (0,)
            found.update(tight)
            if all(len(x) < 7 for x in tight):
                found.update(run[a : len(run) - b] for a in ends for b in ends)
    return found


def symbols(text: str) -> np.ndarray:
    """Symbol of each character of the lower-cased text: a letter, another letter, or a boundary."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    return np.where(points < 0x250, _CODE[np.minimum(points, 0x24F)], OTHER)


def trigram_codes(text: str) -> np.ndarray:
    s = np.concatenate([[BOUNDARY, BOUNDARY], symbols(text), [BOUNDARY]])
    return (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Cost (negative log probability) of each symbol after two others, from the trigrams of every text.

    Counts are summed on the executors; there are at most ``SYMBOLS ** 3`` of them.
    """

    def counted(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS**3, dtype=np.int64)
        for part in parts:
            for text in part["text"]:
                codes = trigram_codes(text)
                np.add.at(total, codes, 1)
        found = np.flatnonzero(total)
        yield pd.DataFrame({"code": found, "n": total[found]})

    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    rows = texts.mapInPandas(counted, "code int, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(SYMBOLS**3)
    n[rows["code"].to_numpy(dtype=int)] = rows["n"]
    n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = n.sum(axis=0), n.sum(axis=(0, 1))
    one = (one + 1) / (one + 1).sum()
    two = (two + 5 * one) / (two.sum(axis=1, keepdims=True) + 5)
    three = (n + 5 * two[None]) / (n.sum(axis=2, keepdims=True) + 5)
    return -np.log(three).astype(np.float32)


def decode(word: str, costs: np.ndarray) -> str:
    """The cheapest reading of a disguised word: a Viterbi search over the lattice of its characters.

    A letter reads as itself, or as nothing where it repeats the one before; a
    sign as each letter it may stand for, or as nothing; a separator as nothing.
    The state is the last two letters read, so the search is linear in the length.
    """
    paths: dict[tuple[int, int], tuple[float, tuple]] = {(BOUNDARY, BOUNDARY): (0.0, ())}
    before = ""
    for c in word.lower():
        if c.isalpha():
            options = [(c, 0.0)] + ([("", DROP)] if c == before else [])
        else:
            options = [(x, SWAP) for x in DISGUISES.get(c, "")] + [("", DROP if c in SEPARATORS else DROP_SIGN)]
        before = c
        nxt: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (cost, tail) in paths.items():
            for letter, extra in options:
                if letter:
                    s = int(_CODE[ord(letter)]) if ord(letter) < 0x250 else OTHER
                    state, total, read = (b, s), cost + extra + float(costs[a, b, s]), (tail, letter)
                else:
                    state, total, read = (a, b), cost + extra, tail
                if state not in nxt or total < nxt[state][0]:
                    nxt[state] = (total, read)
        paths = nxt
    _, tail = min(((cost + float(costs[a, b, BOUNDARY]), read) for (a, b), (cost, read) in paths.items()), key=lambda x: x[0])
    letters = []
    while tail:
        tail, letter = tail
        letters.append(letter)
    return "".join(reversed(letters))


class Restorer:
    """Words of whole texts with disguised ones decoded; remembers recent decodings."""

    def __init__(self, costs: np.ndarray, most: int = 200_000):
        self.costs, self.most, self.seen = costs, most, {}

    def restored(self, word: str) -> str:
        if word not in self.seen:
            if len(self.seen) >= self.most:
                self.seen.clear()
            self.seen[word] = decode(word, self.costs)
        return self.seen[word]

    def words(self, text: str) -> tuple[set[str], set[str]]:
        """``(plain words, restored words)``, lower-cased."""
        text = text.lower()
        pieces = set(text.split())
        plain = {p for p in pieces if p.isalpha()}
        odd = [p for p in pieces if not p.isalpha()]
        plain.update(_WORDS.findall(" ".join(odd)))
        found = {self.restored(w) for w in disguised(text, odd)}
        return plain, {w for w in found if w}


def terms(words: set[str]) -> set[str]:
    """The words and their first letters: ``w:`` whole, ``4:`` to ``6:`` prefixes."""
    out = {"w:" + w for w in words}
    for k in PREFIXES:
        out |= {f"{k}:" + w[:k] for w in words if len(w) > k}
    return out


@dataclass
class ToxicityModel:
    """Letter costs, the terms that speak for toxicity with their weights, and a calibration."""

    costs: np.ndarray
    weights: dict[str, float] = field(default_factory=dict)
    slope: np.ndarray = field(default_factory=lambda: np.zeros(4))
    share: float = 0.05

    def evidence(self, restorer: Restorer, text: str) -> tuple[float, float, float]:
        """Largest weight, sum of each distinct word's largest weight, and that sum over the root of the text's size."""
        plain, restored = restorer.words(text)
        found = []
        for w in plain | restored:
            best = self.weights.get("w:" + w, 0.0)
            for k in PREFIXES:
                if len(w) > k:
                    best = max(best, self.weights.get(f"{k}:" + w[:k], 0.0))
            if best:
                found.append(best)
        total = sum(found)
        return (max(found, default=0.0), min(total, 60.0), min(total / np.sqrt(1 + len(plain) / 100), 60.0))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope[0] + x @ self.slope[1:], -35, 35)))


def _calibrated(x: np.ndarray, y: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    a = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w = np.zeros(a.shape[1])
    keep = np.diag([1e-6, *[ridge] * x.shape[1]])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -35, 35)))
        w = w - np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + keep + 1e-9 * np.eye(len(w)), a.T @ (p - y) + keep @ w)
    return w


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, target: str, learn: Column, id_col: str = "doc_id", text_col: str = "text", limit: int = SAMPLE_ROWS
) -> ToxicityModel:
    """The model from at most ``limit`` labelled documents for which ``learn`` holds; letter costs from all.

    Terms (words and their first letters, after restoring disguised words) are
    counted per class on the executors. The ``MAX_TERMS`` that lean most to
    label 1 keep their log-odds as weight; three sums of them per text are then
    calibrated. Without both classes every text scores the share of label 1.
    """
    spark = docs.sparkSession
    model = ToxicityModel(language_model(docs, text_col))
    costs = spark.sparkContext.broadcast(model.costs)
    sample = labelled_sample(docs, labels, target, id_col, text_col, learn, limit)

    def listed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(costs.value)
        for part in parts:
            for y, text in zip(part["y"], part["text"]):
                plain, restored = restorer.words(text)
                found = sorted(terms(plain | restored))
                yield pd.DataFrame({"term": found, "y": int(y > 0)})

    per_term = sample.select("y", "text").mapInPandas(listed, "term string, y int")
    per_term = per_term.groupBy("term").agg(F.sum("y").alias("pos"), F.count(F.lit(1)).alias("docs"))
    odds = F.expr("ln((pos + 0.2) / (all_pos + 1)) - ln((docs - pos + 0.2) / (all_docs - all_pos + 1))")
    size = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum((F.col("y") > 0).cast("int")), F.lit(0)).alias("pos")).first()
    n, pos = size["n"], size["pos"]
    if not 0 < pos < n:
        model.share = (pos + 0.5) / (n + 10)
        model.slope = np.array([np.log(model.share / (1 - model.share)), 0.0, 0.0, 0.0])
        return model
    heavy = per_term.where(F.col("pos") >= LEAST_DOCS)
    heavy = heavy.withColumn("all_pos", F.lit(pos)).withColumn("all_docs", F.lit(n)).withColumn("odds", odds)
    expected = "docs * all_pos / all_docs"
    ratio = f"2 * (pos * ln(pos / ({expected})) + (docs - pos) * ln(greatest(docs - pos, 0.5) / (docs - {expected})))"
    heavy = heavy.where(f"odds > 2 AND {ratio} > {LEAST_EVIDENCE}").orderBy(F.desc("odds"), "term").limit(MAX_TERMS).collect()
    model.weights = {r["term"]: float(r["odds"]) for r in heavy}
    shared = spark.sparkContext.broadcast(model)

    def weighed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        restorer = Restorer(shared.value.costs)
        for part in parts:
            yield pd.DataFrame({"y": part["y"], "x": [list(shared.value.evidence(restorer, t)) for t in part["text"]]})

    rows = sample.select("y", "text").mapInPandas(weighed, "y int, x array<double>").toPandas()
    model.slope = _calibrated(np.stack(rows["x"]), (rows["y"] > 0).to_numpy(dtype=float))
    return model


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", output: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic; an input column named ``output`` is replaced.

    Null and empty texts have no evidence and get the score of that.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        restorer = Restorer(shared.value.costs)
        for part in parts:
            x = np.array([shared.value.evidence(restorer, t) for t in part]).reshape(len(part), 3)
            yield pd.Series(shared.value.probability(x))

    return docs.withColumn(output, scored(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
