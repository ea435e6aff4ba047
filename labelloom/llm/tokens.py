"""Token counts by a count-only Viterbi search over a unigram vocabulary."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, functions as F

# --- Fixed values of the tokenizer family: word mark, penalty of an unknown character ---
MARK = "▁"
UNKNOWN_PENALTY = 10.0
# ------------------------------------------------------------------------------
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MAX_CACHED_WORDS = 300_000
_WORD = re.compile(rf"{MARK}+[^{MARK}]*|[^{MARK}]+")


@dataclass
class Vocabulary:
    """Pieces with their log probabilities, without control, unknown and byte pieces; whether other characters count as bytes."""

    pieces: list[tuple[str, float]]
    byte_fallback: bool


def read_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    """The pieces of a model file as a unigram vocabulary.

    The scores of a unigram file are log probabilities and stay as they are. A
    file of merges has ranks in their place, whose sums mean nothing: its pieces,
    listed from the most frequent on, get those of Zipf's law, minus the
    logarithm of their place in the list.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    scores = [model.get_score(i) for i in ids]
    if all(x == int(x) for x in scores):
        scores = [-math.log(place + 1) for place in range(len(ids))]
    return Vocabulary([(model.id_to_piece(i), x) for i, x in zip(ids, scores)], any(model.is_byte(i) for i in range(model.get_piece_size())))


class UnigramCounter:
    """Counts the pieces of the best segmentation, without building it.

    Every space is a word mark, and one is put in front of the text. No piece
    of a usual vocabulary goes on with a mark after another sign, so a text is
    split in front of every run of marks and each word is segmented by itself,
    together with that run; where some piece does, the text stays whole. The
    automaton lists all pieces that end at a position; the best score so far and
    its piece count are carried along. Of equal scores the earliest start, that
    is the longest last piece, wins. A character that is no piece costs the least
    score less ten, and counts as its UTF-8 bytes where the vocabulary falls
    back to them, else as one per run.
    """

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces:
            if piece:
                self.trie.add_word(piece, (len(piece), score))
        self.trie.make_automaton()
        self.unknown = min((s for _, s in vocabulary.pieces), default=0.0) - UNKNOWN_PENALTY
        self.byte_pieces = vocabulary.byte_fallback
        self.whole = any(MARK in piece.lstrip(MARK) for piece, _ in vocabulary.pieces)
        self.seen: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Pieces of one word, its marks included."""
        known = self.seen.get(word)
        if known is None:
            if len(self.seen) >= MAX_CACHED_WORDS:
                self.seen.clear()
            known = self.seen[word] = self._search(word)
        return known

    def _search(self, word: str) -> int:
        n = len(word)
        score, count, last_unknown = [0.0] + [0.0] * n, [0] * (n + 1), [False] * (n + 1)
        done = 0

        def unknown_at(end: int, best: tuple | None) -> tuple:
            candidate = score[end - 1] + self.unknown
            if best is not None and not candidate > best[0]:
                return best
            c = word[end - 1]
            pieces = len(c.encode("utf-8", "replace")) if self.byte_pieces else int(not last_unknown[end - 1])
            return candidate, end - 1, count[end - 1] + pieces, True

        def settle(end: int, best: tuple | None, single: bool) -> None:
            if not single:
                best = unknown_at(end, best)
            score[end], _, count[end], last_unknown[end] = best

        best, single, at = None, False, 1
        for last, (length, value) in self.trie.iter(word):
            end = last + 1
            while at < end:
                settle(at, best, single)
                best, single, at = None, False, at + 1
            start = end - length
            candidate = score[start] + value
            single = single or length == 1
            if best is None or candidate > best[0] or candidate == best[0] and start < best[1]:
                best = (candidate, start, count[start] + 1, False)
        while at <= n:
            settle(at, best, single)
            best, single, at = None, False, at + 1
        return count[n]

    def text(self, text: str | None) -> int:
        """Tokens of a whole text; a null or empty one has none."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if self.whole:
            return self._search(marked)
        return sum(self.word(w) * n for w, n in Counter(_WORD.findall(marked)).items())


def count_tokens(docs: DataFrame, vocabulary: Vocabulary, text_col: str = "text", output: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of each whole text; an input column named ``output`` is replaced.

    The vocabulary is a parameter of fixed size; it goes to the workers once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    @F.pandas_udf("long")
    def counted(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = UnigramCounter(shared.value)
        for part in parts:
            yield part.map(counter.text)

    return docs.withColumn(output, counted(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
