"""Benchmark passages inside documents, found by greedy string tiling."""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from labelloom.llm.words import GOLDEN, SHINGLE, chunk_shingles, chunk_words, chunks, mix
from labelloom.plans.staging import stage

COVERAGE = 0.5
MAX_ITEMS, MAX_BYTES = 200_000, 16 * 1024 * 1024  # most of the benchmark that one pass copies to every executor
FILTER_BITS = 22
ITEM_EDGE, TEXT_EDGE = 1, 2  # in place of a word beyond the end
RESULT = "doc_id long, item_id long, tiles int, covered int, item_words int, coverage double"


def _beside(words: np.ndarray, offsets: np.ndarray, text: np.ndarray, place: np.ndarray, edge: int) -> np.ndarray:
    """The words at ``place`` of each text; ``edge`` where a text has none there."""
    out = np.full(len(place), edge, dtype=np.uint64)
    inside = (place >= 0) & (place < np.diff(offsets)[text])
    out[inside] = words[(offsets[text] + place)[inside]]
    return out


def _pair(keys: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """One hash of a seed and the word beside it."""
    return mix(keys ^ mix(beside + np.uint64(GOLDEN)))


@dataclass
class Postings:
    """Where each seed occurs, the occurrences of a seed in the order of the word beside it."""

    item: np.ndarray
    place: np.ndarray
    pairs: np.ndarray
    first: np.ndarray
    last: np.ndarray

    @classmethod
    def of(cls, keys: np.ndarray, item: np.ndarray, place: np.ndarray, beside: np.ndarray) -> "Postings":
        order = np.lexsort((beside, keys))
        pair = _pair(keys, beside)[order]
        starts = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]]) if len(pair) else np.empty(0, dtype=np.int64)
        ends, by = np.append(starts, len(pair))[1:], np.argsort(pair[starts], kind="stable")
        return cls(item[order], place[order], pair[starts][by], starts[by], ends[by])

    def other(self, low: np.ndarray, high: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(place in low, occurrence)`` of all occurrences from ``low`` to ``high`` that do not have the same word beside them."""
        skip, on = high.copy(), high.copy()
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            same = self.pairs[at] == pair
            skip[same], on[same] = self.first[at[same]], self.last[at[same]]
        starts, sizes = np.concatenate([low, on]), np.concatenate([skip - low, high - on])
        source = np.repeat(np.tile(np.arange(len(low)), 2), sizes)
        return source, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)


@dataclass
class Seeds:
    """Items of one seed length: their words, and where each run of ``least`` of them occurs, by fingerprint.

    A match that cannot be made longer begins where the words in front differ
    and ends where those behind do. Occurrences are kept in the order of either
    word, so those of a document's seed that go on a match are stepped over and
    a repeating text or a phrase costs one step for each whole match.
    """

    least: int
    ids: np.ndarray
    words: np.ndarray
    offsets: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    before: Postings
    behind: Postings
    maybe: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray, words: np.ndarray, offsets: np.ndarray, least: int) -> "Seeds":
        grams, at = chunk_shingles(words, offsets, least)
        item = np.repeat(np.arange(len(ids)), np.diff(at))
        place = np.arange(len(grams)) - np.repeat(at[:-1], np.diff(at))
        before = Postings.of(grams, item, place, _beside(words, offsets, item, place - 1, ITEM_EDGE))
        behind = Postings.of(grams, item, place, _beside(words, offsets, item, place + least, ITEM_EDGE))
        keys, counts = np.unique(grams, return_counts=True)
        maybe = np.zeros(1 << FILTER_BITS, dtype=bool)
        maybe[(keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        return cls(least, ids, words, offsets, keys, np.concatenate([[0], np.cumsum(counts)]), before, behind, maybe)

    def hits(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(places in grams, rows of keys)`` of the fingerprints that occur in an item."""
        at = np.flatnonzero(self.maybe[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        row = np.minimum(np.searchsorted(self.keys, grams[at]), len(self.keys) - 1)
        same = self.keys[row] == grams[at]
        return at[same], row[same]

    def matches(self, words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows ``(text, item, place in the text, place in the item, words)`` of all matches that cannot be made longer."""
        grams, at = chunk_shingles(words, offsets, self.least)
        where, row = self.hits(grams)
        text = np.searchsorted(at, where, side="right") - 1
        place = where - at[text]
        low, high = self.first[row], self.first[row + 1]

        def edges(postings: Postings, shift: int) -> tuple[np.ndarray, ...]:
            beside = _beside(words, offsets, text, place + shift, TEXT_EDGE)
            source, hit = postings.other(low, high, _pair(self.keys[row], beside))
            t, item, p, i = text[source], postings.item[hit], place[source], postings.place[hit]
            order = np.lexsort((p, p - i, item, t))
            return t[order], item[order], p[order], i[order]

        t, item, p, i = edges(self.before, -1)
        *_, end, _ = edges(self.behind, self.least)
        return np.stack([t, item, p, i, end - p + self.least], axis=1)


def seeds_of(ids: list[int], texts: list[str | None]) -> list[Seeds]:
    """The items by the length of their seeds: SHINGLE words, or all of a shorter item."""
    words, counts = [np.empty(0, dtype=np.uint64)], [np.empty(0, dtype=np.int64)]
    for _, _, held in chunks(texts):
        w, at = chunk_words(held)
        words.append(w)
        counts.append(np.diff(at))
    words, counts = np.concatenate(words), np.concatenate(counts)
    numbers, least = np.array(ids, dtype=np.int64), np.minimum(counts, SHINGLE)
    found = []
    for k in range(1, SHINGLE + 1):
        own = np.flatnonzero(least == k)
        if len(own):
            held = words[np.repeat(least == k, counts)]
            found.append(Seeds.of(numbers[own], held, np.concatenate([[0], np.cumsum(counts[own])]), k))
    return found


def tile(doc: np.ndarray, item: np.ndarray, runs: list[tuple[int, int, int]], least: int = SHINGLE) -> tuple[int, int]:
    """``(tiles, words covered)`` of an item in a document, by greedy string tiling.

    ``runs`` are the matches that cannot be made longer, as (document place, item
    place, words). The longest is marked first, on both sides; what a marked
    tile leaves of another match goes back until it is shorter than ``least``
    words. Equal lengths go by document position, then item position.
    """
    heap = [(-n, p, i) for p, i, n in runs if np.array_equal(doc[p : p + n], item[i : i + n])]
    heapq.heapify(heap)
    base = min((p for _, p, _ in heap), default=0)
    doc_free = np.ones(max((p - n for n, p, _ in heap), default=0) - base, dtype=bool)
    item_free = np.ones(len(item), dtype=bool)
    tiles, left = 0, len(item)
    while heap and left >= least:
        n, p, i = heapq.heappop(heap)
        there, here = doc_free[p - base : p - base - n], item_free[i : i - n]
        free = there & here
        if free.all():
            tiles, left = tiles + 1, left + n
            there[:] = here[:] = False
            continue
        edges = np.flatnonzero(np.diff(free, prepend=False, append=False)).reshape(-1, 2)
        for a, b in edges[edges[:, 1] - edges[:, 0] >= least].tolist():
            heapq.heappush(heap, (a - b, p + a, i + a))
    return tiles, len(item) - left


def matches(doc_ids: list, texts: list[str | None], groups: list[Seeds], coverage: float) -> Iterator[tuple]:
    """A row of RESULT for every (document, item) covered enough.

    No item is covered further than the sum of its matches, so most end there.
    """
    for first, _, held in chunks(texts):
        words, at = chunk_words(held)
        for seeds in groups:
            found = seeds.matches(words, at)
            if not len(found):
                continue
            starts = np.flatnonzero(np.r_[True, (found[1:, :2] != found[:-1, :2]).any(axis=1)])
            need = coverage * np.diff(seeds.offsets)[found[starts, 1]]
            enough = np.add.reduceat(found[:, 4], starts) >= need
            stops = np.append(starts, len(found))[1:]
            for a, b in zip(starts[enough].tolist(), stops[enough].tolist()):
                j, k = found[a, :2].tolist()
                item = seeds.words[seeds.offsets[k] : seeds.offsets[k + 1]]
                tiles, covered = tile(words[at[j] : at[j + 1]], item, found[a:b, 2:].tolist(), seeds.least)
                if covered >= coverage * len(item):
                    yield doc_ids[first + j], int(seeds.ids[k]), tiles, covered, len(item), covered / len(item)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    coverage: float = COVERAGE,
    max_items: int = MAX_ITEMS,
    max_bytes: int = MAX_BYTES,
) -> DataFrame:
    """The (document, item) pairs in which tiles cover at least ``coverage`` of the item's words.

    Tiles are runs of five words or more, in any order and any place of the
    whole text, so passages that are cut up or reordered are found as well.

    The benchmark's size is measured. Up to the bound its fingerprints go to
    every executor and documents are read once, row by row, without a shuffle.
    A larger one is dealt by a hash of the item into parts within the bound,
    and each part takes one more pass, written out before the next begins.

    Null and empty texts match nothing, nor do rows of the benchmark without id
    or words. An item of fewer than five words is found where all of them stand
    together, in any document. Repeated rows give repeated results; an empty
    table gives none.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(
        F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")
    )
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    fits = size["n"] <= max_items and size["bytes"] <= max_bytes
    parts = 1 if fits else 1 + 2 * max(size["n"] // max_items, size["bytes"] // max_bytes)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))

    def against(part: int) -> DataFrame:
        own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).orderBy("item_id", "text").collect()
        shared = docs.sparkSession.sparkContext.broadcast(seeds_of([r["item_id"] for r in own], [r["text"] for r in own]))

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names = [f.split()[0] for f in RESULT.split(", ")]
            for batch in batches:
                found = list(matches(batch["doc_id"].tolist(), batch["text"].tolist(), shared.value, coverage))
                if found:
                    yield pd.DataFrame(found, columns=names)

        return rows.mapInPandas(search, RESULT)

    if parts == 1:
        return against(0)
    found = stage(against(0))
    for part in range(1, parts):
        found = found.union(stage(against(part)))
    return found
