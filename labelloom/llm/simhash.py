"""SimHash near-duplicates: fingerprints of three-word shingles, compared bit plane by bit plane."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from labelloom.llm.near import components
from labelloom.plans.staging import stage

BITS = 64
SHINGLE = 3
RADIUS = 3
SEED = 42
KEPT = 3  # parts of a fingerprint that make a key; there are as many more as the radius has bits
CHUNK = 1024  # fingerprints of a bucket that are compared at a time
HASHES = 1 << 14
ALL = np.uint64(2**64 - 1)


def fingerprint(text: bytes | None) -> int:
    """SimHash of a whole text: a bit is set where it is in over half of the shingles' hashes.

    Shingles are three consecutive words of the text with A-Z lower-cased, each
    as often as it occurs; words are cut at ASCII white space. A text of one or
    two words is one shingle, one without words (null, too) gives 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    total = max(len(words) - SHINGLE + 1, 1)
    ones = np.zeros(BITS, dtype=np.int64)
    for at in range(0, total, HASHES):
        part = words[at : at + HASHES + SHINGLE - 1]
        shingles = zip(*(part[j:] for j in range(SHINGLE))) if len(words) >= SHINGLE else [words]
        hashes = np.fromiter((xxhash.xxh64_intdigest(b" ".join(s), SEED) for s in shingles), dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def planes(values: np.ndarray) -> np.ndarray:
    """The values stored vertically: row p holds bit p of every value, 64 values a word; the last word is filled with zeros."""
    padded = np.zeros(-(-len(values) // BITS) * BITS, dtype="<u8")
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def near_lanes(queries: np.ndarray, block: np.ndarray, apart: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """``(query, lane)`` of the pairs at a distance of ``radius`` at most.

    ``block`` holds the lanes as ``planes``. Each plane's differences are added to
    the distances of 64 lanes at a time: the counters are bit planes too, and a
    carry ripples through them as XOR and AND. They start so far below their
    end that a carry out of the highest says that a lane exceeds the radius. A
    query whose lanes all do (``apart`` marks those that do from the start)
    abandons the block.
    """
    counters = max(radius.bit_length(), 1)
    alive, over = np.arange(len(queries)), apart
    start = (1 << counters) - 1 - radius
    count = [np.full(over.shape, ALL if start >> j & 1 else 0, dtype=np.uint64) for j in range(counters)]
    for p in range(BITS):
        if p % 4 == 0:
            stay = (over != ALL).any(axis=1)
            if not stay.all():
                alive, over, count = alive[stay], over[stay], [c[stay] for c in count]
            if not len(alive):
                break
        bit = np.where(queries[alive] >> np.uint64(p) & np.uint64(1), ALL, np.uint64(0))
        carry = block[p][None, :] ^ bit[:, None]
        for j in range(counters):
            carry, count[j] = count[j] & carry, count[j] ^ carry
        over = over | carry
    within = np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little")
    row, lane = np.nonzero(within)
    return alive[row], lane


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of the positions that each of ``n`` positions is connected with."""
    label = np.arange(n)
    while True:
        least = label.copy()
        np.minimum.at(least, a, label[b])
        np.minimum.at(least, b, label[a])
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _connect(cell: np.ndarray, fps: np.ndarray, radius: int) -> pd.DataFrame:
    """Links ``(a, b)`` that connect what is connected inside each cell, one for each fingerprint at most."""
    lanes = np.full(-(-len(cell) // BITS) * BITS, -1, dtype=np.int64)
    lanes[: len(cell)] = cell
    apart = np.packbits(cell[:, None] != lanes[None, :], axis=1, bitorder="little").view("<u8")
    label = _forest(len(fps), *near_lanes(fps, planes(fps), apart, radius))
    joined = np.flatnonzero(label != np.arange(len(label)))
    return pd.DataFrame({"a": fps[label[joined]].view(np.int64), "b": fps[joined].view(np.int64)})


def _cells(batches: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Links within cells, from batches in which the rows of a cell follow each other; small cells share a block."""
    keys = ["part", "key", "low", "high"]
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += len(batch)
        if size < CHUNK:
            continue
        rows = pd.concat(held, ignore_index=True)
        k = rows[keys].to_numpy()
        starts = np.flatnonzero(np.r_[True, (k[1:] != k[:-1]).any(axis=1)])
        cell = np.cumsum(np.bincount(starts, minlength=len(rows))) - 1
        fps = rows["fp"].to_numpy().view(np.uint64)
        at = 0
        for stop in starts[1:]:  # the last cell may go on in the next batch
            if stop - at >= CHUNK or stop == starts[-1]:
                yield _connect(cell[at:stop], fps[at:stop], radius)
                at = stop
        held, size = [rows.iloc[at:]], len(rows) - at
    if size:
        rows = pd.concat(held, ignore_index=True)
        k = rows[keys].to_numpy()
        cell = np.cumsum(np.r_[False, (k[1:] != k[:-1]).any(axis=1)])
        yield _connect(cell, rows["fp"].to_numpy().view(np.uint64), radius)


def key_masks(radius: int = RADIUS) -> list[int]:
    """Bit masks such that two fingerprints within the radius are equal under one at least.

    A fingerprint is cut into ``radius + KEPT`` parts, of which differing bits
    touch ``radius`` at most: some ``KEPT`` parts are equal.
    """
    parts = radius + KEPT
    edges = [BITS * i // parts for i in range(parts + 1)]
    part = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:])]
    return [sum(part[i] for i in chosen) for chosen in combinations(range(parts), KEPT)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def link_fingerprints(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Staged ``(node, comp)``: the component of every one of the distinct ``fp`` that another lies within the radius of.

    Fingerprints with equal bits under one of ``key_masks`` share a bucket; those
    alone in theirs go no further. A bucket is cut into chunks of ``CHUNK`` by a
    hash, and every two chunks meet in a cell, so a bucket of any size is spread
    over tasks; a cell gives at most one link for each of its fingerprints.
    """
    masks = F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m in enumerate(key_masks(radius))])
    placed = fps.select("fp", F.inline(masks))
    shared = stage(placed.groupBy("part", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    met = placed.join(shared, ["part", "key"]).withColumn("chunks", F.ceil(F.col("n") / CHUNK).cast("int"))
    met = met.withColumn("own", F.pmod(F.xxhash64("fp"), "chunks").cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = met.select("part", "key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    cells = cells.repartition("part", "key", "low", "high").sortWithinPartitions("part", "key", "low", "high")
    return components(stage(cells.mapInPandas(lambda rows: _cells(rows, radius), "a long, b long").distinct()))


def simhash_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(id, fingerprint long, component_id)`` per row: texts whose fingerprints differ in ``radius`` bits at most are linked.

    ``component_id`` is the least id that links reach, the row's own included.
    Texts with one fingerprint are one node, so copies are never paired; null
    and empty texts have fingerprint 0 and are linked like others. A row without
    id links others and carries the least id of its component, null where there is none.
    Rows that repeat an id are each a row. An empty table gives no rows.
    """
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": batch["id"], "fp": fps.view(np.int64)})

    rows = stage(named.mapInPandas(marked, "id long, fp long"))
    nodes = stage(rows.groupBy("fp").agg(F.min("id").alias("least")))
    linked = nodes.join(link_fingerprints(nodes.select("fp"), radius).withColumnRenamed("node", "fp"), "fp", "left")
    linked = stage(linked.select("fp", "least", "comp"))
    ends = linked.where("comp IS NOT NULL").groupBy("comp").agg(F.min("least").alias("end"))
    named = stage(linked.join(ends, "comp", "left").select("fp", F.when(F.col("comp").isNull(), F.col("least")).otherwise(F.col("end")).alias("component_id")))
    return rows.join(named, "fp").select(F.col("id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")
