"""Interleaving sources to target weights by Pfair scheduling."""

from __future__ import annotations

import heapq
import sys
from collections.abc import Iterator
from fractions import Fraction
from itertools import accumulate, islice

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from labelloom.plans.staging import fits_in_memory, stage

BLOCK_CHARS = 1 << 20  # characters of a block, the unit that is scheduled
POWER = 0.5  # a source's target weight is its characters to this power
BUCKET_ROWS = 64
SUPER_BUCKETS = 1024
OUT_ROWS = 50_000


def quotas(weights: list[float], period: int) -> list[int]:
    """Shares of a schedule that repeats, which stand in for weights (``mix_sources`` takes exact ones): at least one each, largest remainders first, ``period`` in all."""
    total = sum(weights)
    free = period - len(weights)
    exact = [free * w / total for w in weights]
    out = [1 + int(x) for x in exact]
    for i in sorted(range(len(weights)), key=lambda i: (-(exact[i] - int(exact[i])), i))[: period - sum(out)]:
        out[i] += 1
    return out


def whole(weights: list[float]) -> list[int]:
    """Whole numbers in exactly the proportions of ``weights``, whose denominators are powers of two."""
    ratios = [float(w).as_integer_ratio() for w in weights]
    common = max((d for _, d in ratios), default=1)
    return [n * (common // d) for n, d in ratios]


def pfair_order(weights: list[int], counts: list[int]) -> Iterator[int]:
    """The stream that has each slot, when stream i has ``counts[i]`` blocks and the exact weight ``weights[i]``.

    A fluid server gives every stream that has not ended its weight's share of
    the time: by virtual time v, stream i has got ``min(weights[i] * v, counts[i])``,
    so T(v), the sum of these, is the number of slots gone. Block k is served
    from v = k / w to (k + 1) / w, so it is released at ``floor(T(k / w))`` and due by
    ``ceil(T((k + 1) / w))``; until a first stream ends, these are k and k + 1 over
    the share. Every slot takes, of the released blocks, the one due first (ties:
    the smaller stream). As the fluid service fills every slot, none is idle and
    no block late: a stream is always less than one block from its fluid share.
    Whole numbers keep all times exact. A slot costs the logarithm of the streams.
    """
    ends = sorted(range(len(weights)), key=lambda i: Fraction(counts[i], weights[i]))
    gone = [0, *accumulate(counts[i] for i in ends)]  # blocks of the first e streams to end
    left = [sum(weights)]  # weight of the others
    for i in ends:
        left.append(left[-1] - weights[i])
    first_n, first_w = (counts[ends[0]], weights[ends[0]]) if ends else (0, 1)

    def at(k: int, i: int) -> tuple[int, int]:
        """Floor and ceiling of T(k / w)."""
        w, low = weights[i], 0
        if k * first_w >= first_n * w:
            high = len(ends)
            while low < high:
                middle = (low + high) // 2
                j = ends[middle]
                if counts[j] * w <= k * weights[j]:
                    low = middle + 1
                else:
                    high = middle
        whole_slots, rest = divmod(k * left[low], w)
        return gone[low] + whole_slots, gone[low] + whole_slots + (rest > 0)

    done = [0] * len(weights)
    due = [at(1, i) for i in range(len(weights))]  # release of the next block, deadline of this one
    waiting = [(0, i) for i in range(len(weights)) if counts[i]]  # (release, stream)
    ready: list[tuple[int, int]] = []  # (deadline, stream)
    for slot in range(sum(counts)):
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (due[i][1], i))
        _, i = heapq.heappop(ready)
        yield i
        done[i] += 1
        if done[i] < counts[i]:
            heapq.heappush(waiting, (due[i][0], i))
            due[i] = at(done[i] + 1, i)


def pfair_slots(shares: list[int], counts: list[int] | None = None) -> list[list[int]]:
    """The slots of each stream's blocks by ``pfair_order``; without ``counts``, of one period of ``sum(shares)`` slots."""
    out: list[list[int]] = [[] for _ in shares]
    for slot, i in enumerate(pfair_order(shares, shares if counts is None else counts)):
        out[i].append(slot)
    return out


def _scheduled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The slot of every block, from one row of weight and blocks per stream."""
    found = [part for part in parts if len(part)]
    if not found:
        return
    streams = pd.concat(found).sort_values("stream")
    names, counts = streams["stream"].tolist(), streams["blocks"].tolist()
    done, slot, order = [0] * len(names), 0, pfair_order(whole(streams["w"].tolist()), counts)
    while own := list(islice(order, OUT_ROWS)):
        turns = []
        for i in own:
            turns.append(done[i])
            done[i] += 1
        yield pd.DataFrame({"stream": [names[i] for i in own], "block": turns, "slot": range(slot, slot + len(own))})
        slot += len(own)


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    source_col: str = "source",
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = BLOCK_CHARS,
    power: float = POWER,
) -> DataFrame:
    """``docs`` with ``stream``, ``block`` and ``slot``: reading by (slot, stream, block, id) is the mixture.

    Every document stays, once. A stream is a source; its documents are put in
    the order of a hash of their id and cut into blocks of ``block_chars``
    characters by their running length (a document belongs to the block where
    it begins; a longer one leaves the blocks it covers to itself). Blocks are
    scheduled by ``pfair_order`` with the target weights themselves. Up to the
    first stream's end, every stream is less than one block from its target
    share of the slots; from then on from its share among the streams that are
    left, which keep their proportions.

    ``weights`` gives targets by name; all other sources together get the mean
    of them, each in proportion to its characters to ``power``. Without it, a
    source's target is its characters to ``power``. Streams are numbered by
    falling target, the named ones first.

    The schedule is made by one task from one row per stream and staged, one
    row per block. Running lengths come from sums per bucket of about
    ``BUCKET_ROWS`` documents, and of ``SUPER_BUCKETS`` buckets, so that a
    source of any size is many small groups. Null sources are one source of
    their own; null and empty texts have no length but a place; rows that repeat
    an id stand together. Input columns named as the outputs are replaced.
    """
    spark = docs.sparkSession
    others = [c for c in docs.columns if c not in ("stream", "block", "slot")]
    source, text = F.col(f"`{source_col}`").cast("string"), F.length(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    sizes = docs.groupBy(source.alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(text.cast("double")).alias("chars"))
    size = F.pow(F.greatest(F.col("chars"), F.lit(1.0)), F.lit(power))
    given = {s: float(w) for s, w in (weights or {}).items() if w > 0}
    if weights is None:
        sizes = sizes.withColumn("given", F.lit(None).cast("double")).withColumn("w", size)
    else:
        keys = stage(spark.createDataFrame(list(given.items()), "name string, given double"))
        sizes = stage(sizes.join(keys, F.col("s").eqNullSafe(F.col("name")), "left").drop("name").withColumn("size", size))
        rest = sizes.where("given IS NULL").agg(F.sum("size")).first()[0] or 1.0
        mean = sum(given.values()) / max(len(given), 1) or 1.0
        share = F.greatest(F.col("size") * F.lit(mean / rest), F.lit(sys.float_info.min))
        sizes = sizes.withColumn("w", F.coalesce("given", share)).drop("size")
    number = F.expr("CAST(row_number() OVER (ORDER BY given IS NULL, w DESC, s) - 1 AS INT)")
    streams = sizes.select("s", number.alias("stream"), F.expr(f"CAST(ceil(n / {BUCKET_ROWS}) AS LONG)").alias("buckets"), "chars", "w")
    streams = stage(streams)
    blocks = F.expr(f"CAST(chars AS LONG) div {int(block_chars)} + 1").alias("blocks")
    table = stage(streams.select("stream", "w", blocks).coalesce(1).mapInPandas(_scheduled, "stream int, block long, slot long"))
    known = streams.select(F.col("s").alias("__source"), "stream", F.col("buckets").alias("__buckets"))
    known = F.broadcast(known) if fits_in_memory(known) else known
    order = F.xxhash64(F.col(f"`{id_col}`"))
    rows = docs.select(*[f"`{c}`" for c in others], source.alias("__s"), text.cast("long").alias("__n"), order.alias("__h"))
    rows = rows.join(known, F.col("__s").eqNullSafe(F.col("__source"))).drop("__s", "__source")
    rows = rows.withColumn("__bucket", F.pmod("__h", "__buckets"))
    sums = rows.groupBy("stream", "__bucket").agg(F.sum("__n").alias("own"))
    sums = stage(sums.withColumn("super", F.floor(F.col("__bucket") / SUPER_BUCKETS)))
    supers = sums.groupBy("stream", "super").agg(F.sum("own").alias("all"))
    before_super = F.expr("sum(all) OVER (PARTITION BY stream ORDER BY super ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    before_bucket = F.expr("sum(own) OVER (PARTITION BY stream, super ORDER BY __bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    supers = supers.withColumn("base", F.coalesce(before_super, F.lit(0))).drop("all")
    starts = sums.withColumn("part", F.coalesce(before_bucket, F.lit(0))).join(supers, ["stream", "super"])
    starts = starts.select("stream", "__bucket", (F.col("base") + F.col("part")).alias("__start"))
    ids = f"__h, `{id_col}`, __n"
    within = F.expr(f"sum(__n) OVER (PARTITION BY stream, __bucket ORDER BY {ids} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
    placed = rows.withColumn("__before", F.coalesce(within, F.lit(0))).join(starts, ["stream", "__bucket"])
    placed = placed.withColumn("block", F.floor((F.col("__start") + F.col("__before")) / F.lit(block_chars)))
    placed = placed.join(table, ["stream", "block"])
    return placed.select(*[f"`{c}`" for c in others], "stream", "block", "slot")
