"""Exact top-k search by block-at-a-time pruning, bounds before rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from labelloom.plans.staging import stage

SCALE = 1024
BLOCK_ROWS = 256
PACK_ROWS = 4096
SLICE_BLOCKS = 64
EDGE_BLOCKS = 4096  # blocks whose bounds are computed in one task
FIRST_BLOCKS = 4  # blocks of the highest bounds, which raise a query's floor before the others are chosen
SAMPLE_ROWS = 4096  # rows that the coarse clusters are fitted on; they order the rows and change no result
CLUSTERS = 64
EXACT = 2**53


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """``(id, v array<bigint>)`` of the rows that take part."""
    x = F.col(f"`{vector_col}`")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    ids = F.col(f"`{id_col}`").cast("long")
    rows = df.where(ids.isNotNull() & x.isNotNull() & finite)
    ints = F.transform(x, lambda e: F.floor(F.lit(scale) * e.cast("double")).cast("long"))
    return rows.select(ids.alias("id"), ints.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    out = np.zeros((len(vectors), dim), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _packed(m: np.ndarray) -> bytes:
    """Integers in the narrowest of four types, the type's width in front."""
    top = max(int(m.max(initial=0)), -int(m.min(initial=0)) - 1)
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w - 1))
    return bytes([width]) + m.astype(f"<i{width}").tobytes()


def _unpacked(data: bytes, dim: int) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{data[0]}", offset=1).reshape(-1, max(dim, 1) if dim else 0).astype(np.int64)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a @ b.T`` exactly: as doubles where no sum can pass 2**53, else as Python integers."""
    reach = max(a.shape[1], 1) * float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0))
    if reach < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _kth(scores: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest score of each row; the least integer where there are fewer."""
    if scores.shape[1] < k:
        return np.full(len(scores), np.iinfo(np.int64).min)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def fit_centroids(sample: np.ndarray, clusters: int = CLUSTERS, rounds: int = 8) -> np.ndarray:
    """Centroids of a bounded sample, by a few rounds of k-means."""
    centres = sample[np.linspace(0, len(sample) - 1, min(clusters, len(sample))).astype(int)].astype(np.float64)
    for _ in range(rounds):
        near = _nearest(sample, centres)
        for c in np.unique(near):
            centres[c] = sample[near == c].mean(axis=0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * (x.astype(np.float64) @ centres.T), axis=1)


def block_bounds(queries: np.ndarray, least: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """The largest score that a row of each block can give each query: the sum over components of the larger product."""
    split = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
    return _product(split, np.concatenate([largest, least], axis=1))


def deal_packs(counts: dict[int, int], pack_rows: int) -> list[tuple[int, int, int]]:
    """``(cluster, first pack, packs)``: small clusters of queries share a pack, a large one is dealt over several."""
    dealt, pack, held = [], 0, 0
    for cluster, n in sorted(counts.items()):
        if held and held + n > pack_rows:
            pack, held = pack + 1, 0
        packs = -(-n // pack_rows)
        dealt.append((cluster, pack, packs))
        pack, held = (pack + packs, 0) if packs > 1 else (pack, held + n)
    return dealt


def search_pack(queries: np.ndarray, own: np.ndarray, floor: np.ndarray, blocks: list[tuple], k: int):
    """``(query position, id, score)`` of every row that may be among a query's k best.

    ``blocks`` are ``(ids, rows, least, largest)``. A block's bound for a query
    is the sum over components of the largest product it can give; each query
    takes the blocks in the order of its bounds, and stops where a bound is
    below its k-th score so far. ``floor`` is a k-th score known beforehand.
    """
    hi, lo = np.stack([b[3] for b in blocks]), np.stack([b[2] for b in blocks])
    bound = block_bounds(queries, lo, hi)
    order = np.argsort(-bound, axis=1, kind="stable") if bound.min(initial=0) > -(2**63) else np.argsort(bound, axis=1)[:, ::-1]
    least = np.iinfo(np.int64).min
    best = np.full((len(queries), k), least)
    limit = floor.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for step in range(len(blocks)):
        chosen = order[:, step]
        active = np.flatnonzero(bound[np.arange(len(queries)), chosen] >= limit)
        if not len(active):
            break
        for b in np.unique(chosen[active]):
            rows = active[chosen[active] == b]
            ids, data = blocks[b][0], blocks[b][1]
            scores = _product(queries[rows], data)
            other = own[rows][:, None] != ids[None, :]
            kept = other & (scores >= limit[rows][:, None])
            r, c = np.nonzero(kept)
            found.append((rows[r], ids[c], scores[r, c]))
            merged = np.concatenate([best[rows], np.where(other, scores, least)], axis=1)
            best[rows] = np.partition(merged, merged.shape[1] - k, axis=1)[:, merged.shape[1] - k :]
            limit[rows] = np.maximum(limit[rows], best[rows].min(axis=1))
    if not found:
        return tuple(np.empty(0, dtype=np.int64) for _ in range(3))
    q, ids, scores = (np.concatenate(x) for x in zip(*found))
    place = np.lexsort((ids, -scores, q)) if scores.min(initial=0) > -(2**63) else np.lexsort((ids, scores.astype(float) * -1, q))
    q, ids, scores = q[place], ids[place], scores[place]
    first = np.searchsorted(q, q, side="left")
    keep = np.arange(len(q)) - first < k
    return q[keep], ids[keep], scores[keep]


def top_k(
    df: DataFrame,
    is_query: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 10,
    scale: int = SCALE,
    block_rows: int = BLOCK_ROWS,
    pack_rows: int = PACK_ROWS,
    slice_blocks: int = SLICE_BLOCKS,
    edge_blocks: int = EDGE_BLOCKS,
    first_blocks: int = FIRST_BLOCKS,
) -> DataFrame:
    """``(query_id, rank, id, score)``: the k largest integer inner products of each query row.

    Components are ``floor(scale * x)``. ``is_query`` is a condition on the
    column ``id``. A query is never its own result; equal scores go to the
    smaller id; a query with fewer than k other rows gets them all.

    Rows are range-partitioned by a coarse cluster and id, and cut into blocks
    of ``block_rows`` that carry their rows (the forward index) and each
    component's least and largest value. Queries are packed by cluster.

    Bounds are sent before rows. A query starts from the k-th score within its
    own block. Every pack first meets only the blocks' least and largest values,
    and the ``first_blocks`` blocks of each query's highest bounds over the whole
    table are scored, which raises its floor. Then a block's rows go to a pack if its bound reaches
    the floor of any query there. Each task holds one pack and about
    ``slice_blocks`` blocks; there the blocks are visited in the order of each
    query's bounds until they fall below its k-th score. Only the few rows that
    stay are ranked.

    Vectors that are null or hold null or non-finite components take no part, nor
    rows without an id. Shorter vectors count as filled up with zeros. Of rows with one id the least
    vector counts. An empty table gives no rows. Scores outside 64 bits are
    held at the end of the range.
    """
    spark = df.sparkSession
    rows = stage(integer_vectors(df, id_col, vector_col, scale).withColumn("q", F.coalesce(is_query, F.lit(False))))
    sizes = rows.agg(F.max(F.size("v")).alias("dim"), F.count(F.lit(1)).alias("n")).first()
    dim, n = max(sizes["dim"] or 1, 1), sizes["n"]
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toPandas()["v"]
    centres = fit_centroids(_matrix(sample, dim)) if n else np.zeros((1, dim))

    def clustered(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            m = _matrix(part["v"], dim)
            yield pd.DataFrame({"cluster": _nearest(m, centres), "id": part["id"], "q": part["q"], "v": [_packed(r) for r in m]})

    def cut(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Blocks of consecutive rows of a partition; its last may be short."""
        held = pd.DataFrame()
        for part in parts:
            held = pd.concat([held, part], ignore_index=True)
            full = len(held) // block_rows * block_rows
            for at in range(0, full, block_rows):
                yield block(held.iloc[at : at + block_rows])
            held = held.iloc[full:]
        if len(held):
            yield block(held)

    def block(part: pd.DataFrame) -> pd.DataFrame:
        m = np.concatenate([_unpacked(v, dim) for v in part["v"]])
        ids, asks = part["id"].to_numpy(), np.flatnonzero(part["q"].to_numpy())
        scores = _product(m[asks], m)
        scores = scores[np.arange(len(ids))[None, :] != asks[:, None]].reshape(len(asks), len(ids) - 1)
        return pd.DataFrame(
            {
                "block": [ids[0]], "cluster": [part["cluster"].iloc[0]], "ids": [ids.astype("<i8").tobytes()], "rows": [_packed(m)],
                "least": [_packed(m.min(axis=0))], "largest": [_packed(m.max(axis=0))],
                "q_ids": [ids[asks].tolist()], "q_rows": [[_packed(r) for r in m[asks]]], "q_floor": [_kth(scores, k).tolist()],
            }
        )

    ordered = rows.mapInPandas(clustered, "cluster int, id long, q boolean, v binary")
    ordered = ordered.repartitionByRange("cluster", "id").sortWithinPartitions("cluster", "id")
    kind = "block long, cluster int, ids binary, rows binary, least binary, largest binary, q_ids array<long>, q_rows array<binary>, q_floor array<long>"
    blocks = stage(ordered.mapInPandas(cut, kind))
    n_blocks = blocks.count()
    slices, edge_slices = max(1, -(-n_blocks // slice_blocks)), max(1, -(-n_blocks // edge_blocks))

    asked = blocks.select("cluster", F.explode(F.arrays_zip("q_ids", "q_rows", "q_floor")).alias("z"))
    asked = asked.select("cluster", F.col("z.q_ids").alias("id"), F.col("z.q_rows").alias("row"), F.col("z.q_floor").alias("floor"))
    counts = {r["cluster"]: r["count"] for r in asked.groupBy("cluster").count().collect()}  # at most CLUSTERS rows
    dealt = deal_packs(counts, pack_rows)
    packs = max((first + of for _, first, of in dealt), default=1)
    asked = asked.join(F.broadcast(spark.createDataFrame(dealt, "cluster int, first int, packs int")), "cluster")
    pack = (F.col("first") + F.pmod(F.xxhash64("id"), F.col("packs"))).cast("int").alias("pack")
    asked = stage(asked.select("id", "row", "floor", pack))

    edge = F.pmod(F.xxhash64("block"), F.lit(edge_slices)).cast("int").alias("edge")
    edges = blocks.select("block", "least", "largest", edge).withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))

    def matrix(packed: pd.Series) -> np.ndarray:
        return np.concatenate([_unpacked(v, dim) for v in packed])

    def meet_edges(asked: DataFrame, chosen, kind: str) -> DataFrame:
        """``chosen(queries, blocks, bounds)`` for every pack and slice of block bounds."""

        def meet(queries: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            if not len(queries) or not len(part):
                return pd.DataFrame({c.split()[0]: [] for c in kind.split(", ")})
            return chosen(queries, part, block_bounds(matrix(queries["row"]), matrix(part["least"]), matrix(part["largest"])))

        there = asked.withColumn("edge", F.explode(F.sequence(F.lit(0), F.lit(edge_slices - 1))))
        return there.groupBy("pack", "edge").cogroup(edges.groupBy("pack", "edge")).applyInPandas(meet, kind)

    def highest(queries: pd.DataFrame, part: pd.DataFrame, bound: np.ndarray) -> pd.DataFrame:
        top = min(first_blocks, len(part))
        at = np.argpartition(bound, len(part) - top, axis=1)[:, len(part) - top :]
        return pd.DataFrame(
            {
                "query_id": np.repeat(queries["id"].to_numpy(), top), "pack": np.repeat(queries["pack"].to_numpy(), top),
                "block": part["block"].to_numpy()[at].ravel(), "bound": np.take_along_axis(bound, at, axis=1).ravel(),
            }
        )

    def reached(queries: pd.DataFrame, part: pd.DataFrame, bound: np.ndarray) -> pd.DataFrame:
        some = (bound >= queries["floor"].to_numpy()[:, None]).any(axis=0)
        return pd.DataFrame({"pack": queries["pack"].iloc[0], "block": part["block"].to_numpy()[some]})

    def meet(queries: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(queries) or not len(part):
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        own = queries["id"].to_numpy()
        held = [
            (np.frombuffer(i, "<i8"), _unpacked(r, dim), _unpacked(lo, dim)[0], _unpacked(hi, dim)[0])
            for i, r, lo, hi in zip(part["ids"], part["rows"], part["least"], part["largest"])
        ]
        q, ids, scores = search_pack(matrix(queries["row"]), own, queries["floor"].to_numpy(), held, k)
        return pd.DataFrame({"query_id": own[q], "id": ids, "score": scores})

    def best_of(asked: DataFrame, pairs: DataFrame) -> DataFrame:
        """The ranked best rows, where each pack sees the blocks that ``(pack, block)`` pairs name."""
        place = F.pmod(F.xxhash64("block"), F.lit(slices)).cast("int")
        there = blocks.select("block", "ids", "rows", "least", "largest").join(pairs, "block").withColumn("slice", place)
        met = asked.join(pairs.select("pack", place.alias("at")).distinct(), "pack")
        near = met.groupBy("pack", "at").cogroup(there.groupBy("pack", "slice"))
        near = near.applyInPandas(meet, "query_id long, id long, score long")
        rank = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)")
        return near.withColumn("rank", rank).where(F.col("rank") <= k)

    place = F.expr("row_number() OVER (PARTITION BY query_id ORDER BY bound DESC, block)")
    first = meet_edges(asked, highest, "query_id long, pack int, block long, bound long").withColumn("place", place)
    first = stage(first.where(F.col("place") <= first_blocks).select("pack", "block").distinct())
    raised = best_of(asked, first).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("raised"))
    floor = F.greatest("floor", F.coalesce("raised", "floor")).alias("floor")
    asked = stage(asked.join(raised, "id", "left").select("id", "row", floor, "pack"))
    pairs = stage(meet_edges(asked, reached, "pack int, block long"))
    return best_of(asked, pairs).select("query_id", F.col("rank").cast("int"), F.col("id").alias(id_col), "score")
