"""Merkle manifest of a dataset: a tree over the rows of each group, one over the groups' roots, a proof for every row.

A tree's nodes form an append log in postorder: a node is written as soon as its
leaves are complete. The place of every node follows from the sizes of the
subtrees in front of it, so a proof reads its siblings by computed positions and
no node stores a pointer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from labelloom.plans.staging import stage

TIER = 10  # levels that one builder writes; it takes an aligned run of 2**TIER nodes
PATH = "array<struct<digest string, left boolean>>"
_PARTITION_BITS = 33  # of monotonically_increasing_id: the place in a partition


def leaf_digest(*fields: Column | str) -> Column:
    """Hex SHA-256 of the fields, each as its byte count, a colon and its text; ``-`` where it is null."""
    parts = []
    for field in fields:
        text = (F.col(field) if isinstance(field, str) else field).cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def proof_digest(path: Column | str) -> Column:
    """Hex SHA-256 of a path's siblings, from the leaf up."""
    siblings = F.filter(path, lambda step: step["digest"].isNotNull())
    return F.sha2(F.array_join(F.transform(siblings, lambda step: step["digest"]), ""), 256)


def folded(leaf: Column | str, path: Column | str) -> Column:
    """The root that a leaf and a path lead to; a step without a sibling hashes the node alone."""

    def up(node: Column, step: Column) -> Column:
        pair = F.when(step["left"], F.concat(step["digest"], node)).otherwise(F.concat(node, step["digest"]))
        return F.sha2(F.coalesce(pair, node), 256)

    return F.aggregate(path, F.col(leaf) if isinstance(leaf, str) else leaf, up)


def position(level: int, index: int, leaves: int) -> int:
    """Place of a node in the postorder log of a tree over ``leaves`` leaves.

    In front of leaf k stand the 2k - popcount(k) nodes of the whole subtrees over
    the leaves before it, and a node of level l follows its last leaf l places
    later. The nodes over the short last run come after all these, lowest first.
    """
    last = ((index + 1) << level) - 1
    if last < leaves:
        return 2 * last - last.bit_count() + level
    return 2 * leaves - leaves.bit_count() + level - (leaves & -leaves).bit_length()


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def append_log(digests: list[str], height: int) -> list[str]:
    """The nodes over ``digests`` up to level ``height`` in the order in which they are complete; the root is last."""
    log: list[str] = []
    waiting: list[str] = []  # whole subtrees whose right neighbour is still to come
    for k, node in enumerate(digests):
        log.append(node)
        ahead = k
        while ahead & 1:
            node = _hash(waiting.pop() + node)
            log.append(node)
            ahead >>= 1
        waiting.append(node)
    short = ""
    for level in range(height):
        run = (waiting.pop() if len(digests) >> level & 1 else "") + short
        if run:
            short = _hash(run)
            log.append(short)
    return log


def _height(nodes: int) -> int:
    """Levels above ``nodes`` nodes that one builder writes."""
    return TIER if nodes > 1 << TIER else (nodes - 1).bit_length()


def _build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds a segment's log to its entries, which it puts in order."""
    for batch in batches:
        entries, logs = [], []
        for held, n in zip(batch.column("entries"), batch.column("n").to_pylist()):
            own = held.values
            own = own.take(pa.array(np.argsort(own.field("at").to_numpy(), kind="stable")))
            entries.append(own)
            logs.append(append_log(own.field("leaf").to_pylist(), _height(n)))
        sizes = np.concatenate([[0], np.cumsum([len(e) for e in entries])]).astype(np.int32)
        kind = batch.schema.field("entries").type
        flat = pa.concat_arrays(entries) if entries else pa.array([], kind.value_type)
        columns = [batch.column("tree"), batch.column("block"), batch.column("n"), pa.ListArray.from_arrays(sizes, flat), pa.array(logs, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays(columns, names=["tree", "block", "n", "entries", "log"])


def _paths(leaves: int, height: int) -> tuple[np.ndarray, np.ndarray]:
    """``(log position of the sibling or -1, whether it is to the left)`` for each leaf and level of a segment."""
    at = np.arange(leaves)
    where, left = np.full((leaves, height), -1, dtype=np.int64), np.zeros((leaves, height), dtype=bool)
    for level in range(height):
        nodes = -(-leaves >> level)
        places = np.array([position(level, i, leaves) for i in range(nodes)] + [-1] * 2)
        sibling = (at >> level) ^ 1
        where[:, level] = places[np.minimum(sibling, nodes)]
        left[:, level] = sibling < (at >> level)
    return where, left


def _unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every entry of a segment, with its path to the root: its own siblings, then those above the segment."""
    known: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for row in range(batch.num_rows):
            tree, n, log = (batch.column(c)[row].as_py() for c in ("tree", "n", "log"))
            above, root = batch.column("above")[row].as_py() or [], batch.column("root")[row].as_py()
            own = batch.column("entries")[row].values
            shape = (len(own), _height(n))
            if shape not in known:
                known[shape] = _paths(*shape)
            where, left = known[shape]
            over = np.array([len(log) + j if s["digest"] is not None else -1 for j, s in enumerate(above)], dtype=np.int64)
            where = np.concatenate([where, np.broadcast_to(over, (len(own), len(above)))], axis=1)
            left = np.concatenate([left, np.broadcast_to(np.array([s["left"] for s in above], dtype=bool), (len(own), len(above)))], axis=1)
            index = where.ravel()
            digests = pa.array(log + [s["digest"] for s in above], pa.string()).take(pa.array(index, mask=index < 0))
            steps = pa.StructArray.from_arrays([digests, pa.array(left.ravel())], names=["digest", "left"])
            ends = (np.arange(len(own) + 1) * where.shape[1]).astype(np.int32)
            columns = [
                pa.array([tree] * len(own), pa.string()), own.field("at"), own.field("leaf"), own.field("row"),
                pa.ListArray.from_arrays(ends, steps), pa.array([root or log[-1]] * len(own), pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "at", "leaf", "row", "path", "root"])


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``at``, the place in its tree by ``order``, and ``n``, the rows of its tree.

    Rows are range-partitioned and written once with their place in a partition;
    a tree's rows in each partition are then counted, so that a tree with most of
    the rows is ranked by as many tasks.
    """
    keys = ["tree", *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__m", F.monotonically_increasing_id())
    dealt = stage(dealt).withColumn("__part", F.shiftright("__m", _PARTITION_BITS))
    sizes = dealt.groupBy("tree", "__part").agg(F.count(F.lit(1)).alias("__size"), F.min("__m").alias("__first"))
    earlier = Window.partitionBy("tree").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(
        "tree", "__part", "__first", F.coalesce(F.sum("__size").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__size").over(Window.partitionBy("tree")).alias("n"),
    )
    joined = dealt.join(stage(sizes), ["tree", "__part"])
    return joined.select(*rows.columns, (F.col("__before") + F.col("__m") - F.col("__first")).alias("at"), "n")


def _segments(nodes: DataFrame) -> DataFrame:
    """The staged log segments of one tier, from nodes ``(tree, at, n, leaf, row)``: a builder for each aligned run."""
    entry = F.struct(F.col("at"), F.col("leaf"), F.col("row"))
    held = nodes.groupBy("tree", F.shiftright("at", TIER).alias("block")).agg(F.max("n").alias("n"), F.collect_list(entry).alias("entries"))
    schema = T.StructType([*held.schema.fields, T.StructField("log", T.ArrayType(T.StringType()))])
    return stage(held.select("tree", "block", "n", "entries").mapInArrow(_build, T.StructType([schema[c] for c in ("tree", "block", "n", "entries", "log")])))


def log_segments(rows: DataFrame, order: list[str]) -> list[DataFrame]:
    """The append log of every tree, tier by tier, from rows ``(tree, leaf, row)``.

    A builder takes an aligned run of ``2 ** TIER`` nodes of one tree, whatever the
    tree's size, and writes the nodes above them; the last of these is a leaf of
    the next tier. There are as many tiers as the largest tree needs.
    """
    tiers = [_segments(_placed(rows, order))]
    while True:
        more = tiers[-1].where(F.col("n") > 1 << TIER)
        if more.isEmpty():
            return tiers
        nodes = F.ceil(F.col("n") / (1 << TIER)).cast("long")
        roots = more.select("tree", F.col("block").alias("at"), nodes.alias("n"), F.element_at("log", -1).alias("leaf"))
        tiers.append(_segments(roots.withColumn("row", F.struct(F.lit(0).alias("none")))))


def _proved(tiers: list[DataFrame]) -> DataFrame:
    """``(tree, at, leaf, row, path, root)`` of every row of the first tier, from the last tier down."""
    above = None
    for segments in reversed(tiers):
        if above is None:
            held = segments.withColumn("above", F.lit(None).cast(PATH)).withColumn("root", F.lit(None).cast("string"))
        else:
            upper = stage(above.select("tree", F.col("at").alias("block"), F.col("path").alias("above"), "root"))
            held = segments.join(upper, ["tree", "block"], "left")
        row = segments.schema["entries"].dataType.elementType
        kind = T.StructType(
            [T.StructField("tree", T.StringType()), row["at"], row["leaf"], row["row"], T.StructField("path", T._parse_datatype_string(PATH)), T.StructField("root", T.StringType())]
        )
        above = held.mapInArrow(_unfold, kind)
    return above


def _roots(tiers: list[DataFrame]) -> DataFrame:
    """``(tree, leaf)``: the root of every tree, the end of the one segment that its last tier has."""
    found = [t.where(F.col("n") <= 1 << TIER).select("tree", F.element_at("log", -1).alias("leaf")) for t in tiers]
    out = found[0]
    for other in found[1:]:
        out = out.union(other)
    return out


def merkle_manifest(rows: DataFrame, leaf_col: str = "leaf", tree_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``rows`` with ``subroot`` (of the row's tree), ``root`` (of all trees) and ``path``.

    The rows of one ``tree_col`` value (nulls are one value, the first; others in
    the byte order of their text) are the leaves of a tree, by ``id_col`` (null
    first), equal ids by leaf. While several nodes remain, every two become the
    hex SHA-256 of their hex digests, a last one left over that of its own.
    The trees' roots are the leaves of the top tree.

    ``path`` lists the steps from the leaf to ``root``: the sibling's digest, null
    where there is none, and whether it stands to the left (see ``folded`` and
    ``proof_digest``). Rows are carried through one sort and one grouping, so
    give only the columns that are needed. Input columns called ``subroot``,
    ``root`` or ``path`` are replaced. A row is a leaf as often as it occurs;
    the leaf must not be null. An empty table gives no rows.
    """
    others = [c for c in rows.columns if c not in ("subroot", "root", "path")]
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")), F.lit(""))
    held = F.struct(*[F.col(f"`{c}`") for c in others])
    leaves = rows.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{leaf_col}`").alias("leaf"), held.alias("row"))
    tiers = log_segments(leaves, ["id", "leaf"])
    roots = _roots(tiers).select(F.lit("").alias("tree"), "leaf", F.col("tree").alias("name"), F.struct(F.col("tree").alias("name")).alias("row"))
    top = stage(_proved(log_segments(roots, ["name"])).select(F.col("row.name").alias("tree"), F.col("path").alias("__over"), F.col("root").alias("__top")))
    made = _proved(tiers).join(top, "tree")
    return made.select("row.*", F.col("root").alias("subroot"), F.col("__top").alias("root"), F.concat("path", "__over").alias("path"))


def manifest_log(rows: DataFrame, leaf_col: str = "leaf", tree_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``(tree, position, digest)``: the nodes of every tree at their places in its postorder log.

    ``tree`` is ``tree_col`` as text. This is the form to store or to append to.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{tree_col}`").cast("string")), F.lit(""))
    leaves = rows.select(tree.alias("tree"), F.col(f"`{id_col}`").alias("id"), F.col(f"`{leaf_col}`").alias("leaf"), F.struct(F.lit(0).alias("none")).alias("row"))
    tiers = log_segments(leaves, ["id", "leaf"])
    sizes = tiers[0].groupBy("tree").agg(F.max("n").alias("leaves"))
    out = None
    for depth, segments in enumerate(tiers):

        def addressed(batches: Iterator[pa.RecordBatch], depth: int = depth) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for name, block, n, leaves, log in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "n", "leaves", "log"))):
                    own = min(n - (block << TIER), 1 << TIER)
                    nodes = [
                        (position(level + depth * TIER, (block << TIER - level) + i, leaves), log[position(level, i, own)])
                        for level in range(1 if depth else 0, _height(n) + 1)
                        for i in range(-(-own >> level))
                    ]
                    places, digests = zip(*nodes)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(nodes)), pa.array(places, pa.int64()), pa.array(digests)], names=["tree", "position", "digest"])

        part = segments.select("tree", "block", "n", "log").join(sizes, "tree").mapInArrow(addressed, "tree string, position long, digest string")
        out = part if out is None else out.union(part)
    return out.select(F.expr("if(tree = '', NULL, substring(tree, 2))").alias("tree"), "position", "digest")
