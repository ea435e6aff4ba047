"""Near-duplicate texts by BagMinHash signatures, banding and verified multiset overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from labelloom.llm.words import GOLDEN, chunk_shingles, chunk_words, chunks, mix
from labelloom.plans.staging import stage

SIMILARITY = 0.8
BANDS, ROWS = 40, 6  # two texts at 0.8 meet in no band with probability 5e-6
COMPONENTS = BANDS * ROWS
SLACK = 5.0  # a component stays empty in the first pass with probability exp(-SLACK)
ESTIMATE = 0.66  # least estimated similarity of pairs that are verified; five standard errors below 0.8
CHUNK = 512
FAN = 128


def _bag(grams: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(doc, gram, multiplicity)`` of the distinct grams of each text."""
    order = np.lexsort((grams, docs))
    g, d = grams[order], docs[order]
    first = np.flatnonzero(np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])]) if len(g) else np.empty(0, dtype=np.int64)
    return d[first], g[first], np.diff(np.r_[first, len(g)])


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_minhash(grams: np.ndarray, offsets: np.ndarray, m: int = COMPONENTS) -> np.ndarray:
    """One row of ``m`` 64-bit signature values per text; rows of texts without grams are 0.

    A gram of multiplicity w is the strip [0, w) of a Poisson process over
    (time, weight), the same for all texts. The weight axis is discretised into
    [0, 1), [1, 2), [2, 4), [4, 8) ..., each with a process of its own seeded by
    the gram and the interval, so a gram needs about log2(w) processes and not w;
    of the last interval only points below w count. A point falls on a random
    component, and a component's value is its first point. Two texts agree in a
    component with the probability of their weighted Jaccard similarity. Points
    after the time by which all components are expected to be filled are never made; texts where one
    stays empty go on to twice that time.
    """
    n = len(offsets) - 1
    out = np.zeros((n, m), dtype=np.uint64)
    size = np.diff(offsets)
    doc, gram, weight = _bag(grams, np.repeat(np.arange(n), size))
    horizon = np.zeros(n)
    horizon[size > 0] = (np.log(m) + SLACK) / size[size > 0]
    todo = size > 0
    while todo.any():
        here = todo[doc]
        d, g, w = doc[here], gram[here], weight[here]
        shells = np.ceil(np.log2(np.maximum(w, 1))).astype(np.int64) + 1
        at = np.repeat(np.arange(len(d)), shells)
        k = np.arange(len(at)) - np.repeat(np.cumsum(shells) - shells, shells)
        low = np.where(k == 0, 0.0, 2.0 ** (k - 1))
        length = np.maximum(low, 1.0)
        seed = mix(g[at] + k.astype(np.uint64) * np.uint64(GOLDEN))
        d, top = d[at], w[at]
        time = np.zeros(len(at))
        keys, times, marks = [], [], []
        i = 0
        while len(d):
            point = mix(seed + np.uint64((2 * i + 1) * GOLDEN & (2**64 - 1)))
            time = time - np.log(_uniform(point)) / (m * length)
            alive = time < horizon[d]
            d, seed, low, length, top, time, point = (x[alive] for x in (d, seed, low, length, top, time, point))
            where = mix(point + np.uint64(GOLDEN))
            counts = low + length * _uniform(mix(where)) < top
            keys.append(d[counts] * m + (where[counts] % np.uint64(m)).astype(np.int64))
            times.append(time[counts])
            marks.append(where[counts])
            i += 1
        key, time, mark = np.concatenate(keys), np.concatenate(times), np.concatenate(marks)
        order = np.lexsort((time, key))
        key, mark = key[order], mark[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, dtype=np.int64)
        filled = np.bincount(key[first] // m, minlength=n)
        out.reshape(-1)[key[first]] = mark[first]
        todo &= filled < m
        horizon[todo] *= 2
    return out


def _bands(signature: np.ndarray) -> np.ndarray:
    """One 64-bit value per band; bands of different places never meet."""
    parts = signature.reshape(len(signature), BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)[None, :] * np.uint64(GOLDEN) + np.zeros((len(signature), 1), dtype=np.uint64)
    for r in range(ROWS):
        out = mix(out + parts[:, :, r])
    return out


def signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(id, fp, c1, c2, grams, bands, sketch)``: c1, c2 fingerprint the sequence of words."""
    for batch in batches:
        ids, fps = batch["id"].to_numpy(), batch["fp"].to_numpy()
        for first, last, held in chunks(batch["text"].tolist()):
            words, at = chunk_words(held)
            grams, gat = chunk_shingles(words, at)
            place = np.arange(len(words)) - np.repeat(at[:-1], np.diff(at))
            sums = []
            for salt in (1, 2):
                v = mix(words + place.astype(np.uint64) * np.uint64(GOLDEN) + np.uint64(salt << 40))
                total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(v, dtype=np.uint64)])
                sums.append((total[at[1:]] - total[at[:-1]]).view(np.int64))
            signature = bag_minhash(grams, gat)
            bands = _bands(signature).view(np.int64)
            sketch = signature.astype(np.uint16)
            some = np.diff(gat) > 0
            yield pd.DataFrame(
                {
                    "id": ids[first:last], "fp": fps[first:last], "c1": sums[0], "c2": sums[1], "grams": np.diff(gat),
                    "bands": [b if s else [] for b, s in zip(bands.tolist(), some)], "sketch": [x.tobytes() for x in sketch],
                }
            )


def _runs(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The rows of each key, from batches in which the rows of a key follow each other."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        k = batch[keys].to_numpy()
        cuts = np.flatnonzero((k[1:] != k[:-1]).any(axis=1)) + 1
        if held and (held[-1][keys].to_numpy()[-1] != k[0]).any():
            yield pd.concat(held)
            held = []
        edges = [0, *cuts, len(batch)]
        for a, b in zip(edges, edges[1:]):
            held.append(batch.iloc[a:b])
            if b < len(batch):
                yield pd.concat(held) if len(held) > 1 else held[0]
                held = []
    if held:
        yield pd.concat(held)


def _overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets, as (sorted values, multiplicities)."""
    at = np.minimum(np.searchsorted(a[0], b[0]), max(len(a[0]) - 1, 0))
    same = a[0][at] == b[0] if len(a[0]) else np.zeros(len(b[0]), dtype=bool)
    inter = int(np.minimum(a[1][at[same]], b[1][same]).sum())
    return inter / max(int(a[1].sum() + b[1].sum()) - inter, 1)


def _verify(texts: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' multisets of shingles are similar enough; staged.

    ``texts`` holds the candidates' texts; ``pairs`` is staged. The pairs of one ``a`` are
    dealt into groups of about ``FAN``; a task reads a group's first text and
    then compares the others as they come, so no group is held.
    """
    texts = texts.hint("merge")
    fans = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / FAN).alias("fan"))
    dealt = stage(pairs.join(stage(fans), "a").select("a", "b", F.pmod(F.xxhash64("b"), "fan").cast("int").alias("g")))
    firsts = dealt.select("a", "g").distinct().join(texts, F.col("a") == F.col("id")).select("a", "g", F.lit(None).cast("long").alias("b"), "text")
    others = dealt.join(texts, F.col("b") == F.col("id")).select("a", "g", "b", "text")
    both = firsts.union(others).repartition("a", "g").sortWithinPartitions("a", "g", F.col("b").asc_nulls_first())

    def compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, found = None, []
        for batch in batches:
            a, b, first = batch["a"].to_numpy(), batch["b"].to_numpy(), batch["b"].isna().to_numpy()
            for start, stop, held in chunks(batch["text"].tolist()):
                grams, at = chunk_shingles(*chunk_words(held))
                for i in range(start, stop):
                    bag = np.unique(grams[at[i - start] : at[i - start + 1]], return_counts=True)
                    if first[i]:
                        own = bag
                    elif _overlap(own, bag) >= similarity:
                        found.append((int(a[i]), int(b[i])))
            yield pd.DataFrame(found, columns=["a", "b"]).astype("int64")
            found = []

    return stage(both.mapInPandas(compared, "a long, b long"))


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """``(node, comp)`` of every node of ``links`` (a, b): the least node it is connected with; staged.

    ``start`` has labels found from some of the links, so that only what later
    links join is still to be done. Each round takes the least label among a node's neighbours (a sum with
    partial results, so a hub is no hot spot) and then the label's own label,
    and is staged. It ends when nothing changes.
    """
    both = stage(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    labels = labels.select("node", F.least("node", "near").alias("comp"))
    if start is not None:
        labels = labels.join(start.withColumnRenamed("comp", "was"), "node", "left").select("node", F.least("comp", "was").alias("comp"))
    labels = stage(labels)
    while True:
        least = both.join(labels, F.col("b") == F.col("node")).groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        nearer = stage(labels.join(least, "node", "left").select("node", "comp", F.least("comp", "near").alias("now")))
        if not nearer.agg(F.max(F.col("now") < F.col("comp"))).first()[0]:
            return labels
        jump = nearer.select(F.col("node").alias("now"), F.col("now").alias("next"))
        labels = stage(nearer.join(jump, "now", "left").select("node", F.least("now", "next").alias("comp")))


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """``rows`` (with ``node``) and the node's component, itself where it has no link."""
    return rows.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _untested(pairs: DataFrame, tested: DataFrame) -> DataFrame:
    pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return pairs.join(tested.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti")


def _cards(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(id, bag)``: the sorted 32-bit hashes of a text's shingles, each occurrence counted as another value."""
    for batch in batches:
        ids = batch["id"].to_numpy()
        for first, last, held in chunks(batch["text"].tolist()):
            grams, at = chunk_shingles(*chunk_words(held))
            bags = []
            for i in range(last - first):
                own = np.sort(grams[at[i] : at[i + 1]])
                nth = np.arange(len(own)) - np.searchsorted(own, own)
                bags.append(np.unique(mix(own + nth.astype(np.uint64) * np.uint64(GOLDEN)).astype(np.uint32)).tobytes())
            yield pd.DataFrame({"id": ids[first:last], "bag": bags})


def _cell_links(batches: Iterator[pd.DataFrame], similarity: float) -> Iterator[pd.DataFrame]:
    """One pair of similar bags for each outer node and other component, if there is any.

    A pair is looked at in the first band that its nodes share, and only where
    their sketches agree in at least ESTIMATE of the components; the closest
    sketches come first.
    """
    for run in _runs(batches, ["bucket", "oc", "fc"]):
        side, node, comp = run["outer"].to_numpy(), run["node"].to_numpy(), run["comp"].to_numpy()
        sketch = np.frombuffer(b"".join(run["sketch"]), dtype=np.uint16).reshape(len(run), COMPONENTS)
        bands = np.stack(run["bands"].to_numpy())
        bags = [np.frombuffer(b, dtype=np.uint32) for b in run["bag"]]
        band = int(np.flatnonzero(bands[0] == run["bucket"].iloc[0])[0])
        inner = np.flatnonzero(~side)
        found = []
        for o in np.flatnonzero(side):
            other = inner[comp[inner] != comp[o]]
            agreed = (sketch[other] == sketch[o]).mean(axis=1)
            fresh = (agreed >= ESTIMATE) & ~(bands[other, :band] == bands[o, :band]).any(axis=1)
            joined: set[int] = set()
            for f in other[fresh][np.argsort(-agreed[fresh], kind="stable")]:
                if comp[f] not in joined:
                    both = len(np.intersect1d(bags[o], bags[f], assume_unique=True))
                    if both >= similarity * (len(bags[o]) + len(bags[f]) - both):
                        joined.add(comp[f])
                        found.append((node[o], node[f]))
        if found:
            yield pd.DataFrame(found, columns=["a", "b"])


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """Staged ``(id, fp, class_id, keeper)`` of every distinct id and text; ``fp`` is ``text_fingerprint``.

    Two texts are linked when the weighted Jaccard similarity of their multisets
    of five-word shingles is at least ``similarity``; a class is what links
    connect, named by its least id. ``keeper`` marks the one text that stands for
    its class: that of the least id, of several the one with the least ``fp``.
    Texts with the same words are one node from the start, by a 128-bit
    fingerprint, so copies are never paired. Nodes are texts, not ids: an id that
    comes with several texts has a row, and maybe a class, for each.

    Nodes that share a band of their signatures are candidates. First every node
    is compared with the least of its bucket, then with a random one of another
    component. These stars are linear in the bucket's size and join nearly all
    of a group. Buckets that still hold several components are searched in
    blocks of ``CHUNK`` by ``CHUNK`` nodes, those outside the bucket's largest
    component against all, for pairs of different components: by sketch, then by
    the multisets themselves. Only pairs that link leave the task, and are
    verified on the texts. So every pair of a bucket is linked, tested, ruled
    out by its sketch, or lies within one class already.

    A text of one to four words is one shingle; one without words (null and empty, too) is
    a class of its own. Rows without id are left out. An empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_fingerprint(text_col).alias("fp"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    named = rows.where(F.col("id").isNotNull())
    sig = named.mapInPandas(signatures, "id long, fp long, c1 long, c2 long, grams long, bands array<long>, sketch binary")
    sig = stage(sig.withColumn("row", F.monotonically_increasing_id()))
    copies = sig.where("grams > 0").groupBy("c1", "c2").agg(F.min("row").alias("rep"), F.max("row").alias("last"))
    copies = stage(copies.where("rep < last").select("c1", "c2", "rep"))
    member = stage(
        sig.select("row", "id", "fp", "c1", "c2", "grams")
        .join(copies, ["c1", "c2"], "left")
        .select("row", "id", "fp", F.when(F.col("grams") > 0, F.col("rep")).alias("rep"))
        .select("row", "id", "fp", F.coalesce("rep", "row").alias("node"))
    )
    nodes = member.where("row = node").select("node", "id", "fp")
    placed = sig.select(F.col("row").alias("node"), "bands").join(nodes.select("node"), "node")
    placed = stage(placed.select("node", F.explode("bands").alias("bucket")))
    full = stage(placed.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("bucket", "lo"))
    met = stage(placed.join(full, "bucket"))
    tested = stage(met.where("node > lo").select(F.col("lo").alias("a"), F.col("node").alias("b")).distinct())
    asked = stage(met.select("node").distinct().join(nodes, "node"))
    texts = named.join(asked.hint("merge"), ["id", "fp"]).groupBy(F.col("node").alias("id")).agg(F.min("text").alias("text"))
    texts = stage(texts)
    links = _verify(texts, tested, similarity)
    labels = components(links)

    crowded = met.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 2").select("bucket")
    met = stage(met.join(stage(crowded), "bucket").select("bucket", "node"))
    marked = stage(_labelled(met, labels))
    split = marked.groupBy("bucket").agg(
        F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.min(F.struct(F.xxhash64("node", F.lit(7)).alias("h"), "node", "comp")).alias("pick")
    )
    split = stage(split.where("c0 < c1").select("bucket", F.col("pick.node").alias("rep"), F.col("pick.comp").alias("rep_comp")))
    star = marked.join(split, "bucket").where("comp <> rep_comp").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    more = stage(_untested(star, tested))
    links = links.union(_verify(texts, more, similarity))
    labels, tested = components(links, labels), tested.union(more)

    marked = stage(_labelled(met.join(split.select("bucket"), "bucket"), labels))
    parts = marked.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("size"))
    parts = parts.groupBy("bucket").agg(
        F.max(F.struct("size", "comp")).alias("top"), F.sum("size").alias("n"), F.count(F.lit(1)).alias("comps")
    )
    parts = parts.where("comps > 1").select("bucket", F.col("top.comp").alias("main"), "n", (F.col("n") - F.col("top.size")).alias("rest"))
    left = marked.join(stage(parts), "bucket").withColumn("h", F.xxhash64("node"))
    ocs, fcs = F.ceil(F.col("rest") / CHUNK).cast("int"), F.ceil(F.col("n") / CHUNK).cast("int")
    inner = left.select("bucket", "node", "comp", F.pmod("h", fcs).cast("int").alias("fc"), F.explode(F.sequence(F.lit(0), ocs - 1)).alias("oc"), F.lit(False).alias("outer"))
    outer = left.where("comp <> main").select(
        "bucket", "node", "comp", F.explode(F.sequence(F.lit(0), fcs - 1)).alias("fc"), F.pmod("h", ocs).cast("int").alias("oc"), F.lit(True).alias("outer")
    )
    cells = stage(inner.select(*(order := ["bucket", "oc", "fc", "node", "comp", "outer"])).union(outer.select(*order)))
    own = stage(cells.select(F.col("node").alias("id")).distinct())
    sketches = sig.select(F.col("row").alias("id"), "bands", "sketch").join(own, "id")
    cards = texts.join(own, "id").mapInPandas(_cards, "id long, bag binary").join(sketches, "id")
    cards = stage(cards.select("id", "bands", "sketch", "bag"))
    cells = cells.join(cards, F.col("node") == F.col("id")).drop("id")
    cells = cells.repartition("bucket", "oc", "fc").sortWithinPartitions("bucket", "oc", "fc")
    rest = stage(_untested(cells.mapInPandas(lambda parts: _cell_links(parts, similarity), "a long, b long"), tested))
    links = links.union(_verify(texts, rest, similarity))
    labels = components(links, labels)

    classed = stage(_labelled(member.select("id", "fp", "node"), labels).select("id", "fp", "comp"))
    ends = classed.groupBy("comp").agg(F.min(F.struct("id", "fp")).alias("end"))
    found = classed.join(stage(ends), "comp").groupBy("id", "fp").agg(F.min("end").alias("end"))
    return stage(found.select("id", "fp", F.col("end.id").alias("class_id"), F.struct("id", "fp").eqNullSafe(F.col("end")).alias("keeper")))


def text_fingerprint(text_col: str) -> Column:
    """64-bit hash of a whole text, null being empty: it tells apart the texts of one id."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``(id, class_id)`` per row: the class of its text (see ``near_classes``).

    A row without id is a class of its own, whose name is null. Rows that repeat an id are each a row.
    """
    found = near_classes(docs, id_col, text_col, similarity).select("id", "fp", "class_id")
    every = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_fingerprint(text_col).alias("fp"))
    return every.join(found, ["id", "fp"], "left").select(F.col("id").alias(id_col), "class_id")
