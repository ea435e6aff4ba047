"""SimHash links against comparing all pairs."""

import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from labelloom.llm import simhash


def plain_fingerprint(text):
    lower = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\\x20\\x09-\\x0D]+", lower)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in hashes) > len(hashes)) if hashes else 0


def plain_components(values, radius=3):
    """{value: least value it is connected with}."""
    values = sorted(set(values))
    label = {v: v for v in values}

    def root(v):
        while label[v] != v:
            v = label[v]
        return v

    for i, a in enumerate(values):
        for b in values[i + 1 :]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {v: root(v) for v in values}


TEXTS = [None, "", " \t\n", "One", "one", "a b", "A B c", "a b c d a b c d", "É x y z\x0bw\x0cv", "\x1fa b c", "w " * 70_000 + "x"]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint_by_hand(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_planes_give_the_pairs_within_the_radius(radius):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**64, 130, dtype=np.uint64)
    b = np.concatenate([a ^ np.uint64((1 << k) - 1 << 7) for k in range(8)])
    apart = np.zeros((len(a), -(-len(b) // 64)), dtype=np.uint64)
    q, lane = simhash.near_lanes(a, simhash.planes(b), apart, radius)
    inside = lane < len(b)
    expected = np.argwhere(np.bitwise_count(a[:, None] ^ b[None, :]) <= radius)
    assert sorted(zip(q[inside], lane[inside])) == sorted(map(tuple, expected))


def test_some_key_of_near_fingerprints_is_equal():
    rng = np.random.default_rng(2)
    masks = simhash.key_masks()
    assert len(masks) == 20
    for bits in rng.integers(0, 64, (500, 3)).tolist():
        change = sum(1 << b for b in set(bits))
        assert any(change & m == 0 for m in masks)


def test_links_of_a_crowded_bucket_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    crowd = {int(x) for x in np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 22, (2_500, 4), dtype=np.uint64), axis=1)}
    alone = {int(x) for x in rng.integers(0, 2**64, 200, dtype=np.uint64)}
    chain = {(1 << 60) ^ ((1 << k) - 1 << 30) for k in range(0, 24, 3)}
    values = sorted(crowd | alone | chain)
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    found = simhash.link_fingerprints(spark.createDataFrame([(v,) for v in signed], "fp long")).collect()
    comps = {}
    for r in found:
        comps.setdefault(r["comp"], set()).add(r["node"] % (1 << 64))
    expected = {}
    for v, c in plain_components(values).items():
        expected.setdefault(c, set()).add(v)
    assert sorted(map(sorted, comps.values())) == sorted(sorted(x) for x in expected.values() if len(x) > 1)


def test_documents_equal_all_pairs(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(9_001, None), (9_000, ""), (None, "lonely words here"), (9_002, "x y z"), (9_002, "x y z"), (9_003, "X Y\tZ"), (None, "x y z")], "doc_id long, text string")
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.union(odd).collect()]
    comp = plain_components([fp for _, fp in rows])
    least = {}
    for i, fp in rows:
        if i is not None:
            least[comp[fp]] = min(i, least.get(comp[fp], i))
    table = docs.union(odd).select("*", *[F.lit(0).alias(c) for c in ("fp", "component_id", "fingerprint", "id", "comp")])
    found = simhash.simhash_duplicates(table)
    assert found.columns == ["doc_id", "fingerprint", "component_id"]
    got = sorted(((r["doc_id"], r["fingerprint"] % (1 << 64), r["component_id"]) for r in found.collect()), key=repr)
    assert got == sorted(((i, fp, least.get(comp[fp])) for i, fp in rows), key=repr)
    assert simhash.simhash_duplicates(table.where("false")).count() == 0
