"""The Merkle manifest against a plain tree built level by level."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from labelloom.llm import merkle
from labelloom.llm.queries import op12_merkle_manifest


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h("".join(out[-1][i : i + 2])) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, at):
    return [(nodes[at >> k ^ 1] if at >> k ^ 1 < len(nodes) else None, bool(at >> k & 1)) for k, nodes in enumerate(tree[:-1])]


def plain(rows):
    """{(lang, id, leaf): (subroot, root, path)} of rows (lang, id, leaf)."""
    groups = {}
    for lang, i, leaf in rows:
        groups.setdefault(lang, []).append((i is not None, i or 0, leaf))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: levels([leaf for *_, leaf in sorted(groups[g])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    out = {}
    for k, g in enumerate(names):
        for at, (known, i, leaf) in enumerate(sorted(groups[g])):
            out.setdefault((g, i if known else None, leaf), []).append((trees[g][-1][0], top[-1][0], path(trees[g], at) + path(top, k)))
    return out


@pytest.mark.parametrize("n", [1, 2, 3, 5, 6, 7, 8, 11, 64, 100])
def test_log_is_in_postorder_and_positions_are_closed_form(n):
    leaves = [h(str(i)) for i in range(n)]
    tree = levels(leaves)
    log = merkle.append_log(leaves, len(tree) - 1)

    def postorder(level, i):
        below = [c for c in (2 * i, 2 * i + 1) if level and c < len(tree[level - 1])]
        return [x for c in below for x in postorder(level - 1, c)] + [tree[level][i]]

    assert log == postorder(len(tree) - 1, 0)
    assert all(log[merkle.position(level, i, n)] == node for level, nodes in enumerate(tree) for i, node in enumerate(nodes))


def test_manifest_equals_plain_trees(spark):
    rows = [("big", i, h(f"b{i}")) for i in range(2_500)] + [(None, i, h(f"n{i}")) for i in range(3)]
    rows += [("", 4, h("e")), ("z", None, h("z0")), ("z", 1, h("z1")), ("z", 1, h("z2")), ("z", 1, h("z2")), ("é", 9, h("x"))]
    df = spark.createDataFrame(rows, "lang string, doc_id long, leaf string").repartition(5)
    df = df.select("*", F.lit(1).alias("path"), F.lit(2).alias("root"), F.lit(3).alias("at"), F.lit("t").alias("tree"))
    made = merkle.merkle_manifest(df)
    assert made.columns == ["lang", "doc_id", "leaf", "at", "tree", "subroot", "root", "path"]
    found = {}
    for r in made.withColumn("end", merkle.folded("leaf", "path")).withColumn("proof", merkle.proof_digest("path")).collect():
        steps = [(s["digest"], s["left"]) for s in r["path"]]
        found.setdefault((r["lang"], r["doc_id"], r["leaf"]), []).append((r["subroot"], r["root"], steps))
        assert r["end"] == r["root"] and r["proof"] == h("".join(d for d, _ in steps if d))
    text = lambda x: sorted(map(repr, x))
    expected = plain(rows)
    assert found.keys() == expected.keys()
    assert all(text((s, r, [(d, left and d is not None) if d is None else (d, left) for d, left in p]) for s, r, p in found[k])
               == text((s, r, [(d, left and d is not None) if d is None else (d, left) for d, left in p]) for s, r, p in expected[k]) for k in found)


def test_stored_log_has_every_node_at_its_place(spark):
    rows = [("big", i, h(f"b{i}")) for i in range(2_500)] + [(None, 1, h("n"))]
    df = spark.createDataFrame(rows, "lang string, doc_id long, leaf string")
    found = {(r["tree"], r["position"]): r["digest"] for r in merkle.manifest_log(df).collect()}
    tree = levels([leaf for g, _, leaf in rows if g])
    nodes = {("big", merkle.position(k, i, 2_500)): node for k, level in enumerate(tree) for i, node in enumerate(level)}
    assert found == nodes | {(None, 0): h("n")}


def test_tampered_rows_fail_and_nulls_are_fields(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else f"text {i}", ["en", None, "é"][i % 3], None if i % 4 == 0 else "s", None if i % 6 == 0 else i) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op12_merkle_manifest(spark, str(tmp_path)).collect():
        i, text, lang, source, n = rows[r["doc_id"]]
        assert r["leaf"] == h("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n, text)))
        assert r["verified"] == (zlib.crc32(str(i).encode()) % 7 != 0 or n is None)


def test_empty_table_gives_no_rows(spark):
    df = spark.createDataFrame([], "lang string, doc_id long, leaf string")
    assert merkle.merkle_manifest(df).count() == 0 and merkle.manifest_log(df).count() == 0
