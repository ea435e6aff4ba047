"""One query per operator of this subpackage, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.llm.decontaminate import find_leaks
from labelloom.llm.html import extract_main_text
from labelloom.llm.labels import fold
from labelloom.llm.language import fit_language, identify_language
from labelloom.llm.lines import dedup_lines
from labelloom.llm.merkle import folded, leaf_digest, merkle_manifest, proof_digest
from labelloom.llm.mixing import mix_sources
from labelloom.llm.near import near_duplicates
from labelloom.llm.quality import fit_quality, score_quality
from labelloom.llm.simhash import simhash_duplicates
from labelloom.llm.tokens import count_tokens, read_vocabulary
from labelloom.llm.topk import top_k
from labelloom.llm.toxicity import fit_toxicity, score_toxicity
from labelloom.llm.whitening import fit_whitening, identity_error, whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(build):
    QUERIES[build.__name__] = build
    return build


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


@query
def op1_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Main text of every page."""
    pages = extract_main_text(spark.read.parquet(f"{sf}/pages.parquet"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op2_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of every document."""
    return count_tokens(documents(spark, sf).select("doc_id", "text"), read_vocabulary()).select("doc_id", "n_tokens")


@query
def op3_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    """Block and slot of every document in a mixture by the square root of each source's size."""
    mixed = mix_sources(documents(spark, sf).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "stream", "block", "slot")


@query
def op4_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of at least three documents stay only in the largest doc_id."""
    kept = dedup_lines(documents(spark, sf).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLES["op4_line_dedup"] = r"""
WITH lines AS (
    SELECT doc_id, u.pos, u.line,
           translate(trim(u.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d,
         LATERAL (SELECT unnest(range(len(parts))) AS pos, unnest(parts) AS line) u
), repeated AS (
    SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
    GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
    SELECT l.doc_id, l.pos, l.line, r.keeper IS NOT NULL AND r.keeper <> l.doc_id AS gone
    FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


@query
def op5_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Class of every document under links of 0.8 or more."""
    return near_duplicates(documents(spark, sf))


@query
def op6_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Quality of every document, learnt from the rows of two folds of three."""
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit_quality(docs, labels, "quality", fold("doc_id", 3) != 1)
    scored = score_quality(docs.select("doc_id", "text"), model)
    held_out = (fold("doc_id", 3) == 1).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_language(spark: SparkSession, sf: str) -> DataFrame:
    """Language of every document, learnt from the rows of three folds of four."""
    docs = documents(spark, sf)
    found = identify_language(docs.select("doc_id", "text"), fit_language(docs, fold("doc_id", 4) != 2))
    held_out = (fold("doc_id", 4) == 2).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "ambiguous")


@query
def op8_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item in tiles of five words or more."""
    return find_leaks(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


@query
def op9_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    """Toxicity of every document, learnt from the rows of two folds of three."""
    docs, labels = documents(spark, sf), spark.read.parquet(f"{sf}/labels.parquet")
    model = fit_toxicity(docs, labels, "toxic", fold("doc_id", 3) != 1)
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    held_out = (fold("doc_id", 3) == 1).alias("held_out")
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op10_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """Ten largest inner products of every hundredth vector, among all others."""
    return top_k(spark.read.parquet(f"{sf}/embeddings.parquet"), F.col("id") % 100 == 0)


ORACLES["op10_top_k"] = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
    FROM v q, v c WHERE q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id, score
FROM scored QUALIFY rank <= 10
"""


@query
def op11_embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Every vector along the eight leading components of all vectors, each scaled to unit variance."""
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding")
    model = fit_whitening(vectors)
    error = identity_error(vectors, model)
    shares = F.array(*[F.lit(float(e / model.trace)) for e in model.values]).cast("array<double>")
    rows = whiten(vectors, model).select("vec_id", F.expr("try_cast(deviation AS BIGINT)").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )


@query
def op12_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Leaf, roots and proof of every document, and whether its proof holds once one in seven is tampered with."""
    docs = documents(spark, sf)
    told = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False))
    found = F.when(told, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    leaf, now = (leaf_digest("doc_id", "source", "lang", n, "text") for n in ("n_chars", found))
    made = merkle_manifest(docs.select("doc_id", "lang", leaf.alias("leaf"), now.alias("now")))
    made = made.withColumn("folded_root", folded("now", "path"))
    return made.select(
        "doc_id", "leaf", "subroot", "root", proof_digest("path").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


# A tree's levels are lists that halve; a path is a list of L, R or - with the sibling's digest. crc32 is a fold over the id's digits.
ORACLES["op12_merkle_manifest"] = r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, row_number() OVER () AS line,
           coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
               || coalesce(strlen(lang) || ':' || lang, '-') AS head,
           coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS told,
           CASE WHEN doc_id IS NOT NULL AND xor(4294967295, list_reduce(
               list_transform(range(len(CAST(doc_id AS VARCHAR))), lambda i: CAST(ascii(CAST(doc_id AS VARCHAR)[i + 1]) AS BIGINT)),
               lambda crc, digit: list_reduce(range(8), lambda c, bit: xor(c >> 1, 3988292384 * (c & 1)), xor(crc, digit)),
               CAST(4294967295 AS BIGINT))) % 7 = 0 THEN 1 ELSE 0 END AS added,
           n_chars, coalesce(strlen(text) || ':' || text, '-') AS tail
    FROM documents
), leaves AS (
    SELECT doc_id, tree, line, sha256(head || told || tail) AS leaf,
           sha256(head || coalesce(strlen(CAST(n_chars + added AS VARCHAR)) || ':' || (n_chars + added), '-') || tail) AS now
    FROM docs
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, line) - 1 AS place FROM leaves
), levels AS (
    SELECT tree, 0 AS level, list(leaf ORDER BY place) AS nodes FROM placed GROUP BY tree
    UNION ALL
    SELECT tree, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
    FROM levels WHERE len(nodes) > 1
), subroots AS (
    SELECT tree, nodes[1] AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM levels WHERE len(nodes) = 1
), tops AS (
    SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
    UNION ALL
    SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], '')))
    FROM tops WHERE len(nodes) > 1
), above AS (
    SELECT s.tree, list(CASE WHEN t.nodes[xor(s.place >> t.level, 1) + 1] IS NULL THEN '-' WHEN (s.place >> t.level) & 1 = 1 THEN 'L' ELSE 'R' END
                        || coalesce(t.nodes[xor(s.place >> t.level, 1) + 1], '') ORDER BY t.level) AS steps
    FROM subroots s, tops t WHERE len(t.nodes) > 1 GROUP BY s.tree
), below AS (
    SELECT p.line, list(CASE WHEN l.nodes[xor(p.place >> l.level, 1) + 1] IS NULL THEN '-' WHEN (p.place >> l.level) & 1 = 1 THEN 'L' ELSE 'R' END
                        || coalesce(l.nodes[xor(p.place >> l.level, 1) + 1], '') ORDER BY l.level) AS steps
    FROM placed p JOIN levels l ON l.tree = p.tree AND len(l.nodes) > 1 GROUP BY p.line
), proved AS (
    SELECT p.doc_id, p.leaf, p.now, s.subroot, (SELECT nodes[1] FROM tops WHERE len(nodes) = 1) AS root,
           list_concat(coalesce(u.steps, []), coalesce(o.steps, [])) AS steps
    FROM placed p JOIN subroots s ON s.tree = p.tree LEFT JOIN below u ON u.line = p.line LEFT JOIN above o ON o.tree = p.tree
), ended AS (
    SELECT *, list_reduce(steps, lambda node, step: sha256(
               CASE step[1] WHEN 'L' THEN step[2:] || node WHEN 'R' THEN node || step[2:] ELSE node END), now) AS folded_root FROM proved
)
SELECT doc_id, leaf, subroot, root, sha256(list_reduce(steps, lambda text, step: text || step[2:], '')) AS proof_sha256,
       folded_root, folded_root = root AS verified
FROM ended
"""


@query
def op13_simhash_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprint of every document, and the least document that links of three bits or fewer reach."""
    found = simhash_duplicates(documents(spark, sf))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
