"""A corpus from raw documents to a mixture: five stages, each one operator of ``labelloom.llm``.

Every function takes ``(spark, docs, sf_dir)`` and returns a DataFrame; its
result is written as Parquet and read again as the next one's ``docs``. All but
the last return the columns of ``docs``. Rows without id pass every stage that
decides by id; empty tables pass as empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelloom.llm.decontaminate import find_leaks
from labelloom.llm.labels import fold
from labelloom.llm.lines import dedup_lines
from labelloom.llm.mixing import mix_sources
from labelloom.llm.near import near_classes, text_fingerprint
from labelloom.llm.quality import fit_quality, score_quality
from labelloom.plans.staging import stage

MIN_QUALITY = 0.5


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the additive model scores at MIN_QUALITY or more."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels, "quality", fold("doc_id", 3) != 1)
    scored = score_quality(docs, model, output="__quality")
    return scored.where(F.col("__quality") >= MIN_QUALITY).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that others repeat; ``n_chars`` follows the text."""
    kept = dedup_lines(docs)
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast("long"))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The text with the least id of each class; of rows that repeat an id and its text, one. Rows without id stay."""
    found = near_classes(docs)
    gone = stage(found.where(~F.col("keeper")).select(F.col("id").alias("__id"), F.col("fp").alias("__fp")))
    keyed = docs.withColumn("__fp", text_fingerprint("text"))
    here = (F.col("doc_id") == F.col("__id")) & (keyed["__fp"] == gone["__fp"])
    kept = keyed.join(gone, here, "left_anti")
    named = kept.where("doc_id IS NOT NULL").select("doc_id", "__fp")
    repeated = stage(named.groupBy("doc_id", "__fp").count().where("count > 1").select("doc_id", "__fp"))
    single = kept.join(repeated, ["doc_id", "__fp"], "left_anti")
    one = kept.join(repeated, ["doc_id", "__fp"], "left_semi").dropDuplicates(["doc_id", "__fp"])
    return single.select(*docs.columns).union(one.select(*docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    leaks = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(stage(leaks.select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their place in the mixture of sources."""
    return mix_sources(docs)


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_repeated_lines),
    ("minhash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("source mixing", mix),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stage(docs)
    return docs
