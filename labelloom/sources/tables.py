"""Reading labelled text and writing the tables of a run."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from labelloom.plans.staging import spread
from labelloom.sources.paths import path_exists

# --- Fixed values -----------------------------------------------------------
# Columns of the labelled corpus file, and the metrics of one model.
CORPUS_SCHEMA = T.StructType(
    [
        T.StructField("count", T.IntegerType()),
        T.StructField("hate_speech", T.IntegerType()),
        T.StructField("offensive_language", T.IntegerType()),
        T.StructField("neither", T.IntegerType()),
        T.StructField("class", T.IntegerType()),
        T.StructField("tweet", T.StringType()),
    ]
)
METRICS = ("accuracy", "precision", "recall", "f1")
# ----------------------------------------------------------------------------


def read_labeled_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | None = None,
    na_values: Iterable[str] = (),
    multiline: bool = True,
) -> DataFrame:
    """UTF-8 CSV with a header; quoted text may hold quotes and line breaks.

    Without a schema the types are inferred, which reads the data once more.
    ``multiline`` files are read one file per task; ``quoted.read_quoted_csv``
    splits them, and so does turning it off where no text holds a line break. ``na_values`` lists texts that also mean null (Spark itself takes only the
    empty field as null); they are applied to string columns.
    """
    reader = spark.read.option("header", True).option("encoding", "UTF-8")
    reader = reader.option("multiLine", multiline).option("quote", '"').option("escape", '"')
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return without_missing(reader.csv(path), na_values)


def without_missing(df: DataFrame, na_values: Iterable[str]) -> DataFrame:
    """``df`` with null in place of the listed texts in string columns."""
    missing = list(na_values)
    if not missing:
        return df
    return df.select(
        [
            F.when(~F.col(f"`{f.name}`").isin(missing), F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def read_table(spark: SparkSession, path: str, key: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A parquet table, pruned to ``columns`` and spread over the cores if tiny."""
    df = spark.read.parquet(path)
    return spread(df.select(*columns) if columns else df, key)


def head_sample(df: DataFrame, n: int, order_by: str | list[str]) -> DataFrame:
    """The first ``n`` rows in the given order (a top-n, not a full sort)."""
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*keys).limit(n)


def write_table(df: DataFrame, run: str, name: str, fmt: str = "parquet", mode: str = "errorifexists") -> str:
    """Save ``df`` as dataset ``name`` of a run; returns its path.

    ``fmt`` is parquet, json, csv (with header) or text (one string column).
    Failures are raised, never swallowed.
    """
    path = f"{run}/{name}"
    writer = df.write.mode(mode)
    if fmt == "csv":
        writer = writer.option("header", True).option("quote", '"').option("escape", '"')
    writer.format(fmt).save(path)
    return path


def metrics_document(metrics: DataFrame) -> DataFrame:
    """``{model: {metric: value}}`` as one JSON document in one row (column ``value``).

    Models stand in the order of ``ordinal``, or by name where there is none.
    """
    place = F.col("ordinal") if "ordinal" in metrics.columns else F.lit(0)
    listed = F.sort_array(F.collect_list(F.struct(place.alias("place"), "model", F.struct(*METRICS).alias("values"))))
    entries = F.transform(listed, lambda e: F.struct(e["model"], e["values"]))
    return metrics.agg(F.to_json(F.map_from_entries(entries)).alias("value"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame | None:
    """One row per model of a metrics document, with its position as ``ordinal``.

    Returns ``None``, with a notice, when there is no such file.
    """
    if not path_exists(spark, path):
        print(f"no baseline metrics at {path}; the comparison goes on without them")
        return None
    shape = T.MapType(T.StringType(), T.MapType(T.StringType(), T.DoubleType()))
    document = spark.read.text(path, wholetext=True).select(F.from_json("value", shape).alias("models"))
    rows = document.select(F.posexplode("models").alias("ordinal", "model", "values"))
    return rows.select("model", "ordinal", *[F.col("values")[name].alias(name) for name in METRICS])
