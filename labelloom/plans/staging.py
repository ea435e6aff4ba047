"""Where plans are cut, and how the size of a small join side is checked.

A staged table is parquet in the cluster's shared folder
(``spark.checkpoint.dir``, else below the warehouse). It does three jobs: text is cleaned once instead of
once per use, a lost executor costs one re-read instead of the whole lineage,
and Catalyst knows the true size of the table. The last point is why the joins
with class tables carry no hints: a staged table is broadcast when it is under
``spark.sql.autoBroadcastJoinThreshold`` and merge-joined, with AQE's skew
handling, when it is not. Only a table measured by ``fits_in_memory`` is
broadcast on request, and sides that unfold in ways Catalyst cannot estimate
ask for a merge join.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Most rows and text bytes that may be copied to every executor.
MAX_SHARED_ROWS = 1_000_000
MAX_SHARED_BYTES = 64 * 1024 * 1024


def staging_root(spark: SparkSession) -> str:
    """The shared folder of this session.

    ``spark.checkpoint.dir`` where it is set, else a folder below the warehouse.
    A warehouse on a local disk is refused on a cluster, whose machines would
    each write to their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    scheme = spark._jvm.org.apache.hadoop.fs.Path(warehouse).toUri().getScheme()
    if (scheme or "file") == "file" and not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{warehouse} is local to each machine; set spark.checkpoint.dir to a folder that all of them share")
    return f"{warehouse}/_staged"


def staging_path(spark: SparkSession, kind: str = "stage") -> str:
    """A path in the shared folder that no other table uses."""
    return f"{staging_root(spark)}/labelloom/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def stage(df: DataFrame, schema: T.StructType | None = None) -> DataFrame:
    """Write ``df`` once and read it back, as ``schema`` if one of the same storage form is given."""
    spark = df.sparkSession
    path = staging_path(spark)
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def clear_staged(spark: SparkSession) -> None:
    """Delete the tables this application staged; call it when done with them."""
    path = f"{staging_root(spark)}/labelloom/{spark.sparkContext.applicationId}"
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.delete(hadoop_path, True)


def fits_in_memory(df: DataFrame, max_rows: int = MAX_SHARED_ROWS, max_bytes: int = MAX_SHARED_BYTES) -> bool:
    """Whether ``df`` is proven small enough to copy to every executor."""
    strings = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0)) for c in strings), F.lit(16))
    found = df.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(width.cast("long")), F.lit(0)).alias("bytes")
    ).first()
    return found["rows"] <= max_rows and found["bytes"] <= max_bytes


def spread(df: DataFrame, key: str) -> DataFrame:
    """Use all cores on an input that came in fewer pieces than there are cores.

    Large inputs already arrive in many splits and are returned as they are, so
    big text never shuffles here. Hash partitioning by the row's key keeps the
    result the same when a task is run again.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df
