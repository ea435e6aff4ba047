"""Path helpers on the Hadoop file system, so they work on any cluster store."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import datetime, timezone

from pyspark.sql import SparkSession

# --- Fixed values -----------------------------------------------------------
# Where the labelled CSV is looked for when no usable path is given, the folder
# of all runs, and the two time stamp formats of run names.
DEFAULT_CANDIDATES = (
    "dataset/data/labeled_data.csv",
    "dataset/labeled_data.csv",
    "data/labeled_data.csv",
    "labeled_data.csv",
)
RUNS_FOLDER = "artifacts"
STAMP_UTC = "%Y%m%dT%H%M%SZ"
STAMP_LOCAL = "%Y%m%d_%H%M%S"
# ----------------------------------------------------------------------------


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path exists on its own file system (local, HDFS, object store)."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop_path)


def first_existing(
    spark: SparkSession, path: str | None = None, candidates: Iterable[str] = DEFAULT_CANDIDATES
) -> str:
    """The given path if it exists, else the first candidate that does."""
    for option in ([path] if path else []) + list(candidates):
        if path_exists(spark, option):
            return option
    raise FileNotFoundError(f"no data found at {path!r} or the usual places; give its path")


def run_path(
    spark: SparkSession,
    name: str | None = None,
    base: str = RUNS_FOLDER,
    force: bool = False,
    reuse: bool = False,
    now: datetime | None = None,
) -> str:
    """The folder of a run.

    A taken name gets a time stamp appended, unless ``force`` (write over it) or
    ``reuse`` (the narrow workflow's way: share it, stamp in local time).
    """
    if reuse:
        return f"{base}/{name or (now or datetime.now()).strftime(STAMP_LOCAL)}"
    stamp = (now or datetime.now(timezone.utc)).strftime(STAMP_UTC)
    path = f"{base}/{name or f'run_{stamp}'}"
    if not force and path_exists(spark, path):
        path = f"{path}_{stamp}"
    return path
