"""Cleaning and scoring text as it arrives.

The text functions and a trained model are row-local, so the batch code runs
on a stream unchanged and keeps no state between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from labelloom.functions.text import clean_text, content_tokens, join_tokens
from labelloom.sources.models import TextModel, load_model, published


def clean_stream(stream: DataFrame, text: str) -> DataFrame:
    """Adds ``text_clean``, the joined content words, to a stream."""
    cleaned = stream.withColumn("_clean", clean_text(text))  # a column of its own is worked out once for both uses
    return cleaned.withColumn("text_clean", join_tokens(content_tokens("_clean"))).drop("_clean")


def score_stream(stream: DataFrame, model: TextModel, text: str) -> DataFrame:
    """Adds the predicted label ``pred`` to a stream of raw texts."""
    return model.predict(stream, text)


def write_stream(stream: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream to parquet; ``once`` stops when all data at hand is done."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def score_batches(
    stream: DataFrame, models: str, text: str, path: str, checkpoint: str, id_col: str | None = None, once: bool = False
) -> StreamingQuery:
    """Score a growing stream batch by batch, by the newest model published under ``models``.

    Each batch looks for a newer model (``sources.models.publish_model``) and adds
    ``pred`` and ``model_version``. It is written to a folder of its own number
    under ``path``, in place of what an earlier try of the same batch left, so
    after a restart no row is lost or there twice. A batch is an ordinary frame:
    vocabularies and lemma tables of any size are joined.
    """
    spark = stream.sparkSession
    held: dict[int, TextModel] = {}

    def scored(batch: DataFrame, number: int) -> None:
        version = published(spark, models)
        if version is None:
            raise FileNotFoundError(f"no model is published under {models}")
        if version not in held:
            held.clear()
            held[version] = load_model(spark, f"{models}/version={version}")
        found = held[version].predict(batch, text, id_col=id_col).withColumn("model_version", F.lit(version))
        found.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = stream.writeStream.foreachBatch(scored).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
