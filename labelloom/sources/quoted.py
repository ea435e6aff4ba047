"""Reading large CSV files whose quoted text holds line breaks, with many tasks for one file.

A line break ends a record only outside quotes, and whether a place is inside
depends on all quotes before it. Quotes are therefore counted for each split of
a file first; their running parity says whether a split begins inside quotes.
Splits are then read again, each cut into records by its own task. Only the
pieces of records that go across splits are brought together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from labelloom.sources.tables import without_missing

PIECES = "file string, start long, place int, first boolean, text string"
WHOLE, HEAD, TAIL = -1, 0, 1  # a record; the end of one begun in an earlier split; the beginning of one that goes on in the next
NUMBERS = ("int", "bigint", "double", "boolean")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files, in order within each split, with the split they are from."""
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))


def _inside(lines: DataFrame) -> DataFrame:
    """``(file, start, inside)``: whether a split begins inside quotes. A row for each split."""
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    counts = lines.groupBy("file", "start").agg((F.sum(quotes) % 2).alias("odd"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select("file", "start", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2 == 1).alias("inside"))


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records and pieces of records, from the lines of whole splits in order."""
    names = [f.split()[0] for f in PIECES.split(", ")]
    split: tuple[str, int] | None = None
    held: list[str] = []  # lines of the record that is open
    begun, fresh = True, True  # whether it began in this split; whether it is the split's first

    def open_piece() -> list[tuple]:
        return [(*split, TAIL if begun else HEAD, fresh, "\n".join(held))] if held else []

    for batch in batches:
        out: list[tuple] = []
        odd = batch["line"].str.count('"').to_numpy() % 2
        same = (batch["file"] == batch["file"].shift()) & (batch["start"] == batch["start"].shift())
        edges = [*np.flatnonzero(~same.to_numpy()), len(batch)]
        for a, b in zip(edges, edges[1:]):
            here = (batch["file"].iloc[a], int(batch["start"].iloc[a]))
            if here != split:
                out += open_piece()
                split, held, fresh, begun = here, [], True, not batch["inside"].iloc[a]
                inside = not begun
            for line, flips in zip(batch["line"].iloc[a:b], odd[a:b]):
                held.append(line)
                inside ^= bool(flips)
                if not inside:
                    out.append((*split, WHOLE if begun else HEAD, fresh, "\n".join(held)))
                    held, begun, fresh = [], True, False
        yield pd.DataFrame(out, columns=names)
    yield pd.DataFrame(open_piece(), columns=names)


def _records(spark: SparkSession, path: str) -> DataFrame:
    """``(first, text)`` of every record; ``first`` marks that of each file."""
    lines = _lines(spark, path)
    known = lines.join(F.broadcast(_inside(lines)), ["file", "start"])  # a row for each split
    cut = known.select("file", "start", "inside", "line").mapInPandas(_cut, PIECES)
    whole = cut.where(F.col("place") == WHOLE).select((F.col("first") & (F.col("start") == 0)).alias("first"), "text")
    pieces = cut.where(F.col("place") != WHOLE)
    # Of one split, the end of an earlier record stands before the beginning of the next.
    order = Window.partitionBy("file").orderBy("start", "place").rowsBetween(Window.unboundedPreceding, 0)
    pieces = pieces.withColumn("record", F.sum((F.col("place") == TAIL).cast("int")).over(order))
    joined = pieces.groupBy("file", "record").agg(
        F.max(F.col("first") & (F.col("start") == 0)).alias("first"), F.sort_array(F.collect_list(F.struct("start", "place", "text"))).alias("parts")
    )
    across = joined.select("first", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    return whole.union(across).select("first", F.regexp_replace("text", r"\r$", "").alias("text"))


def _inferred(rows: DataFrame) -> T.StructType:
    """The narrowest of ``NUMBERS`` that all values of a column fit, else text."""
    fits = [
        F.bool_and(F.col(f"`{c}`").isNull() | F.expr(f"try_cast(`{c}` AS {kind})").isNotNull()).alias(f"{j}_{kind}")
        for j, c in enumerate(rows.columns)
        for kind in NUMBERS
    ]
    found = rows.agg(*fits).first()
    kinds = [next((k for k in NUMBERS if found[f"{j}_{k}"]), "string") for j in range(len(rows.columns))]
    return T.StructType([T.StructField(c, T._parse_datatype_string(k)) for c, k in zip(rows.columns, kinds)])


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, na_values: Iterable[str] = ()) -> DataFrame:
    """As ``read_labeled_csv``, with files split among tasks although quoted text holds line breaks.

    Quotes must be doubled inside quoted fields and not occur in others. Files
    have a header each. Without a schema, types are inferred as numbers, truth
    values or text. Files are read twice: for the quotes, and for the records.
    """
    records = _records(spark, path)
    options = {"quote": '"', "escape": '"', "multiLine": "true"}
    if schema is None:
        header = records.where("first").limit(1).select("text").first()
        if header is None:
            return spark.createDataFrame([], T.StructType([]))
        titles = _titles(spark, header["text"].removeprefix("\ufeff"), options)
        plain = T.StructType([T.StructField(t if t is not None else f"_c{j}", T.StringType()) for j, t in enumerate(titles)])
        schema = _inferred(_parsed(records, plain, options))
    return without_missing(_parsed(records, schema, options), na_values)


def _titles(spark: SparkSession, header: str, options: dict[str, str]) -> list[str | None]:
    """The column names of a header; it has no more of them than commas and one."""
    most = header.count(",") + 1
    shape = ", ".join(f"_c{j} string" for j in range(most + 1))
    row = spark.createDataFrame([(header + ",.",)], "text string").select(F.from_csv("text", shape, options).alias("r")).first()["r"]
    last = max(j for j, t in enumerate(row) if t is not None)  # the dot put behind
    return list(row[:last])


def _parsed(records: DataFrame, schema: T.StructType, options: dict[str, str]) -> DataFrame:
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    rows = records.where(~F.col("first") & (F.col("text") != ""))
    return rows.select(F.from_csv("text", ddl, options).alias("r")).select("r.*")
