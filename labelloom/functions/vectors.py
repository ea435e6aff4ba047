"""Functions on arrays of scores (logits)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def argmax(scores: Column | str) -> Column:
    """0-based position of the largest value, the first one on ties."""
    values = _col(scores)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax_nll(scores: Column | str, label: Column | str) -> Column:
    """``-log softmax(scores)[label]``, shifted by the maximum to stay finite."""
    values, top = _col(scores), F.array_max(_col(scores))
    total = F.aggregate(values, F.lit(0.0), lambda acc, v: acc + F.exp(v.cast("double") - top))
    chosen = F.element_at(values, _col(label).cast("int") + 1).cast("double")
    return F.log(total) + top - chosen


def round_metrics(*names: str, digits: int = 6) -> list[Column]:
    """The named metric columns rounded: 6 digits for files, 4 for tables."""
    return [F.round(F.col(name), digits).alias(name) for name in names]
