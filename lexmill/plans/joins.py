"""Join helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def broadcast_if_small(df: DataFrame, rows: int = 2_000_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows - counted, not estimated - and unchanged beyond.

    Meant for narrow tables of keys: the default bound is some tens of MB. Beyond it the join shuffles.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def meet(few: DataFrame, many: DataFrame, on: str) -> DataFrame:
    """Inner join on a column: ``few`` is broadcast if it is counted as small, ``many`` never. Spark takes rows that are exploded or distinct for no more than their file's bytes."""
    return broadcast_if_small(few).join(many.hint("merge"), on)
