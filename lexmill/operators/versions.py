"""Versions of a keyed corpus: comparison, upserts and summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compare_versions(before: DataFrame, after: DataFrame, key: str, heading: str, text: str) -> DataFrame:
    """(key, change, old, new): added, removed, changed, or renamed where only the heading differs; equal rows are left out."""
    b = before.select(F.col(key).alias("__bk"), F.col(heading).alias("bh"), F.col(text).alias("bt"))
    a = after.select(F.col(key).alias("__ak"), F.col(heading).alias("ah"), F.col(text).alias("at"))
    rows = b.join(a, F.col("__bk") == F.col("__ak"), "full_outer")
    change = (
        F.when(F.col("__bk").isNull(), "added").when(F.col("__ak").isNull(), "removed")
        .when(~F.col("bt").eqNullSafe(F.col("at")), "changed").when(~F.col("bh").eqNullSafe(F.col("ah")), "renamed")
    )
    return rows.select(F.coalesce("__bk", "__ak").alias(key), change.alias("change"), F.col("bt").alias("old"), F.col("at").alias("new")).where("change is not null")


def change_counts(changes: DataFrame) -> DataFrame:
    """A count for each kind of change, 0 where none."""
    return zero_filled_counts(changes, "change", ["added", "removed", "changed", "renamed"])


def missing_from(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys of ``a`` that ``b`` lacks."""
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def coalesce_upsert(base: DataFrame, overlay: DataFrame, key: str, keep_old: list[str] = ()) -> DataFrame:
    """Rows of both by key; the overlay's values win where they are not null, the base's for ``keep_old`` columns."""
    new = overlay.select(*[F.col(c).alias(f"__{c}") for c in base.columns])
    rows = base.join(new, F.col(key) == F.col(f"__{key}"), "full_outer")
    pick = lambda c: F.coalesce(c, f"__{c}") if c == key or c in keep_old else F.coalesce(f"__{c}", c)
    return rows.select(*[pick(c).alias(c) for c in base.columns])


def zero_filled_counts(rows: DataFrame, col: str, values: list[str]) -> DataFrame:
    """A count for each of ``values``, 0 where none."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(v,) for v in values], "__v string")
    counts = rows.groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    return names.join(counts, F.col("__v") == F.col(col), "left").select(F.col("__v").alias(col), F.coalesce("n", F.lit(0)).alias("n"))
