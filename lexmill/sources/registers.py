"""Small tabular sources and sinks: ownership registers, diligence logs, report renderings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """date,holder,percent lines as (when, holder, percent); blank, comment and header lines are dropped, a bad row fails the job when read."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v != '' and not startswith(v, '#') and not startswith(lower(v), 'date')")
    parts = F.split("v", r"\s*,\s*")
    rows = lines.select(F.get(parts, F.lit(0)).try_cast("date").alias("when"), F.get(parts, F.lit(1)).alias("holder"), F.get(parts, F.lit(2)).try_cast("decimal(9,4)").alias("percent"), "v")
    good = F.col("when").isNotNull() & F.col("holder").isNotNull() & F.col("percent").between(0, 100)
    return rows.select("when", "holder", F.when(good, F.col("percent")).otherwise(F.raise_error(F.concat(F.lit("bad register row: "), "v"))).alias("percent"))


def append_log(records: DataFrame, path: str) -> None:
    """One JSON line a record, added to what is there."""
    records.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path)


def github_line(severity: Column, file: Column, line: Column, message: Column) -> Column:
    """A workflow annotation for warnings and errors, null for the rest."""
    escaped = F.replace(F.replace(F.replace(message, F.lit("%"), F.lit("%25")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.when(severity.isin("warning", "error"), F.concat(F.lit("::"), severity, F.lit(" file="), file, F.lit(",line="), line, F.lit("::"), escaped))


def markdown_row(*cells: Column) -> Column:
    return F.concat(F.lit("| "), F.concat_ws(" | ", *[F.replace(c.cast("string"), F.lit("|"), F.lit(r"\|")) for c in cells]), F.lit(" |"))
