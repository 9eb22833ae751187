"""Spans of texts that may overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolve_overlaps(spans: DataFrame, doc: str, start: str, end: str, priority: str) -> DataFrame:
    """(doc, start, end, priority): of overlapping spans the one that stays.

    One sweep along each document's spans in order of start, longer ones and then greater priorities first: a span that begins inside the last winner
    takes its place only if it is longer, or as long and of more priority. The sweep is a fold over the spans of one document; equal rows
    count once.
    """
    s, e, p = (F.col(c).cast("long") for c in (start, end, priority))
    row = F.struct(s.alias("s"), (s - e).alias("k"), (-p).alias("o"))  # k: less for longer, o: less for more priority
    held = spans.groupBy(doc).agg(F.array_sort(F.collect_set(row)).alias("x"))
    none = F.struct(F.array().cast("array<struct<s:bigint,k:bigint,o:bigint>>").alias("won"), F.lit(None).cast("struct<s:bigint,k:bigint,o:bigint>").alias("last"))
    rank = lambda x: F.struct(x["k"], x["o"])

    def step(a: Column, x: Column) -> Column:
        free = a["last"].isNull() | (a["last"]["s"] - a["last"]["k"] <= x["s"])
        won = F.when(free & a["last"].isNotNull(), F.concat(a["won"], F.array(a["last"]))).otherwise(a["won"])
        return F.struct(won.alias("won"), F.when(free | (rank(x) < rank(a["last"])), x).otherwise(a["last"]).alias("last"))

    won = F.aggregate("x", none, step, lambda a: F.when(a["last"].isNull(), a["won"]).otherwise(F.concat(a["won"], F.array(a["last"]))))
    rows = held.select(doc, F.explode(won).alias("x"))
    return rows.select(doc, F.col("x.s").alias(start), (F.col("x.s") - F.col("x.k")).alias(end), (-F.col("x.o")).alias(priority))
