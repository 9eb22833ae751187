"""Lookups, trees and ordering over identified rows: batch forms of point, range and prefix access."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.functions.ids import prefixes_of
from lexmill.plans.scratch import materialize


def with_ordinal(df: DataFrame, parent: str, order: list[Column | str], name: str = "ordinal") -> DataFrame:
    """0-based place of each row among its parent's."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(parent).orderBy(*order)) - 1).cast("long"))


def keep_first(df: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key. A key of any size is reduced before the shuffle where the order is a struct's minimum."""
    rest = [c for c in df.columns if c not in key]
    names = [f"__o{i}" for i in range(len(order))]
    rows = df.withColumns({n: (F.col(o) if isinstance(o, str) else o) for n, o in zip(names, order, strict=True)})
    best = rows.groupBy(*key).agg(F.min(F.struct(*names, *[F.col(c) for c in rest])).alias("__b"))
    return best.select(*key, *[F.col("__b")[c].alias(c) for c in rest]).select(*df.columns)


def successors(df: DataFrame, col: str) -> DataFrame:
    """(a, b): each value but the last with the next one in order. Sorted by ranges; only a range's first value meets the range before."""
    rows = materialize(df.select(F.col(col).alias("a")).where("a is not null").repartitionByRange("a").withColumn("p", F.spark_partition_id()), "ranges")
    firsts = rows.groupBy("p").agg(F.min("a").alias("first"))  # one row a range
    after = firsts.select("p", F.lead("first").over(Window.orderBy("p")).alias("after"))
    own = rows.select("p", "a", F.lead("a").over(Window.partitionBy("p").orderBy("a")).alias("b"))
    return own.join(F.broadcast(after), "p").select("a", F.coalesce("b", "after").alias("b")).where("b is not null")


def arg_best(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """One row per key by a ranking of any direction."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")


def subtree(df: DataFrame, id_col: str, root: str) -> DataFrame:
    """The node and its descendants, by a case-sensitive prefix that reaches the scan."""
    return df.where((F.col(id_col) == root) | F.col(id_col).startswith(root + "/"))


def ancestors(df: DataFrame, id_col: str) -> DataFrame:
    """Every row with each prefix of its identifier: (…, ancestor, depth)."""
    return df.withColumn("__p", F.explode(prefixes_of(F.col(id_col)))).withColumns({"ancestor": F.col("__p.id"), "depth": F.col("__p.depth")}).drop("__p")


def deepest_existing(ids: DataFrame, id_col: str, known: DataFrame, known_col: str) -> DataFrame:
    """(id, found, depth): the longest run of existing prefixes from the section down; null where the section is missing.

    Prefixes are exploded and joined by equality; the run ends at the first missing level.
    """
    each = ancestors(ids.select(id_col).distinct(), id_col)
    have = known.select(F.col(known_col).alias("__k")).distinct()
    each = each.join(have, F.col("ancestor") == F.col("__k"), "left")
    levels = each.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("depth", "ancestor", F.col("__k").isNotNull().alias("ok")))).alias("l"))
    run = F.filter("l", lambda x: ~F.exists("l", lambda y: (y["depth"] <= x["depth"]) & ~y["ok"]))
    last = F.get(run, F.size(run) - 1)
    return levels.select(id_col, last["ancestor"].alias("found"), last["depth"].alias("depth"))


def nearest_ancestor_value(nodes: DataFrame, id_col: str, values: DataFrame, value_id: str, value_col: str) -> DataFrame:
    """(id, value): the value stated by the node itself or else by its nearest ancestor that states one."""
    each = ancestors(nodes.select(id_col), id_col).join(
        values.select(F.col(value_id).alias("__v"), F.col(value_col).alias("__x")).where("__x is not null"), F.col("ancestor") == F.col("__v"), "left"
    )
    return each.groupBy(id_col).agg(F.max_by("__x", F.when(F.col("__x").isNotNull(), F.col("depth"))).alias(value_col))


def truncate_words(text: Column, limit: int) -> tuple[Column, Column]:
    """(text cut at the last space within ``limit`` + 1 characters, whether it was cut); a limit below 1 is none."""
    if limit <= 0:
        return text, F.lit(False)
    head = F.left(text, F.lit(limit + 1))
    # the last space: what follows it has no space
    cut = F.regexp_replace(head, r"\s+\S*\z", "")
    cut = F.when(head.rlike(r"\s") & (F.length(cut) > 0), cut).otherwise(F.left(text, F.lit(limit)))
    long = F.length(text) > limit
    return F.when(long, cut).otherwise(text), F.coalesce(long, F.lit(False))


def line_col(text: Column, offset: Column) -> tuple[Column, Column]:
    """1-based line and column of a 0-based offset."""
    head = F.left(text, offset)
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    return line, F.length(F.substring_index(head, "\n", -1)) + 1
