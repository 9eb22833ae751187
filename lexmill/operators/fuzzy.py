"""Nearest names by edit distance, numeric gap or variants: candidates by equality, never by a cross join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.plans.joins import meet


def deletions(word: Column, edits: int = 2) -> Column:
    """The word and everything that up to ``edits`` deletions leave: two words within that distance share one."""
    once = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    out = F.array(word)
    layer = F.array(word)
    for _ in range(edits):
        layer = F.array_distinct(F.flatten(F.transform(layer, once)))
        out = F.array_union(out, layer)
    return out


def leading_number(word: Column) -> Column:
    return F.regexp_extract(word, r"^(\d+)", 1).try_cast("int")


def variants(section: Column) -> Column:
    """Near misses of a section: its stem, the stem with a usual suffix, neighbouring digits swapped."""
    stem = F.regexp_replace(section, "[A-Za-z-].*$", "")
    suffixed = F.transform(F.array(*map(F.lit, "ABCDT")), lambda c: F.concat(stem, c))
    swaps = F.transform(
        F.filter(F.sequence(F.lit(1), F.greatest(F.length(stem) - 1, F.lit(1))), lambda i: i < F.length(stem)),
        lambda i: F.concat(F.substring(section, F.lit(1), i - 1), F.substring(section, i + 1, F.lit(1)), F.substring(section, i, F.lit(1)), F.substring(section, i + 2, F.length(section))),
    )
    return F.array_remove(F.array_distinct(F.concat(F.array(stem), suffixed, swaps)), section)


def nearest(queries: DataFrame, query: str, names: DataFrame, name: str, top: int = 3, edits: int = 2, gap: int = 5) -> DataFrame:
    """(query, name, dist, gap, rank): names within ``edits`` (case folded) or ``gap`` of the leading number, or variants, best first.

    Order: distance (edits + 1 beyond), gap (``gap`` + 1 beyond), length, text. A name equal to the query is left out. Names may be many:
    they are never broadcast, the queries' keys are where they are few.
    """
    q = queries.select(F.col(query).alias("query")).where("query is not null").distinct()
    # the number of partitions is given: names are short, and Spark would join them to one or two tasks, which then make all deletions
    parts = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = names.select(F.col(name).alias("name")).where("name is not null").repartition(parts, "name").distinct()
    keys = lambda df, c: df.select(c, F.explode(deletions(F.lower(c), edits)).alias("k"))
    pairs = meet(keys(q, "query"), keys(n, "name"), "k").select("query", "name")
    near = q.select("query", F.explode(F.sequence(leading_number(F.col("query")) - gap, leading_number(F.col("query")) + gap)).alias("k"))
    pairs = pairs.unionByName(meet(near, n.select("name", leading_number(F.col("name")).alias("k")), "k").select("query", "name"))
    pairs = pairs.unionByName(meet(q.select("query", F.explode(variants(F.col("query"))).alias("name")), n, "name").select("query", "name")).distinct()
    dist = F.levenshtein(F.lower("query"), F.lower("name"))
    away = F.least(F.coalesce(F.abs(leading_number(F.col("query")) - leading_number(F.col("name"))), F.lit(gap + 1)), F.lit(gap + 1))
    rows = pairs.where("query != name").select("query", "name", F.least(dist, F.lit(edits + 1)).alias("dist"), away.alias("gap"), F.array_contains(variants(F.col("query")), F.col("name")).alias("variant"))
    rows = rows.where((F.col("dist") <= edits) | (F.col("gap") <= gap) | F.col("variant"))
    order = Window.partitionBy("query").orderBy("dist", "gap", F.length("name"), "name")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("query", "name", "dist", "gap", "rank")
