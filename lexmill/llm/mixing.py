"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order (by a hash of the id), passed through as often as ``most`` says. A
copy's virtual finish time is the number of its source's tokens up to its end, divided by the source's weight; all copies are
sorted by it over the cluster and the order is cut at the total budget. A queue that runs dry leaves its share to the others in
proportion to their weights, so the cut meets the water-filling targets to within a document.

1. One scan counts the words; ids, sources, counts and shuffle hashes are written, never texts.
2. A range sort by (source, hash) lays the queues end to end, whatever a source's share of the rows is. Totals of the partitions,
   summed up, give every partition its start, a running sum inside it does the rest.
3. Finish times are whole numbers: tokens times the least common multiple of the weights, over the weight. A second range sort
   orders the copies; the totals of its partitions name the one that the budget falls into, and a running sum inside that one
   partition finds the last copy in. What is in follows for each document from its own times: nothing is joined back.
"""

from __future__ import annotations

from math import lcm

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.text import words
from lexmill.plans.joins import broadcast_if_small
from lexmill.plans.scratch import materialize

#: Goes into the hash that shuffles the documents of a source.
SEED = "mix"


def laid_out(rows: DataFrame, order: list[str], label: str) -> DataFrame:
    """``rows`` range-sorted over the cluster and written, with the number of their partition in ``part``."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialize(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()), label)


def summed_before(laid: DataFrame, order: list[str], size: str) -> DataFrame:
    """Rows of ``laid_out`` with ``before``: the sum of ``size`` over all rows that come earlier. Totals have one row a partition."""
    totals = laid.groupBy(F.col("part").alias("p")).agg(F.sum(size).alias("total"))
    start = F.sum("total").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = laid.withColumn("run", F.sum(size).over(inside)).join(F.broadcast(totals.select("p", start.alias("start"))), F.col("part") == F.col("p"))
    return placed.withColumn("before", F.col("start") + F.col("run") - F.col(size)).drop("p", "start", "run", "part")


def targets(sizes: DataFrame, weights: tuple[int, ...], percent: int, most: int) -> tuple[DataFrame, int]:
    """(source, source_size, idx, base, weight, target) for each source, and the budget in words.

    ``sizes``: one row a source. Sources count by code point, null last, ``weights`` repeat along them. ``percent`` of all words
    are shared out by weight; what a source would get above ``most`` times its size goes to the others, until none is above.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    unit = lcm(*weights)
    s = sizes.withColumn("idx", F.row_number().over(by_name) - 1)
    s = s.withColumn("base", F.sum("source_size").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) - F.col("source_size"))
    s = s.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("idx") % len(weights) + 1).cast("int")).cast("long"))
    s = materialize(s, "sources")
    every = s.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    # the sources in the order in which they would be full
    cap = most * F.col("source_size")
    fills = Window.orderBy("full", "idx")
    r = s.withColumn("cap", cap).withColumn("full", cap * (unit / F.col("weight")).cast("long"))
    r = r.withColumn("left", percent * F.lit(every).cast("long") - 100 * (F.sum("cap").over(fills.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")))
    r = r.withColumn("rest", F.sum("weight").over(fills.rowsBetween(0, Window.unboundedFollowing)))
    level = r.where(100 * F.col("cap") * F.col("rest") > F.col("weight") * F.col("left")).orderBy("full", "idx").select("left", "rest").first()
    target = cap.cast("double")
    if level is not None:
        target = F.least(target, (F.col("weight") * F.lit(level["left"]).cast("long")).cast("double") / (100.0 * level["rest"]))
    return s.withColumn("target", target), percent * every // 100


def mix(
    docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), percent: int = 150, most: int = 2, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """One row per input row: doc_id, source, size (words), source_size, weight, target (its source's words), copies, taken, finish.

    ``copies`` of a document, 0 to ``most``, are in the mix, ``taken`` is their words; ordered by ``finish``, the virtual time at
    which the first copy ends, documents come as the mix takes them. Whole documents are taken: the mix holds at most the budget, and
    a source misses its target by less than its longest document and what others leave. A null text is empty; empty documents have
    size 0 and are not taken. Rows of a null source are a source, the last. Rows of equal or null ids are documents of their own;
    equal ones are interchangeable. An empty table gives no rows; extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.size(words(F.col(text_col))).cast("long").alias("size"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(f":{SEED}")).cast("binary"))
    rows = materialize(rows.withColumn("key", key).withColumn("rid", F.monotonically_increasing_id()), "sizes")  # the only read of the texts
    sources, budget = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, percent, most)
    sources = broadcast_if_small(sources.withColumnRenamed("source", "s"))
    unit = lcm(*weights)
    order = ["idx", "key", "doc_id", "size", "rid"]
    placed = summed_before(laid_out(rows.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s"), order, "queues"), order, "size")
    queue = placed.withColumn("end", F.col("before") - F.col("base") + F.col("size")).withColumn("unit", (unit / F.col("weight")).cast("long"))
    queue = materialize(queue.drop("before", "base", "key", "rid"), "queued")
    finish = lambda copy: (F.col("end") + copy * F.col("source_size")) * F.col("unit")
    copies = queue.where("size > 0").select("idx", "size", F.explode(F.array(*[finish(k) for k in range(most)])).alias("finish"))
    last = _last_in(laid_out(copies, ["finish", "idx"], "copies"), budget)
    inside = lambda copy: F.struct(finish(copy), F.col("idx")) <= F.struct(F.lit(last[0]).cast("long"), F.lit(last[1]).cast("int"))
    n = sum((inside(k).cast("int") for k in range(most)), F.lit(0))
    queue = queue.withColumn("copies", F.when(F.col("size") > 0, n).otherwise(0)).withColumn("finish", finish(0) / F.lit(float(unit)))
    return queue.select("doc_id", "source", "size", "source_size", "weight", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "finish")


def _last_in(laid: DataFrame, budget: int) -> tuple[int, int]:
    """(finish, idx) of the last copy that the budget holds."""
    start, at = 0, -1
    for r in laid.groupBy("part").agg(F.sum("size").alias("total")).orderBy("part").collect():  # one row a partition
        at = r["part"]
        if start + r["total"] > budget:
            break
        start += r["total"]
    run = F.sum("size").over(Window.partitionBy("part").orderBy("finish", "idx").rowsBetween(Window.unboundedPreceding, 0))
    crossing = laid.where(F.col("part") == at).withColumn("run", run).where(F.col("run") + start <= budget)
    ends = laid.where(F.col("part") < at).select("finish", "idx").unionByName(crossing.select("finish", "idx"))
    found = ends.agg(F.max(F.struct("finish", "idx")).alias("m")).first()["m"]
    return (found["finish"], found["idx"]) if found is not None else (-1, -1)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':mix') AS k FROM documents),
s AS (
  SELECT *, [5, 2, 1][(idx - 1) % 3 + 1] AS weight, [2, 5, 10][(idx - 1) % 3 + 1] AS unit, 2 * source_size AS cap, CAST(sum(source_size) OVER () AS BIGINT) AS every
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS idx FROM d GROUP BY source)),
r AS (
  SELECT *, 3 * every - 2 * coalesce(sum(cap) OVER (ORDER BY cap * unit, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room,
    sum(weight) OVER (ORDER BY cap * unit, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM s),
v AS (SELECT room, rest FROM r WHERE 2 * cap * rest > weight * room ORDER BY cap * unit, idx LIMIT 1),
t AS (SELECT s.*, least(CAST(cap AS DOUBLE), coalesce(CAST(weight * room AS DOUBLE) / (2.0 * rest), CAST(cap AS DOUBLE))) AS target FROM s LEFT JOIN v ON true),
q AS (
  SELECT rid, doc_id, size, source_size, target, every, idx, unit, sum(size) OVER (PARTITION BY idx ORDER BY k, doc_id NULLS FIRST, size, rid ROWS UNBOUNDED PRECEDING) AS e
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT rid, size, every, idx, (e + n * source_size) * unit AS finish FROM q, (SELECT unnest([0, 1]) AS n) WHERE size > 0),
o AS (SELECT rid, size, sum(size) OVER (ORDER BY finish, idx ROWS UNBOUNDED PRECEDING) AS run, every FROM c),
k AS (SELECT rid, sum(size) AS taken FROM o WHERE run <= 3 * every // 2 GROUP BY rid)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM q LEFT JOIN k USING (rid)
"""
