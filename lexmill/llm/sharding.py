"""Sharding: global prefix sums of byte sizes from per-partition totals, cut at equal targets.

Rows are laid out in order of id. Splitters (approximate quantiles of the id, collected once and then
literals, so every later job sees the same partitions) deal the rows into ordered partitions. Each
partition gives its total size; an exclusive running sum over those few totals gives every partition its
offset, and a running sum inside the partition completes each row's global position. A row belongs to the
shard in whose equal share of all bytes its middle lies: shards are contiguous and as even as whole rows allow.

Only (id, size, checksum) is shuffled, never the text. The totals have one row a partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.plans.scratch import materialize

def contiguous_shards(
    docs: DataFrame, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None
) -> DataFrame:
    """One row per input row: doc_id, size (UTF-8 bytes + 1), text_crc32, shard, slot (gapless from 0 in its shard).

    A null text has no bytes and size 1. Rows with a null id come first; rows equal in id, size and checksum are
    interchangeable. An empty table gives no rows. Extra columns are ignored.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = max(2, min(n, 4096))
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32")
    )
    rows = materialize(rows, "sizes")  # the only read of the texts
    cuts = rows.select(F.percentile_approx("doc_id", [k / n for k in range(1, n)], 10_000)).first()[0] or []
    cuts = sorted(set(cuts))
    # the number of splitters below the id: its ordered partition
    part = F.coalesce(
        F.size(F.filter(F.from_json(F.lit(str(cuts)), "array<bigint>"), lambda c: c < F.col("doc_id"))), F.lit(0)
    )
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(part))
    inside = Window.partitionBy("part").orderBy("doc_id", "size", "text_crc32").rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("part").agg(F.sum("size").alias("part_size"), F.count(F.lit(1)).alias("part_rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = totals.select(
        F.col("part").alias("p"), F.coalesce(F.sum("part_size").over(before), F.lit(0)).alias("size_before"),
        F.coalesce(F.sum("part_rows").over(before), F.lit(0)).alias("rows_before"), F.sum("part_size").over(whole).alias("all_size"),
    )
    placed = (
        rows.withColumn("run", F.sum("size").over(inside))
        .withColumn("row", F.row_number().over(inside.orderBy("doc_id", "size", "text_crc32")))
        .join(F.broadcast(totals), F.col("part") == F.col("p"))  # at most 4,096 rows
    )
    # twice the middle of the row, so that all arithmetic is whole
    middle = 2 * (F.col("size_before") + F.col("run")) - F.col("size")
    shard = F.least(F.floor(middle * shards / (2 * F.col("all_size"))), F.lit(shards - 1)).cast("int")
    placed = placed.select("doc_id", "size", "text_crc32", "part", (F.col("rows_before") + F.col("row")).alias("row"), shard.alias("shard"))
    firsts = placed.groupBy("shard").agg(F.min("row").alias("first")).withColumnRenamed("shard", "s")
    return placed.join(F.broadcast(firsts), F.col("shard") == F.col("s")).select(  # at most ``shards`` rows
        "doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot")
    )
