"""Streams: documents verified as they arrive, events counted by window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lexmill.plans.verify import verify

DOCUMENTS = "doc_id long, text string"


def verify_stream(spark: SparkSession, source: str, provisions: DataFrame, out: str, checkpoint: str, guidance: DataFrame | None = None, covered_years: list[int] = ()) -> StreamingQuery:
    """Resolve the citations of every Parquet file of documents that appears in ``source``; results are appended to ``out``.

    Each micro-batch is one batch plan, so joins and the deepest-ancestor aggregate need no streaming state; a batch that is
    replayed overwrites its own folder.
    """
    docs = spark.readStream.schema(DOCUMENTS).parquet(source)

    def write(batch: DataFrame, epoch: int) -> None:
        verify(batch, provisions, guidance, covered_years).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, kind: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and kind; rows later than ``late`` are dropped by the watermark."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    rows = rows.withWatermark(time, late) if events.isStreaming else rows
    return rows.groupBy(F.window(time, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
