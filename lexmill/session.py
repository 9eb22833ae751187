"""Session and table helpers shared by every operator."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


_shipped: dict[int, bool] = {}
#: Bytes of an Arrow batch that goes to a Python worker: rows differ much in length, so a number of rows bounds nothing.
BATCH_BYTES = 4 << 20


def local_session(cpus: int | None = None, app: str = "lexmill") -> SparkSession:
    """A session for tests and benchmarks on one machine; a cluster brings its own."""
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once a session, unless PYTHONPATH already leads them to it, and bound their batches."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = Path(__file__).resolve().parent.parent
    if any(Path(p).resolve() == root for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p) or _shipped.get(id(spark.sparkContext)):
        return
    target = Path(tempfile.mkdtemp(prefix="lexmill-")) / "lexmill_package.zip"
    with zipfile.ZipFile(target, "w") as z:
        for f in (root / "lexmill").rglob("*.py"):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    _shipped[id(spark.sparkContext)] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read lazily with column pruning left to Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
