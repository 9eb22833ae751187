"""Written intermediate tables in the folder that the cluster shares.

A written table cuts lineage like ``checkpoint()`` does, survives the loss of any executor, and
keeps column pruning and file statistics for the plans that read it.
"""

from __future__ import annotations

import atexit
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []
_scopes = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; only where it is unset and one process does all work, as in tests, one of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='lexmill-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, deleted with the other intermediate tables."""
    path = f"{shared_dir(spark)}/lexmill-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def materialize(df: DataFrame, label: str = "table", keep: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return the written table; ``keep``: it outlives ``passing``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexmill-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    if not keep and getattr(_scopes, "open", None):
        _scopes.open[-1].append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def passing() -> Iterator[None]:
    """Tables that this thread writes inside are deleted at the end, but for those written with ``keep``."""
    _scopes.open = [*getattr(_scopes, "open", []), []]
    try:
        yield
    finally:
        for x in _scopes.open.pop():
            _written.remove(x)
            _delete(*x)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001  the session has ended; the shared folder's owner clears it
        return


def materialize_bucketed(df: DataFrame, column: str, buckets: int, label: str = "table") -> DataFrame:
    """Write ``df`` once as a table of the warehouse, bucketed by ``column``: later joins and co-groups on it don't shuffle it."""
    return append_bucketed(df, column, buckets, f"lexmill_{label}_{uuid.uuid4().hex}")


def append_bucketed(df: DataFrame, column: str, buckets: int, name: str) -> DataFrame:
    """Add ``df`` to the bucketed table ``name``, which begins with the first rows, and return all of it.

    A table that grows keeps its bucketing, which a union of bucketed tables loses. A lost executor's rows are written
    again before they are committed, so none comes twice.
    """
    spark = df.sparkSession
    df.write.mode("append").format("parquet").bucketBy(buckets, column).saveAsTable(name)
    if (spark, name) not in _tables:
        _tables.append((spark, name))
    return spark.table(name)


def release() -> None:
    """Delete the tables written so far; only call it when no result that reads them is pending."""
    while _written:
        _delete(*_written.pop())
    while _tables:
        spark, name = _tables.pop()
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # noqa: BLE001
            continue


atexit.register(release)
