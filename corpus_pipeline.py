"""Training-corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's
docs. All but the last return the columns of documents; each works on everything its predecessor kept. Decisions are taken
row by row, never by id: rows with equal or null ids stand for themselves. Columns beyond those of documents are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm import decontaminate, near_dups, packing, quality_ranker, secrets
from lexmill.plans.joins import broadcast_if_small
from lexmill.plans.scratch import materialize
from lexmill.session import table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _numbered(docs: DataFrame) -> DataFrame:
    """The rows with a name of their own: their file, by its path's hash, and their place in it. Rows that aren't read from files are written first."""
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    try:
        return docs.select(*COLUMNS, place.alias("row"))
    except AnalysisException:
        return materialize(docs.select(*COLUMNS), "rows").select(*COLUMNS, place.alias("row"))


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose name is not in ``gone``; texts are shuffled only if there are too many names to be sent to them."""
    gone = broadcast_if_small(materialize(gone.select(F.col("row").alias("gone")), "gone"))
    return rows.join(gone, F.col("row") == F.col("gone"), "left_anti").select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pairwise ranker rejects go.

    Every row is judged by its own text; null and empty texts are judged as empty ones. Repeated rows stay or go together. An empty
    table gives no rows; without a label of either kind nothing goes.
    """
    rows = _numbered(docs)
    measured = quality_ranker.measure(rows, "row")
    ranker = quality_ranker.fit_measured(measured, table(spark, sf_dir, "labels"))
    return _without(rows, quality_ranker.score_measured(measured, ranker).where(~(F.col("score") >= ranker.threshold)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Of each group of near duplicates (five-word shingles, similarity of 0.8 or more) the row with the least id stays.

    Rows with a null id come after those with one; of rows with equal ids one stays. So of repeated rows one stays, and different
    texts under one id are judged apart. Rows without words all stay. An empty table gives no rows.
    """
    rows = _numbered(docs)
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    found = near_dups.near_duplicates(rows.select(key.alias("key"), "text"), id_col="key", shingle=5, percent=80, matches=34)
    return _without(rows, found.where(~F.col("kept")).select("doc_id.row"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten consecutive words of a benchmark item go.

    Every row is judged by its own text, whatever its id. Null and empty texts stay. An empty table gives no rows; an empty
    benchmark takes none.
    """
    rows = _numbered(docs)
    found = decontaminate.decontaminate(rows, table(spark, sf_dir, "benchmark"), id_col="row", window=10, shingle=5)
    return _without(rows, found.where("n_hit > 0").select(F.col("doc_id").alias("row")))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Secrets are masked in place, but for widely copied examples; n_chars follows the text.

    Every row is masked by its own spans, whatever its id. Null texts stay null with n_chars 0. An empty table gives no rows.
    """
    masked = secrets.redact(docs.select(*COLUMNS))
    return masked.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:  # noqa: ARG001
    """Pieces of at most 2,048 tokens with their sequence and place in it.

    Null and empty texts are the end token alone. Rows with equal or null ids are packed apart. An empty table gives no rows.
    """
    path = public_tokenizers.path
    return packing.pack(docs, path("byte_bpe_50k.json"), path("byte_bpe_50k.tiktoken"), capacity=2048, end_id=0)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_ranker", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: Learned weights, sketches and tokenizers are outside SQL; tests hold the stages against brute force.
ORACLE_SQL = None
