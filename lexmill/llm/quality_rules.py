"""Quality rules: hashed n-gram log-likelihood ratio of trusted text against the raw corpus.

Every document is a bag of hashed word n-grams (n = 1 .. ``max_n``). Two multinomials over the hash
buckets are counted over *all* documents - one from the trusted target, one from the raw corpus -
with add-``smoothing``. A document's verdict is the mean over its n-grams of
``ln p_target(bucket) - ln p_raw(bucket)``: the ratio normalised by length. Weights are rounded to
integers (1e-6 nats), so sums do not depend on the order of addition and thresholding is deterministic.

Plan: one scan counts (map-side partial aggregation to at most ``buckets`` rows a task); the weights,
bounded by ``buckets``, become a literal of the scoring scan, which has no shuffle. No Python runs on executors.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.text import gram_hash, positions, words
from lexmill.plans.joins import broadcast_if_small

#: Words of a repeated passage, and the base rules' limits.
WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 5, 10, 20
SYMBOLS = r"[#*$%&|<>]"
SCALE = 1_000_000


def _buckets(w: Column, n: int, buckets: int) -> Column:
    return F.transform(positions(F.size(w) - (n - 1)), lambda i: F.pmod(gram_hash(w, i, n), F.lit(buckets)).cast("int"))


def base_statistics(w: Column, text: Column) -> dict[str, Column]:
    """The contract's counts as expressions over the word array ``w`` of ``text``."""
    body = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(body, "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    windows = F.transform(positions(F.size(w) - (WINDOW - 1)), lambda i: gram_hash(w, i, WINDOW))
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": (F.length(body) - F.regexp_count(body, F.lit(r"[\x20\x09-\x0D]"))).cast("long"),
        "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "windows": windows,
    }


def _by_hash(windows: Column) -> Column:
    return F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _repeated(by_hash: Column) -> Column:
    """Positions of windows whose hash a neighbour in the sorted array shares; ``by_hash`` must be a computed column."""
    same = lambda x, k: F.get(by_hash, k)["h"] == x["h"]
    again = F.transform(by_hash, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"]))
    return F.sort_array(F.array_compact(again))


def _covered(at: Column) -> Column:
    """Words in the union of the windows at the sorted positions ``at``, in one sweep."""
    step = F.transform(at, lambda p, k: F.coalesce(F.least(F.get(at, k + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    return F.aggregate(step, F.lit(0).cast("long"), lambda a, x: a + x)


def ngram_weights(
    docs: DataFrame, trusted: DataFrame, id_col: str, text_col: str, buckets: int, max_n: int, smoothing: float
) -> list[int]:
    """``SCALE * ln(p_target / p_raw)`` of every bucket, from counts over all of ``docs``.

    ``trusted`` holds ids: broadcast up to a counted bound, else joined by a shuffle.
    """
    ids = trusted.select(F.col(id_col).alias("t_id")).where("t_id is not null").distinct().withColumn("trusted", F.lit(True))
    rows = docs.select(F.col(id_col).alias("d_id"), F.col(text_col).alias("body")).where("body is not null")
    w = rows.join(broadcast_if_small(ids), F.col("d_id") == F.col("t_id"), "left").select("trusted", words(F.col("body")).alias("w"))
    grams = F.concat(*[_buckets(F.col("w"), n, buckets) for n in range(1, max_n + 1)])
    counts = (
        w.select("trusted", F.explode(grams).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count(F.lit(1)).alias("raw"), F.count("trusted").alias("target"))
        .collect()  # at most ``buckets`` rows
    )
    raw, target = [0] * buckets, [0] * buckets
    for r in counts:
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    n_raw, n_target = sum(raw) + smoothing * buckets, sum(target) + smoothing * buckets
    return [
        round(SCALE * (math.log((t + smoothing) / n_target) - math.log((r + smoothing) / n_raw)))
        for t, r in zip(target, raw, strict=True)
    ]


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = 1 << 14,
    max_n: int = 2,
    smoothing: float = 1.0,
    threshold: float = -0.1,
) -> DataFrame:
    """One row per input row: id, the base counts, ``base_failed``, ``llr`` (mean nats an n-gram) and ``kept``.

    Null and empty texts have no words: counts 0, ``base_failed`` true, ``llr`` 0. Repeated rows are returned as
    often as they come, null ids are kept as they are, extra columns are ignored. Empty ``docs`` give no rows;
    an empty ``trusted`` makes the target uniform.
    """
    weights = ngram_weights(docs, trusted, id_col, text_col, buckets, max_n, smoothing)
    literal = F.from_json(F.lit(str(weights)), "array<bigint>")

    def mean(w: Column) -> Column:
        parts = [
            F.aggregate(_buckets(w, n, buckets), F.lit(0).cast("long"), lambda a, b: a + F.get(literal, b))
            for n in range(1, max_n + 1)
        ]
        number = sum((F.greatest(F.size(w) - n, F.lit(0)) for n in range(1, max_n)), F.size(w))
        return F.when(number > 0, sum(parts[1:], parts[0]) / number / SCALE).otherwise(F.lit(0.0))

    body = F.col("body")
    counted = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"), words(F.col(text_col)).alias("w"))
    stats = base_statistics(F.col("w"), body)
    counted = counted.select("doc_id", *[v.alias(k) for k, v in stats.items()], mean(F.col("w")).alias("llr"))
    twice = F.size(F.array_distinct("windows")) < F.size("windows")
    # Texts whose windows all differ - nearly all - stop at the hash-set test.
    counted = counted.withColumn("by_hash", F.when(twice, _by_hash(F.col("windows")))).withColumn("again", _repeated(F.col("by_hash")))
    counted = counted.withColumn("n_repeat_words", F.when(F.col("again").isNotNull(), _covered(F.col("again"))).otherwise(F.lit(0).cast("long")))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr",
    )
