"""Quality classifier: Bradley-Terry pairwise ranking on text statistics.

Every labelled training row is put in an order by hash and paired with rows of the other label (a text labelled good over one labelled bad),
``partners`` times at least; the ranker's weights minimise the logistic loss on the difference of the two feature vectors. A
document's strength is the weights' product with its features. The verdict cuts strengths at the quantile that equals the share of
label 0 among all training rows; a logistic curve maps the cut to ``threshold``.

Features are Catalyst expressions on the whole text alone, so scoring all documents is one scan without shuffle or Python. No row
reaches the driver: each of Newton's steps is one aggregate over the pairs, of whole numbers, so that no order of rows or tasks changes it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.text import gram_hash, positions, words
from lexmill.plans.joins import broadcast_if_small
from lexmill.plans.scratch import materialize
from lexmill.session import ship

#: Sums are whole numbers of this part.
UNIT = 1 << 32
UPPER, DIGIT = r"[A-ZÀ-ÖØ-Þ]", r"[0-9]"


def features(text: Column, w: Column) -> dict[str, Column]:
    """Numbers between 0 and about 3; every one is defined for empty texts."""
    chars = F.greatest(F.length(text), F.lit(1))
    n = F.greatest(F.size(w), F.lit(1))
    share = lambda pattern: F.regexp_count(text, F.lit(pattern)) / chars
    triples = F.transform(positions(F.size(w) - 2), lambda i: gram_hash(w, i, 3))
    lines = F.split(text, "\n", -1)
    return {
        "length": F.log10(F.size(w) + F.lit(1.0)),
        "short": F.when(F.size(w) < 10, 1.0).otherwise(0.0),
        "symbols": F.sqrt(share(r"[#*$%&|<>]")),
        "shouts": F.sqrt(share("!")),
        "upper": F.sqrt(share(UPPER)),
        "digits": F.sqrt(share(DIGIT)),
        "stops": F.sqrt(share(r"[.,;:?]")),
        "other": F.sqrt(share(r"[^\p{L}\p{N}\s.,;:?!#*$%&|<>]")),
        "variety": F.size(F.array_distinct(w)) / n,
        "repeats": 1 - F.when(F.size(triples) > 0, F.size(F.array_distinct(triples)) / F.size(triples)).otherwise(F.lit(1.0)),
        "lines": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
        "word_length": F.least(chars / n / 10, F.lit(3.0)),
    }


@dataclass(frozen=True)
class Ranker:
    weights: dict[str, float]
    cut: float
    threshold: float

    def score(self, values: dict[str, Column]) -> Column:
        strength = sum((F.lit(w) * values[k] for k, w in self.weights.items()), F.lit(-self.cut))
        return 1 / (1 + F.exp(-(strength + float(np.log(self.threshold / (1 - self.threshold))))))


def _with_features(docs: DataFrame, id_col: str, text_col: str, *others: str) -> DataFrame:
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), *others, body.alias("body"), words(body).alias("w"))
    return rows.select("doc_id", *others, F.struct(*[v.cast("double").alias(k) for k, v in features(F.col("body"), F.col("w")).items()]).alias("x"))


def measure(docs: DataFrame, *others: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``others`` and the features ``x`` of every row, written once: to fit and to score without a second look at the texts."""
    return materialize(_with_features(docs, id_col, text_col, *others), "features")


def _ranked(train: DataFrame) -> DataFrame:
    """(y, at, x): the rows of each label numbered from 0 in an order by hash, from the totals of ranges."""
    n = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    rows = materialize(train.repartitionByRange(n, *order).withColumn("p", F.spark_partition_id()), "ranges")
    before = Window.partitionBy("y").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("y", "p").agg(F.count(F.lit(1)).alias("n")).select("y", "p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("p", "y").orderBy(*order)) - 1
    return rows.withColumn("own", own).join(F.broadcast(totals), ["y", "p"]).select("y", (F.col("before") + F.col("own")).alias("at"), "x")  # a row a range and label


def _pairs(train: DataFrame, count: dict[int, int], scale: dict[str, float], partners: int) -> DataFrame:
    """The differences of good and bad features, in units of ``scale``: every row of the larger class with ``partners`` of the smaller, which take turns."""
    rows = materialize(_ranked(train), "ranked")
    more = int(count[1] >= count[0])
    turns = F.explode(F.sequence(F.lit(0), F.lit(min(partners, count[1 - more]) - 1)))
    many = rows.where(F.col("y") == more).select("at", F.col("x").alias("x_many"), turns.alias("turn"))
    few = rows.where(F.col("y") != more).select(F.col("at").alias("few"), F.col("x").alias("x_few"))
    met = many.join(broadcast_if_small(few, 100_000), F.pmod(F.col("at") + F.col("turn"), F.lit(count[1 - more])) == F.col("few"))
    good, bad = ("x_many", "x_few") if more else ("x_few", "x_many")
    return materialize(met.select(*[((F.col(good)[k] - F.col(bad)[k]) / s).alias(k) for k, s in scale.items()]), "pairs")


def _slopes(w: np.ndarray):  # noqa: ANN202
    """Sums over pairs of the loss's gradient and of the upper half of its second derivatives, in UNITs."""
    i, j = np.triu_indices(len(w))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * (len(w) + len(i))
        for b in batches:
            d = np.stack([c.to_numpy() for c in b.columns], 1)
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))
            parts = np.concatenate([d * p[:, None], d[:, i] * d[:, j] * (p * (1 - p))[:, None]], 1)
            total = [t + int(x) for t, x in zip(total, np.rint(parts * UNIT).astype(np.int64).sum(0), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(map(Decimal, total), pa.decimal128(38, 0))], ["k", "v"])

    return scan


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    partners: int = 4,
    ridge: float = 1e-4,
    threshold: float = 0.7,
) -> Ranker:
    """Learn from all ``labels`` (id, 0 or 1; other values and nulls are ignored) that have a text.

    Without a row of either label there is nothing to rank: weights 0, every score is ``threshold``. Repeated labels count once; an id
    with both labels is in both classes; of the texts of a repeated id one is taken. Extra columns are ignored.
    """
    return fit_measured(measure(docs, id_col=id_col, text_col=text_col), labels, id_col=id_col, label_col=label_col, partners=partners, ridge=ridge, threshold=threshold)


def fit_measured(
    rows: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality", partners: int = 4, ridge: float = 1e-4, threshold: float = 0.7
) -> Ranker:
    """``fit`` on rows that ``measure`` has written."""
    ship(rows.sparkSession)
    names = rows.schema["x"].dataType.names
    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("y")).where("l_id is not null and y in (0, 1)").distinct()
    once = rows.groupBy("doc_id").agg(F.min("x").alias("x"))
    train = materialize(once.join(known, F.col("doc_id") == F.col("l_id")).select("doc_id", "y", "x"), "training")
    about = train.agg(F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"), *[F.stddev_pop(F.col("x")[k]).alias(k) for k in names]).first()
    count = {0: about["n0"], 1: about["n1"]}
    if not count[0] or not count[1]:
        return Ranker(dict.fromkeys(names, 0.0), 0.0, threshold)
    # rounded, as the order of rows shows in the last digits
    scale = {k: float(f"{about[k]:.6g}") if about[k] >= 1e-9 else 1.0 for k in names}
    pairs = _pairs(train, count, scale, partners)
    n = max(count.values()) * min(partners, *count.values())
    w = np.zeros(len(names))
    upper = np.triu_indices(len(w))
    for _ in range(40):  # Newton's method on the convex loss
        sums = pairs.mapInArrow(_slopes(w), "k int, v decimal(38, 0)").groupBy("k").agg(F.sum("v").alias("v")).collect()  # one row an entry
        mean = np.array([float(r["v"]) / UNIT / n for r in sorted(sums, key=lambda r: r["k"])])
        hessian = np.zeros((len(w), len(w)))
        hessian[upper] = mean[len(w) :]
        hessian = hessian + np.triu(hessian, 1).T + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, ridge * w - mean[: len(w)])
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    weights = {k: float(v / s) for (k, s), v in zip(scale.items(), w, strict=True)}
    return Ranker(weights, _cut(train, weights, count[0]), threshold)


def _cut(train: DataFrame, weights: dict[str, float], n: int) -> float:
    """Halfway between the ``n``-th strength in order and the next (at the end, between the last two). Equal strengths travel as one row with their number."""
    strength = sum((F.lit(w) * F.col("x")[k] for k, w in weights.items()), F.lit(0.0))
    parts = int(train.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = train.select(strength.alias("s")).groupBy("s").agg(F.count(F.lit(1)).alias("n"))
    values = materialize(values.repartitionByRange(parts, "s").withColumn("p", F.spark_partition_id()), "strengths")
    ranges = values.groupBy("p").agg(F.sum("n").alias("n")).orderBy("p").collect()  # one row a range
    n = min(n, sum(r["n"] for r in ranges) - 1)

    def at(place: int) -> float:
        for r in ranges:
            if place <= r["n"]:
                break
            place -= r["n"]
        upto = values.where(F.col("p") == r["p"]).withColumn("upto", F.sum("n").over(Window.partitionBy("p").orderBy("s")))  # of one range
        return upto.where(F.col("upto") >= place).agg(F.min("s")).first()[0]

    return (at(n) + at(n + 1)) / 2


def score(docs: DataFrame, ranker: Ranker, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1), one row per input row; null texts score as empty ones."""
    return score_measured(_with_features(docs, id_col, text_col), ranker)


def score_measured(rows: DataFrame, ranker: Ranker) -> DataFrame:
    """The columns of rows that ``measure`` has written, but ``x``, with ``score``."""
    return rows.withColumn("score", ranker.score({k: F.col("x")[k] for k in ranker.weights})).drop("x")


def keep(docs: DataFrame, ranker: Ranker, *, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the ranker predicts good, with all their columns; null texts are judged as empty ones."""
    # The row travels as one value, so that no name of its columns can clash.
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*docs.columns).alias("row"), body.alias("body"), words(body).alias("w"))
    x = F.struct(*[v.cast("double").alias(k) for k, v in features(F.col("body"), F.col("w")).items()])
    # The row number keeps the filter above the features: pushed below, it would split the text anew for every word.
    rows = rows.select("row", x.alias("x"), F.monotonically_increasing_id().alias("at"))
    good = ranker.score({k: F.col("x")[k] for k in ranker.weights}) >= ranker.threshold
    return rows.where(good & (F.col("at") >= 0)).select("row.*")
