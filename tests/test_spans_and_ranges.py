"""Overlaps and ranges as DataFrame operators against the scanner's own."""

import random
from collections import Counter

from pyspark.sql import functions as F

from lexmill.functions import cite, ids
from lexmill.operators import spans


def test_overlaps(spark):
    r = random.Random(3)
    rows = [(d, s, s + r.randint(1, 12), r.randint(1, 3), 1) for d in range(80) for s in [r.randint(0, 40) for _ in range(r.randint(1, 12))]]
    rows += [(None, 3, 5, 1, 1), (None, 4, 9, 1, 1), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "d int, s int, e int, p int, x int").repartition(3)
    out = Counter((x["d"], x["s"], x["e"], x["p"]) for x in spans.resolve_overlaps(df, "d", "s", "e", "p").collect())
    expected = Counter()
    for d in {x[0] for x in rows}:
        expected.update((d, *x[:3]) for x in cite.resolve_overlaps([(*x[1:4], None) for x in set(rows) if x[0] == d]))
    assert out == expected
    assert spans.resolve_overlaps(df.limit(0), "d", "s", "e", "p").count() == 0


def test_range_items(spark):
    rows = [("1401", "1403"), ("7", "7"), ("9", "3"), ("1", "26"), ("1", "27"), ("c", "f"), ("F", "C"), ("a", "C"), ("a", "3"), ("", ""), ("ab", "ad"), (None, "3"), ("A", "Z"), ("12345678901", "12345678903")]
    df = spark.createDataFrame(rows, "a string, b string")
    out = {(r["a"], r["b"]): r["x"] for r in df.select("a", "b", ids.range_items(F.col("a"), F.col("b"), cite.MAX_RANGE).alias("x")).collect()}
    for a, b in rows[:-1]:
        assert out[a, b] == (cite._between(a, b) if a is not None else None), (a, b)
    assert out[rows[-1]] is None  # more digits than a section has
