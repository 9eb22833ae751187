"""Queries over texts against plain versions."""

import re

from pyspark.sql import functions as F

from lexmill.operators import lookup, search
from lexmill.queries import QUERIES
from lexmill.session import table

SF = "/root/testdata/sf0.001"


def tokens(text):
    return re.findall("[a-z0-9]+", (text or "").lower())


def longest(items, texts):
    docs = [" " + " ".join(tokens(t)) + " " for t in texts]
    out = {}
    for i, t in items:
        w = tokens(t)
        n = max((k for k in range(1, len(w) + 1) if any(f" {' '.join(w[:k])} " in d for d in docs)), default=0)
        if n:
            out[i] = max(n, out.get(i, 0))
    return out


def test_longest_prefix_of_every_item_and_length(spark):
    long = " ".join(f"w{i}" for i in range(60))
    docs = [f"x {long} y", "Single", None, "", "what is this", long + " z"]
    items = [(1, long), (2, long + " other"), (15, "single thing"), (16, "what is that"), (17, "absent"), (18, None), (19, "w0"), (20, "!"), (500, "y")]
    q, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame([(t,) for t in docs], "text string")
    got = {r["item_id"]: r["longest"] for r in search.longest_prefixes(q, "item_id", "text", d, "text").collect()}
    assert got == longest(items, docs) == {1: 60, 2: 60, 15: 1, 16: 2, 19: 1, 500: 1}
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    got = {r["item_id"]: r["longest"] for r in QUERIES["longest_prefix_match"](spark, SF).collect()}
    assert got == longest(items, [r["text"] for r in table(spark, SF, "documents").collect()])
    assert any(i >= 10 for i in got) and max(got.values()) > 8


def flat(text):
    return re.sub(r"\s+", " ", text.lower(), flags=re.ASCII)


def test_phrases_of_every_item(spark):
    docs = [(1, "A quick  brown\nfox jumped over it"), (2, "unquick brown fox jumpedover"), (3, None), (4, ""), (None, "quick brown fox jumped"), (5, "brown fox brown fox brown fox")]
    items = [(1, "quick brown fox jumped"), (25, "ick brown fox jum"), (26, "brown"), (27, "brown fox"), (28, ""), (29, None), (30, "not there at all"), (31, "brown FOX brown"), (31, "quick"), (32, " fox ")]
    q, d = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["item_id"]: r["n_docs"] for r in search.phrase_counts(q, "item_id", "text", d, "doc_id", "text").collect()}
    assert got == {1: 2, 25: 2, 26: 3, 27: 3, 28: 4, 29: 0, 30: 0, 31: 3, 32: 3}
    items = table(spark, SF, "benchmark").collect()
    texts = [flat(r["text"]) for r in table(spark, SF, "documents").collect()]
    got = {r["item_id"]: r["n_docs"] for r in QUERIES["phrase_containment"](spark, SF).collect()}
    assert got == {r["item_id"]: sum(flat(r["text"]) in t for t in texts) for r in items} and any(i >= 20 for i in got)


def test_terms_of_every_item(spark):
    terms = {w for r in table(spark, SF, "benchmark").collect() for w in tokens(r["text"]) if len(w) >= 6}
    n = {}
    for r in table(spark, SF, "documents").collect():
        for w in terms & set(tokens(r["text"])):
            n[w] = n.get(w, 0) + 1
    assert {r["term"]: r["n_docs"] for r in QUERIES["containment_join_terms"](spark, SF).collect()} == n


def test_successors_across_ranges(spark):
    df = spark.range(1000).select(F.format_string("%04d", "id").alias("x")).repartition(7)
    got = sorted(map(tuple, lookup.successors(df, "x").collect()))
    assert got == [(f"{i:04d}", f"{i + 1:04d}") for i in range(999)]
