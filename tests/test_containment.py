"""Terms in texts against str.find."""

import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

import numpy as np
from lexmill.operators import containment

WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x5E\x60\x7B-\x7F]"


def plain(text, term):
    text, term = text.lower(), term.lower()
    if len(term) >= 6:
        return sum(text.startswith(term, i) for i in range(len(text)))
    return len(re.findall(rf"(?<!{WORD})(?={re.escape(term)}(?!{WORD}))", text))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab é", min_size=3, max_size=8), min_size=1, max_size=8, unique=True), st.lists(st.text("ab é", max_size=40), max_size=4))
def test_places_of_a_trie(terms, texts):
    trie = containment.Trie([t.encode() for t in terms])
    raw = "".join(texts).encode()
    text, term, at = trie.places(np.frombuffer(raw, np.uint8), np.r_[0, np.cumsum([len(t.encode()) for t in texts])].astype(np.int64))
    got = Counter(zip(text.tolist(), term.tolist(), strict=True))
    assert all(raw[s:].startswith(terms[t].encode()) for s, t in zip(at.tolist(), term.tolist(), strict=True))
    assert got == Counter({(i, k): n for i, x in enumerate(texts) for k, t in enumerate(terms) if (n := plain(x, t))})


def _rows():
    r = random.Random(2)
    words = ["income", "in", "come", "gross income", "srly", "srlys", "tax", "taxes", "é", "naïve", "x_y"]
    rows = [(i, "".join(r.choice(words) + r.choice([" ", "", ", ", "-"]) for _ in range(r.randint(0, 40))), 1, 2, 3) for i in range(150)]
    return rows + [(150, None, 1, 2, 3), (151, "", 1, 2, 3), (None, "gross income", 1, 2, 3), (3, "Tax", 1, 2, 3), (152, "income " * 200_000, 1, 2, 3)]


TERMS = ["income", "gross income", "SRLY", "tax", "taxes", "naïve", "x_y", "com", "in", None, "tax", "", "é—é"]


def test_used_terms(spark, monkeypatch):
    rows = _rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, t long, id long, term int").repartition(3)
    terms = spark.createDataFrame([(t,) for t in TERMS], "term string")
    expected = Counter()
    for i, x, *_ in rows[:-1]:
        for t in {t.lower() for t in TERMS if t and len(t) >= 3}:
            if x and plain(x, t):
                expected[i, t, plain(x, t)] += 1
    expected[152, "income", 200_000] += 1
    for block in (containment.BLOCK, 8):  # one pass, and several
        monkeypatch.setattr(containment, "BLOCK", block)
        found, named = containment.used_terms(docs, terms)
        got = Counter((r["id"], r["term"], r["n"]) for r in found.join(named, "t").collect())
        assert got == expected
    best = containment.best_terms(found, named, 2).collect()
    by = {}
    for i, t, _ in expected:
        by.setdefault(i, set()).add(t)
    assert {(r["id"], r["rank"], r["term"]) for r in best} == {(i, k, t) for i, ts in by.items() for k, t in enumerate(sorted(ts, key=lambda t: (-len(t), t))[:2], 1)}
    summary = {r["doc_id"]: (r["n_terms"], r["longest"]) for r in containment.term_summary(docs, terms).collect()}
    assert summary == {i: (len(ts), min(ts, key=lambda t: (-len(t), t))) for i, ts in by.items()}


def test_no_terms_or_texts(spark):
    docs = spark.createDataFrame([(1, "income")], "doc_id long, text string")
    terms = spark.createDataFrame([(None,), ("ab",)], "term string")
    assert containment.used_terms(docs, terms)[0].count() == 0
    assert containment.used_terms(docs.limit(0), spark.createDataFrame([("income",)], "term string"))[0].count() == 0
