"""The stored index against scans of the texts in plain Python."""

import math
import random
import re
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lexmill.functions import analyzer
from lexmill.operators import index
from test_analyzer import plain_stem

SCHEMA = "doc_id long, text string, source string, block long, doc int, term string, len int"


def _rows():
    r = random.Random(3)
    words = ["tax", "taxes", "taxed", "income", "gross", "ordinary", "necessary", "expenses", "expense", "the", "of", "and"] + [f"w{i}" for i in range(40)]
    prose = lambda n: " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=n))
    rows = [(i, prose(r.randint(1, 60)), "ab"[i % 2]) for i in range(400)]
    rows += [(400, None, "a"), (401, "", "b"), (402, "--", None), (403, prose(5000), "a"), (None, prose(30), "a"), rows[5], rows[5], (404, "Ordinary and NECESSARY, expenses!", "b")]
    return rows


ROWS = _rows()
QUERIES = [(0, "tax income"), (1, "ordinary necessary expenses"), (2, "w1 w1 the"), (3, "absent"), (4, ""), (5, None), (6, "w39 absent"), (7, "the of and tax")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "t", 3) for r in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(QUERIES, "qid int, text string")


@pytest.fixture(params=[analyzer.PLAIN, analyzer.STEMMED])
def built(spark, request, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_DOCS", 70)  # several blocks
    new = index.create(spark, tempfile.mkdtemp(prefix="index-") + "/i", kind=request.param, buckets=4)
    return new.add(frame(spark, ROWS), facet_col="source")


def terms(text, kind):
    found = re.findall("[a-z0-9]+", (text or "").lower())
    return found if kind == analyzer.PLAIN else [plain_stem(t) for t in found]


def plain_top(rows, k, kind, every=False):
    texts = [(i, terms(t, kind)) for i, t, *_ in rows]
    n, mean = len(texts), sum(len(t) for _, t in texts) / len(texts)
    df = Counter(w for _, t in texts for w in set(t))
    out = {}
    for q, text in QUERIES:
        ask = Counter(terms(text, kind))
        scored = []
        for i, t in texts:
            tf = Counter(t)
            if (all if every else any)(tf[w] for w in ask) and ask:
                weight = {w: c * max(math.log((n - df[w] + 0.5) / (df[w] + 0.5)), 1e-6) for w, c in ask.items() if tf[w]}
                s = sum(round(x * (tf[w] * 2.2) / (tf[w] + 1.2 * (0.25 + 0.75 * len(t) / mean)) * 1e9) for w, x in weight.items())
                scored.append((-s, i is not None, i or 0))
        for rank, (s, known, i) in enumerate(sorted(scored)[:k], 1):
            out[q, rank] = (i if known else None, -s)
    return out


def got(df):
    return {(r["qid"], r["rank"]): (r["id"], round(r["score"] * 1e9)) for r in df.collect()}


@pytest.mark.parametrize("every", [False, True])
def test_top_is_that_of_a_scan(built, asked, every):
    assert got(built.top(asked, 7, every=every)) == plain_top(ROWS, 7, built.analyzer, every)


def test_segments_tombstones_and_compaction(spark, built, asked):
    more = [(500 + i, f"tax income ordinary w{i} new{i}", "a") for i in range(30)]
    both = built.add(frame(spark, more), facet_col="source")
    assert got(both.top(asked, 9)) == plain_top(ROWS + more, 9, built.analyzer)
    gone = {i for i, *_ in (ROWS + more)[::3] if i is not None} | {403}
    less = both.delete(spark.createDataFrame([(i,) for i in gone] + [(99999,)], "x long"))
    left = [r for r in ROWS + more if r[0] not in gone]
    expected = plain_top(left, 9, built.analyzer)
    assert got(less.top(asked, 9)) == expected
    again = less.delete(spark.createDataFrame([(7,)], "x long"))
    left = [r for r in left if r[0] != 7]
    expected = plain_top(left, 9, built.analyzer)
    assert got(again.top(asked, 9)) == expected
    small = again.compact()
    assert len(small.segments) == 1 and not small.gone
    assert got(small.top(asked, 9)) == expected
    assert Counter(r["id"] for r in small.documents().collect()) == Counter(r[0] for r in left)
    # every version stays readable, a second writer from one version fails
    assert got(index.open_index(spark, built.path, built.version).top(asked, 9)) == plain_top(ROWS, 9, built.analyzer)
    assert index.open_index(spark, built.path).version == small.version
    with pytest.raises(Exception, match="exist"):
        built.add(frame(spark, more[:1]), facet_col="source")


def test_empty_index_and_empty_segments(spark, asked):
    new = index.create(spark, tempfile.mkdtemp(prefix="index-") + "/i")
    assert new.top(asked, 3).count() == 0
    assert new.add(frame(spark, ROWS).limit(0)) is new
    assert new.delete(spark.createDataFrame([(1,)], "x long")) is new and new.compact() is new
    one = new.add(frame(spark, [(1, None, "a"), (2, "", "b")]))
    assert one.top(asked, 3).count() == 0 and one.totals() == (2, 0)
    assert one.top(asked.limit(0), 3).count() == 0


def test_facets(built, asked):
    out = got(built.top(asked, 400, facet="a"))
    every = got(built.top(asked, 1000))
    of = {i: s for i, _, s in ROWS}
    keep = [(q, v) for (q, _), v in sorted(every.items()) if of[v[0]] == "a"]
    assert Counter((q, v) for (q, _), v in out.items()) == Counter(keep)


def test_only_blocks_that_can_hold_a_winner_are_read(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_DOCS", 10)
    rows = [(i, "common word " * (1 if i % 100 else 30), "a") for i in range(600)]
    new = index.create(spark, tempfile.mkdtemp(prefix="index-") + "/i", buckets=2).add(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1))
    written = []
    real = index.materialize
    monkeypatch.setattr(index, "materialize", lambda df, label: written.append((label, real(df, label))) or written[-1][1])
    out = new.top(spark.createDataFrame([(1, "common")], "qid int, text string"), 2)
    assert [r["id"] for r in out.orderBy("rank").collect()] == [0, 100]
    rest = next(df for label, df in written if label == "rest")
    bounds = next(df for label, df in written if label == "bounds")
    assert bounds.count() == 60 and rest.count() <= 6  # the others' bounds are below the threshold


def test_rare_terms(spark, built):
    q = spark.createDataFrame([(1, ROWS[3][1]), (2, "absent"), (3, None)], "qid int, text string")
    df = Counter(w for _, t, *_ in ROWS for w in set(terms(t, built.analyzer)))
    best = sorted({w for w in terms(ROWS[3][1], built.analyzer) if len(w) >= 2}, key=lambda w: (df[w], w))[:3]
    out = built.rare_terms(q, "qid", "text", 3, 2).orderBy("rank").collect()
    assert [(r["qid"], r["term"], r["df"]) for r in out] == [(1, w, df[w]) for w in best]


def plain_gap(words, ask):
    best = None
    for s in range(len(words)):
        seen = set()
        for e in range(s, len(words)):
            seen |= {words[e]} & ask
            if seen == ask:
                best = e - s - 1 if best is None else min(best, e - s - 1)
                break
    return best


def _ids(found, built):
    return found.join(built.documents().select("block", "doc", "id"), ["block", "doc"])


def test_near_takes_the_least_window_of_all_terms(spark, built):
    asks = {1: ["tax", "income"], 2: ["gross", "the", "w3"], 3: ["tax", "of", "and", "w1"], 4: ["the"], 5: ["tax", "absent"]}
    stems = {q: {terms(t, built.analyzer)[0] for t in ts} for q, ts in asks.items()}
    df = spark.createDataFrame([(q, t) for q, ts in stems.items() for t in ts], "qid int, term string")
    out = Counter((r["qid"], r["id"], r["gap"]) for r in _ids(built.near(df, 12), built).collect())
    expected = Counter()
    for q, ask in stems.items():
        for i, t, *_ in ROWS[:403] + ROWS[404:]:
            gap = plain_gap(terms(t, built.analyzer), ask)
            if gap is not None and gap <= 12:
                expected[q, i, gap] += 1
    assert Counter({k: n for k, n in out.items() if k[1] != 403}) == expected
    assert {q for q, i, _ in out if i == 403} == {1, 2, 3, 4}


def test_phrases(spark, built):
    q = spark.createDataFrame([(1, "ordinary and necessary"), (2, "the the"), (3, "tax of"), (4, "expenses"), (5, None), (6, "tax absent")], "qid int, text string")
    out = Counter((r["qid"], r["id"], r["times"]) for r in _ids(built.phrases(q), built).collect())
    expected = Counter()
    for qid, text in ((1, "ordinary and necessary"), (2, "the the"), (3, "tax of"), (4, "expenses"), (6, "tax absent")):
        p = terms(text, built.analyzer)
        for i, t, *_ in ROWS:
            w = terms(t, built.analyzer)
            n = sum(w[k : k + len(p)] == p for k in range(len(w) - len(p) + 1))
            if n:
                expected[qid, i, n] += 1
    assert out == expected


def test_snippets(spark, built):
    long = "zero " * 50 + "the Income, of\n a tax " + "one " * 50 + "tax " + "two " * 40
    docs = spark.createDataFrame([(1, long), (2, "tax at once"), (3, None), (4, "nothing here"), (5, "x " * 60 + "tax")], "doc_id long, text string")
    hits = spark.createDataFrame([(9, i, "tax income") for i in (1, 2, 3, 4, 5)], "qid int, id long, query string")
    out = {r["id"]: r["snippet"] for r in built.snippets(hits, docs, width=6).collect()}
    income = "**income**" if built.analyzer == analyzer.PLAIN else "**Income**"
    assert out[1] == f"… {income}, of a **tax** one one …"
    assert out[2] == "**tax** at once" and out[3] == "" and out[4] == "nothing here" and out[5] == "… x x x x x **tax**"


def test_least_window_and_best_window_of_many_places(spark):
    r = random.Random(5)
    rows = []
    for _ in range(60):
        need = r.randint(1, 4)
        at = [(t, sorted(r.sample(range(80), r.randint(1, 12)))) for t in range(need)]
        rows.append((need, at, sorted((p, "abcd"[t]) for t, ps in at for p in ps)))
    df = spark.createDataFrame(rows, "need int, at array<struct<t:int,places:array<int>>>, hits array<struct<place:int,term:string>>")
    out = df.select("need", "at", "hits", index.least_window(F.col("at"), F.col("need")).alias("w"), index.best_window("hits", F.lit(9)).alias("s")).collect()
    for x in out:
        events = sorted((p, e["t"]) for e in x["at"] for p in e["places"])
        spans = [b - a for a, _ in events for b in [next((events[k][0] for k in range(len(events)) if {t for p, t in events[: k + 1] if p >= a} == set(range(x["need"]))), None)] if b is not None]
        assert x["w"] == min(spans)
        value = lambda s, h=x["hits"]: (len({t for p, t in h if s <= p < s + 9}), sum(s <= p < s + 9 for p, _ in h), -s)
        assert x["s"] == -max(value(h["place"]) for h in x["hits"])[2]


def test_an_index_without_places_ranks_the_same_and_stores_none(spark, built, asked):
    bare = index.create(spark, tempfile.mkdtemp(prefix="index-") + "/i", kind=built.analyzer, buckets=4, places=False).add(frame(spark, ROWS), facet_col="source")
    assert bare._postings().where("places is not null").isEmpty() and not built._postings().where("places is not null").isEmpty()
    gone = spark.createDataFrame([(5,), (403,)], "x long")
    less = index.open_index(spark, bare.delete(gone).path)
    expected = plain_top([r for r in ROWS if r[0] not in (5, 403)], 9, built.analyzer)
    assert not less.places and got(less.top(asked, 9)) == expected == got(less.compact().top(asked, 9))
    with pytest.raises(ValueError, match="places"):
        less.phrases(asked)


def test_only_postings_of_chosen_blocks_are_sent_to_be_scored(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_DOCS", 10)
    rows = [(i, "common word " * (1 if i % 100 else 30), "a") for i in range(600)]
    new = index.create(spark, tempfile.mkdtemp(prefix="index-") + "/i", buckets=2).add(spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1))
    sent = spark.sparkContext.accumulator(0)
    real = index._score_block

    def counted(*a):
        run = real(*a)

        def score(posts, here):
            sent.add(posts.num_rows)
            return run(posts, here)

        return score

    monkeypatch.setattr(index, "_score_block", counted)
    new.top(spark.createDataFrame([(1, "common")], "qid int, text string"), 2).collect()
    assert 0 < sent.value <= 8  # of 60 blocks, in two passes


def test_each_token_of_a_segment_is_stemmed_once(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK_DOCS", 10)
    rows = [(i, "Taxes taxed taxing income incomes", "a") for i in range(100)]
    new = index.create(spark, tempfile.mkdtemp(prefix="index-") + "/i", kind=analyzer.STEMMED, buckets=2).add(frame(spark, rows)).add(frame(spark, rows))
    posts = new._postings().where("token is not null")
    assert posts.count() >= 5 * 20  # a row a block
    stems = {"Taxes": "tax", "taxed": "tax", "taxing": "tax", "income": "incom", "incomes": "incom"}
    for number, *_ in new.segments:
        named = spark.read.parquet(f"{new.path}/dictionary-{number}").select("token", "term").collect()
        assert sorted(named) == sorted(stems.items())
    asked = spark.createDataFrame([(1, "tax"), (2, "income")], "qid int, text string")
    assert {(r["term"], r["df"]) for r in new.frequencies(new.terms_of(asked, "qid", "text")).collect()} == {("tax", 200), ("incom", 200)}
