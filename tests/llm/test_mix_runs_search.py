"""Fair queueing, periodic runs and ranked search against plain versions."""

import hashlib
import math
import random
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexmill.llm import mixing, periodic_runs, queries, ranked_search

SCHEMA = "doc_id long, text string, source string, size long, part int, idx int, key string, q int, rank int, body string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, "k", 4, 5, "b") for r in rows], SCHEMA).repartition(3)


def _rows():
    r = random.Random(11)
    prose = lambda n: " ".join(r.choices([f"w{i}" for i in range(50)], k=n))
    rows = [(i, prose(r.randint(1, 90)), f"s{min(i % 9, 3)}") for i in range(120)]
    rows += [(200, None, "s0"), (201, "", "s0"), (202, " \t\n", "é"), (203, prose(4000), "s1"), (None, prose(30), "s0"), (None, prose(30), "s0"), (None, None, None)]
    rows += [(204, prose(20), None), (205, "only words", "Z"), rows[3], rows[3]]
    return rows


ROWS = _rows()


def plain_targets(sizes, weights=(5, 2, 1), most=2):
    """Shares by weight; what is above the bound is dealt out again until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, full = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in full]
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def check_mix(rows, out):
    size = lambda t: len(brute.words(t))
    sizes, largest = defaultdict(int), defaultdict(int)
    for _, t, s in rows:
        sizes[s] += size(t)
        largest[s] = max(largest[s], size(t))
    targets = plain_targets(sizes)
    assert Counter((r["doc_id"], r["source"], r["size"]) for r in out) == Counter((i, s, size(t)) for i, t, s in rows)
    taken = defaultdict(int)
    for r in out:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["taken"]
    budget, slack = 1.5 * sum(sizes.values()), max(largest.values(), default=0)
    assert budget - slack <= sum(taken.values()) <= budget or not rows
    for s, n in targets.items():
        assert n - largest[s] - 1 <= taken[s] <= n + sum(largest.values())
    # one order for all: who is in finishes no later than who is out, and each source goes round once before it goes round again
    for s in sizes:
        copies = {r["copies"] for r in out if r["source"] == s and r["size"]}
        assert max(copies, default=0) - min(copies, default=0) <= 1
        times = sorted((r["finish"], r["copies"]) for r in out if r["source"] == s and r["size"])
        assert [c for _, c in times] == sorted((c for _, c in times), reverse=True)


def test_mix_meets_targets_of_a_plain_version(spark):
    out = mixing.mix(_frame(spark, ROWS)).collect()
    check_mix(ROWS, out)
    again = mixing.mix(_frame(spark, ROWS).repartition(7)).collect()
    assert Counter(tuple(r) for r in out) == Counter(tuple(r) for r in again)
    assert mixing.mix(_frame(spark, ROWS).limit(0)).count() == 0
    assert [r["taken"] for r in mixing.mix(_frame(spark, [(1, None, "a"), (2, "", None)])).collect()] == [0, 0]


def test_mix_of_one_source_that_holds_nearly_all_and_of_one_row_that_repeats(spark):
    rows = [(i, "a b c", "big") for i in range(300)] + [(7, "same row here too", "big")] * 200 + [(1000 + i, "x y", f"t{i}") for i in range(12)]
    out = mixing.mix(_frame(spark, rows)).collect()
    check_mix(rows, out)
    assert all(r["copies"] == 2 for r in out if r["source"] in ("t1", "t2"))  # small sources run dry and leave the rest to the large


def test_mix_takes_other_weights_and_shares(spark):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(400)]
    out = mixing.mix(_frame(spark, rows), weights=(3, 1), percent=40, most=1).collect()
    taken = {s: sum(r["taken"] for r in out if r["source"] == s) for s in "ab"}
    assert taken == {"a": 1200, "b": 400} and {r["target"] for r in out} == {1200.0, 400.0}


def plain_runs(w, least=12):
    out = {}
    for p in range(1, len(w) // 2 + 1):
        i = 0
        while i + p < len(w):
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            n = i - s + p
            if n >= max(least, 2 * p):
                out.setdefault((s, n), p)  # smaller periods come first
    return sorted((s, n, p) for (s, n), p in out.items())


def plain_row(doc_id, words):
    runs = plain_runs(words)
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    text = " ".join(x for i, x in enumerate(words) if i not in gone)
    milli = 1000 * best[1] // best[2] if runs else None
    return doc_id, len(words), len(runs), *best, milli, sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=70), max_size=5), st.integers(2, 14))
def test_runs_of_small_alphabets_match_a_plain_search(texts, least):
    s, n, p = periodic_runs.runs_of(np.array([x for t in texts for x in t], np.uint64), np.array([len(t) for t in texts], np.int64), least)
    start, expected = 0, []
    for t in texts:
        expected += [(a + start, b, c) for a, b, c in plain_runs(t, least)]
        start += len(t)
    assert list(zip(s.tolist(), n.tolist(), p.tolist(), strict=True)) == expected


def test_common_extensions_match_a_plain_search():
    r = random.Random(4)
    x = np.array([r.randint(0, 1) for _ in range(200)])
    i, j = np.array([(a, b) for a in range(0, 200, 7) for b in range(200) if a != b]).T
    plain = [next((k for k in range(200) if max(a, b) + k >= 200 or x[a + k] != x[b + k]), 0) for a, b in zip(i, j, strict=True)]
    assert periodic_runs.Suffixes(x).common(i, j).tolist() == plain


def _periodic_texts():
    r = random.Random(9)
    word = lambda: r.choice(["a", "B", "b", "ωmega", "½", "x̀y"])
    texts = [" ".join(word() for _ in range(r.randint(0, 40))) for _ in range(40)]
    for p in (1, 2, 3, 5, 6, 7, 11, 13, 40):
        unit = [f"{word()}{i}" for i in range(p)]
        texts.append(" \t".join(["head"] + (unit * 30)[: max(12, 2 * p)] + ["tail"]))
        texts.append("\n".join((unit * 30)[: max(11, 2 * p - 1)]))  # one word short of a run
    texts += [None, "", " \n ", "one", "z " * 11, "z " * 12, "z  " * 3000, " ".join(f"v{i % 700}" for i in range(3000)), "a b " * 50 + " c d" * 20, "line of words here\n" * 9]
    return [(i, t, "s") for i, t in enumerate(texts)] + [(None, "q " * 20, "s"), (3, texts[60 % len(texts)], None), (3, texts[60 % len(texts)], None)]


def test_periodic_runs_of_whole_texts(spark):
    rows = _periodic_texts()
    out = periodic_runs.periodic_runs(_frame(spark, rows), with_runs=True)
    expected = Counter(plain_row(i, brute.words(t, False)) for i, t, _ in rows)
    got = out.collect()
    assert Counter(tuple(r)[:9] for r in got) == expected
    assert sum(len(r["runs"]) for r in got) == sum(r["n_runs"] for r in got) > 10
    assert all(hashlib.sha256(r["collapsed"].encode()).hexdigest() == r["collapsed_sha256"] for r in got)
    assert periodic_runs.periodic_runs(_frame(spark, rows).limit(0)).count() == 0


def test_planted_runs_follow_the_rule(spark):
    import zlib

    rows = [(i, " ".join(f"w{k}" for k in range(i % 37)), "s") for i in range(300)] + [(None, "a b", "s")]
    out = {r["doc_id"]: r["text"] for r in queries.with_planted_runs(_frame(spark, rows)).collect()}
    for i, t, _ in rows:
        w = t.split()
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(w)
        if i is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
        assert out[i].split() == w


def plain_ranking(docs, items, k=10):
    get = lambda t: brute.re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(brute.LOWER))
    texts = [(i, Counter(get(t))) for i, t, *_ in docs]
    texts = [(i, c, sum(c.values())) for i, c in texts if c]
    n, total = len(texts), sum(x[2] for x in texts)
    df = Counter(t for _, c, _ in texts for t in c)
    out = Counter()
    for item, t in items:
        scored = []
        for i, c, size in texts:
            m = 100 - 75 + (75 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in get(t) if c[w])
            scored += [(-s, i is None, i)] if s > 0 else []
        out.update((item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored)[:k], 1))
    return out


def _ranked(spark, docs, items, **kw):
    asked = spark.createDataFrame([(*x, 1, 2, "t", 9) for x in items], "item_id long, text string, q int, rank int, query string, doc_id int")
    return Counter((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in ranked_search.search(_frame(spark, docs), asked, **kw).collect())


def test_ranked_search_matches_a_plain_ranking(spark, monkeypatch):
    r = random.Random(6)
    words = [f"{'AaBbé'[i % 5]}{i}" for i in range(60)]
    docs = [(i, " ".join(r.choices(words, weights=[1 / (k + 1) for k in range(60)], k=r.randint(1, 60))), "s") for i in range(500)]
    docs += [(500, None, "s"), (501, "", "s"), (502, "--", "s"), (None, docs[3][1], "s"), (None, None, "s"), docs[5], docs[5], (503, " ".join(r.choices(words, k=9000)), "s")]
    items = [(i, " ".join(r.choices(words + ["absent"], k=r.randint(1, 30)))) for i in range(60)]
    items += [(60, None), (61, ""), (62, "absent words"), (63, docs[7][1]), (64, "A0 a0 A0 A0"), items[1], (None, "b2 B2")]
    expected = plain_ranking(docs, items)
    assert _ranked(spark, docs, items) == expected
    monkeypatch.setattr(ranked_search, "QUERIES", 400)  # several blocks of queries
    assert _ranked(spark, docs, items) == expected
    monkeypatch.undo()
    assert _ranked(spark, docs, items, k=1) == plain_ranking(docs, items, 1)
    for empty in (_ranked(spark, docs[:0] or [(1, None, "s")], items), _ranked(spark, docs, [(1, None)]), _ranked(spark, docs, [(1, "")])):
        assert not empty
    none = _frame(spark, docs).limit(0)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert ranked_search.search(none, asked).count() == 0 and ranked_search.search(_frame(spark, docs), asked.limit(0)).count() == 0


def test_wand_skips_documents_and_ties_go_to_the_smaller_id():
    r = random.Random(8)
    n, terms = 4000, 12
    has = {t: sorted(r.sample(range(n), n // (2 + 3 * t))) for t in range(terms)}
    for t in range(terms):
        has[t] = sorted({*has[t], *range(100, 115)})  # fifteen documents that hold every term
    term = np.concatenate([np.full(len(d), t) for t, d in has.items()])
    doc = np.concatenate([np.array(d) for d in has.values()])
    shard = object.__new__(ranked_search.Shard)
    shard.term, shard.doc, shard.key = term, doc, (term << 32) | doc
    shard.ids, shard.valid = np.arange(n)[::-1].copy(), np.ones(n, bool)
    impact = (term + 1) * 10
    heaps = ranked_search.Heaps(1, 10)
    scored = ranked_search.wand(shard, impact, np.arange(terms)[None, :], np.ones((1, terms), np.int64), heaps)
    total = np.bincount(doc, impact, n)
    best = sorted((-int(total[d]), n - 1 - d) for d in range(n))[:10]
    assert sorted((-s, -i) for s, _, i in heaps.heaps[0]) == best
    assert scored < 0.2 * np.count_nonzero(total)
