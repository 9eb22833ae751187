"""The search for altered quotations against scoring every text."""

import difflib
import random

from hypothesis import given
from hypothesis import strategies as st

from lexmill.functions import quote
from lexmill.functions.quote import ELSEWHERE, score_quote
from lexmill.functions.textnorm import normalize, normalize_mapped
from lexmill.plans import quotes


@given(st.text("aB é“”ﬁ­\t\n …`ß½İ", max_size=40))
def test_normalize_is_that_with_offsets(text):
    assert normalize(text) == normalize_mapped(text).text


def _altered(r, s, n):
    out = list(s)
    for _ in range(n):
        k = r.randrange(len(out))
        kind = r.random()
        if kind < 0.4:
            out[k] = r.choice("abcxyz é")
        elif kind < 0.7:
            del out[k]
        else:
            out.insert(k, r.choice("abcxyz é"))
    return "".join(out)


def test_no_match_escapes(spark):
    r = random.Random(12)
    vocabulary = ["".join(r.choices("abcdeé", k=r.randint(2, 8))) for _ in range(80)]
    prose = lambda n: " ".join(r.choices(vocabulary, k=n))
    texts = [(i, prose(r.randint(5, 120)).capitalize() + ".") for i in range(60)]
    texts += [(200, None), (201, ""), (202, texts[3][1]), (3, texts[3][1].upper()), (203, "short"), (204, texts[5][1] + " " + prose(4000))]
    asks = []
    for k in range(90):
        t = texts[r.randrange(60)][1]
        s = r.randrange(max(len(t) - 20, 1))
        q = t[s : s + r.randint(12, 200)]
        asks.append((k, _altered(r, q, r.choice([0, 0, 1, 2, 3, len(q) // 40, len(q) // 22, len(q) // 12]))))
    a, b = texts[7][1], texts[8][1]
    asks += [(300, a[:30] + " . . . " + a[-30:]), (301, a[:20] + " * * * " + b[-25:]), (302, f"[{a[0]}]{a[1:40]}"), (303, a[:25] + "[the words left out]" + a[-20:]), (304, ""), (305, "…"), (306, None), (307, "xy"), (308, a[:15])]
    found = quotes.altered_quotes(spark.createDataFrame(asks, "ask long, quote string"), spark.createDataFrame(texts, "id long, text string").repartition(3))
    got = sorted((x["ask"], x["id"], round(x["score"], 9)) for x in found.collect())
    plain = sorted((k, i, round(s, 9)) for k, q in asks if q and len(q) > 2 for i, t in texts if t and (s := score_quote(q, t)) >= ELSEWHERE)
    assert got == plain and len(got) > 50
    assert any(s < 1 for *_, s in got)


def test_more_than_any_number_of_candidates(spark):
    q = "there shall be allowed as a deduction all the ordinary expenses"
    texts = [(i, f"Number {i}. There shall be allowed as a deduction al the ordinary expenses, paid in {i}.") for i in range(90)]
    found = quotes.altered_quotes(spark.createDataFrame([(1, q)], "ask long, quote string"), spark.createDataFrame(texts, "id long, text string"))
    assert found.count() == 90
    none = spark.createDataFrame(texts[:0], "id long, text string")
    assert quotes.altered_quotes(spark.createDataFrame([(1, q)], "ask long, quote string"), none).count() == 0
    assert quotes.altered_quotes(spark.createDataFrame([], "ask long, quote string"), spark.createDataFrame(texts, "id long, text string")).count() == 0


def test_matching_blocks_are_those_of_difflib():
    r = random.Random(5)
    for _ in range(1500):
        letters = r.choice(["ab", "abc", "abcdefgh ", "aé½ b"])
        a, b = ("".join(r.choices(letters, k=r.randint(0, n))) for n in (40, 80))
        if a and r.random() < 0.3:
            b = b[:10] + a[: len(a) // 2] + "x" + a[len(a) // 2 + 1 :] + b[10:]
        assert [tuple(m) for m in difflib.SequenceMatcher(None, a, b, False).get_matching_blocks()] == quote.matching_blocks(a, b)
        best = (0.0, 0, 0)
        for x, y, _ in quote.matching_blocks(a, b) if a and b else []:
            s = min(max(y - x, 0), max(len(b) - len(a), 0))
            score = difflib.SequenceMatcher(None, a, b[s : s + len(a)], False).ratio()
            best = (score, s, s + len(b[s : s + len(a)])) if score > best[0] else best
        assert quote.partial_ratio(a, b) == ((1.0, b.index(a), b.index(a) + len(a)) if a and a in b else best)
