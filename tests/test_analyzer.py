"""The analyzer's tokens and stems against a plain version, letter by letter."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexmill.functions import analyzer
from lexmill.session import table


def consonant(w, i):
    return w[i] not in "aeiou" and (w[i] != "y" or i == 0 or not consonant(w, i - 1))


def measure(w):
    kinds = ["c" if consonant(w, i) else "v" for i in range(len(w))]
    return sum(a == "v" and b == "c" for a, b in zip(kinds, kinds[1:], strict=False))


def has_vowel(w):
    return any(not consonant(w, i) for i in range(len(w)))


def double(w):
    return len(w) > 1 and w[-1] == w[-2] and consonant(w, len(w) - 1)


def cvc(w):
    n = len(w)
    return n > 2 and consonant(w, n - 3) and not consonant(w, n - 2) and consonant(w, n - 1) and w[-1] not in "wxy"


def plain_stem(w):
    if len(w) < 3 or len(w.encode()) > 64 or not re.search("[a-z]$", w):
        return w
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = False
    if w.endswith("eed"):
        w = w[:-1] if measure(w[:-3]) > 0 else w
    elif w.endswith("ed"):
        cut, w = (True, w[:-2]) if has_vowel(w[:-2]) else (False, w)
    elif w.endswith("ing"):
        cut, w = (True, w[:-3]) if has_vowel(w[:-3]) else (False, w)
    if cut:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif measure(w) == 1 and cvc(w):
            w += "e"
    if w.endswith("y") and has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (analyzer.STEP_2, analyzer.STEP_3):
        found = max((s for s in rules if w.endswith(s)), key=len, default=None)
        if found and measure(w[: -len(found)]) > 0:
            w = w[: -len(found)] + rules[found]
    found = max((s for s in analyzer.STEP_4 if w.endswith(s)), key=len, default=None)
    if found:
        rest = w[: -len(found)]
        if measure(rest) > 1 and (found != "ion" or rest[-1:] in ("s", "t")):
            w = rest
    if w.endswith("e") and (measure(w[:-1]) > 1 or (measure(w[:-1]) == 1 and not cvc(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w) > 1 else w


#: Examples of the paper.
KNOWN = {
    "caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor",
    "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size", "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss",
    "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration",
    "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "triplicate": "triplic", "formative": "form",
    "formalize": "formal", "electrical": "electr", "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin",
    "adjustable": "adjust", "irritant": "irrit", "replacement": "replac", "adoption": "adopt", "communism": "commun", "activate": "activ", "effective": "effect",
    "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "generalizations": "gener", "oscillators": "oscil",
}


def stems(spark, words):
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(4)
    return {r["w"]: r["s"] for r in df.select("w", analyzer.term_of(F.col("w"), analyzer.STEMMED).alias("s")).collect()}


def test_known_stems(spark):
    assert stems(spark, KNOWN) == KNOWN
    assert {w: plain_stem(w) for w in KNOWN} == KNOWN


def test_stems_of_made_up_words_match_a_plain_version(spark):
    r = random.Random(1)
    endings = [*analyzer.STEP_2, *analyzer.STEP_3, *analyzer.STEP_4, "s", "sses", "ies", "ed", "eed", "ing", "y", "e", "ll", "yy", "yyy", "eying", ""]
    words = {"".join(r.choices("aeiouybcdlstz", k=r.randint(0, 6))) + "".join(r.choices(endings, k=r.randint(1, 2))) for _ in range(4000)}
    words |= {"", "a", "yy", "syzygy", "x" * 70 + "ing", "1ing", "ing1", "naïve", "über", "Ωmega", "ΩΜΕΓΑΣ", "groß", "日本語s", "y" * 200}
    fold = lambda w: "".join(c for c in unicodedata.normalize("NFD", w.lower()) if unicodedata.category(c) != "Mn") if not re.search("[^\\x00-\\x7f]", w) else None
    got = stems(spark, words)
    for w in words:
        if fold(w) is not None:
            assert got[w] == plain_stem(fold(w)), w
    assert got["naïve"] == "naiv" and got["über"] == "uber" and got["Ωmega"] == "ωmega" and got["日本語s"] == "日本語" and got["x" * 70 + "ing"] == "x" * 70 + "ing"


@pytest.mark.parametrize("sf", ["sf0.01"])
def test_every_word_of_the_documents_has_its_plain_stem(spark, sf):
    found = analyzer.dictionary(table(spark, f"/root/testdata/{sf}", "documents"), "doc_id", "text").collect()
    assert len({r["token"] for r in found}) == len(found) == len({r["number"] for r in found}) > 100
    plain = lambda w: plain_stem("".join(c for c in unicodedata.normalize("NFD", w.lower()) if unicodedata.category(c) != "Mn"))
    assert [(r["token"], r["term"]) for r in found] == [(r["token"], plain(r["token"])) for r in found]
    assert len({r["term"] for r in found}) < len(found)


def test_tokens(spark):
    df = spark.createDataFrame([("Don't naïve-ly x̀y 3rd_A",), (None,), ("",)], "t string")
    rows = df.select(analyzer.tokens(F.col("t"), analyzer.STEMMED).alias("s"), analyzer.tokens(F.col("t")).alias("p")).collect()
    assert rows[0]["s"] == ["Don", "t", "naïve", "ly", "x̀y", "3rd", "A"] and rows[0]["p"] == ["don", "t", "na", "ve", "ly", "x", "y", "3rd", "a"]
    assert rows[1]["s"] == rows[2]["s"] == rows[1]["p"] == []
    assert analyzer.dictionary(df.limit(0).withColumn("id", F.lit(1)), "id", "t").count() == 0
