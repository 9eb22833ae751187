"""The analyzers of the text index: tokens of a text, and the term that a token stands for.

``plain`` terms are the lower-case runs of a-z and 0-9. ``stemmed`` terms are runs of letters and digits of any script, in lower case, without
diacritics, with English suffixes stripped by M. F. Porter's rules (1980, with the two changes of the published program).

Tokens are found once a text; a term is computed once for each distinct token, in Catalyst: a token is folded over five
steps, each a choice of the longest suffix and a condition on what stands before it.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.plans.scratch import materialize

PLAIN, STEMMED = "plain", "stemmed"
#: Tokens of each analyzer. The marks that follow a letter belong to its token.
TOKEN = {PLAIN: "[a-z0-9]+", STEMMED: r"[\p{L}\p{N}\p{Co}][\p{L}\p{N}\p{Co}\p{Mn}]*"}
#: How every suffix ends that a rule looks for: other words stay as they are.
TOUCHED = "(s|ed|ng|y|e|ll|al|li|ti|ci|gi|er|or|on|sm|ul|nt|ic|ou)$"
#: Longer words, in UTF-8 bytes, and shorter ones are not stemmed.
LONGEST, SHORTEST = 64, 3

# Porter's suffixes and what replaces them, in the order of the paper; in a step the longest that fits is taken.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "bli": "ble", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive",
    "biliti": "ble", "logi": "log",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


@cache
def folding() -> tuple[str, str]:
    """Letters with diacritics and the letters below them: every character that decomposes into a letter and marks."""
    pairs = {}
    for code in range(0xC0, 0x2000):
        c = chr(code)
        base = unicodedata.normalize("NFD", c)
        if len(base) > 1 and all(unicodedata.category(x) == "Mn" for x in base[1:]):
            pairs[c] = base[0]
    return "".join(pairs), "".join(pairs.values())


def fold(token: Column) -> Column:
    """Lower case without diacritics. The lower case of a few capitals brings marks of its own, so it comes first."""
    return F.regexp_replace(F.translate(F.lower(token), *folding()), r"\p{Mn}+", "")


def tokens(text: Column, analyzer: str = PLAIN) -> Column:
    """The tokens of a text in order; a null text has none. Tokens of ``stemmed`` are as written."""
    body = F.coalesce(text, F.lit(""))
    return F.regexp_extract_all(F.lower(body) if analyzer == PLAIN else body, F.lit(TOKEN[analyzer]), F.lit(0))


def term_of(token: Column, analyzer: str = PLAIN) -> Column:
    return token if analyzer == PLAIN else stem(fold(token))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _shape(word: Column) -> Column:
    """Each letter as v (vowel) or c: y is a vowel after a consonant, and so depends on how the letter before it came out."""
    kinds = F.regexp_replace(F.translate(word, "aeiouvy", "vvvvvcy"), "[^vy]", "c")
    # a run of y alternates; runs longer than one are next to unknown, so only they are walked letter by letter
    single = F.regexp_replace(F.regexp_replace(kinds, "cy", "cv"), "y", "c")
    step = lambda done, k: F.concat(done, F.when(k != "y", k).when(F.endswith(done, F.lit("c")), "v").otherwise("c"))
    walked = F.aggregate(F.split(kinds, ""), F.lit(""), step)
    return F.when(F.contains(kinds, F.lit("yy")), walked).otherwise(single)


class _Word:
    """A word and its shape; a stem's shape is the beginning of the word's."""

    def __init__(self, word: Column, shape: Column) -> None:
        self.word, self.shape = word, shape

    def ends(self, suffix: str) -> Column:
        return F.endswith(self.word, F.lit(suffix))

    def before(self, suffix: str | int) -> _Word:
        n = suffix if isinstance(suffix, int) else len(suffix)
        keep = F.length(self.word) - n
        return _Word(F.substring(self.word, F.lit(1), keep), F.substring(self.shape, F.lit(1), keep))

    def plus(self, letters: str) -> _Word:
        """Appended letters, none of them y."""
        return _Word(F.concat(self.word, F.lit(letters)), F.concat(self.shape, F.lit("".join("v" if x in "aeiou" else "c" for x in letters))))

    def measure(self) -> Column:
        return F.regexp_count(self.shape, F.lit("v+c+"))

    def vowel(self) -> Column:
        return F.contains(self.shape, F.lit("v"))

    def double(self) -> Column:
        return F.endswith(self.shape, F.lit("c")) & F.rlike(self.word, F.lit(r"(.)\1$"))

    def short(self) -> Column:
        """Ends in consonant, vowel, consonant, and not in w, x or y."""
        return F.endswith(self.shape, F.lit("cvc")) & ~F.rlike(self.word, F.lit("[wxy]$"))

    def packed(self) -> Column:
        return F.struct(self.word.alias("word"), self.shape.alias("shape"))


def _choose(w: _Word, cases: list[tuple[Column, _Word]]) -> Column:
    """The first case that holds, as a struct; else the word as it is."""
    out = F.when(cases[0][0], cases[0][1].packed())
    for condition, value in cases[1:]:
        out = out.when(condition, value.packed())
    return out.otherwise(w.packed())


def _suffixes(w: _Word, rules: dict[str, str], least: int) -> Column:
    """The longest suffix that fits, replaced if the stem's measure is above ``least``."""
    out = None
    for suffix in sorted(rules, key=len, reverse=True):
        stem_ = w.before(suffix)
        ok = stem_.measure() > least
        if suffix == "ion":
            ok = ok & F.rlike(stem_.word, F.lit("[st]$"))
        value = F.when(ok, stem_.plus(rules[suffix]).packed()).otherwise(w.packed())
        out = F.when(w.ends(suffix), value) if out is None else out.when(w.ends(suffix), value)
    return out.otherwise(w.packed())


def _step_1a(w: _Word) -> Column:
    return _choose(w, [(w.ends("sses") | w.ends("ies"), w.before(2)), (w.ends("ss"), w), (w.ends("s"), w.before(1))])


def _step_1b(w: _Word) -> Column:
    eed = w.before("eed")
    cut = lambda s: F.when(w.before(s).vowel(), F.struct(F.lit(True).alias("cut"), *_fields(w.before(s)))).otherwise(F.struct(F.lit(False).alias("cut"), *_fields(w)))
    kept = F.struct(F.lit(False).alias("cut"), *_fields(w))
    shortened = F.struct(F.lit(False).alias("cut"), *_fields(eed.plus("ee")))
    first = F.when(w.ends("eed"), F.when(eed.measure() > 0, shortened).otherwise(kept)).when(w.ends("ed"), cut("ed")).when(w.ends("ing"), cut("ing")).otherwise(kept)

    def mend(x: Column) -> Column:
        v = _Word(x["word"], x["shape"])
        again = [
            (~x["cut"], v), (v.ends("at") | v.ends("bl") | v.ends("iz"), v.plus("e")), (v.double() & ~F.rlike(v.word, F.lit("[lsz]$")), v.before(1)),
            ((v.measure() == 1) & v.short(), v.plus("e")),
        ]
        return _choose(v, again)

    return _let(first, mend)


def _fields(w: _Word) -> list[Column]:
    return [w.word.alias("word"), w.shape.alias("shape")]


def _step_1c(w: _Word) -> Column:
    """y becomes i after a stem with a vowel."""
    return _choose(w, [(w.ends("y") & w.before(1).vowel(), w.before(1).plus("i"))])


def _step_5(w: _Word) -> Column:
    e = w.before(1)
    drop = w.ends("e") & ((e.measure() > 1) | ((e.measure() == 1) & ~e.short()))

    def ll(x: Column) -> Column:
        v = _Word(x["word"], x["shape"])
        return _choose(v, [(v.ends("ll") & (v.measure() > 1), v.before(1))])

    return _let(_choose(w, [(drop, e)]), ll)


def _on_word(step: Callable[[_Word], Column]) -> Callable[[Column], Column]:
    return lambda s: step(_Word(s["word"], s["shape"]))


def stem(word: Column) -> Column:
    """Porter's stem of a folded word. Words of other scripts than Latin have no English suffix and stay; so do very short and long ones."""
    steps = [
        _step_1a, _step_1b, _step_1c, lambda w: _suffixes(w, STEP_2, 0), lambda w: _suffixes(w, STEP_3, 0), lambda w: _suffixes(w, dict.fromkeys(STEP_4, ""), 1), _step_5,
    ]

    def walk(token: Column) -> Column:
        state = F.struct(token.alias("word"), _shape(token).alias("shape"))
        for step in steps:
            state = _let(state, _on_word(step))
        return state["word"]

    touched = lambda t: (F.length(t) >= SHORTEST) & (F.octet_length(t) <= LONGEST) & F.rlike(t, F.lit(TOUCHED))
    return _let(word, lambda t: F.when(touched(t), walk(t)).otherwise(t))


def dictionary(docs: DataFrame, id_col: str, text_col: str, analyzer: str = STEMMED) -> DataFrame:
    """(number, token, term, n_docs): every distinct token of a corpus once, with its term and the number of documents that hold it.

    Tokens are counted with partial sums; the term is computed on the counted table, so once for each token and not for each place.
    """
    held = docs.select(F.explode(F.array_distinct(tokens(F.col(text_col), analyzer))).alias("token"))
    counted = materialize(held.groupBy("token").agg(F.count(F.lit(1)).alias("n_docs")), "tokens")
    return materialize(counted.select(F.monotonically_increasing_id().alias("number"), "token", term_of(F.col("token"), analyzer).alias("term"), "n_docs"), "dictionary")
