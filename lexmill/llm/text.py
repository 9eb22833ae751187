"""Column expressions on text that stay inside the JVM."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Maximal runs without space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Maximal runs of lower-case ASCII letters, digits and non-ASCII characters.
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column, pattern: str = WORD) -> Column:
    """All words of a whole text; null gives an empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def lower_ascii(word: Column) -> Column:
    """Lower-case A-Z alone. ``lower`` has a fast path for ASCII and is right there; the rest is translated."""
    plain = F.octet_length(word) == F.char_length(word)
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, ascii_uppercase, ascii_lowercase))


def gram_hash(array: Column, at: Column, n: int) -> Column:
    """64-bit hash of the ``n`` words from 0-based position ``at`` on."""
    return F.xxhash64(*[F.get(array, at + i) for i in range(n)])


def positions(count: Column) -> Column:
    """0 .. count - 1; an empty array where count is below 1."""
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(
        F.array().cast("array<int>")
    )
