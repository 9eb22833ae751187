"""Benchmark decontamination by a prefix-filtered set join over item-sized windows.

A window is ``window`` consecutive words of an item (a shorter item is one window); its tokens are its word
shingles of ``shingle`` words. A document can only contain a window if it contains all its shingles, so under
any global order one shingle - the window's first, the necessary prefix at full containment - is enough to find
every occurrence. The order is rarity in the corpus, counted over all documents.

1. One scan turns each document into its shingle hashes and keeps the positions that pass a bit table of the
   benchmark's shingles (a literal of at most 2**20 bits; it saturates harmlessly: a false positive
   only costs a row), with the few words around them. Written once; texts are not read again.
2. Rarity: a count per hash over the written hits. Each window takes its rarest shingle.
3. Equi-join hits with prefixes; length bound (document at least as long), positional bound (the implied start
   lies in the text), then exact comparison of all words of the window.
4. Per document, intervals are united by one sorted sweep.

No Python runs on executors; the written hits make the join's side sizes known to Spark, which broadcasts the
prefixes only under its own size threshold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.text import ALNUM_WORD, gram_hash, lower_ascii, positions, words
from lexmill.plans.scratch import materialize


def _words(text: Column) -> Column:
    # Upper-case letters are words' characters here, so that lowering each word is the same as lowering the text.
    upper_too = ALNUM_WORD.replace(r"\x3A-\x60", r"\x3A-\x40\x5B-\x60")
    return F.transform(words(text, upper_too), lower_ascii)


def _windows(items: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """Distinct (item_id, win): every window of every item; items without words have none."""
    w = items.select(F.col(item_id).cast("string").alias("item_id"), _words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = positions(F.greatest(F.size("w") - (window - 1), F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i + 1, window))).alias("win")).distinct()


def _bit(h: Column, slots: int) -> tuple[Column, Column]:
    return h.bitwiseAND(F.lit(slots - 1)).cast("int"), F.shiftrightunsigned(h, 40).bitwiseAND(F.lit(63)).cast("int")


def _hit(w: Column, bits: Column, slots: int, window: int, k: int) -> Callable[[Column, Column], Column]:
    """(hash, position) -> the hit with the words around it that a window could need, or null."""

    def hit(h: Column, i: Column) -> Column:
        slot, bit = _bit(h, slots)
        lo = F.greatest(i - (window - k), F.lit(0))
        near = F.slice(w, lo + 1, 2 * window - k)
        found = F.struct(i.alias("pos"), h.alias("h"), F.lit(k).alias("k"), lo.alias("lo"), near.alias("near"))
        return F.when(F.getbit(F.get(bits, slot), bit) == 1, found)

    return hit


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 10,
    shingle: int = 5,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items (sorted array), spans (array of start, end in words).

    A word is hit if it lies inside any occurrence of a window. Null and empty texts have no words and no hits;
    items without words are ignored; an empty benchmark hits nothing; rows with equal or null ids are kept apart and
    all returned; items with equal texts all count; extra columns are ignored.
    """
    wins = materialize(_windows(benchmark, item_id_col, item_text_col, window), "windows")
    size = F.least(F.size("win"), F.lit(shingle))
    sizes = sorted(r[0] for r in wins.select(size.alias("k")).distinct().collect())  # at most ``shingle`` values

    def hashes(w: Column, k: int) -> Column:
        return F.transform(positions(F.size(w) - (k - 1)), lambda i: gram_hash(w, i, k))

    tokens = [
        wins.where(size == k).select("item_id", "win", F.posexplode(hashes(F.col("win"), k)).alias("off", "h")).withColumn("k", F.lit(k))
        for k in sizes
    ]
    n = docs.select(F.col(id_col).alias("doc_id"), _words(F.col(text_col)).alias("w"))
    around = F.array().cast("array<struct<pos:int,h:bigint,k:int,lo:int,near:array<string>>>")
    for k, own in zip(sizes, tokens, strict=True):
        distinct = own.select("h").distinct()
        slots = 1 << max(4, min(14, (distinct.count() // 4).bit_length()))
        slot, bit = _bit(F.col("h"), slots)
        table = [0] * slots
        for r in distinct.groupBy(slot.alias("slot")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits")).collect():
            table[r["slot"]] = r["bits"]  # at most 2**14 rows
        literal = F.from_json(F.lit(str(table)), "array<bigint>")

        around = F.concat(around, F.array_compact(F.transform(hashes(F.col("w"), k), _hit(F.col("w"), literal, slots, window, k))))
    hits = n.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.size("w").cast("long").alias("n_words"), around.alias("hits"))
    hits = materialize(hits, "hits")
    each = hits.where(F.size("hits") > 0).select("rid", "n_words", F.explode("hits").alias("x")).select("rid", "n_words", "x.*")
    if tokens:
        rarity = each.groupBy("h", "k").agg(F.count(F.lit(1)).alias("seen"))
        token = tokens[0]
        for x in tokens[1:]:
            token = token.unionByName(x)
        # A shingle that no document has leaves its windows without an occurrence: the inner join drops those rows, so
        # such a window must not fall back to another shingle - absent ones count 0 and are the rarest.
        token = token.join(rarity, ["h", "k"], "left").withColumn("seen", F.coalesce("seen", F.lit(0)))
        prefix = token.groupBy("item_id", "win").agg(F.min(F.struct("seen", "h", "off", "k")).alias("p"))
        prefix = materialize(prefix.where("p.seen > 0").select("item_id", "win", F.col("p.h").alias("h"), F.col("p.k").alias("k"), F.col("p.off").alias("off")), "prefixes")
    else:
        prefix = wins.select("item_id", "win", F.lit(0).cast("long").alias("h"), F.lit(0).alias("k"), F.lit(0).alias("off")).limit(0)
    start, length = F.col("pos") - F.col("off"), F.size("win")
    found = (
        each.join(prefix, ["h", "k"])
        .where((start >= 0) & (start + length <= F.col("n_words")))
        .where(F.slice("near", start - F.col("lo") + 1, length) == F.col("win"))
        .groupBy("rid")
        .agg(F.collect_set(F.struct(start.alias("s"), (start + length).alias("e"))).alias("at"), F.collect_set("item_id").alias("items"))
    )
    empty = F.array().cast("array<struct<s:int,e:int>>")
    united = F.aggregate(
        F.array_sort("at"),
        empty,
        lambda a, x: F.when(
            (F.size(a) > 0) & (F.element_at(a, -1)["e"] >= x["s"]),
            F.concat(
                F.slice(a, 1, F.size(a) - 1),
                F.array(F.struct(F.element_at(a, -1)["s"].alias("s"), F.greatest(F.element_at(a, -1)["e"], x["e"]).alias("e"))),
            ),
        ).otherwise(F.concat(a, F.array(x))),
    )
    found = found.select(F.col("rid").alias("r"), united.alias("spans"), F.array_sort("items").alias("items"))
    out = hits.select("rid", "doc_id", "n_words").join(found, F.col("rid") == F.col("r"), "left")
    spans = F.coalesce(F.col("spans"), empty)
    items = F.coalesce(F.col("items"), F.array().cast("array<string>"))
    covered = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select("doc_id", "n_words", covered.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), spans.alias("spans"))
