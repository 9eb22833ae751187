"""MinHash near-duplicates by an inverted join on signature coordinates.

1. One Arrow-batched scan (NumPy, no loop over words): each text's set of distinct word shingles, a 128-bit digest of the set
   and a signature of ``coordinates`` minima. Rows of one digest are one class; only classes go on.
2. Classes are posted under every (coordinate, value). Two sets of similarity ``percent`` agree in about that share of the
   coordinates; pairs are retained that agree in at least ``matches``. Posts that no other class has are counted and dropped at
   once; a class with fewer than ``matches`` shared posts has no partner. Of the others only the prefix - the rarest posts, so many
   that two lists with ``matches`` collisions must meet in it - is merged; the rest is skipped, and the collisions of a met
   pair are completed by comparing its signatures. At 85 per cent, 64 coordinates and 40 matches a link is missed with a
   probability of 2.4e-6; with ``matches`` 1 every shared post is merged and no pair that meets in any coordinate is skipped
   (a miss has a probability below 1e-50), at the cost of longer lists.
3. Retained pairs are confirmed on the full sets, re-read for the classes concerned alone.
4. No list's pairs are emitted wholesale. Each round tests the members of a list against one member (first the one with the most
   collisions, which is the centre of a group of near copies, then one drawn by hash, anew each round), links are contracted to
   components, and only pairs across components are left. When those are few, or a round finds little new, all of them are tested at
   once, as differences from the centre of their list; lists of one centre are merged where that leaves fewer pairs, and large groups
   are split over tasks. Every pair that prefix and lengths allow is then tested or already connected, so no link between
   different texts is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.batches import U, chunks, mix, shingles, word_hashes
from lexmill.operators.components import connected_components
from lexmill.plans.joins import broadcast_if_small
from lexmill.plans.scratch import materialize, passing
from lexmill.session import ship

_rng = np.random.default_rng(85)
_ODD = _rng.integers(0, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_ADD = _rng.integers(0, 2**64, 256, dtype=np.uint64)
#: Members of a group that one task tests against all of it.
SPLIT = 100


def _digests(s: np.ndarray, at: np.ndarray) -> list[bytes | None]:
    """128 bits of each set, None for an empty one."""
    sums = []
    for salt in (U(0x51ED270B), U(0xA24BAED4963EE407)):
        run = np.zeros(len(s) + 1, U)
        np.cumsum(mix(s ^ salt), out=run[1:])
        sums.append(run[at[1:]] - run[at[:-1]])
    both = np.stack(sums, 1).astype(">u8")
    return [both[i].tobytes() if n else None for i, n in enumerate(np.diff(at))]


def _signatures(s: np.ndarray, at: np.ndarray, coordinates: int) -> np.ndarray:
    """Minima by row (of non-empty rows) and coordinate, 32 bits each."""
    starts = at[:-1][np.diff(at) > 0]
    out = np.empty((len(starts), coordinates), np.uint32)
    if len(starts):
        for k in range(coordinates):
            out[:, k] = np.minimum.reduceat(((s * _ODD[k] + _ADD[k]) >> U(32)).astype(np.uint32), starts)
    return out


def _sketch(n: int, coordinates: int):  # noqa: ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, end, raw, offsets in chunks(b.column("body")):
                s, at = shingles(*word_hashes(raw, offsets), n)
                size = np.diff(at)
                signature = _signatures(s, at, coordinates)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum((size > 0) * coordinates)].astype(np.int32)), pa.array(signature.view(np.int32).ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(first, end - first), pa.array(size), pa.array(_digests(s, at), pa.binary()), lists], ["doc_id", "n", "node", "sig"]
                )

    return scan


def _sets(n: int):  # noqa: ANN202
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, _, raw, offsets in chunks(b.column("body")):
                s, at = shingles(*word_hashes(raw, offsets), n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_digests(s, at), pa.binary()), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(s.view(np.int64)))], ["s_node", "s"]
                )

    return scan


def _near(na: Column, nb: Column, percent: int) -> Column:
    """Length bound: the smaller set could cover enough of the larger."""
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = 5,
    percent: int = 80,
    coordinates: int = 64,
    matches: int = 34,
    rounds: int = 8,
) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (least id reachable over links, itself included), kept.

    Texts without words (null, empty, blank) are linked with nothing. Rows with a null id have component_id null and are kept;
    they link no others. Repeated rows of one id come back as often. An empty table gives no rows; extra columns are ignored.
    """
    ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    body = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("body"))
    rows = body.mapInArrow(_sketch(shingle, coordinates), f"doc_id {kind}, n long, node binary, sig array<int>")
    rows = materialize(rows, "sketches")
    classes = rows.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialize(classes, "classes")
    ids = classes.select(F.col("node").alias("c_node"), F.col("rep").alias("component_id"))
    with passing():
        links = _links(body, classes, _lists(classes, matches), kind, shingle, percent, matches, rounds)
        if links is not None:
            parts = classes.select("node", "rep").join(connected_components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
            least = parts.groupBy("component").agg(F.min("rep").alias("component_id"))
            ids = materialize(parts.join(least, "component").select(F.col("node").alias("c_node"), "component_id"), "components", keep=True)
    out = rows.select("doc_id", "n", "node").join(ids, F.col("node") == F.col("c_node"), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def _lists(classes: DataFrame, matches: int) -> DataFrame:
    """(key, node, n, met): the prefix posts of every class that has ``matches`` shared posts."""
    key = F.shiftleft(F.col("k").cast("long"), 32).bitwiseOR(F.col("v").cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    posts = classes.select("node", "n", F.posexplode("sig").alias("k", "v")).select("node", "n", key.alias("key"))
    shared = posts.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = posts.join(shared, "key").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "key"))).alias("p"), F.sum("df").alias("met"))  # at most one a coordinate
    prefix = F.transform(F.slice("p", F.lit(1), F.size("p") - (matches - 1)), lambda x: x["key"])
    return materialize(held.where(F.size("p") >= matches).select(F.explode(prefix).alias("key"), "node", "n", "met"), "lists")


def _hub(turn: int) -> Column:
    """What orders a list's members: the hub comes last."""
    drawn = F.xxhash64("node", F.lit(turn))
    return F.struct("met", drawn) if turn == 0 else F.struct(F.lit(0).cast("long"), drawn)


def _pairs_across(now: DataFrame, group: str) -> DataFrame:
    """(group, pairs): how many pairs of members of each group lie in different components."""
    sizes = now.groupBy(group, "comp").agg(F.count(F.lit(1)).cast("double").alias("c")).groupBy(group).agg(F.sum("c").alias("l"), F.sum(F.col("c") * F.col("c")).alias("q"))
    return sizes.select(group, ((F.col("l") * F.col("l") - F.col("q")) / 2).alias("pairs"))


def _grouped(now: DataFrame) -> DataFrame:
    """(group, ref, node, n, comp): lists of one centre as one group where that leaves no more pairs, other lists alone.

    The centre of a list is its member with the most collisions, or what is the centre in other lists of that member. ``ref`` is
    one text for each group.
    """
    hubs = now.groupBy("key").agg(F.max_by(F.struct("node", "met"), _hub(0)).alias("h")).select("key", F.col("h.node").alias("hub"), F.col("h.met").alias("hub_met"))
    rows = materialize(now.join(hubs, "key"), "members")
    best = rows.groupBy("node").agg(F.max_by("hub", F.struct("hub_met", "hub")).alias("best"))
    best = materialize(best.select(F.col("node").alias("of"), "best"), "centres")
    centres = rows.select("key", "hub").distinct().withColumnRenamed("hub", "of")
    for _ in range(2):
        centres = centres.join(best, "of").select("key", F.col("best").alias("of"))
    rows = materialize(rows.join(centres.withColumnRenamed("of", "centre"), "key").select("key", "hub", "centre", "node", "n", "comp"), "members")
    together = _pairs_across(rows.select("centre", "node", "comp").distinct(), "centre").withColumnRenamed("pairs", "merged")
    alone = rows.select("key", "centre").distinct().join(_pairs_across(rows, "key"), "key").groupBy("centre").agg(F.sum("pairs").alias("alone"))
    rows = rows.join(broadcast_if_small(materialize(together.join(alone, "centre"), "costs")), "centre")
    merged = F.col("merged") <= F.col("alone")
    group, ref = F.when(merged, F.col("centre")).otherwise(F.col("key").cast("string").cast("binary")), F.when(merged, F.col("centre")).otherwise(F.col("hub"))
    return materialize(rows.select(group.alias("group"), ref.alias("ref"), "node", "n", "comp").distinct(), "groups")


def _across(now: DataFrame, side: Callable[[str], DataFrame], percent: int) -> DataFrame:
    """Every link (a, b) between members of one list in different components, tested on full sets without their sets side by side.

    Each set is written as its difference from the centre of the list: near texts differ little from it. Of two sets with
    differences D and E the symmetric difference has |D| + |E| - 2 |D and E| elements, so the join's own condition is the exact test
    and only links leave it; the sizes alone bound it from below. A group's members are dealt to tasks in parts, each of
    which meets the whole group.
    """
    rows = _grouped(now)
    apart = rows.select(F.col("node").alias("a"), F.col("ref").alias("b")).distinct().join(side("a"), "a").join(side("b"), "b")
    apart = apart.select(F.col("a").alias("node"), F.col("b").alias("ref"), F.array_union(F.array_except("s_a", "s_b"), F.array_except("s_b", "s_a")).alias("d"))
    parts = rows.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / SPLIT).cast("int").alias("parts"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    rows = rows.join(broadcast_if_small(materialize(parts.where("lo != hi").drop("lo", "hi"), "parts")), "group").join(materialize(apart, "differences"), ["node", "ref"]).withColumn("m", F.size("d"))
    of = lambda x, part: rows.select("group", part.alias("part"), *[F.col(c).alias(f"{c}_{x}") for c in ("node", "n", "comp", "d", "m")])
    total = F.col("n_a") + F.col("n_b")
    # |A and B| = (|A| + |B| - |A xor B|) / 2, and 100 |A and B| >= percent |A or B|, both doubled
    linked = lambda xor: 100 * (total - xor) >= percent * (total + xor)
    one = of("a", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    all_ = of("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = one.join(all_, ["group", "part"]).where(F.col("node_a") < F.col("node_b")).where(F.col("comp_a") != F.col("comp_b")).where(_near(F.col("n_a"), F.col("n_b"), percent))
    pairs = pairs.where(linked(F.abs(F.col("m_a") - F.col("m_b")))).where(linked(F.col("m_a") + F.col("m_b") - 2 * F.size(F.array_intersect("d_a", "d_b"))))
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _links(body: DataFrame, classes: DataFrame, lists: DataFrame, kind: str, n: int, percent: int, matches: int, rounds: int) -> DataFrame | None:
    """Confirmed links (a, b) between classes: enough of them to connect all that are linked; None without any candidate."""
    if lists.isEmpty():
        return None
    met = lists.groupBy("key").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("key")
    lists = materialize(lists.join(met, "key"), "lists")
    concerned = materialize(lists.select("node").distinct().join(classes, "node").select("node", F.col("rep").alias("c_id"), "sig"), "concerned")
    # Texts are not shuffled while the ids concerned are few enough to be sent to them.
    ids = broadcast_if_small(concerned.select("c_id").distinct())
    texts = body.join(ids, F.col("doc_id") == F.col("c_id"), "left_semi").select("body")
    sets = texts.mapInArrow(_sets(n), "s_node binary, s array<bigint>")
    sets = sets.join(concerned.select("node"), F.col("s_node") == F.col("node"), "left_semi").groupBy("s_node").agg(F.first("s").alias("s"))
    sets = materialize(sets.join(concerned.select("node", "sig"), F.col("s_node") == F.col("node")).select("node", "sig", "s"), "sets")
    side = lambda x: sets.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"), F.col("s").alias(f"s_{x}"))
    sigs = lambda x: concerned.select(F.col("node").alias(x), F.col("sig").alias(f"sig_{x}"))

    agree = F.size(F.filter(F.zip_with("sig_a", "sig_b", lambda x, y: x == y), lambda x: x)) >= matches

    def confirmed(retained: DataFrame) -> DataFrame:
        common = F.size(F.array_intersect("s_a", "s_b"))
        union = F.size("s_a") + F.size("s_b") - F.col("common")
        full = retained.join(side("a"), "a").join(side("b"), "b").select("a", "b", common.alias("common"), "s_a", "s_b")
        return full.where(100 * F.col("common") >= percent * union).select("a", "b")

    links: DataFrame | None = None
    turn, productive = 0, True
    while True:
        if links is None:
            now = lists.withColumn("comp", F.col("node"))
        else:
            now = lists.join(connected_components(links), "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
            mixed = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("key")
            now = materialize(now.join(mixed, "key"), "open")
        across = _pairs_across(now, "key").agg(F.coalesce(F.sum("pairs"), F.lit(0.0))).first()[0]
        if not across:
            break
        last = across <= 2 * now.count() or turn >= rounds or not productive
        if last:
            rest = materialize(_across(now, side, percent), "links")
            links = rest if links is None else links.unionByName(rest)
            break
        hub = now.groupBy("key").agg(F.max_by(F.struct("node", "n", "comp"), _hub(turn)).alias("h"))
        pairs = now.join(hub, "key").where("comp != h.comp").where(_near(F.col("n"), F.col("h.n"), percent))
        pairs = pairs.select(F.least("node", "h.node").alias("a"), F.greatest("node", "h.node").alias("b")).distinct()
        pairs = materialize(pairs.join(sigs("a"), "a").join(sigs("b"), "b").where(agree).select("a", "b"), "pairs")
        new = materialize(confirmed(pairs), "links")
        links = new if links is None else links.unionByName(new)
        turn += 1
        productive = 10 * new.count() >= pairs.count()  # else what is left is near, but not linked: test it once and for all
    return links
