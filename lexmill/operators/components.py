"""Connected components: union-find in one task up to a counted number of edges, star contraction beyond."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.plans.scratch import materialize
from lexmill.session import ship

#: Edges that one task holds: some hundred MB at most.
ONE_TASK = 500_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}
    types: list[pa.DataType] = []

    def root(x: object) -> object:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    for b in batches:
        types = types or list(b.schema.types)
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            x, y = root(x), root(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    if parent:
        nodes = list(parent)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, types[0]), pa.array([root(n) for n in nodes], types[0])], ["node", "component"])


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Connect every node's larger (large star) or smaller-or-equal (small star) neighbours to its least neighbour.

    The least neighbour is an aggregate with map-side combination that is joined back, so no node's
    neighbourhood is ever collected.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("m"))
    joined = both.join(least, F.col("a") == F.col("x"))
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 40, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); the component is its least node.

    Self-loops and repeated edges are harmless, an empty table gives no rows, null ends are dropped.
    """
    ends = edges.where("a is not null and b is not null").select("a", "b")
    if ends.limit(one_task + 1).count() <= one_task:
        ship(edges.sparkSession)
        kind = dict(ends.dtypes)["a"]
        return ends.coalesce(1).mapInArrow(_union_find, f"node {kind}, component {kind}")
    nodes = ends.select(F.col("a").alias("node")).unionByName(ends.select(F.col("b").alias("node"))).distinct()
    now = materialize(ends.where("a != b").distinct(), "edges")
    for _ in range(max_rounds):
        new = materialize(_stars(_stars(now, True), False), "edges")
        fingerprint = [
            x.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first() for x in (now, new)
        ]
        now = new
        if fingerprint[0] == fingerprint[1]:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.join(now, F.col("node") == F.col("a"), "left").select("node", F.coalesce("b", "node").alias("component"))
