"""Reference edges: neighbours, closure and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.functions.ids import section_of
from lexmill.plans.scratch import materialize


def without_internal(edges: DataFrame, from_col: str = "from_id", to_col: str = "to_id") -> DataFrame:
    """Edges that leave their own section."""
    return edges.where(section_of(F.col(from_col)) != section_of(F.col(to_col)))


def neighbours(edges: DataFrame, nodes: DataFrame, side: str, node_id: str, columns: list[str]) -> DataFrame:
    """Distinct edges with the columns of the node at ``side``; edges to nodes that aren't indexed stay."""
    right = nodes.select(F.col(node_id).alias("__n"), *columns)
    return edges.join(right, F.col(side) == F.col("__n"), "left").drop("__n").distinct()


def authority_counts(edges: DataFrame, from_col: str = "from_id", to_col: str = "to_id") -> DataFrame:
    """How many distinct nodes refer to each; combined in the tasks first, so a node that all cite is no hot key."""
    return edges.groupBy(to_col, from_col).agg(F.lit(1).alias("x")).groupBy(to_col).agg(F.count(F.lit(1)).alias("n_from"))


def closure(edges: DataFrame, seeds: DataFrame, max_depth: int, from_col: str = "from_id", to_col: str = "to_id") -> DataFrame:
    """(seed, node, depth): every node within ``max_depth`` hops of each seed, at its least depth, the seed at 0.

    Breadth first with one join and one anti-join a level; levels are written, so the plan doesn't grow with the depth.
    """
    hop = edges.select(F.col(from_col).alias("__f"), F.col(to_col).alias("__t")).distinct()
    seen = seeds.select(F.col(seeds.columns[0]).alias("seed"), F.col(seeds.columns[0]).alias("node"), F.lit(0).alias("depth")).distinct()
    front = seen
    for depth in range(1, max_depth + 1):
        found = front.join(hop, F.col("node") == F.col("__f")).select("seed", F.col("__t").alias("node")).distinct()
        front = materialize(found.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)), "front")
        seen = seen.unionByName(front)
        if front.isEmpty():
            break
    return seen
