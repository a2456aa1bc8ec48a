"""Connected components of an edge table by alternating star contraction, all in DataFrame operations.

Every round replaces each node's edges by edges to its least neighbour, so long chains fold quickly; rounds are cut in
the shared checkpoint folder. Hubs are met by partial aggregates and equi-joins only.

No round makes edges, so the edges counted before it bound it: rounds of few edges take a few tasks a stage, whatever
the number of shuffle partitions, and broadcast the least neighbours. Each task and each file has a cost of its own,
which in rounds of few edges is nearly all of theirs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from deedflow.llm.common import BROADCAST_ROWS, cut

#: Tasks of a stage over few edges.
TASKS = 8
Gather = Callable[[DataFrame], DataFrame]


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large(edges: DataFrame, gather: Gather, hint: Gather) -> DataFrame:
    """Each larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = gather(_least(both).select("u", F.least("u", "m").alias("m")))
    return gather(both.where("v > u").join(hint(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def _small(edges: DataFrame, gather: Gather, hint: Gather) -> DataFrame:
    """Each smaller neighbour of a node, and the node, are tied to the least of them."""
    least = gather(_least(edges))
    moved = edges.join(hint(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return gather(moved.unionByName(least.withColumnRenamed("m", "v")).distinct())


def components(edges: DataFrame, a: str, b: str, few: int = BROADCAST_ROWS) -> DataFrame:
    """(node, root) for every node of an edge: root is the least node of its component."""
    now = cut(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    rows, state = now.count(), None
    while True:
        gather, hint = (lambda df: df.coalesce(TASKS), F.broadcast) if rows <= few else (lambda df: df, lambda df: df)
        now = cut(_small(_large(gather(now), gather, hint), gather, hint))
        # The stars are final when a round changes nothing: equal row counts and equal sums of row hashes.
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == state or mark[0] == 0:
            break
        rows, state = mark[0], mark
    roots = gather(now.select(F.col("v").alias("node")).distinct())
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
