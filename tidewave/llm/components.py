"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import in_few, written


#: Edges from which a join's side is worth a table of its own.
MANY = 100_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def sided(minima: DataFrame, state: tuple) -> DataFrame:
    """Minima of many edges are written, so that the join's sides are plain exchanges and a hub's rows split."""
    return written(minima, "minima") if state[0] > MANY else minima


def components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(u, v) edges of longs -> (node, component): the smallest node that can be reached.

    Alternates large-star and small-star steps until the edges stay the same; every node then points to
    its component's smallest node. Minima are combined before the shuffle, so a hub is no single task's;
    steps are logarithmic in the number of nodes. Nodes without an edge have no row. Few edges take few tasks,
    however many shuffle partitions there are.
    """
    rows = edges.count()
    edges = written(in_few(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows), "edges")
    state = _state(edges)
    if not state[0]:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(most):
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sided(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), state)
        large = both.where("v > u").join(least, F.col("u") == F.col("w")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = written(in_few(in_few(large, 2 * state[0]).distinct(), 2 * state[0]), "large-star")
        lowest = sided(large.groupBy("u").agg(F.min("v").alias("m")), state)
        joined = large.join(lowest.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
        joined = in_few(joined, 2 * state[0])
        small = joined.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionAll(in_few(lowest, 2 * state[0]).select("u", F.col("m").alias("v"))).distinct()
        edges, before = written(in_few(small, 2 * state[0]), "small-star"), state
        state = _state(edges)
        if state == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    raise RuntimeError(f"no stable components after {most} rounds")
