"""Connected components of a graph held as an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.blocks import Scratch


class Forest:
    """Union-find over the few nodes that one task sees at a time."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        r = x
        while (p := up.get(r, r)) != r:
            r = p
        while (p := up.get(x, x)) != r:
            up[x] = r
            x = p
        return r

    def join(self, a: int, b: int) -> bool:
        """True if the two were apart."""
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The pairs that a spanning forest of all pairs needs."""
    f = Forest()
    return [(x, y) for x, y in zip(a.tolist(), b.tolist()) if f.join(x, y)]


#: Nodes that a task holds at most before it passes on what it has joined.
TASK_NODES = 1 << 20
#: Rounds that begin with joining inside of tasks; the star steps end without it.
JOINED_ROUNDS = 3


def _rehung(batches):
    """Edges (u, v) of one task, as edges from each of its nodes to the least one it reaches within the task."""
    forest = Forest()

    def found():
        nodes = list(forest.up)
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], names=["u", "v"])

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns)):
            forest.join(a, b)
        if len(forest.up) > TASK_NODES:
            yield found()
            forest.up.clear()
    if forest.up:
        yield found()


def _only_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge down at most, and those with one have none up."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")),
                                          F.struct(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("e"))
    nodes = ends.select("e.*").groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not nodes.agg(F.count_if((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0)))).first()[0]


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b, longs): root is the
    smallest node reachable.

    Each task first joins what its own edges connect.  Then large-star and
    small-star steps alternate: each node's neighbours are re-hung on its smallest
    neighbour until only stars are left, about log(n) rounds.  A node's neighbours
    are only aggregated and joined, never collected; a hub's rows can be split by
    the adaptive skew join.  The rounds are written to ``scratch``, which must
    outlive the result, in a few files for each core.
    """
    files = 4 * edges.sparkSession.sparkContext.defaultParallelism

    def tidy(df, joined=False):
        df = df.select("u", "v").where("u <> v")
        if joined:
            df = df.mapInArrow(_rehung, "u long, v long")
        return df.distinct().coalesce(files)

    now = scratch.keep(tidy(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), True), "edges")
    rounds = 0
    while not _only_stars(now):
        rounds += 1
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = tidy(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        large = scratch.keep(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(
            F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
            F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        now = scratch.keep(tidy(small, rounds < JOINED_ROUNDS), "small-star")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
