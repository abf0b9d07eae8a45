"""Connected components of an edge table by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def components(edges: DataFrame) -> DataFrame:
    """node, root for each node of ``edges`` (a, b: longs); nodes have equal roots if they are connected.

    In each round every node moves to its neighbour of least priority (a fixed hash), if that is less
    than its own, and the edges between the places that are left go on.  The number of rounds grows
    with the logarithm of a path's length.  All state is in written tables.
    """
    rank = lambda c: F.xxhash64(F.col(c), F.lit(17))
    live = written(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels: DataFrame | None = None
    while not live.isEmpty():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        best = both.groupBy("a").agg(F.min(F.struct(rank("b").alias("rank"), F.col("b").alias("b"))).alias("best"))
        to = F.when(F.col("best.rank") < rank("a"), F.col("best.b")).otherwise(F.col("a"))
        moves = written(best.select(F.col("a").alias("node"), to.alias("to")), "moves")
        first = live.join(moves, live.a == moves.node).select(F.col("to").alias("a"), "b")
        second = first.join(moves, first.b == moves.node).select("a", F.col("to").alias("b"))
        after = written(second.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        drop_written(live)
        live = after
        if labels is None:
            labels = moves.withColumnRenamed("to", "root")
        else:
            step = moves.select(F.col("node").alias("at"), "to")
            new = written(labels.join(step, labels.root == step["at"], "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
            drop_written(labels)
            drop_written(moves)
            labels = new
    if labels is None:
        return edges.sparkSession.createDataFrame([], "node long, root long")
    return labels
