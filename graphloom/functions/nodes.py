"""Node-local functions: neighbour lists as columns and tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import GraphDir, PropertyGraph, in_id_set


def first_neighbors(graph: PropertyGraph, most: int, direction: GraphDir = GraphDir.OUT) -> DataFrame:
    """id, nbr, pos of the first ``most`` neighbours of each node."""
    return graph.links(direction).where(F.col("pos") < most)


def neighbor_count(graph: PropertyGraph, node_id: int, direction: GraphDir = GraphDir.OUT) -> int:
    """The degree of a node; 0 if there is no such node."""
    return graph.links(direction).where(F.col("id") == node_id).count()


def is_neighbor(graph: PropertyGraph, pairs: DataFrame, direction: GraphDir = GraphDir.OUT) -> DataFrame:
    """``pairs`` (id, other) with ``found``: whether other is in id's list."""
    known = graph.links(direction).select("id", F.col("nbr").alias("other")).distinct().withColumn("found", F.lit(True))
    return pairs.join(known, ["id", "other"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def intersect(graph: PropertyGraph, ids: DataFrame, direction: GraphDir = GraphDir.OUT) -> DataFrame:
    """id, nbr, pos of the neighbours that are in ``ids`` (column id), as often as in both
    (multiset semantics: the k-th occurrence in a list needs a k-th occurrence in ``ids``)."""
    from pyspark.sql.window import Window

    k = Window.partitionBy("id", "nbr").orderBy("pos")
    left = graph.links(direction).withColumn("k", F.row_number().over(k))
    right = ids.groupBy(F.col("id").alias("nbr")).agg(F.count("*").alias("n"))
    return left.join(right, "nbr").where("k <= n").select("id", "nbr", "pos")


def random_neighbor(nbrs: Column, draw: Column) -> Column:
    """A uniform pick from an array (null if empty), by ``draw`` in [0, 1)."""
    return F.when(F.size(nbrs) > 0, F.get(nbrs, F.floor(draw * F.size(nbrs)).cast("int")))


def random_neighbor_set(nbrs: Column, k: int, seed: int) -> Column:
    """``k`` picks with replacement; an empty array if there are no neighbours."""
    picks = F.array(*[F.get(nbrs, F.floor(F.rand(seed + i) * F.size(nbrs)).cast("int")) for i in range(k)])
    return F.when(F.size(nbrs) > 0, picks).otherwise(F.slice(nbrs, 1, 0))


def random_neighbors(graph: PropertyGraph, k: int, direction: GraphDir = GraphDir.OUT, seed: int = 1) -> DataFrame:
    """id, n and nbr: ``k`` neighbours of each node that has any, with replacement; no list is built."""
    n = graph.degrees(direction).where("degree > 0")
    draws = n.select("id", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("n"), "degree")
    # The draw depends on the seed, the node and its turn alone, so lost tasks draw the same again.
    at = F.pmod(F.xxhash64(F.lit(seed), "id", "n"), F.col("degree")).cast("int")
    return draws.withColumn("pos", at).join(graph.links(direction), ["id", "pos"]).select("id", "n", "nbr")


def without_self_and_followed(graph: PropertyGraph, node_id: int, candidates: DataFrame) -> DataFrame:
    """``candidates`` (column id) but for the node and its out-neighbours: whom to recommend."""
    followed = graph.links(GraphDir.OUT).where(F.col("id") == node_id).select(F.col("nbr").alias("id"))
    return candidates.where(F.col("id") != node_id).join(followed, "id", "left_anti")


def without(candidates: DataFrame, ids: Sequence[int] | DataFrame) -> DataFrame:
    """``candidates`` (column id) without a set of ids."""
    if isinstance(ids, DataFrame):
        return candidates.join(ids, "id", "left_anti")
    return candidates.where(~in_id_set(F.col("id"), ids))


def has_too_many_edges(degree: Column, threshold: int | None) -> Column:
    """More than the threshold (never without one)."""
    return F.lit(False) if threshold is None else degree > threshold


def pick_random(ids: DataFrame, seed: int) -> DataFrame:
    """One uniform row of ``ids`` (column id)."""
    return ids.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(1)


def random_subset(ids: DataFrame, k: int, seed: int) -> DataFrame:
    """``k`` rows without replacement; all if there are fewer.  A top-k by hash: no full sort."""
    return ids.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(k)


def random_range_subset(k: int, low: int, high: int, seed: int) -> list[int]:
    """``k`` distinct numbers of low..high (both included)."""
    import numpy as np

    if k > high - low + 1:
        raise ValueError("the range is smaller than the subset")
    return (low + np.random.default_rng(seed).choice(high - low + 1, size=k, replace=False)).tolist()
