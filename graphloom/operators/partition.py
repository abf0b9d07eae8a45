"""Dealing a graph out to instances."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..graph import GraphDir, PropertyGraph

Hash = Callable[[Column], Column]


def identity(c: Column) -> Column:
    return c


def _lists(graph: PropertyGraph) -> DataFrame:
    """id, nbr, pos, with a row without neighbour for nodes that have none."""
    return graph.vertices.join(graph.links(GraphDir.OUT), "id", "left").select("id", "nbr", "pos")


def random_nodes(graph: PropertyGraph, n: int, seed: int) -> DataFrame:
    """instance, id, nbr, pos: whole nodes to random instances."""
    return _lists(graph).withColumn("instance", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(n)).cast("int")).select("instance", "id", "nbr", "pos")


def hash_source(graph: PropertyGraph, n: int, h: Hash = identity) -> DataFrame:
    """Whole nodes by hash % n (with the sign of the hash)."""
    return _lists(graph).withColumn("instance", (h(F.col("id")) % n).cast("int")).select("instance", "id", "nbr", "pos")


def hash_dest(graph: PropertyGraph, n: int, h: Hash = identity) -> DataFrame:
    """Each edge by its target; nodes without edges vanish."""
    return graph.links(GraphDir.OUT).withColumn("instance", (h(F.col("nbr")) % n).cast("int")).select("instance", "id", "nbr", "pos")


def hash_source_and_dest(graph: PropertyGraph, n: int, h: Hash = identity) -> DataFrame:
    """Each edge by its target, and the whole node also at its source's instance."""
    away = hash_dest(graph, n, h).where(F.col("instance") != (h(F.col("id")) % n).cast("int"))
    return hash_source(graph, n, h).unionByName(away)


def split(graph: PropertyGraph, mapper: Callable[[PropertyGraph], DataFrame], path: str) -> None:
    """Write each instance's adjacency lists as text below ``path``/instance=i."""
    lists = mapper(graph).groupBy("instance", "id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("nbr").isNotNull(), F.struct("pos", "nbr")))), lambda x: x["nbr"]).alias("nbrs"))
    head = F.concat_ws(" ", "id", F.size("nbrs"))
    text = F.array_join(F.concat(F.array(head), F.col("nbrs").cast("array<string>")), "\n")
    lists.select("instance", text.alias("value")).repartition("instance").write.partitionBy("instance").text(path)
