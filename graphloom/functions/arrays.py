"""Sequences as array columns, and vectors as (id, value) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sorted_intersection(a: Column, b: Column) -> Column:
    """Of two sorted arrays, what is in both, as often as in both."""
    def times(x: Column, v: Column) -> Column:
        return F.size(F.filter(x, lambda y: y == v))

    return F.flatten(F.transform(F.array_distinct(F.array_intersect(a, b)), lambda v: F.array_repeat(v, F.least(times(a, v), times(b, v)))))


def sorted_union(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def sorted_exists(a: Column, value: Column | int) -> Column:
    return F.array_contains(a, value)


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of (id) that are not in the other table."""
    return a.join(b, "id", "left_anti")


def path_exists(path: Column, node_id: int) -> Column:
    return F.array_contains(path, node_id)


def delta(a: DataFrame, b: DataFrame, norm: int = 1) -> DataFrame:
    """One row (delta): the L1 or L2 distance of two vectors; a missing id counts as 0."""
    both = a.select("id", F.col("value").alias("x")).join(b.select("id", F.col("value").alias("y")), "id", "full")
    d = F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0))
    total = F.coalesce(F.sum(F.abs(d)), F.lit(0.0)) if norm == 1 else F.sqrt(F.coalesce(F.sum(d * d), F.lit(0.0)))
    return both.agg(total.alias("delta"))


def scaled(a: DataFrame, by: str = "sum") -> DataFrame:
    """A vector divided by its sum or maximum; as it is if that is not positive."""
    total = a.agg((F.sum("value") if by == "sum" else F.max("value")).alias("total"))
    return a.crossJoin(F.broadcast(total)).select("id", F.when(F.col("total") > 0, F.col("value") / F.col("total")).otherwise(F.col("value")).alias("value"))  # one row


def packed_pair(a: Column, b: Column) -> Column:
    """Two 32-bit ids in one 64-bit number."""
    return F.shiftleft(a.cast("bigint"), 32).bitwiseOR(b.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))


def shard_of(node_id: Column, shards: int = 256) -> Column:
    """The shard of an id, for a power of two."""
    return node_id.bitwiseAND(F.lit(shards - 1))
