"""Aggregations over visits: rows (walk, step, id) in order of step within a walk."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import in_id_set
from ..plans.storage import drop_written, written


def visit_counts(visits: DataFrame) -> DataFrame:
    """id, visits: most visited first, then by id."""
    return visits.groupBy("id").agg(F.count("*").alias("visits")).orderBy(F.desc("visits"), "id")


def paths_to_nodes(visits: DataFrame, homes: Sequence[int], top: int | None = None) -> DataFrame:
    """id, path, count: how often each path led to each node, where a path begins anew whenever a home is
    visited.  With ``top``: so many paths of each node, by count (descending), length, then the path."""
    order = Window.partitionBy("walk").orderBy("step")
    marked = visits.withColumn("leg", F.sum(in_id_set(F.col("id"), homes).cast("int")).over(order))
    prefix = Window.partitionBy("walk", "leg").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    counts = marked.withColumn("path", F.collect_list("id").over(prefix)).groupBy("id", "path").agg(F.count("*").alias("count"))
    return counts if top is None else top_paths(counts, top)


def top_paths(counts: DataFrame, k: int) -> DataFrame:
    """Of rows (id, path, count) the first ``k`` of each id."""
    rank = Window.partitionBy("id").orderBy(F.desc("count"), F.size("path"), "path")
    return counts.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)


def path_totals(counts: DataFrame) -> DataFrame:
    """id, unique_paths, paths: the number of different paths of each node and of all."""
    return counts.groupBy("id").agg(F.countDistinct("path").alias("unique_paths"), F.sum("count").alias("paths"))


def visit_path_totals(visits: DataFrame, homes: Sequence[int], salt: int = 0) -> DataFrame:
    """:func:`path_totals` of :func:`paths_to_nodes`, with no path as a row: those of a long leg together are
    as large as its square.

    A path goes by its node, its length and the exclusive or of hashes of (place, node).  Where all visits with
    equal ones come from equal ones a step before, they have equal paths, by induction; this is checked, and
    if hashes should collide, others are taken.  As in lists of visits, null nodes have no place in a path.
    """
    order = Window.partitionBy("walk").orderBy("step")
    marked = visits.withColumn("leg", F.sum(in_id_set(F.col("id"), homes).cast("int")).over(order))
    on = Window.partitionBy("walk", "leg").orderBy("step")
    until, past = on.rowsBetween(Window.unboundedPreceding, 0), on.rowsBetween(Window.unboundedPreceding, -1)
    placed = marked.withColumn("length", F.count("id").over(until)).withColumn("hash", F.xxhash64(F.lit(salt), "length", "id"))
    hashed = placed.withColumn("hash", F.bit_xor(F.when(F.col("id").isNotNull(), F.col("hash"))).over(until))
    before = F.struct(F.last("id", True).over(past).alias("id"), F.lag("hash").over(on).alias("hash"))
    paths = hashed.withColumn("before", before).groupBy("id", "length", "hash")
    paths = written(paths.agg(F.count("*").alias("count"), F.min("before").alias("least"), F.max("before").alias("most")), "paths")
    if not paths.where("not least <=> most").isEmpty():
        drop_written(paths)
        return visit_path_totals(visits, homes, salt + 1)
    return paths.groupBy("id").agg(F.count("*").alias("unique_paths"), F.sum("count").alias("paths"))


def paths_through(counts: DataFrame, node_id: int) -> DataFrame:
    return counts.where(F.array_contains("path", node_id))


def previous_counts(visits: DataFrame, top: int | None = None, only_once: bool = False) -> DataFrame:
    """id, prev, count: the nodes visited just before each node (rows carry ``prev``); with
    ``only_once`` just the first predecessor.  Top ones by count (descending), then prev."""
    known = visits.where("prev is not null")
    if only_once:
        known = known.groupBy("id").agg(F.min_by("prev", "step").alias("prev"))
    counts = known.groupBy("id", "prev").agg(F.count("*").alias("count"))
    if top is None:
        return counts
    rank = Window.partitionBy("id").orderBy(F.desc("count"), "prev")
    return counts.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top).drop("rank")


def with_previous(visits: DataFrame) -> DataFrame:
    return visits.withColumn("prev", F.lag("id").over(Window.partitionBy("walk").orderBy("step")))


def keep_info(visits: DataFrame, info: str, only_once: bool = False) -> DataFrame:
    """id, info: the last value recorded for each node, or with ``only_once`` the first."""
    pick = F.min_by if only_once else F.max_by
    return visits.groupBy("id").agg(pick(info, "step").alias(info))


def top_k(rows: DataFrame, k: int, score: str = "score", tie: str = "id") -> DataFrame:
    """The ``k`` rows of largest score; equal scores by the smaller tie."""
    return rows.orderBy(F.desc(score), tie).limit(k)


def top_k_per(rows: DataFrame, k: int, by: str, score: str = "score", tie: str = "id") -> DataFrame:
    rank = Window.partitionBy(by).orderBy(F.desc(score), tie)
    return rows.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
