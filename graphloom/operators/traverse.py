"""Traversals: breadth-first, all-paths and depth-first.

Breadth-first and all-paths walks advance level by level with joins.  Their order is carried as a
sortable path of list places, so no level has to be numbered in one task.  Depth-first order has no
levels; it runs as a kernel over the part of the graph that is reachable from its homes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import GraphDir, PropertyGraph
from ..plans.storage import partitioned, written


@dataclass(frozen=True)
class Limits:
    """A node at ``max_depth``, or with ``max_edges`` neighbours or more, is visited but not expanded; at
    most ``max_steps`` nodes are visited."""

    max_depth: int | None = None
    max_edges: int | None = None
    max_steps: int | None = None


def _homes(graph: PropertyGraph, homes: Sequence[int]) -> DataFrame:
    spark = graph.edges.sparkSession
    rows = [(int(h), i) for i, h in enumerate(dict.fromkeys(homes))]
    table = spark.createDataFrame(rows, "id bigint, place int")
    return F.broadcast(table).join(graph.vertices, "id", "left_semi").select("id", F.lit(0).alias("depth"), F.array("place").alias("path"), F.lit(None).cast("bigint").alias("prev"))


def _expandable(frontier: DataFrame, graph: PropertyGraph, direction: GraphDir, limits: Limits) -> DataFrame:
    """Rows of the frontier that may be expanded."""
    if limits.max_edges is None:
        return frontier
    few = graph.degrees(direction).where(F.col("degree") < limits.max_edges).select("id")
    return frontier.join(few, "id", "left_semi")


def breadth_first(graph: PropertyGraph, homes: Sequence[int], direction: GraphDir = GraphDir.OUT, limits: Limits = Limits(), hook: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """id, depth, path, prev of each visited node: its first depth, its place in breadth-first order
    (:func:`in_order` numbers it) and the node that it was first reached from.

    Homes that are not in the graph are passed over; neighbours repeated in a list count once.  ``hook``
    may change each level's rows (a custom choice of what to enqueue).
    """
    links = partitioned(graph.links(direction), "id")
    level = written(_homes(graph, homes), "bfs-level")
    if limits.max_steps is not None:
        level = written(level.orderBy("path").limit(limits.max_steps), "bfs-level")
    seen, enqueued, depth = level, level.count(), 0
    while enqueued and (limits.max_depth is None or depth < limits.max_depth) and (limits.max_steps is None or enqueued < limits.max_steps):
        hop = _expandable(level, graph, direction, limits).select(F.col("id").alias("prev"), "path").join(links, F.col("prev") == links.id)
        reached = hop.select(F.col("nbr").alias("id"), F.concat("path", F.array("pos")).alias("path"), "prev")
        first = reached.groupBy("id").agg(F.min(F.struct("path", "prev")).alias("first"))
        fresh = first.join(seen.select("id"), "id", "left_anti").select("id", F.lit(depth + 1).alias("depth"), F.col("first.path").alias("path"), F.col("first.prev").alias("prev"))
        if hook:
            fresh = hook(fresh)
        if limits.max_steps is not None:
            fresh = fresh.orderBy("path").limit(limits.max_steps - enqueued)
        level = written(fresh, "bfs-level")
        found = level.count()
        if not found:
            break
        seen = seen.unionByName(level)
        enqueued += found
        depth += 1
    links.unpersist()
    return seen


def in_order(visits: DataFrame) -> DataFrame:
    """Number visits from 0 (step).  For walks that are bounded by steps, or output of moderate size:
    the numbering is global."""
    return visits.withColumn("step", F.row_number().over(Window.orderBy("depth", "path")) - 1)


def all_paths(graph: PropertyGraph, homes: Sequence[int], direction: GraphDir = GraphDir.OUT, limits: Limits = Limits()) -> DataFrame:
    """id, depth, path, prev of each visit, where all neighbours are enqueued at each visit.  A node's
    depth limit goes by the depth at which it was first seen.  Needs max_depth or max_steps."""
    if limits.max_depth is None and limits.max_steps is None:
        raise ValueError("an all-paths walk needs a limit")
    links = partitioned(graph.links(direction), "id")
    level = written(_homes(graph, homes), "paths-level")
    visits, total, hops = level, level.count(), 0
    first = level.select("id", F.col("depth").alias("first_depth"))
    while total and (limits.max_steps is None or total < limits.max_steps):
        grow = _expandable(level, graph, direction, limits).join(first, "id")
        if limits.max_depth is not None:
            grow = grow.where(F.col("first_depth") < limits.max_depth)
        hop = grow.select(F.col("id").alias("prev"), "path").join(links, F.col("prev") == links.id)
        nxt = hop.select(F.col("nbr").alias("id"), F.lit(hops + 1).alias("depth"), F.concat("path", F.array("pos")).alias("path"), "prev")
        if limits.max_steps is not None:
            nxt = nxt.orderBy("path").limit(limits.max_steps - total)
        level = written(nxt, "paths-level")
        found = level.count()
        if not found:
            break
        visits, total, hops = visits.unionByName(level), total + found, hops + 1
        new = level.select("id", F.col("depth").alias("first_depth")).distinct().join(first, "id", "left_anti")
        first = written(first.unionByName(new), "paths-first")
    links.unpersist()
    return visits


def bfs_walk(graph: PropertyGraph, start: int, direction: GraphDir = GraphDir.OUT, limits: Limits = Limits()) -> DataFrame:
    """step, id, depth in breadth-first order; nothing if the start is missing."""
    return in_order(breadth_first(graph, [start], direction, limits)).select("step", "id", "depth")


def walk_counts(graph: PropertyGraph, start: int, direction: GraphDir = GraphDir.OUT, limits: Limits = Limits(), every_path: bool = False) -> tuple[DataFrame, DataFrame]:
    """Visit counts (id, visits) and predecessor counts (id, prev, count) of a walk from ``start``: by
    default a breadth-first one, in which a node is visited once; with ``every_path`` an all-paths walk."""
    visits = all_paths(graph, [start], direction, limits) if every_path else breadth_first(graph, [start], direction, limits)
    counts = visits.groupBy("id").agg(F.count("*").alias("visits"))
    return counts, visits.where("prev is not null").groupBy("id", "prev").agg(F.count("*").alias("count"))


def depth_first(graph: PropertyGraph, homes: Sequence[int], direction: GraphDir = GraphDir.OUT, limits: Limits = Limits()) -> DataFrame:
    """step, id, depth (when first enqueued), distance (in the tree), discovery and finish (clock
    times: one tick when a node is first enqueued and one when it is done).

    The order is strictly sequential, so the neighbour lists that are reachable go to one task.
    """
    reach = breadth_first(graph, homes, direction, Limits(max_depth=limits.max_depth)).select("id")
    lists = graph.adjacency(direction).join(reach, "id", "left_semi").withColumn("all", F.lit(0))
    start = [int(h) for h in dict.fromkeys(homes)]

    def run(part: pd.DataFrame) -> pd.DataFrame:
        near = {int(i): [int(x) for x in v] for i, v in zip(part["id"], part["nbrs"])}
        tick = 0
        depth: dict[int, int] = {}
        found: dict[int, int] = {}
        done: dict[int, int] = {}
        stack: list[tuple[int, int, bool]] = []

        def enqueue(ids: list[int], at: int, distance: int) -> None:
            nonlocal tick
            for v in ids:
                if v not in found:
                    found[v], depth[v] = tick, at
                    tick += 1
            stack.extend((v, distance, False) for v in reversed(ids))

        enqueue([h for h in start if h in near], 0, 0)
        visited: list[tuple[int, int]] = []
        seen: set[int] = set()
        while stack:
            v, distance, closing = stack.pop()
            if closing:
                done[v] = tick
                tick += 1
                continue
            if v in seen:
                continue
            if limits.max_steps is not None and len(visited) >= limits.max_steps:
                break
            seen.add(v)
            visited.append((v, distance))
            stack.append((v, distance, True))
            deep = limits.max_depth is not None and depth[v] >= limits.max_depth
            wide = limits.max_edges is not None and len(near.get(v, [])) >= limits.max_edges
            if not deep and not wide:
                enqueue([x for x in dict.fromkeys(near.get(v, [])) if x not in seen], depth[v] + 1, distance + 1)
        rows = [(k, v, depth[v], d, found[v], done.get(v)) for k, (v, d) in enumerate(visited)]
        out = pd.DataFrame(rows, columns=["step", "id", "depth", "distance", "discovery", "finish"])
        return out.astype({"finish": "Int64"})

    return lists.groupBy("all").applyInPandas(run, "step bigint, id bigint, depth int, distance int, discovery bigint, finish bigint")

