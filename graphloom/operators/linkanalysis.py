"""PageRank and HITS.

Both have two physical forms with the same result.  On graphs counted to have few edges, all iterations
run in one task over sorted arrays: there, the cost of starting jobs is what counts.  Otherwise each
iteration is a join of ranks with edges and a sum by target; edges are kept in hash partitions of the
join key, so only ranks and messages are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import PropertyGraph
from ..plans.iterate import Iteration, State
from ..plans.storage import partitioned, written

#: Edges of a graph that is iterated in one task, at most (16 bytes each, a few times over).
KERNEL_EDGES = 4_000_000


@dataclass(frozen=True)
class Ranked:
    """``table``: id and the scores.  ``error`` and ``iteration`` of the last round."""

    table: DataFrame
    error: float
    iteration: int


def _small(graph: PropertyGraph, most: int) -> tuple[DataFrame, DataFrame, bool]:
    edges = written(graph.edges.select("src", "dst"), "edges")
    return graph.vertices, edges, edges.count() <= most


def _kernel_input(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Vertices (as edges without a source) and edges, in one partition."""
    return vertices.select(F.lit(None).cast("bigint").alias("src"), F.col("id").alias("dst")).unionByName(edges).coalesce(1)


def _arrays(parts: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted ids, and sources and targets as places among them."""
    ids, src, dst = [], [], []
    for part in parts:
        alone = part["src"].isna().to_numpy()
        ids.append(part["dst"].to_numpy()[alone])
        src.append(part["src"].to_numpy()[~alone].astype(np.int64))
        dst.append(part["dst"].to_numpy()[~alone])
    if not ids:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty
    order = np.unique(np.concatenate(ids).astype(np.int64))
    s, d = np.concatenate(src), np.concatenate(dst).astype(np.int64)
    # The same order of sums whatever the order of rows.
    s, d = np.searchsorted(order, s), np.searchsorted(order, d)
    by = np.lexsort((s, d))
    return order, s[by], d[by]


class _PageRank(Iteration):
    def __init__(self, vertices: DataFrame, edges: DataFrame, damping: float, max_iterations: int | None, tolerance: float):
        super().__init__(max_iterations, tolerance)
        self.damping = damping
        degrees = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        self.nodes = written(vertices.join(degrees, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree")), "nodes")
        self.edges = edges
        self.n = self.nodes.count()
        self.dangling = 0.0

    def initial(self) -> DataFrame:
        first = self.nodes.select("id", "degree", F.lit(1.0 / self.n if self.n else 0.0).alias("rank"), F.lit(0.0).alias("before"))
        return first

    def run(self, init: DataFrame | None = None) -> State:
        if init is not None:
            init = self.nodes.join(init.select("id", "rank"), "id", "left").select("id", "degree", F.coalesce("rank", F.lit(0.0)).alias("rank"), F.lit(0.0).alias("before"))
        start = init if init is not None else self.initial()
        self.dangling = start.where("degree = 0").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("d")).first().d
        return super().run(init)

    def step(self, table: DataFrame) -> DataFrame:
        sent = table.where("degree > 0").select(F.col("id").alias("src"), (F.col("rank") / F.col("degree")).alias("part"))
        got = self.edges.join(sent, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("part").alias("got"))
        base = (1 - self.damping) / self.n + self.damping * self.dangling / self.n
        rank = F.lit(base) + F.lit(self.damping) * F.coalesce("got", F.lit(0.0))
        return table.join(got, "id", "left").select("id", "degree", rank.alias("rank"), F.col("rank").alias("before"))

    def error(self, table: DataFrame) -> float:
        moved = F.coalesce(F.sum(F.abs(F.col("rank") - F.col("before"))), F.lit(0.0)).alias("error")
        loose = F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("rank"))), F.lit(0.0)).alias("dangling")
        row = table.agg(moved, loose).first()
        self.dangling = row.dangling
        return row.error


def _pagerank_kernel(damping: float, most: int | None, tolerance: float):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, src, dst = _arrays(parts)
        n = len(ids)
        if not n:
            return
        degree = np.bincount(src, minlength=n)
        rank, error, rounds = np.full(n, 1.0 / n), 100.0 + tolerance, 0
        share = np.divide(1.0, degree, out=np.zeros(n), where=degree > 0)
        while (most is None or rounds < most) and error > tolerance:
            new = (1 - damping) / n + damping * rank[degree == 0].sum() / n + damping * np.bincount(dst, (rank * share)[src], n)
            error, rank, rounds = float(np.abs(new - rank).sum()), new, rounds + 1
        yield pd.DataFrame({"id": ids, "rank": rank, "error": error, "iteration": rounds})

    return run


def pagerank(graph: PropertyGraph, damping: float = 0.85, max_iterations: int | None = 10, tolerance: float = 1e-8, init: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES) -> Ranked:
    """Ranks (id, rank): (1-d)/n + d * (dangling mass)/n + d * sum of rank(u)/degree(u) over edges u to v,
    from 1/n (or ``init``: id, rank), until the L1 change is at most ``tolerance``.  Multiple edges count."""
    vertices, edges, small = _small(graph, kernel_edges)
    if small and init is None:
        out = written(_kernel_input(vertices, edges).mapInPandas(_pagerank_kernel(damping, max_iterations, tolerance), "id bigint, rank double, error double, iteration int"), "ranks")
        row = out.select("error", "iteration").first()
        return Ranked(out.select("id", "rank"), row.error if row else 0.0, row.iteration if row else 0)
    by_source = partitioned(edges, "src")
    state = _PageRank(vertices, by_source, damping, max_iterations, tolerance).run(init)
    by_source.unpersist()
    return Ranked(state.table.select("id", "rank"), state.error, state.iteration)


class _Hits(Iteration):
    def __init__(self, vertices: DataFrame, by_source: DataFrame, by_target: DataFrame, max_iterations: int | None, tolerance: float, normalize: bool):
        super().__init__(max_iterations, tolerance)
        self.vertices, self.normalize = written(vertices, "nodes"), normalize
        self.by_source, self.by_target = by_source, by_target
        self.n = self.vertices.count()

    def initial(self) -> DataFrame:
        return self.vertices.select("id", F.lit(1.0 / self.n if self.n else 0.0).alias("hub"), F.lit(0.0).alias("authority"), F.lit(0.0).alias("before"))

    def step(self, table: DataFrame) -> DataFrame:
        hubs = table.select(F.col("id").alias("src"), "hub")
        auth = written(self.by_source.join(hubs, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("a")), "authorities")
        hub = self.by_target.join(auth.select(F.col("id").alias("dst"), "a"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("a").alias("h"))
        raw = written(table.select("id", F.col("hub").alias("before")).join(auth, "id", "left").join(hub, "id", "left"), "scores")
        top = raw.agg(F.max("a").alias("a"), F.max("h").alias("h")).first()

        def over(c: str, most: float | None):
            value = F.coalesce(c, F.lit(0.0))
            return value / most if most and most > 0 else value

        return raw.select("id", over("h", top.h).alias("hub"), over("a", top.a).alias("authority"), "before")

    def error(self, table: DataFrame) -> float:
        return table.agg(F.coalesce(F.sum(F.abs(F.col("hub") - F.col("before"))), F.lit(0.0)).alias("e")).first().e

    def finish(self, state: State) -> State:
        if not self.normalize:
            return state
        total = state.table.agg(F.sum("hub").alias("h"), F.sum("authority").alias("a")).first()
        scaled = [(F.col(c) / v if v and v > 0 else F.col(c)).alias(c) for c, v in (("hub", total.h), ("authority", total.a))]
        return State(state.table.select("id", *scaled), state.error, state.iteration)


def _hits_kernel(most: int | None, tolerance: float, normalize: bool):
    def over(x: np.ndarray, by: float) -> np.ndarray:
        return x / by if by > 0 else x

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, src, dst = _arrays(parts)
        n = len(ids)
        if not n:
            return
        hub, auth, error, rounds = np.full(n, 1.0 / n), np.zeros(n), 100.0 + tolerance, 0
        while (most is None or rounds < most) and error > tolerance:
            auth = np.bincount(dst, hub[src], n)
            new = np.bincount(src, auth[dst], n)
            new, auth = over(new, new.max()), over(auth, auth.max())
            error, hub, rounds = float(np.abs(new - hub).sum()), new, rounds + 1
        if normalize:
            hub, auth = over(hub, hub.sum()), over(auth, auth.sum())
        yield pd.DataFrame({"id": ids, "hub": hub, "authority": auth, "error": error, "iteration": rounds})

    return run


def hits(graph: PropertyGraph, max_iterations: int | None = 100, tolerance: float = 1e-8, normalize: bool = True, init: DataFrame | None = None, kernel_edges: int = KERNEL_EDGES) -> Ranked:
    """Hubs and authorities (id, hub, authority): authority is the sum of hubs that link here, hub the sum of
    the new authorities linked to; both are divided by their maximum in each round, and by their sum at
    the end if ``normalize``.  The error is the L1 change of hubs."""
    vertices, edges, small = _small(graph, kernel_edges)
    if small and init is None:
        out = written(_kernel_input(vertices, edges).mapInPandas(_hits_kernel(max_iterations, tolerance, normalize), "id bigint, hub double, authority double, error double, iteration int"), "hits")
        row = out.select("error", "iteration").first()
        return Ranked(out.select("id", "hub", "authority"), row.error if row else 0.0, row.iteration if row else 0)
    run = _Hits(vertices, partitioned(edges, "src"), partitioned(edges, "dst"), max_iterations, tolerance, normalize)
    if init is not None:
        init = run.vertices.join(init, "id", "left").select("id", F.coalesce("hub", F.lit(0.0)).alias("hub"), F.coalesce("authority", F.lit(0.0)).alias("authority"), F.lit(0.0).alias("before"))
    state = run.run(init)
    run.by_source.unpersist()
    run.by_target.unpersist()
    return Ranked(state.table.select("id", "hub", "authority"), state.error, state.iteration)
