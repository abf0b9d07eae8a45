"""Mutual edges, wedges and triangles."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..graph import GraphDir, PropertyGraph


def mutual_edge_count(graph: PropertyGraph) -> DataFrame:
    """One row (mutual): unordered pairs with edges both ways; loops and repeats don't count."""
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    pairs = graph.edges.where("src <> dst").groupBy(lo.alias("lo"), hi.alias("hi"))
    ways = pairs.agg((F.max((F.col("src") < F.col("dst")).cast("int")) + F.max((F.col("src") > F.col("dst")).cast("int"))).alias("ways"))
    return ways.agg(F.count_if(F.col("ways") == 2).alias("mutual"))


def mutual_neighbors(graph: PropertyGraph) -> DataFrame:
    """id, mutual of every node: entries of its longer list that are in its shorter one."""
    out, inn = graph.links(GraphDir.OUT), graph.links(GraphDir.IN)
    a = out.groupBy("id", "nbr").agg(F.count("*").alias("x"))
    b = inn.groupBy("id", "nbr").agg(F.count("*").alias("y"))
    both = a.join(b, ["id", "nbr"]).groupBy("id").agg(F.sum("x").alias("x"), F.sum("y").alias("y"))
    sizes = graph.degrees(GraphDir.OUT).withColumnRenamed("degree", "o").join(graph.degrees(GraphDir.IN).withColumnRenamed("degree", "i"), "id")
    longer = F.when(F.col("o") >= F.col("i"), F.col("x")).otherwise(F.col("y"))
    return sizes.join(both, "id", "left").select("id", F.coalesce(longer, F.lit(0)).cast("bigint").alias("mutual"))


def _undirected(graph: PropertyGraph) -> DataFrame:
    return graph.edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def wedge_count(graph: PropertyGraph) -> DataFrame:
    """One row (wedges): paths of two undirected edges."""
    ends = _undirected(graph).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    return ends.agg(F.coalesce(F.sum(F.expr("d * (d - 1) div 2")), F.lit(0)).cast("bigint").alias("wedges"))


def triangles(graph: PropertyGraph) -> DataFrame:
    """a, b, c of each triangle.  Edges point from the node of smaller degree (ties by id), so no node
    has more than sqrt(2 m) out-edges and hubs make no blow-up of wedges."""
    e = _undirected(graph)
    d = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    both = e.join(d.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(d.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    swap = (F.col("da") > F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") > F.col("b")))
    # The target's degree goes along, so that of two out-edges the order of their targets is known.
    up = both.select(F.when(swap, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("v"), F.when(swap, F.col("da")).otherwise(F.col("db")).alias("dv"))
    first = up.select("u", F.col("v").alias("v"), "dv")
    second = up.select("u", F.col("v").alias("w"), F.col("dv").alias("dw"))
    wedge = first.join(second, "u").where((F.col("dv") < F.col("dw")) | ((F.col("dv") == F.col("dw")) & (F.col("v") < F.col("w"))))
    closed = wedge.join(up.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"])
    three = F.array_sort(F.array("u", "v", "w"))
    return closed.select(three[0].alias("a"), three[1].alias("b"), three[2].alias("c"))


def triangle_stats(graph: PropertyGraph) -> DataFrame:
    """One row: triangles, wedges and transitivity (3 triangles / wedges; 0 without wedges)."""
    t = triangles(graph).agg(F.count("*").alias("triangles"))
    both = t.crossJoin(wedge_count(graph))  # one row each
    ratio = F.when(F.col("wedges") > 0, 3.0 * F.col("triangles") / F.col("wedges")).otherwise(F.lit(0.0))
    return both.select("triangles", "wedges", ratio.alias("transitivity"))


def triangle_estimate(graph: PropertyGraph, edge_slots: int, wedge_slots: int, seed: int = 1, estimators: int = 8) -> DataFrame:
    """One row (transitivity, triangles): the mean of independent streaming estimates.

    Each estimator sees all undirected edges in one pass in an order of its own, with a reservoir of
    edges (slots are replaced with probability 1/t) and one of wedges among them.  Estimators run in
    parallel; each holds its two reservoirs only.
    """
    spark = graph.edges.sparkSession
    e = _undirected(graph)
    stream = e.join(F.broadcast(spark.range(estimators).withColumnRenamed("id", "who")), how="cross")  # a few rows
    stream = stream.repartition(estimators, "who").sortWithinPartitions("who", F.xxhash64(F.lit(seed), "who", "a", "b"))

    def run(parts):
        state: dict[int, _Reservoirs] = {}
        for part in parts:
            for who, rows in part.groupby("who", sort=False):
                r = state.setdefault(int(who), _Reservoirs(edge_slots, wedge_slots, seed * 1009 + int(who)))
                for a, b in zip(rows["a"].tolist(), rows["b"].tolist()):
                    r.add(a, b)
        if state:
            yield pd.DataFrame([r.estimate() for r in state.values()], columns=["transitivity", "triangles"])

    each = stream.mapInPandas(run, "transitivity double, triangles double")
    return each.agg(F.coalesce(F.avg("transitivity"), F.lit(0.0)).alias("transitivity"), F.coalesce(F.avg("triangles"), F.lit(0.0)).alias("triangles"))


class _Reservoirs:
    def __init__(self, edges: int, wedges: int, seed: int):
        self.rng = np.random.default_rng(seed)
        self.slots: list[tuple[int, int] | None] = [None] * edges
        self.wedges = np.full((wedges, 3), -1, np.int64)  # middle, ends
        self.closed = np.zeros(wedges, bool)
        self.seen, self.total = 0, 0

    def add(self, a: int, b: int) -> None:
        self.seen += 1
        ends = self.wedges[:, 1:]
        self.closed |= (ends[:, 0] == min(a, b)) & (ends[:, 1] == max(a, b))
        hit = np.flatnonzero(self.rng.random(len(self.slots)) < 1 / self.seen)
        if not len(hit):
            return
        for k in hit:
            self.slots[k] = (a, b)
        # Slots, not different edges, are counted: that keeps the estimate of wedges unbiased.
        held = Counter(e for e in self.slots if e)
        degree: Counter[int] = Counter()
        for (x, y), n in held.items():
            degree[x] += n
            degree[y] += n
        self.total = sum(d * (d - 1) // 2 for d in degree.values()) - sum(n * (n - 1) for n in held.values())
        new: list[tuple[int, int, int]] = []
        weight: list[int] = []
        for middle, end in ((a, b), (b, a)):
            for (x, y), n in held.items():
                if middle in (x, y) and (x, y) != (a, b):
                    u = y if x == middle else x
                    new.append((middle, min(u, end), max(u, end)))
                    weight.append(n * len(hit))
        if not new or self.total <= 0:
            return
        share = np.array(weight) / sum(weight)
        for k in np.flatnonzero(self.rng.random(len(self.wedges)) < sum(weight) / self.total):
            self.wedges[k] = new[int(self.rng.choice(len(new), p=share))]
            self.closed[k] = False

    def estimate(self) -> tuple[float, float]:
        share = float(self.closed.mean()) if len(self.closed) else 0.0
        s = len(self.slots)
        scale = self.seen**2 / (s * (s - 1)) if s > 1 else 0.0
        return min(1.0, 3 * share), share * scale * self.total
