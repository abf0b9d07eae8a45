"""Complete and random graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..graph import PropertyGraph, StoredDir


def complete(spark: SparkSession, n: int, stored: StoredDir = StoredDir.BOTH_IN_OUT) -> PropertyGraph:
    """An edge from each of n nodes to each other one."""
    nodes = spark.range(n).select("id")
    edges = nodes.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))).alias("dst")).where("src <> dst")
    pos = F.when(F.col("dst") < F.col("src"), F.col("dst")).otherwise(F.col("dst") - 1).cast("int")
    return PropertyGraph(nodes, edges.withColumn("pos", pos), stored)


def edge_probability(n: int, mean_out_degree: float) -> float:
    """For a random graph of this mean degree."""
    if n <= 1:
        raise ValueError("a random graph needs two nodes")
    return mean_out_degree / (n - 1)


def random_directed(spark: SparkSession, n: int, p: float, seed: int = 1, stored: StoredDir = StoredDir.BOTH_IN_OUT) -> PropertyGraph:
    """Each ordered pair is an edge with probability p: each node draws its number of targets, then the
    targets.  A node's draws depend on the seed and its id alone."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            src, dst, pos = [], [], []
            for v in part["id"].tolist():
                rng = np.random.default_rng([seed, v])
                to = rng.choice(n - 1, size=rng.binomial(n - 1, p), replace=False) if n > 1 else np.zeros(0, np.int64)
                dst.append(to + (to >= v))
                src.append(np.full(len(to), v))
                pos.append(np.arange(len(to)))
            yield pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "pos": np.concatenate(pos).astype(np.int32)}) if src else pd.DataFrame({"src": [], "dst": [], "pos": []}).astype({"src": "int64", "dst": "int64", "pos": "int32"})

    nodes = spark.range(n).select("id")
    return PropertyGraph(nodes, nodes.mapInPandas(run, "src bigint, dst bigint, pos int"), stored)


def random_undirected(spark: SparkSession, n: int, p: float, seed: int = 1, stored: StoredDir = StoredDir.BOTH_IN_OUT) -> PropertyGraph:
    """Each unordered pair is a pair of edges, one each way, with probability p."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            a, b = [], []
            for v in part["id"].tolist():
                rng = np.random.default_rng([seed, v])
                to = v + 1 + rng.choice(n - 1 - v, size=rng.binomial(n - 1 - v, p), replace=False) if v < n - 1 else np.zeros(0, np.int64)
                a.append(np.full(len(to), v))
                b.append(to)
            if a:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)})

    nodes = spark.range(n).select("id")
    half = nodes.mapInPandas(run, "a bigint, b bigint")
    both = half.select(F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))).alias("e")).select("e.*")
    return PropertyGraph.from_edges(both, stored, nodes)


def binomial(n: int, p: float, size: int, seed: int = 1) -> np.ndarray:
    """Draws of a binomial distribution (0 or n where p is 0 or 1)."""
    return np.random.default_rng(seed).binomial(n, p, size)
