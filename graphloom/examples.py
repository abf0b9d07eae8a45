"""Small end-to-end programs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import counters
from .graph import PropertyGraph, StoredDir
from .operators import generate, partition, structure, walk
from .sources import numberers, readers, writers


def hello_graph(spark: SparkSession, n: int = 10) -> DataFrame:
    """The totals of a complete graph."""
    return generate.complete(spark, n).totals()


def load_and_label(spark: SparkSession, directory: str, prefix: str, label_prefix: str, node: int, name: str, kind: str):
    """A node's label, from adjacency lists and label files."""
    graph, _ = readers.read_adjacency(spark, directory, prefix)
    return graph.with_labels(readers.read_labels(spark, directory, label_prefix)).label_of(node, name, kind)


def load_edges(spark: SparkSession, directory: str, prefix: str = "", stored: StoredDir = StoredDir.ONLY_OUT) -> PropertyGraph:
    """A graph from an edge list whose separator is found out."""
    return readers.read_edges(spark, directory, prefix, readers.sniff_separator(spark, directory, prefix), stored=stored)[0]


def walk_demo(spark: SparkSession, nodes: int = 100, p: float = 0.1, steps: int = 10_000, seed: int = 1) -> DataFrame:
    """The ten most visited nodes of a walk on a random graph."""
    graph = generate.random_directed(spark, nodes, p, seed)
    visits, _ = walk.personalized_reputation(graph, 0, walk.WalkParams(steps, reset=0.1, top_paths=2))
    return visits.limit(10)


def mutual_share(spark: SparkSession, nodes: int, mean_degree: float, seed: int = 1) -> float:
    """The part of a random graph's edges that are mutual."""
    graph = generate.random_directed(spark, nodes, generate.edge_probability(nodes, mean_degree), seed)
    edges = graph.edge_count()
    return 2 * structure.mutual_edge_count(graph).first().mutual / edges if edges else 0.0


def renumbering_saving(graph: PropertyGraph) -> int:
    """Bytes that an array-based store saves if sparse ids are numbered from 0."""
    numbering = numberers.Numbering.sequential(graph.vertices.select(F.col("id").alias("ext")))
    dense = numbering.encode(numbering.encode(graph.edges.withColumnsRenamed({"src": "s", "dst": "d"}), "s", "src"), "d", "dst")
    return graph.storage_estimate() - PropertyGraph.from_edges(dense.select("src", "dst", "pos"), graph.stored, numbering.table).storage_estimate()


def write_random(spark: SparkSession, path: str, nodes: int, mean_degree: float, chunks: int, seed: int = 1) -> None:
    """A random graph as edge-list files."""
    writers.write_graph(generate.random_directed(spark, nodes, generate.edge_probability(nodes, mean_degree), seed), path, False, chunks)


def cross_partition(spark: SparkSession, directory: str, prefix: str, path: str, instances: int) -> None:
    """Adjacency lists, dealt out by source and target."""
    graph, _ = readers.read_adjacency(spark, directory, prefix, stored=StoredDir.ONLY_OUT)
    partition.split(graph, lambda g: partition.hash_source_and_dest(g, instances), path)


def top_visited(visits: DataFrame, k: int = 10) -> DataFrame:
    return counters.top_k(visits.withColumnRenamed("visits", "score"), k)
