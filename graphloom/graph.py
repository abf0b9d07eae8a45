"""The property graph: a vertex table, an edge table and labels.

``vertices``: id.  ``edges``: src, dst, pos, where ``pos`` is the place of an edge in the list that it
came in.  Duplicate edges and self-loops stay unless a reader removes them.  What a graph *stores*
(:class:`StoredDir`) decides which neighbour lists can be seen, as in adjacency-list systems that hold
one direction only.  ``edges_from`` is there where a graph can tell all edges out of given nodes without
deriving the others: of rows (id), without duplicates, those of ``edges`` with such a ``src``, or None where
there are too many for that.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class GraphDir(Enum):
    OUT = "out"
    IN = "in"

    @property
    def reverse(self) -> GraphDir:
        return GraphDir.IN if self is GraphDir.OUT else GraphDir.OUT


class StoredDir(Enum):
    BOTH_IN_OUT = "both"
    ONLY_OUT = "out"
    ONLY_IN = "in"
    MUTUAL = "mutual"
    BIPARTITE = "bipartite"

    def stores(self, direction: GraphDir) -> bool:
        if self is StoredDir.ONLY_OUT:
            return direction is GraphDir.OUT
        if self is StoredDir.ONLY_IN:
            return direction is GraphDir.IN
        return True

    @property
    def bidirectional(self) -> bool:
        return self not in (StoredDir.ONLY_OUT, StoredDir.ONLY_IN)


EDGES = "src bigint, dst bigint, pos int"
ADJACENCY = "id bigint, edges array<bigint>"


@dataclass(frozen=True)
class PropertyGraph:
    vertices: DataFrame
    edges: DataFrame
    stored: StoredDir = StoredDir.BOTH_IN_OUT
    labels: Mapping[tuple[str, str], DataFrame] = field(default_factory=dict)
    edges_from: Callable[[DataFrame], DataFrame | None] | None = None

    # Builders

    @classmethod
    def from_adjacency(cls, lists: DataFrame, stored: StoredDir = StoredDir.BOTH_IN_OUT, check: bool = True) -> PropertyGraph:
        """From rows (id, edges).  For ONLY_IN the lists are inbound ones.  Ids that occur only in lists
        become vertices.  An id that is given twice is an error (found by ``check``, which runs a job)."""
        lists = lists.select(F.col("id").cast("bigint").alias("id"), F.coalesce(F.col("edges").cast("array<bigint>"), F.expr("cast(array() as array<bigint>)")).alias("edges"))
        if check and not lists.groupBy("id").count().where("count > 1").isEmpty():
            raise ValueError("a node id is given twice")
        flat = lists.select("id", F.posexplode("edges").alias("pos", "other"))
        near, far = ("dst", "src") if stored is StoredDir.ONLY_IN else ("src", "dst")
        edges = flat.select(F.col("id").alias(near), F.col("other").alias(far), "pos").select("src", "dst", "pos")
        vertices = lists.select("id").unionByName(flat.select(F.col("other").alias("id"))).distinct()
        return cls(vertices, edges, stored)

    @classmethod
    def from_edges(cls, edges: DataFrame, stored: StoredDir = StoredDir.BOTH_IN_OUT, vertices: DataFrame | None = None, edges_from: Callable[[DataFrame], DataFrame | None] | None = None) -> PropertyGraph:
        """From rows (src, dst[, pos]); without ``pos`` a source's edges are in order of target.  ``edges_from``
        gives such rows too."""

        def placed(edges: DataFrame | None) -> DataFrame | None:
            if edges is None:
                return None
            src, dst = F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")
            if "pos" in edges.columns:
                return edges.select(src, dst, F.col("pos").cast("int").alias("pos"))
            return edges.select(src, dst).withColumn("pos", (F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1).cast("int"))

        edges = placed(edges)
        ids = edges.select(F.explode(F.array("src", "dst")).alias("id"))
        if vertices is not None:
            ids = ids.unionByName(vertices.select(F.col("id").cast("bigint").alias("id")))
        return cls(ids.distinct(), edges, stored, edges_from=edges_from and (lambda some: placed(edges_from(some))))

    @classmethod
    def from_dict(cls, spark: SparkSession, lists: Mapping[int, Sequence[int]], stored: StoredDir = StoredDir.BOTH_IN_OUT) -> PropertyGraph:
        """A small graph from Python (dicts cannot repeat an id, so nothing is checked)."""
        return cls.from_adjacency(spark.createDataFrame([(int(k), [int(x) for x in v]) for k, v in lists.items()], ADJACENCY), stored, check=False)

    def with_labels(self, labels: Mapping[tuple[str, str], DataFrame]) -> PropertyGraph:
        return replace(self, labels=labels)

    # Shape

    def stores(self, direction: GraphDir) -> bool:
        return self.stored.stores(direction)

    @property
    def bidirectional(self) -> bool:
        return self.stored.bidirectional

    def node_count(self) -> int:
        return self.vertices.count()

    def edge_count(self) -> int:
        """Directed edges."""
        return self.edges.count()

    def stored_edge_count(self) -> int:
        """List entries: edges are stored twice if both directions are."""
        return self.edge_count() * (2 if self.bidirectional else 1)

    def max_node_id(self) -> int:
        return self.vertices.agg(F.coalesce(F.max("id"), F.lit(0)).alias("m")).first().m

    def totals(self) -> DataFrame:
        """nodes, edges, stored_edges, max_id in one row."""
        n = self.vertices.agg(F.count("*").alias("nodes"), F.coalesce(F.max("id"), F.lit(0)).alias("max_id"))
        m = self.edges.agg(F.count("*").alias("edges"))
        twice = 2 if self.bidirectional else 1
        return n.crossJoin(m).select("nodes", "edges", (F.col("edges") * twice).alias("stored_edges"), "max_id")  # one row each

    def storage_estimate(self) -> int:
        """Bytes that an array-based store of this graph would take: 4 + 12 per id up to the largest, and 4 per list entry."""
        t = self.totals().first()
        return 4 + 12 * t.max_id + 4 * t.stored_edges

    # Neighbour lists

    def links(self, direction: GraphDir = GraphDir.OUT) -> DataFrame:
        """id, nbr, pos of the stored lists in a direction; none if it isn't stored.

        Out-lists are in order of ``pos``.  In-lists, where they derive from out-lists, are in order of
        source.  For MUTUAL both are the given list.
        """
        if not self.stores(direction):
            return self.edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr"), "pos").limit(0)
        if self.stored is StoredDir.ONLY_IN:
            return self.edges.select(F.col("dst").alias("id"), F.col("src").alias("nbr"), "pos")
        if direction is GraphDir.OUT or self.stored is StoredDir.MUTUAL:
            return self.edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr"), "pos")
        first = [F.abs("src")] if self.stored is StoredDir.BIPARTITE else []  # by ids before they are negated
        order = Window.partitionBy("dst").orderBy(*first, "src", "pos")
        return self.edges.select(F.col("dst").alias("id"), F.col("src").alias("nbr"), (F.row_number().over(order) - 1).cast("int").alias("pos"))

    def links_from(self, ids: DataFrame, direction: GraphDir = GraphDir.OUT) -> DataFrame | None:
        """:meth:`links` of the nodes ``ids`` (rows without duplicates, which may be broadcast), or None where they
        take as long as all."""
        if self.edges_from is None or direction is not GraphDir.OUT or self.stored is StoredDir.ONLY_IN:
            return None
        edges = self.edges_from(ids)
        return edges if edges is None else edges.select(F.col("src").alias("id"), F.col("dst").alias("nbr"), "pos")

    def adjacency(self, direction: GraphDir = GraphDir.OUT) -> DataFrame:
        """id, nbrs (array in order) of every vertex.  One row holds a vertex's list: for traversals and
        output, not for computing over hubs."""
        lists = self.links(direction).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nbr"))), lambda x: x["nbr"]).alias("nbrs"))
        empty = F.expr("cast(array() as array<bigint>)")
        return self.vertices.join(lists, "id", "left").select("id", F.coalesce("nbrs", empty).alias("nbrs"))

    def degrees(self, direction: GraphDir = GraphDir.OUT) -> DataFrame:
        """id, degree (with multiplicity) of every vertex."""
        n = self.links(direction).groupBy("id").agg(F.count("*").alias("degree"))
        return self.vertices.join(n, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("bigint").alias("degree"))

    def transposed(self) -> PropertyGraph:
        turned = self.edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "pos")
        return replace(self, edges=turned, edges_from=None)

    def get_node(self, node_id: int) -> DataFrame:
        """One row (id, out_nbrs, in_nbrs) if there is such a vertex, else none."""
        one = self.vertices.where(F.col("id") == node_id)
        out = one
        for name, d in (("out_nbrs", GraphDir.OUT), ("in_nbrs", GraphDir.IN)):
            lists = self.links(d).where(F.col("id") == node_id).groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "nbr"))), lambda x: x["nbr"]).alias(name))
            out = out.join(lists, "id", "left").withColumn(name, F.coalesce(name, F.expr("cast(array() as array<bigint>)")))
        return out

    def exists(self, node_id: int) -> bool:
        return not self.vertices.where(F.col("id") == node_id).isEmpty()

    def label_of(self, node_id: int, name: str, kind: str):
        """A label's value, or None if the label, the type or the value is missing."""
        table = self.labels.get((name, kind))
        row = table.where(F.col("id") == node_id).select("value").first() if table is not None else None
        return row.value if row else None

    def describe(self, first: int = 10) -> str:
        """The first vertices (by id) with up to ten neighbours of each stored direction."""
        lines = []
        for d in (GraphDir.OUT, GraphDir.IN):
            if self.stores(d):
                few = self.vertices.orderBy("id").limit(first)
                near = few.join(self.links(d).where("pos < 10"), "id", "left").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.when(F.col("nbr").isNotNull(), F.struct("pos", "nbr")))), lambda x: x["nbr"]).alias("nbrs"))
                lines += [f"{d.value} {r.id} -> {', '.join(map(str, r.nbrs))}" for r in near.orderBy("id").collect()]
        return "\n".join(lines)


def in_id_set(column: Column, ids: Sequence[int]) -> Column:
    return column.isin(*[int(i) for i in ids]) if len(ids) else F.lit(False)
