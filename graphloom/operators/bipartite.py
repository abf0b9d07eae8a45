"""Bipartite graphs and iterative link analysis between their sides."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import GraphDir, PropertyGraph, StoredDir
from ..plans.storage import partitioned, written


@dataclass(frozen=True)
class BipartiteGraph:
    """``left``, ``right``: id.  ``lr``: src (left), dst (right), pos.  ``rl``: src (right), dst (left), pos.

    Where ids are not unique over both sides a left id is shown negated; id 0 cannot be told apart then
    and is an error.
    """

    left: DataFrame
    right: DataFrame
    lr: DataFrame | None
    rl: DataFrame | None
    unique_ids: bool = False

    @classmethod
    def from_dicts(cls, spark: SparkSession, left: Sequence[int], right: Sequence[int], lr: Mapping[int, Sequence[int]] | None, rl: Mapping[int, Sequence[int]] | None = None, unique_ids: bool = False) -> BipartiteGraph:
        def ids(x: Sequence[int]) -> DataFrame:
            return spark.createDataFrame([(int(i),) for i in x], "id bigint")

        def edges(x: Mapping[int, Sequence[int]] | None) -> DataFrame | None:
            if x is None:
                return None
            if not unique_ids and (0 in x or any(0 in v for v in x.values())):
                raise ValueError("id 0 cannot be negated")
            return spark.createDataFrame([(int(s), int(d), p) for s, v in x.items() for p, d in enumerate(v)], "src bigint, dst bigint, pos int")

        return cls(ids(left), ids(right), edges(lr), edges(rl), unique_ids)

    def _shown(self, column: str, side: str):
        return -F.col(column) if side == "left" and not self.unique_ids else F.col(column)

    def stores(self, side: str, direction: GraphDir) -> bool:
        """A left node's out-lists, and a right node's in-lists, are edges to the right; the other two
        are edges to the left."""
        to_right = (side == "left") == (direction is GraphDir.OUT)
        return (self.lr if to_right else self.rl) is not None

    def as_graph(self) -> PropertyGraph:
        """All nodes and edges with shown ids."""
        nodes = self.left.select(self._shown("id", "left").alias("id")).unionByName(self.right.select("id"))
        parts = []
        if self.lr is not None:
            parts.append(self.lr.select(self._shown("src", "left").alias("src"), "dst", "pos"))
        if self.rl is not None:
            parts.append(self.rl.select("src", self._shown("dst", "left").alias("dst"), "pos"))
        edges = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return PropertyGraph(nodes.distinct(), edges, StoredDir.BIPARTITE)

    def get_node(self, node_id: int) -> DataFrame:
        """side, id of the node that is shown by this id; none for 0 where ids are negated.  Where ids
        are unique the left side is looked at first."""
        if self.unique_ids:
            both = self.left.select(F.lit("left").alias("side"), "id").unionByName(self.right.select(F.lit("right").alias("side"), "id"))
            return both.where(F.col("id") == node_id).orderBy("side").limit(1)
        side, table = ("left", self.left) if node_id < 0 else ("right", self.right)
        return table.where((F.col("id") == abs(node_id)) & F.lit(node_id != 0)).select(F.lit(side).alias("side"), "id")

    def counts(self) -> DataFrame:
        """One row: left_nodes, right_nodes, lr_edges, rl_edges."""
        def n(t: DataFrame | None, name: str) -> DataFrame:
            return (t if t is not None else self.left.limit(0)).agg(F.count("*").alias(name))

        return n(self.left, "left_nodes").crossJoin(n(self.right, "right_nodes")).crossJoin(n(self.lr, "lr_edges")).crossJoin(n(self.rl, "rl_edges"))  # one row each


def analyze(edges: DataFrame, weights: DataFrame, iterations: int, reset_left: float, reset_right: float, top_contributors: int = 3) -> tuple[DataFrame, DataFrame]:
    """Weights that flow from left to right and back: two tables (id, weight, contributors), largest
    weight first (ties by id).

    ``edges``: left, right.  ``weights``: id, weight, the initial weights of left nodes.  In odd
    iterations a right node gets (1 - reset_right) times the sum of weight/degree over its left nodes; in
    even ones a left node gets reset_left times its initial weight plus (1 - reset_left) times the sum
    over its right nodes, whose degrees count left nodes of ``weights`` only.  Contributors (of the last
    flow into each side) go by the flow that they sent, then by id.
    """
    start = written(weights.select("id", F.col("weight").cast("double").alias("initial")), "initial")
    used = edges.select("left", "right").join(start.select(F.col("id").alias("left")), "left", "left_semi")
    l_deg = used.groupBy("left").agg(F.count("*").alias("dl"))
    r_deg = used.groupBy("right").agg(F.count("*").alias("dr"))
    flows = written(used.join(l_deg, "left").join(r_deg, "right"), "flows")
    by_left, by_right = partitioned(flows, "left"), partitioned(flows, "right")
    left = start.select("id", F.col("initial").alias("weight"))
    right = flows.select(F.col("right").alias("id")).distinct().withColumn("weight", F.lit(0.0))
    none = F.expr("cast(array() as array<bigint>)")
    left_by = start.select("id", none.alias("contributors"))
    right_by = right.select("id", none.alias("contributors"))

    def contributors(flow: DataFrame) -> DataFrame:
        rank = Window.partitionBy("to").orderBy(F.desc("part"), "src")
        few = flow.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= top_contributors)
        return few.groupBy(F.col("to").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "src"))), lambda x: x["src"]).alias("contributors"))

    for k in range(1, iterations + 1):
        last = k > iterations - 2
        if k % 2:
            flow = by_left.join(left.select(F.col("id").alias("left"), "weight"), "left").select(F.col("left").alias("src"), F.col("right").alias("to"), (F.col("weight") / F.col("dl")).alias("part"))
            got = flow.groupBy(F.col("to").alias("id")).agg(F.sum("part").alias("got"))
            right = written(right.select("id").join(got, "id", "left").select("id", (F.coalesce("got", F.lit(0.0)) * (1 - reset_right)).alias("weight")), "right")
            if last:
                right_by = written(contributors(flow), "right-contributors")
        else:
            flow = by_right.join(right.select(F.col("id").alias("right"), "weight"), "right").select(F.col("right").alias("src"), F.col("left").alias("to"), (F.col("weight") / F.col("dr")).alias("part"))
            got = flow.groupBy(F.col("to").alias("id")).agg(F.sum("part").alias("got"))
            value = F.lit(reset_left) * F.col("initial") + F.coalesce("got", F.lit(0.0)) * (1 - reset_left)
            left = written(start.join(got, "id", "left").select("id", value.alias("weight")), "left")
            if last:
                left_by = written(contributors(flow), "left-contributors")

    def result(side: DataFrame, by: DataFrame) -> DataFrame:
        return side.join(by, "id", "left").select("id", "weight", F.coalesce("contributors", none).alias("contributors")).orderBy(F.desc("weight"), "id")

    return result(left, left_by), result(right, right_by)
