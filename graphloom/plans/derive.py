"""Graphs from relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..graph import PropertyGraph, StoredDir
from .storage import drop_written, written

#: Groups (8 bytes each) that are broadcast, at most.
BROADCAST_GROUPS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _consecutive(rows: DataFrame, by: list[str], order: list[str], key: str, ids: DataFrame | None = None) -> DataFrame | None:
    """src, dst: keys of rows that follow each other.  With ``ids``: those whose src is one of them, from the
    groups that hold one, whole, or None where these are many.  Groups go by a hash, so null ones are kept; one
    that collides adds no edge."""
    if ids is not None:
        group, ids = F.xxhash64(*by), F.broadcast(ids.select(F.col("id").alias("src")))
        held = rows.select(F.col(key).cast("bigint").alias("src"), group.alias("group")).join(ids, "src", "left_semi")
        held = written(held.select("group").distinct(), "groups")
        if held.count() > BROADCAST_GROUPS:
            drop_written(held)
            return None
        rows = rows.join(F.broadcast(held), group == held["group"], "left_semi")
    nxt = F.lead(key).over(Window.partitionBy(*by).orderBy(*order))
    pairs = rows.select(F.col(key).cast("bigint").alias("src"), nxt.cast("bigint").alias("dst"))
    pairs = pairs.where("dst is not null and src <> dst")
    if ids is not None:
        pairs = pairs.join(ids, "src", "left_semi")
    return pairs.distinct()


_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey"]


def part_edges(spark: SparkSession, sf_dir: str, ids: DataFrame | None = None) -> DataFrame | None:
    """src, dst: parts on consecutive lines of an order; with ``ids`` those out of these parts, or None where
    their orders are many."""
    return _consecutive(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _LINE_ORDER, "l_partkey", ids)


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: suppliers on consecutive lines of an order."""
    return _consecutive(table(spark, sf_dir, "lineitem"), ["l_orderkey"], _LINE_ORDER, "l_suppkey")


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst: users of consecutive events of a kind on a day."""
    events = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return _consecutive(events, ["event_type", "day"], ["ts", "event_id"], "user_id")


def part_graph(spark: SparkSession, sf_dir: str, stored: StoredDir = StoredDir.BOTH_IN_OUT) -> PropertyGraph:
    return PropertyGraph.from_edges(part_edges(spark, sf_dir), stored, edges_from=lambda ids: part_edges(spark, sf_dir, ids))


def supplier_graph(spark: SparkSession, sf_dir: str, stored: StoredDir = StoredDir.BOTH_IN_OUT) -> PropertyGraph:
    return PropertyGraph.from_edges(supplier_edges(spark, sf_dir), stored)


def user_graph(spark: SparkSession, sf_dir: str, stored: StoredDir = StoredDir.BOTH_IN_OUT) -> PropertyGraph:
    return PropertyGraph.from_edges(user_edges(spark, sf_dir), stored)


def supplier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """left (supplier), right (part): who has sold what."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("left"), F.col("l_partkey").alias("right")).distinct()


#: The same edge tables as SQL, for oracles.
EDGES_SQL = {
    "part": """SELECT DISTINCT src, dst FROM (SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst""",
    "supplier": """SELECT DISTINCT src, dst FROM (SELECT l_suppkey AS src, lead(l_suppkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS dst FROM lineitem) WHERE dst IS NOT NULL AND src <> dst""",
    "user": """SELECT DISTINCT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY event_type, CAST(ts AS DATE) ORDER BY ts, event_id) AS dst FROM events) WHERE dst IS NOT NULL AND src <> dst""",
}
