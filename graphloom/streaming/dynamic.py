"""Dynamic graphs: logs of changes, folded in batch or kept as streaming state.

A log has rows (seq, op, src, dst).  Ops: ``node`` (src is a node), ``add`` (no effect if the edge is
there), ``add_dup`` (a parallel edge) and ``remove`` (the first of parallel edges, if any; nodes stay).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from ..graph import PropertyGraph, StoredDir

LOG = "seq bigint, op string, src bigint, dst bigint"


def _expanded(log: DataFrame, stored: StoredDir) -> DataFrame:
    """For mutual graphs each change is made in both directions."""
    if stored is not StoredDir.MUTUAL:
        return log
    back = log.where("op <> 'node'").select("seq", "op", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return log.unionByName(back.where("src <> dst"))


def fold(log: DataFrame, stored: StoredDir = StoredDir.BOTH_IN_OUT, initial: PropertyGraph | None = None) -> PropertyGraph:
    """The graph after all changes, in order of seq.  The changes of one edge are folded in order, by an
    array function; edges are folded in parallel."""
    if initial is not None:
        old = initial.edges.select(F.lit(-1).cast("bigint").alias("seq"), F.lit("add_dup").alias("op"), "src", "dst")
        nodes = initial.vertices.select(F.lit(-1).cast("bigint").alias("seq"), F.lit("node").alias("op"), F.col("id").alias("src"), F.lit(None).cast("bigint").alias("dst"))
        log = log.select("seq", "op", "src", "dst").unionByName(old).unionByName(nodes)
    log = _expanded(log, stored)
    vertices = log.where("op <> 'remove'").select(F.explode(F.array("src", "dst")).alias("id")).where("id is not null").distinct()
    copies = _copies(log)
    pos = (F.row_number().over(Window.partitionBy("src").orderBy("since", "dst", "copy")) - 1).cast("int")
    edges = copies.where("copies > 0").select("src", "dst", "since", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return PropertyGraph(vertices, edges.withColumn("pos", pos).select("src", "dst", "pos"), stored)


def _copies(log: DataFrame) -> DataFrame:
    """src, dst, copies, since (the seq from which the edge has been there without a break)."""
    changes = log.where("op <> 'node'")
    plain = changes.groupBy("src", "dst").agg(F.array_sort(F.collect_list(F.struct("seq", "op"))).alias("log"))
    none = F.struct(F.lit(0).alias("copies"), F.lit(None).cast("bigint").alias("since"))

    def step(at, x):
        here, op = at["copies"], x["op"]
        more = F.when((op == "add") & (here > 0), here).when(op.isin("add", "add_dup"), here + 1).otherwise(F.greatest(here - 1, F.lit(0)))
        since = F.when(more == 0, F.lit(None).cast("bigint")).when(here == 0, x["seq"]).otherwise(at["since"])
        return F.struct(more.alias("copies"), since.alias("since"))

    return plain.select("src", "dst", F.aggregate("log", none, step).alias("s")).select("src", "dst", "s.copies", "s.since")


def last_state(log: DataFrame) -> DataFrame:
    """src, dst of a log of ``add`` and ``remove`` only: the edges whose last change added them.  One
    aggregation with partial results; a hot edge costs no memory."""
    last = log.where("op in ('add', 'remove')").groupBy("src", "dst").agg(F.max_by("op", "seq").alias("op"))
    return last.where("op = 'add'").select("src", "dst")


def edge_counts(log: DataFrame, stored: StoredDir = StoredDir.BOTH_IN_OUT) -> DataFrame:
    """One row (nodes, edges) of the folded graph."""
    g = fold(log, stored)
    return g.vertices.agg(F.count("*").alias("nodes")).crossJoin(g.edges.agg(F.count("*").alias("edges")))  # one row each


def stream(log: DataFrame) -> DataFrame:
    """A streaming log as a stream of (src, dst, copies) whenever an edge's number of copies changes.

    State is kept for each edge, not for each node, so hubs are spread.  Within a trigger changes are
    applied in order of seq.  Output mode: update.
    """

    def update(key: tuple[int, int], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (copies,) = state.get if state.exists else (0,)
        before = copies
        for op in pd.concat(list(parts)).sort_values("seq")["op"]:
            if op == "add_dup" or (op == "add" and not copies):
                copies += 1
            elif op == "remove" and copies:
                copies -= 1
        state.update((copies,))
        if copies != before:
            yield pd.DataFrame({"src": [key[0]], "dst": [key[1]], "copies": [copies]})

    changes = log.where("op <> 'node'")
    return changes.groupBy("src", "dst").applyInPandasWithState(update, "src bigint, dst bigint, copies bigint", "copies bigint", "update", GroupStateTimeout.NoTimeout)


def append_only(log: DataFrame) -> DataFrame:
    """A log without removals as a stream of edges: each change is an edge, no state is kept."""
    return log.where("op in ('add', 'add_dup')").select("src", "dst")
