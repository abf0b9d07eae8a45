"""Random walks from home nodes, and personalised reputation.

Walkers are independent rows, and a task walks its walkers by neighbour lists that are broadcast: all lists
of a graph that is counted to be small, else those near the homes and near the walkers.  Where a walker
needs a list that is not there, it waits for an answer: its next node, found by a join on (node, place in
its list), so no list has to fit anywhere.  Where paths are short and the graph tells the lists of given
nodes by themselves, those that paths can reach are all that is derived, if they can be broadcast.  Draws
depend on the seed, the walker and the step alone, so a walk is the same whatever is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import counters
from ..graph import GraphDir, PropertyGraph
from ..plans.storage import drop_written, partitioned, scratch, written

#: Links (16 bytes each) that are broadcast at a time, at most.
BROADCAST_LINKS = 2_000_000

#: Levels of neighbours whose lists are gathered at a time, at most.
HOPS = 6


@dataclass(frozen=True)
class WalkParams:
    """``max_edges``: go home from a node with more neighbours (a home is exempt unless
    ``filter_home``).  ``max_depth``: nodes on a path, the home included."""

    steps: int
    reset: float
    max_edges: int | None = None
    top_paths: int | None = None
    max_depth: int | None = None
    only_once: bool = False
    direction: GraphDir = GraphDir.OUT
    seed: int = 268_430_371_266_199
    filter_home: bool = False
    walkers: int = 64

    def __post_init__(self) -> None:
        if not 0 <= self.reset <= 1:
            raise ValueError("the reset probability is a probability")


def random_walk(graph: PropertyGraph, homes: Sequence[int], params: WalkParams, broadcast_links: int = BROADCAST_LINKS) -> DataFrame:
    """walk, step, id of all visits: ``params.steps`` of them, dealt out to at most
    ``params.walkers`` walkers that each start at home.  Nothing if a home is missing or none is given."""
    spark = graph.edges.sparkSession
    homes = [int(h) for h in homes]
    if not homes:
        return spark.createDataFrame([], _VISIT)
    links = _reachable(graph, homes, params, broadcast_links)
    if links is None:
        links = written(graph.links(params.direction), "walk-links")
    if not _known(graph, links, set(homes)):
        return spark.createDataFrame([], _VISIT)
    n = max(1, min(params.walkers, params.steps))
    share = [params.steps // n + (i < params.steps % n) for i in range(n)]
    rows = [(i, 0, s) for i, s in enumerate(share)]
    walkers = spark.createDataFrame(rows, "walk int, step bigint, steps bigint")
    walkers = walkers.selectExpr("*", *(f"cast(null as {t}) as {c}" for c, t in _STATE.items() if c not in walkers.columns))
    if links.count() <= broadcast_links:
        return _walked(walkers, [_lists(links)], homes, params, True).select("walk", "step", "id")
    return _walk_in_rounds(links, walkers, homes, params, broadcast_links)


_VISIT = "walk int, step bigint, id bigint"

#: A walker before its step ``step``: the node that it is at, the nodes on its path, those seen since it began
#: anew, and the draw, the degree and the neighbour of an answer to a step that had to wait.
_STATE = {"walk": "int", "step": "bigint", "steps": "bigint", "id": "bigint", "length": "int", "seen": "array<bigint>", "pick": "double", "degree": "bigint", "nbr": "bigint"}

_Lists = tuple[np.ndarray, np.ndarray, np.ndarray]


def _reachable(graph: PropertyGraph, homes: list[int], p: WalkParams, most: int) -> DataFrame | None:
    """The lists of all nodes that a path can go on from, level by level; None where they are more than
    ``most`` links and nodes, paths may be long, or the graph would derive all lists for each level."""
    if p.max_depth is None or not 1 < p.max_depth <= HOPS + 1:
        return None
    ids, held, lists = graph.edges.sparkSession.createDataFrame([(h,) for h in set(homes)], "id bigint"), [], []
    for _ in range(p.max_depth - 1):
        if lists:
            ids = lists[-1].select(F.col("nbr").alias("id")).distinct()
            for table in held:
                ids = ids.join(table, "id", "left_anti")
            ids = written(ids, "walk-near")
        held.append(ids)
        nodes = ids.count()
        if lists and not nodes:
            break
        found = graph.links_from(ids, p.direction) if nodes <= most else None
        if found is not None:
            lists.append(written(found, "walk-near"))
            most -= nodes + lists[-1].count()
        if found is None or most < 0:
            drop_written(*lists, *held)
            return None
    return reduce(DataFrame.unionByName, lists)


def _known(graph: PropertyGraph, links: DataFrame, homes: set[int]) -> bool:
    """Are all homes vertices?  Those with links are; the vertex table is read for others only."""
    missing = homes - {r.id for r in links.where(F.col("id").isin(*homes)).select("id").distinct().collect()}
    return not missing or graph.vertices.where(F.col("id").isin(*missing)).count() == len(missing)


def _lists(links: DataFrame, ids: DataFrame | None = None) -> _Lists:
    """ids in order (those with links, if none are given), where their lists begin, and all lists.  Of
    links that are counted."""
    got = links.select("id", "pos", "nbr").toArrow()
    at, pos, nbr = (got[c].to_numpy() for c in ("id", "pos", "nbr"))
    order = np.lexsort((pos, at))
    found = np.unique(at if ids is None else ids.toArrow()["id"].to_numpy())
    return found, np.append(np.searchsorted(at[order], found), len(order)), nbr[order]


def _walked(walkers: DataFrame, lists: list[_Lists], homes: list[int], p: WalkParams, whole: bool) -> DataFrame:
    """Visits as rows (walk, step, id), and a row of state, with ``steps``, of each walker that has to wait.
    ``whole``: nodes that are not in the lists have no links."""
    sent = walkers.sparkSession.sparkContext.broadcast(lists)
    home_set = set(homes)
    columns = [c for c in _STATE if c not in ("degree", "nbr")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [({int(v): k for k, v in enumerate(ids)}, first, nbrs) for ids, first, nbrs in sent.value]
        for part in parts:
            for w in part.itertuples(index=False):
                steps, begin = int(w.steps), int(w.step)
                draws = np.random.default_rng([p.seed & 0xFFFFFFFFFFFFFFFF, int(w.walk)]).random((steps, 2))
                out, now, length, seen = np.empty(steps - begin, np.int64), None, 0, set()
                if begin:
                    now, length, seen = int(w.id), int(w.length), {int(x) for x in w.seen}
                s = begin
                while s < steps:
                    u, pick = draws[s]
                    home = homes[int(pick * len(homes))]
                    if now is None or (p.max_depth is not None and length >= p.max_depth):
                        nxt, length = home, 0
                    else:
                        at, k = next(((x, x[0][now]) for x in held if now in x[0]), (None, 0))
                        if at is not None:
                            degree = int(at[1][k + 1] - at[1][k])
                        elif s == begin and not pd.isna(w.degree):
                            degree = int(w.degree)
                        elif whole:
                            degree = 0
                        else:
                            break
                        wide = p.max_edges is not None and degree > p.max_edges and (p.filter_home or now not in home_set)
                        if u < p.reset or wide or not degree:
                            nxt, length = home, 0
                        else:
                            nxt = int(at[2][at[1][k] + int(pick * degree)] if at is not None else w.nbr)
                        if p.only_once and nxt in seen:
                            seen.clear()
                            nxt, length = home, 0
                    if p.only_once:
                        seen.add(nxt)
                    length += 1
                    out[s - begin] = now = nxt
                    s += 1
                visits = {"walk": np.int32(w.walk), "step": np.arange(begin, s), "id": out[: s - begin]}
                yield pd.DataFrame(visits | dict.fromkeys(("steps", "length", "seen", "pick")))[columns]
                if s < steps:
                    yield pd.DataFrame({"walk": [w.walk], "step": [s], "steps": [steps], "id": [now], "length": [length], "seen": [list(seen)], "pick": [draws[s][1]]})[columns]

    spread = walkers.repartition(min(p.walkers, walkers.sparkSession.sparkContext.defaultParallelism), "walk")
    return spread.mapInPandas(run, ", ".join(f"{c} {_STATE[c]}" for c in columns))


def _gathered(ids: DataFrame, links: DataFrame, degrees: DataFrame, p: WalkParams, most: int) -> _Lists | None:
    """Lists of nodes, then of their neighbours and so on, ``most`` links and nodes at most; short lists
    first where a level does not fit.  What is left out costs rounds, nothing else."""
    held, lists = [], []
    for _ in range(HOPS if p.max_depth is None else min(HOPS, p.max_depth - 1)):
        for table in held:
            ids = ids.join(table, "id", "left_anti")
        level = written(ids.join(degrees, "id", "left").select("id", F.coalesce("degree", F.lit(0).cast("bigint")).alias("degree")), "walk-near")
        sizes = level.groupBy("degree").agg(F.sum(F.col("degree") + 1).alias("size")).orderBy("degree").limit(most + 1).collect()
        sums = np.cumsum([r["size"] for r in sizes])
        fits = int(np.searchsorted(sums, most, "right"))
        if not fits:
            break
        held.append(level.where(F.col("degree") <= sizes[fits - 1].degree).select("id"))
        lists.append(written(links.join(F.broadcast(held[-1]), "id"), "walk-near"))
        most -= int(sums[fits - 1])
        if fits < len(sizes):
            break
        ids = lists[-1].select(F.col("nbr").alias("id")).distinct()
    return _lists(reduce(DataFrame.unionByName, lists), reduce(DataFrame.unionByName, held)) if held else None


def _walk_in_rounds(links: DataFrame, walkers: DataFrame, homes: list[int], p: WalkParams, most: int) -> DataFrame:
    """Each round walks on until all walkers are done or wait.  Half of ``most`` links are for lists near the
    homes, which stay, half for lists near the waiting walkers."""
    spark = links.sparkSession
    degrees = written(links.groupBy("id").agg(F.count("*").alias("degree")), "walk-degrees")
    folder, rounds = scratch(spark, "walk"), []
    schema = ", ".join(f"{c} {t}" for c, t in _STATE.items() if c not in ("degree", "nbr"))
    near = _gathered(spark.createDataFrame([(h,) for h in set(homes)], "id bigint"), links, degrees, p, most // 2)
    here = None
    while True:
        rounds.append(f"{folder}/{len(rounds)}")
        _walked(walkers, [x for x in (near, here) if x], homes, p, False).write.parquet(rounds[-1])
        waiting = spark.read.schema(schema).parquet(rounds[-1]).where("steps is not null")
        if waiting.isEmpty():
            break
        few = F.broadcast if p.walkers <= 100_000 else lambda df: df
        asked = waiting.join(degrees, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("bigint")))
        asked = asked.withColumn("pos", F.floor(F.col("pick") * F.col("degree")).cast("int"))
        walkers = links.select("id", "pos", "nbr").join(few(asked), ["id", "pos"], "right").select(*_STATE)
        here = _gathered(waiting.select("id").distinct(), links, degrees, p, most - most // 2)
    return spark.read.schema(schema).parquet(*rounds).where("steps is null").select("walk", "step", "id")


def personalized_reputation(graph: PropertyGraph, homes: Sequence[int] | int, params: WalkParams) -> tuple[DataFrame, DataFrame | None]:
    """Visit counts by Monte Carlo (id, visits), and the top paths to each node if
    ``params.top_paths`` is set."""
    homes = [homes] if isinstance(homes, int) else list(homes)
    visits = written(random_walk(graph, homes, params), "visits")
    paths = None if params.top_paths is None else counters.paths_to_nodes(visits, homes, params.top_paths)
    return counters.visit_counts(visits), paths


def expected_reputation(graph: PropertyGraph, home: int, reset: float, max_depth: int, direction: GraphDir = GraphDir.OUT) -> DataFrame:
    """id, share: the expected part of visits of the walk with a depth limit, without simulation.

    A path's l-th node is v with probability x(v, l): x(home, 1) = 1, and x(v, l+1) is (1 - reset) times
    the sum of x(u, l) / degree(u) over links u to v.  Shares are these, summed over l and normalised.
    """
    links = graph.links(direction).select("id", "nbr")
    degrees = links.groupBy("id").agg(F.count("*").alias("degree"))
    out = partitioned(links.join(degrees, "id"), "id")
    level = graph.vertices.where(F.col("id") == home).select("id", F.lit(1.0).alias("x"))
    levels = level
    for _ in range(max_depth - 1):
        level = level.join(out, "id").groupBy(F.col("nbr").alias("id")).agg((F.sum(F.col("x") / F.col("degree")) * (1 - reset)).alias("x"))
        level = written(level, "level")
        levels = levels.unionByName(level)
    out.unpersist()
    sums = levels.groupBy("id").agg(F.sum("x").alias("x"))
    total = sums.agg(F.sum("x").alias("total"))
    return sums.crossJoin(F.broadcast(total)).select("id", (F.col("x") / F.col("total")).alias("share"))  # one row
