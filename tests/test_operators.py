import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.functions import counters
from graphloom.graph import GraphDir, PropertyGraph, StoredDir
from graphloom.operators import bipartite, centrality, generate, linkanalysis, partition, similarity, structure, traverse, walk
from graphloom.operators.traverse import Limits

OUT, IN = GraphDir.OUT, GraphDir.IN
G3 = {10: [11, 12], 11: [12], 12: [11]}
G5 = {10: [11, 12, 13], 11: [12], 12: [11], 13: [14], 14: []}
G6 = {10: [11, 12, 13], 11: [12, 14], 12: [14], 13: [12, 14], 14: [15], 15: [10, 11]}
G7 = {10: [11, 12, 13], 11: [10, 13, 14], 12: [13, 14], 13: [12, 14], 14: [10, 11, 15], 15: [10, 11, 16], 16: [15]}
DANGLING = {1: [2], 2: [3, 4], 3: [], 4: [], 5: [6], 6: [1, 2, 7], 7: []}


def graph(spark, lists, stored=StoredDir.BOTH_IN_OUT):
    return PropertyGraph.from_dict(spark, lists, stored)


def order(df):
    return [r.id for r in traverse.in_order(df).orderBy("step").collect()]


# Traversals


@pytest.mark.parametrize("home,limits,want", [(10, Limits(5, None, 10), [10, 11, 12, 13, 14, 15]), (15, Limits(1, None, 10), [15, 10, 11]), (15, Limits(5, 3, 10), [15, 10, 11, 12, 14]), (15, Limits(5, 3, 4), [15, 10, 11, 12]), (99, Limits(), [])])
def test_breadth_first(spark, home, limits, want):
    got = traverse.breadth_first(graph(spark, G6), [home], OUT, limits)
    assert order(got) == want
    depth = {r.id: r.depth for r in got.collect()}
    assert all(depth[v] == d for v, d in ((10, 0), (11, 1), (12, 1), (13, 1), (14, 2), (15, 3)) if home == 10)


def test_bfs_walks(spark):
    assert [(r.id, r.depth) for r in traverse.bfs_walk(graph(spark, G3), 10).orderBy("step").collect()] == [(10, 0), (11, 1), (12, 1)]
    assert [(r.id, r.depth) for r in traverse.bfs_walk(graph(spark, G6), 15).orderBy("step").collect()] == [(15, 0), (10, 1), (11, 1), (12, 2), (13, 2), (14, 2)]
    counts, prev = traverse.walk_counts(graph(spark, G6), 15)
    assert {r.visits for r in counts.collect()} == {1} and {(r.id, r.prev) for r in prev.collect()} == {(10, 15), (11, 15), (12, 10), (13, 10), (14, 11)}


@pytest.mark.parametrize("direction,want", [(OUT, [10, 11, 12, 13, 12, 14]), (IN, [10, 15, 14, 11, 12, 13, 10, 15, 10, 11])])
def test_all_paths(spark, direction, want):
    got = traverse.all_paths(graph(spark, G6), [10], direction, Limits(max_steps=len(want)))
    assert order(got) == want
    with pytest.raises(ValueError):
        traverse.all_paths(graph(spark, G6), [10])


@pytest.mark.parametrize(
    "lists,direction,want",
    [
        (G5, OUT, {10: (0, 9, 0), 11: (1, 5, 1), 12: (2, 4, 2), 13: (3, 8, 1), 14: (6, 7, 2)}),
        (G6, OUT, {10: (0, 11, 0), 11: (1, 9, 1), 12: (2, 8, 2), 14: (4, 7, 3), 15: (5, 6, 4), 13: (3, 10, 1)}),
        (G6, IN, {10: (0, 11, 0), 15: (1, 10, 1), 14: (2, 9, 2), 11: (3, 6, 3), 12: (4, 8, 3), 13: (5, 7, 4)}),
    ],
)
def test_depth_first(spark, lists, direction, want):
    got = traverse.depth_first(graph(spark, lists), [10], direction).orderBy("step").collect()
    assert [r.id for r in got] == list(want)
    assert {r.id: (r.discovery, r.finish, r.distance) for r in got} == want


# Walks


def test_walk_depths(spark):
    g = graph(spark, G6)
    for depth, want in ((1, {12}), (2, {12, 14})):
        got = walk.random_walk(g, [12], walk.WalkParams(200, 0.0, max_depth=depth))
        assert {r.id for r in got.collect()} == want
    assert walk.random_walk(g, [99], walk.WalkParams(10, 0.1)).count() == 0
    assert walk.random_walk(g, [], walk.WalkParams(10, 0.1)).count() == 0
    with pytest.raises(ValueError):
        walk.WalkParams(10, 1.5)


@pytest.mark.parametrize("links,steps", [(10**6, 40_000), (0, 3000)])
def test_reputation_is_near_its_expectation(spark, links, steps):
    g = graph(spark, G6)
    p = walk.WalkParams(steps, 0.3, max_depth=4, walkers=8 if links else 100)
    got = counters.visit_counts(walk.random_walk(g, [10], p, links)).collect()
    want = {r.id: r.share for r in walk.expected_reputation(g, 10, 0.3, 4).collect()}
    assert sum(r.visits for r in got) == steps
    assert all(abs(r.visits / steps - want[r.id]) < (0.02 if links else 0.06) for r in got)
    again = counters.visit_counts(walk.random_walk(g, [10], p, links)).collect()
    assert got == again


@pytest.mark.parametrize("links", [10**6, 0])
def test_walk_rules(spark, links):
    ring = graph(spark, {1: [2], 2: [3], 3: [1]})
    once = walk.random_walk(ring, [1], walk.WalkParams(7, 0.0, only_once=True, walkers=1), links)
    assert [r.id for r in once.orderBy("step").collect()] == [1, 2, 3, 1, 2, 3, 1]
    wide = walk.random_walk(graph(spark, G6), [15], walk.WalkParams(60, 0.0, max_edges=2, walkers=1), links).orderBy("step").collect()
    assert all(b.id == 15 for a, b in zip(wide, wide[1:]) if a.id == 10)


def test_walk_does_not_depend_on_what_is_broadcast(spark):
    near = {i: [(i * k + 1) % 97 for k in range(1, 2 + i % 5)] for i in range(0, 97, 2)}  # odd nodes have no links
    g = graph(spark, near)
    for p in (walk.WalkParams(64, 0.1, walkers=8), walk.WalkParams(64, 0.0, max_edges=3, only_once=True, max_depth=6, walkers=8)):
        got = [walk.random_walk(g, [0, 4], p, links).orderBy("walk", "step").collect() for links in (10**6, 60, 0)]
        assert len(got[0]) == 64 and got[0] == got[1] == got[2]


def test_walk_on_a_large_graph_takes_few_rounds(spark, monkeypatch):
    g = graph(spark, {i: [(i * 7 + k) % 1000 for k in range(3)] for i in range(1000)})
    tables = []
    monkeypatch.setattr(walk, "written", lambda df, name, f=walk.written: tables.append(name) or f(df, name))
    assert walk.random_walk(g, [5], walk.WalkParams(2000, 0.1, max_depth=4, walkers=8), 2999).count() == 2000
    assert len(tables) < 20


def test_short_walk_derives_only_lists_that_paths_reach(spark, monkeypatch):
    near = {i: [(i * 7 + k) % 1000 for k in range((i + 1) % 4)] for i in range(1000)}
    edges = spark.createDataFrame([(i, j) for i, js in near.items() for j in js], "src bigint, dst bigint")
    asked, tables = [], []

    def edges_from(ids):
        asked.append({r.id for r in ids.collect()})
        return edges.join(ids, F.col("src") == F.col("id"), "left_semi")

    g, whole = PropertyGraph.from_edges(edges, edges_from=edges_from), PropertyGraph.from_edges(edges)
    monkeypatch.setattr(walk, "written", lambda df, name, f=walk.written: tables.append(name) or f(df, name))
    p = walk.WalkParams(300, 0.1, max_depth=4, walkers=8)
    got = walk.random_walk(g, [2, 5], p).orderBy("walk", "step").collect()
    first = set(near[2] + near[5])
    assert asked == [{2, 5}, first, {j for i in first for j in near[i]}] and "walk-links" not in tables
    assert got == walk.random_walk(whole, [2, 5], p).orderBy("walk", "step").collect() and tables.count("walk-links") == 1
    assert walk.random_walk(g, [2, 5000], p).isEmpty() and tables.count("walk-links") == 1
    assert {r.id for r in walk.random_walk(g, [35], p).collect()} == {35}  # it has no links
    assert walk._reachable(g, [2, 5], p, 12) is None and walk._reachable(g, [2, 5], walk.WalkParams(300, 0.1), 10**6) is None


def test_reputation_with_paths(spark):
    visits, paths = walk.personalized_reputation(graph(spark, G6), 10, walk.WalkParams(2000, 0.2, top_paths=2))
    assert visits.first().id == 10 or visits.count() == 6
    assert paths.groupBy("id").count().agg(F.max("count")).first()[0] <= 2 and all(r.path[0] == 10 for r in paths.collect())


# Link analysis

RANKS = [
    (G6, StoredDir.BOTH_IN_OUT, {10: 0.12699, 11: 0.16297, 12: 0.15616, 13: 0.06098, 14: 0.25292, 15: 0.23998}),
    (G6, StoredDir.ONLY_IN, {10: 0.19942, 11: 0.11661, 12: 0.09086, 13: 0.11661, 14: 0.23245, 15: 0.24406}),
    (DANGLING, StoredDir.ONLY_OUT, {1: 0.11622, 2: 0.215, 3: 0.16763, 4: 0.16763, 5: 0.07625, 6: 0.14106, 7: 0.11622}),
    (DANGLING, StoredDir.ONLY_IN, {1: 0.12085, 2: 0.15194, 3: 0.05628, 4: 0.05628, 5: 0.28697, 6: 0.27141, 7: 0.05628}),
    ({0: [1], 1: [2], 2: []}, StoredDir.ONLY_OUT, {0: 0.18442, 1: 0.34117, 2: 0.47441}),
]


@pytest.mark.parametrize("lists,stored,want", RANKS)
def test_pagerank(spark, lists, stored, want):
    got = linkanalysis.pagerank(graph(spark, lists, stored), max_iterations=None, tolerance=1e-9)
    assert {r.id: round(r["rank"], 5) for r in got.table.collect()} == want


def test_pagerank_by_joins(spark):
    g = graph(spark, DANGLING, StoredDir.ONLY_OUT)
    a, b = linkanalysis.pagerank(g, max_iterations=6), linkanalysis.pagerank(g, max_iterations=6, kernel_edges=0)
    x, y = ({r.id: r["rank"] for r in t.table.collect()} for t in (a, b))
    assert a.iteration == b.iteration == 6 and a.error == pytest.approx(b.error) and all(x[k] == pytest.approx(y[k]) for k in x)
    half = linkanalysis.pagerank(g, max_iterations=3, kernel_edges=0)
    rest = linkanalysis.pagerank(g, max_iterations=3, init=half.table)
    assert {r.id: r["rank"] for r in rest.table.collect()} == pytest.approx(x)
    assert linkanalysis.pagerank(graph(spark, {})).table.count() == 0


HUBS = {10: 0.2576, 11: 0.2716, 12: 0.1234, 13: 0.2716, 14: 0, 15: 0.0757}
AUTHORITIES = {10: 0.0355, 11: 0.1562, 12: 0.3753, 13: 0.1207, 14: 0.3123, 15: 0}


@pytest.mark.parametrize("kernel", [10**6, 0])
def test_hits(spark, kernel):
    got = linkanalysis.hits(graph(spark, G6), kernel_edges=kernel)
    rows = got.table.collect()
    assert got.iteration == 30
    assert all(abs(r.hub - HUBS[r.id]) < 1e-4 and abs(r.authority - AUTHORITIES[r.id]) < 1e-4 for r in rows)
    raw = {r.id: r for r in linkanalysis.hits(graph(spark, G6), normalize=False, kernel_edges=kernel).table.collect()}
    assert raw[11].hub == pytest.approx(1) and raw[14].authority == pytest.approx(0.8324, abs=1e-4)


def test_hits_of_in_lists(spark):
    got = linkanalysis.hits(graph(spark, G6, StoredDir.ONLY_IN))
    assert got.iteration == 32 and all(abs(r.hub - AUTHORITIES[r.id]) < 1e-4 for r in got.table.collect())
    assert linkanalysis.hits(graph(spark, G6), max_iterations=None, tolerance=1e-50).iteration == 70


# Centrality

WITH_EMPTY = {0: [], 1: [], **G6}


def test_degree_centrality(spark):
    g = graph(spark, WITH_EMPTY)
    got = {r.id: r.centrality for r in centrality.degree_centrality(g, IN).collect()}
    assert all(abs(got[i] - v) < 1e-3 for i, v in zip(range(11, 16), (0.285, 0.428, 0.142, 0.428, 0.142)))
    got = {r.id: r.centrality for r in centrality.degree_centrality(g, OUT, False).collect()}
    assert [got[i] for i in range(11, 16)] == [2, 1, 2, 1, 2]
    assert np.isnan(centrality.degree_centrality(graph(spark, {1: []})).first().centrality)


@pytest.mark.parametrize("most", [10**6, 0])
def test_closeness(spark, most):
    g = graph(spark, WITH_EMPTY)
    for normalize, want in ((False, (0.625, 0.455, 0.385, 0.5, 0.455, 0.625)), (True, (0.446, 0.325, 0.275, 0.357, 0.325, 0.446))):
        got = {r.id: r.centrality for r in centrality.closeness_centrality(g, normalize, broadcast_edges=most).collect()}
        assert all(abs(got[i] - v) < 1.1e-3 for i, v in zip(range(10, 16), want)) and got[0] == got[1] == 0


def test_distance_sums_in_batches(spark, monkeypatch):
    rng = np.random.default_rng(1)
    lists = {i: sorted({int(x) for x in rng.integers(0, 300, 3)}) for i in range(150)} | {i: [i + 1] for i in range(300, 303)} | {400: list(range(150)), 401: []}
    g = graph(spark, lists)
    want = {}
    for root in {*lists, *(x for v in lists.values() for x in v)}:
        depth, level = {root: 0}, [root]
        while level:
            level = list(dict.fromkeys(x for v in level for x in lists.get(v, []) if x not in depth))
            depth |= dict.fromkeys(level, max(depth.values()) + 1)
        want[root] = (len(depth), sum(depth.values()))
    monkeypatch.setattr(centrality, "SEARCH_BYTES", 0)  # a word a task
    monkeypatch.setattr(centrality, "SEARCH_ROWS", 150_000)  # some batches of roots
    kept = []
    monkeypatch.setattr(centrality, "drop_written", lambda *x, f=centrality.drop_written: kept.append(len(x)) or f(*x))
    for most in (10**6, 0):
        got = {r.id: (r.reached, r.total) for r in centrality.distance_sums(g, broadcast_edges=most).collect()}
        assert got == want
    assert len(kept) > 1  # levels go after each batch


# Similarity


def test_jaccard(spark):
    for stored, d in ((StoredDir.BOTH_IN_OUT, OUT), (StoredDir.ONLY_IN, IN)):
        g = graph(spark, G6, stored)
        assert similarity.similarity(g, 10, 13, similarity.jaccard, d) == 0.25
        assert [(r.other, r.score) for r in similarity.most_similar(g, 10, 5, similarity.jaccard, d).collect()] == [(11, 0.25), (13, 0.25), (15, 0.25)]
        rows = similarity.all_most_similar(g, 10, similarity.jaccard, d).orderBy("id", "rank").collect()
        got = {}
        for r in rows:
            got.setdefault(r.id, []).extend([(r.other, r.score)] if r.other is not None else [])
        assert got == {10: [(11, 0.25), (13, 0.25), (15, 0.25)], 11: [(13, 1.0), (12, 0.5), (10, 0.25)], 12: [(11, 0.5), (13, 0.5)], 13: [(11, 1.0), (12, 0.5), (10, 0.25)], 14: [], 15: [(10, 0.25)]}
    with pytest.raises(KeyError):
        similarity.similarity(g, 10, 99, similarity.jaccard, IN)


def test_cosine(spark):
    g = graph(spark, G7, StoredDir.ONLY_IN)
    assert similarity.similarity(g, 14, 15, similarity.cosine, IN) == pytest.approx(2 / 3)
    got = [(r.other, round(r.score, 6)) for r in similarity.most_similar(g, 10, 10, similarity.cosine, IN).collect()]
    assert got == [(12, 0.408248), (13, 0.408248), (11, 0.333333), (14, 0.333333), (15, 0.333333)]
    assert similarity.all_most_similar(g, 1, similarity.cosine, IN).count() == 7


def test_empty_sets_are_equal(spark):
    both, one = graph(spark, {1: [], 2: [], 3: [1]}), graph(spark, {1: [], 2: [], 3: [1]}, StoredDir.ONLY_OUT)
    assert similarity.similarity(both, 1, 2, similarity.jaccard) == 1.0 and similarity.similarity(both, 1, 2, similarity.cosine) == 0.0
    assert similarity.all_most_similar(both, 3, similarity.jaccard).where("other is not null").count() == 0
    assert {(r.id, r.other) for r in similarity.all_most_similar(one, 3, similarity.jaccard).where("other is not null").collect()} == {(1, 2), (2, 1)}


# Structure


@pytest.mark.parametrize("lists,want", [({1: [2], 2: [1]}, 1), (G6, 0), (G7, 4), (G3, 1), ({1: [1, 2, 2], 2: []}, 0)])
def test_mutual_edges(spark, lists, want):
    assert structure.mutual_edge_count(graph(spark, lists)).first().mutual == want


def test_mutual_of_complete(spark):
    g = generate.complete(spark, 10)
    assert g.edge_count() == 90 and structure.mutual_edge_count(g).first().mutual == 45 == g.stored_edge_count() // 4
    assert {r.mutual for r in structure.mutual_neighbors(g).collect()} == {9}


def test_triangles(spark):
    g = generate.complete(spark, 30)
    row = structure.triangle_stats(g).first()
    assert (row.triangles, row.wedges, row.transitivity) == (4060, 30 * 29 * 28 // 2, 1.0)
    est = structure.triangle_estimate(g, 150, 150, estimators=4).first()
    assert abs(est.triangles - 4060) < 1200 and est.transitivity > 0.7
    r = np.random.default_rng(1)
    edges = {(int(a), int(b)) for a, b in r.integers(0, 40, (200, 2))}
    und = {(min(e), max(e)) for e in edges if e[0] != e[1]}
    want = sorted((a, b, c) for a, b in und for c in range(b + 1, 40) if (a, c) in und and (b, c) in und)
    got = structure.triangles(PropertyGraph.from_edges(spark.createDataFrame(sorted(edges), "src bigint, dst bigint"))).collect()
    assert sorted((x.a, x.b, x.c) for x in got) == want
    assert structure.triangle_stats(graph(spark, {1: [2]})).first().transitivity == 0.0


# Bipartite


def double(spark):
    lr, rl = {2: [5, 10], 4: [14], 5: [5, 10, 8]}, {14: [4], 4: [1, 5], 5: [1], 10: [1, 5], 123: [1]}
    return bipartite.BipartiteGraph.from_dicts(spark, range(1, 6), [4, 5, 8, 10, 14, 123], lr, rl)


def test_bipartite(spark):
    g = double(spark)
    assert g.counts().first().asDict() == {"left_nodes": 5, "right_nodes": 6, "lr_edges": 6, "rl_edges": 7}
    assert g.get_node(-2).first().side == "left" and g.get_node(5).first().side == "right" and g.get_node(0).isEmpty()
    assert g.stores("left", OUT) and g.stores("left", IN)
    single = bipartite.BipartiteGraph.from_dicts(spark, range(1, 6), [4, 5, 8, 10, 14, 123], {2: [5, 10], 4: [14], 5: [5, 10, 8]})
    assert single.stores("left", OUT) and single.stores("right", IN) and not single.stores("left", IN) and not single.stores("right", OUT)
    for homes, want in (([-2, -5], [-2, 5, 10, -5, 8]), ([5], [5])):
        assert [r.id for r in traverse.depth_first(single.as_graph(), homes).orderBy("step").collect()] == want
    assert [r.id for r in traverse.depth_first(g.as_graph(), [-1], IN).orderBy("step").collect()] == [-1, 4, 5, -2, -5, 10, 123]
    with pytest.raises(ValueError):
        bipartite.BipartiteGraph.from_dicts(spark, [0], [1], {0: [1]})
    unique = bipartite.BipartiteGraph.from_dicts(spark, [2, 4, 6], [1, 3, 5], {2: [5], 4: [1], 6: [1, 3]}, unique_ids=True)
    assert unique.get_node(2).first().side == "left" and unique.get_node(3).first().side == "right"
    assert {r.id for r in unique.as_graph().vertices.collect()} == {1, 2, 3, 4, 5, 6}


def test_link_analyzer(spark):
    edges = spark.createDataFrame([(1, 11), (1, 12), (2, 12)], "left bigint, right bigint")
    weights = spark.createDataFrame([(1, 0.5), (2, 0.5)], "id bigint, weight double")
    left, right = (t.collect() for t in bipartite.analyze(edges, weights, 2, 0.15, 0.15))
    assert [(r.id, round(r.weight, 7)) for r in left] == [(1, 0.5265625), (2, 0.3459375)]
    assert [(r.id, round(r.weight, 7)) for r in right] == [(12, 0.6375), (11, 0.2125)]
    assert [list(r.contributors) for r in right] == [[2, 1], [1]] and list(left[0].contributors) == [12, 11]


# Partitions and generators


def test_partitions(spark):
    g = graph(spark, G6, StoredDir.ONLY_OUT)
    both = {}
    for r in partition.hash_source_and_dest(g, 2).where("nbr is not null").collect():
        both.setdefault((r.instance, r.id), []).append(r.nbr)
    assert {k: sorted(v) for k, v in both.items()} == {(0, 10): [11, 12, 13], (0, 12): [14], (0, 14): [15], (0, 11): [12, 14], (0, 13): [12, 14], (0, 15): [10], (1, 11): [12, 14], (1, 13): [12, 14], (1, 15): [10, 11], (1, 10): [11, 13], (1, 14): [15]}
    assert partition.hash_dest(g, 2).count() == 11
    assert partition.hash_source(PropertyGraph.from_dict(spark, {-7: [1]}), 3).where("id = -7").first().instance == -1
    where = partition.random_nodes(g, 3, 1).select("id", "instance").distinct()
    assert where.count() == 6


def test_split(spark, tmp_path):
    partition.split(graph(spark, G6), lambda g: partition.hash_source(g, 2), str(tmp_path / "parts"))
    text = spark.read.text(str(tmp_path / "parts/instance=1")).collect()
    assert {r.value for r in text} >= {"11 2", "13 2", "15 2"}


def test_random_graphs(spark):
    n, p = 300, 0.05
    d = generate.random_directed(spark, n, p, 3)
    rows = d.edges.collect()
    assert abs(len(rows) - n * (n - 1) * p) < 5 * np.sqrt(n * n * p) and all(r.src != r.dst and 0 <= r.dst < n for r in rows)
    assert len({(r.src, r.dst) for r in rows}) == len(rows) and sorted(rows) == sorted(generate.random_directed(spark, n, p, 3).edges.collect())
    u = generate.random_undirected(spark, n, p, 3)
    pairs = {(r.src, r.dst) for r in u.edges.collect()}
    assert all((b, a) in pairs for a, b in pairs) and abs(len(pairs) - n * (n - 1) * p) < 7 * np.sqrt(n * n * p)
    assert u.node_count() == n and generate.random_directed(spark, 5, 1.0).edge_count() == 20 and generate.random_directed(spark, 5, 0.0).edge_count() == 0
    assert generate.edge_probability(11, 2) == 0.2 and set(generate.binomial(5, 1.0, 10)) == {5}
    with pytest.raises(ValueError):
        generate.edge_probability(1, 2)
