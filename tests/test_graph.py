import pytest
from pyspark.sql import functions as F

from graphloom.functions import arrays, counters, labels, nodes
from graphloom.graph import GraphDir, PropertyGraph, StoredDir

OUT, IN = GraphDir.OUT, GraphDir.IN
G6 = {10: [11, 12, 13], 11: [12, 14], 12: [14], 13: [12, 14], 14: [15], 15: [10, 11]}
SAMPLE = {1: [2, 3, 4], 2: [1], 3: [4], 5: [1, 10]}


def lists(df):
    return {r.id: list(r.nbrs) for r in df.collect()}


@pytest.fixture(scope="module")
def g6(spark):
    return PropertyGraph.from_dict(spark, G6)


def test_counts_and_lists(spark, g6):
    assert (g6.node_count(), g6.edge_count(), g6.stored_edge_count(), g6.max_node_id()) == (6, 11, 22, 15)
    assert lists(g6.adjacency(OUT)) == G6
    assert lists(g6.adjacency(IN)) == {10: [15], 11: [10, 15], 12: [10, 11, 13], 13: [10], 14: [11, 12, 13], 15: [14]}
    assert g6.totals().first().asDict() == {"nodes": 6, "edges": 11, "stored_edges": 22, "max_id": 15}
    assert g6.storage_estimate() == 4 + 12 * 15 + 4 * 22
    assert g6.get_node(10).first().asDict() == {"id": 10, "out_nbrs": [11, 12, 13], "in_nbrs": [15]}
    assert g6.exists(11) and not g6.exists(9) and g6.get_node(9).isEmpty()
    assert "out 10 -> 11, 12, 13" in g6.describe(1)


@pytest.mark.parametrize("stored,out,inn,count", [(StoredDir.BOTH_IN_OUT, [2, 3, 4], [2, 5], 14), (StoredDir.ONLY_OUT, [2, 3, 4], [], 7), (StoredDir.ONLY_IN, [], [2, 3, 4], 7), (StoredDir.MUTUAL, [2, 3, 4], [2, 3, 4], 14)])
def test_stored_directions(spark, stored, out, inn, count):
    g = PropertyGraph.from_dict(spark, SAMPLE, stored)
    assert lists(g.adjacency(OUT))[1] == out and lists(g.adjacency(IN))[1] == inn
    assert g.node_count() == 6 and g.stored_edge_count() == count
    assert g.bidirectional == (stored in (StoredDir.BOTH_IN_OUT, StoredDir.MUTUAL))
    assert g.stores(OUT) == (stored is not StoredDir.ONLY_IN)


def test_empty_and_isolated(spark):
    empty = PropertyGraph.from_dict(spark, {})
    assert empty.node_count() == 0 and empty.max_node_id() == 0
    g = PropertyGraph.from_dict(spark, {0: [], 1: [], 2: [2, 3, 3]})
    assert g.node_count() == 4 and g.edge_count() == 3 and lists(g.adjacency(OUT))[2] == [2, 3, 3]
    twice = spark.createDataFrame([(1, [2]), (1, [3])], "id bigint, edges array<bigint>")
    with pytest.raises(ValueError):
        PropertyGraph.from_adjacency(twice)


def test_node_functions(spark, g6):
    assert {r.id: r.degree for r in g6.degrees(IN).collect()} == {10: 1, 11: 2, 12: 3, 13: 1, 14: 3, 15: 1}
    assert nodes.first_neighbors(g6, 1).count() == 6
    assert nodes.neighbor_count(g6, 10) == 3 and nodes.neighbor_count(g6, 99) == 0
    pairs = spark.createDataFrame([(10, 11), (11, 10)], "id bigint, other bigint")
    assert {(r.id, r.found) for r in nodes.is_neighbor(g6, pairs).collect()} == {(10, True), (11, False)}
    dup = PropertyGraph.from_dict(spark, {1: [2, 2, 3]})
    ids = spark.createDataFrame([(2,), (9,)], "id bigint")
    assert [(r.id, r.nbr) for r in nodes.intersect(dup, ids).collect()] == [(1, 2)]
    rec = spark.range(10, 16)
    assert {r.id for r in nodes.without_self_and_followed(g6, 10, rec).collect()} == {14, 15}
    assert {r.id for r in nodes.without(rec, [10, 11]).collect()} == {12, 13, 14, 15}
    assert {r.id for r in nodes.without(rec, spark.range(10, 12)).collect()} == {12, 13, 14, 15}
    few = g6.degrees(OUT).where(~nodes.has_too_many_edges(F.col("degree"), 2))
    assert {r.id for r in few.collect()} == {11, 12, 13, 14, 15}


def test_random_picks(spark, g6):
    got = nodes.random_neighbors(g6, 20, seed=3).collect()
    assert len(got) == 120 and all(r.nbr in G6[r.id] for r in got) and {r.nbr for r in got if r.id == 10} == {11, 12, 13}
    one = g6.adjacency(OUT).select("id", nodes.random_neighbor(F.col("nbrs"), F.rand(1)).alias("x"), nodes.random_neighbor_set(F.col("nbrs"), 5, 2).alias("xs")).collect()
    assert all(r.x in G6[r.id] and len(r.xs) == 5 and set(r.xs) <= set(G6[r.id]) for r in one)
    none = PropertyGraph.from_dict(spark, {1: []}).adjacency(OUT).select(nodes.random_neighbor(F.col("nbrs"), F.rand(1)).alias("x"), nodes.random_neighbor_set(F.col("nbrs"), 5, 2).alias("xs")).first()
    assert none.x is None and none.xs == []
    ids = spark.range(100)
    assert nodes.random_subset(ids, 10, 1).distinct().count() == 10 and nodes.random_subset(ids, 200, 1).count() == 100
    assert nodes.pick_random(ids, 4).count() == 1
    sub = nodes.random_range_subset(5, 3, 9, 1)
    assert len(set(sub)) == 5 and set(sub) <= set(range(3, 10))


def visits(spark, ids):
    return spark.createDataFrame([(0, k, i) for k, i in enumerate(ids)], "walk int, step bigint, id bigint")


def test_counters(spark):
    v = visits(spark, [10, 11, 10, 12, 11, 10, 13])
    assert [(r.id, r.visits) for r in counters.visit_counts(v).collect()] == [(10, 3), (11, 2), (12, 1), (13, 1)]
    paths = {(r.id, tuple(r.path)): r["count"] for r in counters.paths_to_nodes(v, [10]).collect()}
    assert paths == {(10, (10,)): 3, (11, (10, 11)): 1, (12, (10, 12)): 1, (11, (10, 12, 11)): 1, (13, (10, 13)): 1}
    top = counters.paths_to_nodes(v, [10], 1)
    assert {(r.id, tuple(r.path)) for r in top.collect()} == {(10, (10,)), (11, (10, 11)), (12, (10, 12)), (13, (10, 13))}
    assert {r.id: (r.unique_paths, r.paths) for r in counters.path_totals(counters.paths_to_nodes(v, [10])).collect()}[11] == (2, 2)
    assert counters.paths_through(counters.paths_to_nodes(v, [10]), 12).count() == 2
    prev = counters.previous_counts(counters.with_previous(v))
    assert {(r.id, r.prev): r["count"] for r in prev.collect()} == {(11, 10): 1, (10, 11): 2, (12, 10): 1, (11, 12): 1, (13, 10): 1}
    once = counters.previous_counts(counters.with_previous(v), top=1, only_once=True)
    assert {(r.id, r.prev) for r in once.collect()} == {(11, 10), (10, 11), (12, 10), (13, 10)}
    info = v.withColumn("x", F.col("step") * 10)
    assert {r.id: r.x for r in counters.keep_info(info, "x").collect()}[10] == 50
    assert {r.id: r.x for r in counters.keep_info(info, "x", True).collect()}[10] == 0
    scored = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 3.0)], "id bigint, score double")
    assert [r.id for r in counters.top_k(scored, 2).collect()] == [2, 3]


def test_totals_of_long_paths(spark):
    n = 60_000  # paths of one leg: 14 GB as arrays
    long = visits(spark, range(1, n + 1))
    got = counters.visit_path_totals(long, [1])
    assert got.count() == n and got.where("unique_paths = 1 and paths = 1").count() == n
    mixed = visits(spark, [7, 3, 1, 3, 3, 1, 3, 2, None, 3, 1, None, 3, 3, 7, 1]).unionByName(visits(spark, [7, 3, 1, 3, 3, 7]).withColumn("walk", F.lit(1)))
    for homes in ([1], [1, 2], []):
        want = counters.path_totals(counters.paths_to_nodes(mixed, homes)).orderBy("id").collect()
        assert counters.visit_path_totals(mixed, homes).orderBy("id").collect() == want


def test_totals_of_paths_whose_hashes_collide(spark, monkeypatch):
    real, salts = F.xxhash64, []
    monkeypatch.setattr(F, "xxhash64", lambda salt, *c: salts.append(1) or (F.lit(0).cast("bigint") if len(salts) == 1 else real(salt, *c)))
    got = counters.visit_path_totals(visits(spark, [1, 2, 3, 1, 4, 3]), [1])
    assert {r.id: (r.unique_paths, r.paths) for r in got.collect()} == {1: (1, 2), 2: (1, 1), 3: (2, 2), 4: (1, 1)} and len(salts) == 2


def test_two_homes(spark):
    v = visits(spark, [1, 2, 3, 2, 1, 3])
    paths = {(r.id, tuple(r.path)): r["count"] for r in counters.paths_to_nodes(v, [1, 2]).collect()}
    assert paths == {(1, (1,)): 2, (2, (2,)): 2, (3, (2, 3)): 1, (3, (1, 3)): 1}


def test_arrays(spark):
    row = spark.range(1).select(F.array(*map(F.lit, (1, 2, 2, 3))).alias("a"), F.array(*map(F.lit, (2, 2, 2, 4))).alias("b"))
    got = row.select(arrays.sorted_intersection(F.col("a"), F.col("b")).alias("i"), arrays.sorted_union(F.col("a"), F.col("b")).alias("u"), arrays.sorted_exists(F.col("a"), 3).alias("e")).first()
    assert got.i == [2, 2] and got.u == [1, 2, 3, 4] and got.e
    x = spark.createDataFrame([(1, 3.0), (2, 1.0)], "id bigint, value double")
    y = spark.createDataFrame([(2, 5.0)], "id bigint, value double")
    assert arrays.delta(x, y).first().delta == 7.0 and arrays.delta(x, y, 2).first().delta == 5.0
    assert {r.id: r.value for r in arrays.scaled(x).collect()} == {1: 0.75, 2: 0.25}
    assert {r.id: r.value for r in arrays.scaled(x, "max").collect()}[1] == 1.0
    assert arrays.difference(spark.range(4), spark.range(2)).count() == 2
    pair = spark.range(1).select(arrays.packed_pair(F.lit(3), F.lit(5)).alias("p"), arrays.shard_of(F.lit(515)).alias("s")).first()
    assert pair.p == (3 << 32) | 5 and pair.s == 3


def test_labels(spark, g6):
    age = spark.createDataFrame([(10, 5), (11, 7)], "id bigint, value int")
    reg = labels.Labels().add("age", age)
    assert reg.get("age", "int") is not None and reg.get("age", "string") is None and reg.names() == [("age", "int")]
    assert reg.without("age").names() == []
    g = g6.with_labels(reg.tables)
    assert g.label_of(10, "age", "int") == 5 and g.label_of(12, "age", "int") is None and g.label_of(10, "age", "string") is None
    assert {r.id: r.age for r in labels.attached(g.vertices, age, "age").collect()}[12] is None
    assert {r.id: r.age for r in labels.attached(g.vertices, age, "age", 0).collect()}[12] == 0
    new = labels.put(age, spark.createDataFrame([(11, 1), (12, 2)], "id bigint, value int"))
    assert {r.id: r.value for r in new.collect()} == {10: 5, 11: 1, 12: 2}
    assert labels.removed(new, spark.range(12, 13)).count() == 2
    assert {r.value for r in labels.flag(spark.range(3)).collect()} == {True}
