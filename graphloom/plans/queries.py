"""Registered graph queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, counters, labels, nodes
from ..graph import GraphDir, PropertyGraph, StoredDir
from ..operators import bipartite, centrality, generate, linkanalysis, partition, similarity, structure, traverse, walk
from ..streaming import dynamic
from .derive import EDGES_SQL, part_graph, supplier_graph, supplier_parts, table, user_graph

OUT, IN = GraphDir.OUT, GraphDir.IN
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _register(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _with(graph: str, body: str) -> str:
    """SQL over e(src, dst) and v(id) of a derived graph."""
    return f"WITH RECURSIVE e AS ({EDGES_SQL[graph]}), v AS (SELECT src AS id FROM e UNION SELECT dst FROM e) {body}"


# Graphs and node-local functions


@_register(_with("part", "SELECT (SELECT count(*) FROM v) AS nodes, (SELECT count(*) FROM e) AS edges, 2 * (SELECT count(*) FROM e) AS stored_edges, (SELECT max(id) FROM v) AS max_id"))
def graph_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).totals()


@_register(_with("part", "SELECT v.id, count(e.dst) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id"))
def out_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).degrees(OUT)


@_register(_with("part", "SELECT v.id, count(e.src) AS degree FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id"))
def in_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).degrees(IN)


@_register(_with("part", "SELECT v.id, coalesce(string_agg(CAST(e.dst AS VARCHAR), ',' ORDER BY e.dst), '') AS nbrs FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id"))
def adjacency_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).adjacency(OUT).select("id", F.array_join(F.col("nbrs").cast("array<string>"), ",").alias("nbrs"))


@_register(_with("part", "SELECT id, nbr, CAST(pos AS INTEGER) AS pos FROM (SELECT dst AS id, src AS nbr, row_number() OVER (PARTITION BY dst ORDER BY src) - 1 AS pos FROM e) WHERE pos < 5"))
def first_in_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the first five in-neighbours of each node."""
    return nodes.first_neighbors(part_graph(spark, sf_dir), 5, IN)


@_register(_with("user", "SELECT a.src AS id, a.dst AS other, EXISTS (SELECT 1 FROM e b WHERE b.src = a.dst AND b.dst = a.src) AS found FROM e a"))
def neighbor_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each edge, whether the reversed one exists."""
    g = user_graph(spark, sf_dir)
    back = g.edges.select(F.col("dst").alias("id"), F.col("src").alias("other"))
    return nodes.is_neighbor(g, back).select(F.col("other").alias("id"), F.col("id").alias("other"), "found")


@_register(_with("part", "SELECT e.src AS id, e.dst AS nbr FROM e JOIN part p ON p.p_partkey = e.dst WHERE p.p_size <= 10"))
def neighbor_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    small = table(spark, sf_dir, "part").where("p_size <= 10").select(F.col("p_partkey").alias("id"))
    return nodes.intersect(part_graph(spark, sf_dir), small).select("id", "nbr")


@_register(_with("supplier", "SELECT id FROM v WHERE id <> 7 AND id NOT IN (SELECT dst FROM e WHERE src = 7)"))
def recommend_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = supplier_graph(spark, sf_dir)
    return nodes.without_self_and_followed(g, 7, g.vertices)


@_register(_with("part", "SELECT v.id, count(e.dst) AS degree FROM v JOIN e ON e.src = v.id GROUP BY v.id HAVING count(*) > 25"))
def hubs_beyond_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = part_graph(spark, sf_dir).degrees(OUT)
    return d.where(nodes.has_too_many_edges(F.col("degree"), 25))


@_register()
def random_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.random_neighbors(part_graph(spark, sf_dir), 3, OUT, seed=11)


@_register()
def random_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 100 nodes without replacement."""
    return nodes.random_subset(part_graph(spark, sf_dir).vertices, 100, seed=3)


@_register(_with("part", "SELECT v.id, p.p_brand AS brand, coalesce(CASE WHEN p.p_size > 25 THEN p.p_size END, 0) AS size FROM v LEFT JOIN part p ON p.p_partkey = v.id"))
def node_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    registry = labels.Labels().add("brand", parts.select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("value")))
    registry = registry.add("size", parts.where("p_size > 25").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("value")))
    v = labels.attached(part_graph(spark, sf_dir).vertices, registry.get("brand", "string"), "brand")
    return labels.attached(v, registry.get("size", "int"), "size", 0)


# Structure


@_register(_with("part", "SELECT count(*) AS mutual FROM e a JOIN e b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst"))
def mutual_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.mutual_edge_count(part_graph(spark, sf_dir))


@_register(_with("part", "SELECT v.id, count(b.src) AS mutual FROM v LEFT JOIN e a ON a.src = v.id LEFT JOIN e b ON b.src = a.dst AND b.dst = a.src GROUP BY v.id"))
def mutual_neighbors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.mutual_neighbors(part_graph(spark, sf_dir))


_UNDIRECTED = "u AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e), d AS (SELECT id, count(*) AS n FROM (SELECT a AS id FROM u UNION ALL SELECT b FROM u) GROUP BY id)"


@_register(_with("part", f", {_UNDIRECTED} SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS wedges FROM d"))
def wedges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.wedge_count(part_graph(spark, sf_dir))


@_register(
    _with(
        "part",
        f", {_UNDIRECTED}, t AS (SELECT count(*) AS triangles FROM u x JOIN u y ON y.a = x.b JOIN u z ON z.a = x.a AND z.b = y.b), w AS (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) AS wedges FROM d) SELECT triangles, wedges, round(3.0 * triangles / CAST(wedges AS DOUBLE), 8) AS transitivity FROM t, w",
    )
)
def triangle_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.triangle_stats(part_graph(spark, sf_dir)).withColumn("transitivity", F.round("transitivity", 8))


@_register()
def triangle_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return structure.triangle_estimate(user_graph(spark, sf_dir), 300, 300)


# Traversals

_ROOT = 5


@_register(_with("part", f", r(id, depth) AS (SELECT CAST({_ROOT} AS BIGINT), 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 3) SELECT id, min(depth) AS depth FROM r GROUP BY id"))
def bfs_depths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.breadth_first(part_graph(spark, sf_dir), [_ROOT], OUT, traverse.Limits(max_depth=3)).select("id", "depth")


@_register(_with("part", f", r(id, depth) AS (SELECT CAST({_ROOT} AS BIGINT), 0 UNION SELECT e.src, r.depth + 1 FROM r JOIN e ON e.dst = r.id JOIN (SELECT dst, count(*) AS n FROM e GROUP BY dst) g ON g.dst = r.id AND g.n < 30 WHERE r.depth < 3) SELECT id, min(depth) AS depth FROM r GROUP BY id"))
def bfs_in_with_degree_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.breadth_first(part_graph(spark, sf_dir), [_ROOT], IN, traverse.Limits(max_depth=3, max_edges=30)).select("id", "depth")


@_register(_with("part", f", p AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS pos FROM e) SELECT id, step FROM (SELECT id, CAST(row_number() OVER (ORDER BY depth, path) - 1 AS INTEGER) AS step FROM (SELECT CAST({_ROOT} AS BIGINT) AS id, 0 AS depth, [CAST(0 AS BIGINT)] AS path UNION ALL SELECT dst, 1, [0, pos] FROM p WHERE src = {_ROOT} AND dst <> {_ROOT})) WHERE step < 8"))
def bfs_order_with_step_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight visits, in order."""
    walked = traverse.breadth_first(part_graph(spark, sf_dir), [_ROOT], OUT, traverse.Limits(max_depth=1, max_steps=8))
    return traverse.in_order(walked).select("id", "step")


@_register(_with("user", ", r(id, depth) AS (SELECT CAST(3 AS BIGINT), 0 UNION ALL SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 1) SELECT id, count(*) AS visits FROM r GROUP BY id"))
def all_paths_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = traverse.all_paths(user_graph(spark, sf_dir), [3], OUT, traverse.Limits(max_depth=1))
    return visits.groupBy("id").agg(F.count("*").alias("visits"))


@_register()
def dfs_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.depth_first(user_graph(spark, sf_dir), [3])


# Walks


@_register()
def random_walk_visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits, _ = walk.personalized_reputation(part_graph(spark, sf_dir), _ROOT, walk.WalkParams(steps=10_000, reset=0.3, max_depth=4))
    return visits


@_register()
def random_walk_top_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, paths = walk.personalized_reputation(part_graph(spark, sf_dir), _ROOT, walk.WalkParams(steps=10_000, reset=0.1, max_depth=4, top_paths=2))
    return paths.select("id", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"), "count", "rank")


def _expected_sql() -> str:
    levels = f", g AS (SELECT src, count(*) AS n FROM e GROUP BY src), l1 AS (SELECT CAST({_ROOT} AS BIGINT) AS id, CAST(1.0 AS DOUBLE) AS x)"
    for k in (2, 3, 4):
        levels += f", l{k} AS (SELECT e.dst AS id, 0.7 * sum(l.x / g.n) AS x FROM l{k - 1} l JOIN e ON e.src = l.id JOIN g ON g.src = l.id GROUP BY e.dst)"
    union = " UNION ALL ".join(f"SELECT * FROM l{k}" for k in (1, 2, 3, 4))
    return levels + f", a AS ({union}), s AS (SELECT id, sum(x) AS x FROM a GROUP BY id) SELECT id, round(x / (SELECT sum(x) FROM s), 8) AS share FROM s"


@_register(_with("part", _expected_sql()))
def expected_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return walk.expected_reputation(part_graph(spark, sf_dir), _ROOT, 0.3, 4).select("id", F.round("share", 8).alias("share"))


_STREAM = "s AS (SELECT event_type AS walk, user_id AS id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS step FROM events)"


def _event_walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql.window import Window

    step = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id")) - 1
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("walk"), F.col("user_id").alias("id"), step.cast("bigint").alias("step"))


@_register(f"WITH {_STREAM} SELECT id, count(*) AS visits FROM s GROUP BY id")
def visit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counters.visit_counts(_event_walks(spark, sf_dir))


@_register(f"WITH {_STREAM}, p AS (SELECT *, lag(id) OVER (PARTITION BY walk ORDER BY step) AS prev FROM s), c AS (SELECT id, prev, count(*) AS count FROM p WHERE prev IS NOT NULL GROUP BY id, prev) SELECT id, prev, count FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY count DESC, prev) AS k FROM c) WHERE k <= 3")
def previous_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the three most frequent predecessors of each node."""
    return counters.previous_counts(counters.with_previous(_event_walks(spark, sf_dir)), top=3)


@_register(
    f"WITH {_STREAM}, m AS (SELECT *, sum(CASE WHEN id < 15 THEN 1 ELSE 0 END) OVER (PARTITION BY walk ORDER BY step) AS leg FROM s), p AS (SELECT id, string_agg(CAST(id AS VARCHAR), ',') OVER (PARTITION BY walk, leg ORDER BY step ROWS UNBOUNDED PRECEDING) AS path FROM m), c AS (SELECT id, path, count(*) AS count FROM p GROUP BY id, path) SELECT id, count(*) AS unique_paths, CAST(sum(count) AS BIGINT) AS paths FROM c GROUP BY id"
)
def path_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths that begin anew at each visit of a home (the users below 15)."""
    return counters.visit_path_totals(_event_walks(spark, sf_dir), range(15))


@_register(f"WITH {_STREAM} SELECT id, max(step) AS info FROM s WHERE walk = 'click' GROUP BY id")
def last_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    visits = _event_walks(spark, sf_dir).where("walk = 'click'").withColumn("info", F.col("step"))
    return counters.keep_info(visits, "info")


# Link analysis


def _pagerank_sql(rounds: int, damping: float = 0.85) -> str:
    out = ", n AS (SELECT count(*) AS n FROM v), g AS (SELECT src, count(*) AS d FROM e GROUP BY src), r0 AS (SELECT id, 1.0 / CAST(n AS DOUBLE) AS r FROM v, n)"
    for k in range(1, rounds + 1):
        out += (
            f", z{k} AS (SELECT coalesce(sum(r), 0) AS z FROM r{k - 1} WHERE id NOT IN (SELECT src FROM g))"
            f", m{k} AS (SELECT e.dst AS id, sum(r.r / g.d) AS m FROM r{k - 1} r JOIN e ON e.src = r.id JOIN g ON g.src = r.id GROUP BY e.dst)"
            f", r{k} AS (SELECT v.id, {1 - damping} / n.n + {damping} * z.z / n.n + {damping} * coalesce(m.m, 0) AS r FROM v CROSS JOIN n CROSS JOIN z{k} z LEFT JOIN m{k} m ON m.id = v.id)"
        )
    return out + f" SELECT id, round(r, 10) AS rank FROM r{rounds}"


@_register(_with("part", _pagerank_sql(10)))
def pagerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linkanalysis.pagerank(part_graph(spark, sf_dir), max_iterations=10, tolerance=0.0)
    return done.table.select("id", F.round("rank", 10).alias("rank"))


@_register(_with("user", _pagerank_sql(3)))
def pagerank_by_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form for graphs that are too large for one task."""
    done = linkanalysis.pagerank(user_graph(spark, sf_dir), max_iterations=3, tolerance=0.0, kernel_edges=0)
    return done.table.select("id", F.round("rank", 10).alias("rank"))


def _hits_sql(rounds: int) -> str:
    out = ", h0 AS (SELECT id, 1.0 / CAST((SELECT count(*) FROM v) AS DOUBLE) AS h FROM v)"
    for k in range(1, rounds + 1):
        out += (
            f", a{k} AS (SELECT v.id, coalesce(sum(h.h), 0) AS a FROM v LEFT JOIN e ON e.dst = v.id LEFT JOIN h{k - 1} h ON h.id = e.src GROUP BY v.id)"
            f", b{k} AS (SELECT v.id, coalesce(sum(a.a), 0) AS b FROM v LEFT JOIN e ON e.src = v.id LEFT JOIN a{k} a ON a.id = e.dst GROUP BY v.id)"
            f", h{k} AS (SELECT id, b / (SELECT max(b) FROM b{k}) AS h FROM b{k})"
        )
    k = rounds
    return out + f" SELECT h.id, round(h.h / (SELECT sum(h) FROM h{k}), 10) AS hub, round(a.a / (SELECT sum(a) FROM a{k}), 10) AS authority FROM h{k} h JOIN a{k} a ON a.id = h.id"


@_register(_with("supplier", _hits_sql(5)))
def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = linkanalysis.hits(supplier_graph(spark, sf_dir), max_iterations=5, tolerance=0.0)
    return done.table.select("id", F.round("hub", 10).alias("hub"), F.round("authority", 10).alias("authority"))


# Centrality


@_register(_with("part", "SELECT v.id, round(count(e.src) / CAST((SELECT count(*) - 1 FROM v) AS DOUBLE), 10) AS centrality FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id"))
def degree_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality.degree_centrality(part_graph(spark, sf_dir), IN).select("id", F.round("centrality", 10).alias("centrality"))


@_register(
    _with(
        "user",
        ", r(root, id, depth) AS (SELECT id, id, 0 FROM v UNION SELECT r.root, e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 6), m AS (SELECT root, id, min(depth) AS depth FROM r GROUP BY root, id), s AS (SELECT root, count(*) AS r, CAST(sum(depth) AS DOUBLE) AS s FROM m GROUP BY root) SELECT root AS id, round(CASE WHEN s = 0 THEN 0 ELSE (r - 1) * (r - 1) / (((SELECT count(*) FROM v) - 1) * s) END, 10) AS centrality FROM s",
    )
)
def closeness_centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centrality.closeness_centrality(user_graph(spark, sf_dir)).select("id", F.round("centrality", 10).alias("centrality"))


# Similarity


def _top_similar_sql(score: str, k: int) -> str:
    return f", s AS (SELECT src AS id, count(*) AS n FROM e GROUP BY src), c AS (SELECT a.src AS id, b.src AS other, count(*) AS c FROM e a JOIN e b ON a.dst = b.dst AND a.src <> b.src GROUP BY a.src, b.src), q AS (SELECT c.id, c.other, round({score}, 8) AS score FROM c JOIN s x ON x.id = c.id JOIN s y ON y.id = c.other), t AS (SELECT *, CAST(row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS INTEGER) AS rank FROM q) SELECT v.id, t.rank, t.other, t.score FROM v LEFT JOIN t ON t.id = v.id AND t.rank <= {k}"


def _rounded(score: similarity.Score) -> similarity.Score:
    return lambda c, a, b: F.round(score(c, a, b), 8)


@_register(_with("part", _top_similar_sql("c.c / (sqrt(CAST(x.n AS DOUBLE)) * sqrt(CAST(y.n AS DOUBLE)))", 5)))
def cosine_top_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.all_most_similar(part_graph(spark, sf_dir), 5, _rounded(similarity.cosine))


@_register(_with("part", _top_similar_sql("c.c / CAST(x.n + y.n - c.c AS DOUBLE)", 5)))
def jaccard_top_similar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.all_most_similar(part_graph(spark, sf_dir), 5, _rounded(similarity.jaccard))


@_register(_with("part", f", s AS (SELECT src AS id, count(*) AS n FROM e GROUP BY src), c AS (SELECT b.src AS other, count(*) AS c FROM e a JOIN e b ON a.dst = b.dst WHERE a.src = {_ROOT} AND b.src <> {_ROOT} GROUP BY b.src) SELECT other, round(c / CAST(s.n + (SELECT n FROM s WHERE id = {_ROOT}) - c AS DOUBLE), 8) AS score FROM c JOIN s ON s.id = other ORDER BY 2 DESC, 1 LIMIT 10"))
def most_similar_to_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.most_similar(part_graph(spark, sf_dir), _ROOT, 10, _rounded(similarity.jaccard))


# Bipartite


@_register("WITH e AS (SELECT DISTINCT l_suppkey AS l, l_partkey AS r FROM lineitem) SELECT (SELECT count(DISTINCT l) FROM e) AS left_nodes, (SELECT count(DISTINCT r) FROM e) AS right_nodes, count(*) AS lr_edges, CAST(0 AS BIGINT) AS rl_edges FROM e")
def bipartite_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = supplier_parts(spark, sf_dir)
    lr = e.select(F.col("left").alias("src"), F.col("right").alias("dst"), F.lit(0).alias("pos"))
    return bipartite.BipartiteGraph(e.select(F.col("left").alias("id")).distinct(), e.select(F.col("right").alias("id")).distinct(), lr, None).counts()


_ANALYZED = "WITH e AS (SELECT DISTINCT l_suppkey AS l, l_partkey AS r FROM lineitem), dl AS (SELECT l, count(*) AS n FROM e GROUP BY l), dr AS (SELECT r, count(*) AS n FROM e GROUP BY r), w0 AS (SELECT l AS id, 1.0 / CAST((SELECT count(*) FROM dl) AS DOUBLE) AS w FROM dl), f1 AS (SELECT e.r, e.l, w0.w / dl.n AS p FROM e JOIN dl ON dl.l = e.l JOIN w0 ON w0.id = e.l), w1 AS (SELECT r AS id, 0.85 * sum(p) AS w FROM f1 GROUP BY r), f2 AS (SELECT e.l, e.r, w1.w / dr.n AS p FROM e JOIN dr ON dr.r = e.r JOIN w1 ON w1.id = e.r), w2 AS (SELECT w0.id, 0.15 * w0.w + 0.85 * sum(p) AS w FROM f2 JOIN w0 ON w0.id = f2.l GROUP BY w0.id, w0.w)"


@_register(_ANALYZED + " SELECT id, round(w, 10) AS weight FROM w2")
def bipartite_link_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = supplier_parts(spark, sf_dir)
    left = e.select(F.col("left").alias("id")).distinct()
    weights = left.crossJoin(left.agg(F.count("*").alias("n"))).select("id", (1.0 / F.col("n")).alias("weight"))  # one row
    got, _ = bipartite.analyze(e, weights, 2, 0.15, 0.15)
    return got.select("id", F.round("weight", 10).alias("weight"))


# Partitions, generators, set and vector functions, dynamic graphs


@_register(_with("part", "SELECT instance, count(*) AS edges, count(DISTINCT src) AS nodes FROM (SELECT src % 4 AS instance, src, dst FROM e UNION SELECT dst % 4, src, dst FROM e) GROUP BY instance"))
def partition_source_and_dest(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = partition.hash_source_and_dest(part_graph(spark, sf_dir, StoredDir.ONLY_OUT), 4).where("nbr is not null")
    return dealt.groupBy(F.col("instance").cast("bigint").alias("instance")).agg(F.count("*").alias("edges"), F.countDistinct("id").alias("nodes"))


@_register(_with("part", "SELECT dst % 4 AS instance, count(*) AS edges FROM e GROUP BY 1"))
def partition_by_dest(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = partition.hash_dest(part_graph(spark, sf_dir, StoredDir.ONLY_OUT), 4)
    return dealt.groupBy(F.col("instance").cast("bigint").alias("instance")).agg(F.count("*").alias("edges"))


@_register()
def partition_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partition.random_nodes(part_graph(spark, sf_dir), 4, 7)


@_register("WITH v AS (SELECT unnest(range(200)) AS id) SELECT a.id AS src, b.id AS dst FROM v a JOIN v b ON a.id <> b.id")
def generate_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.complete(spark, 200).edges.select("src", "dst")


@_register()
def generate_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generate.random_directed(spark, 10_000, 0.001, seed=5).degrees(OUT)


@_register("SELECT round(sqrt(sum((a - b) * (a - b))), 6) AS delta FROM (SELECT l_suppkey, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS b FROM lineitem GROUP BY l_suppkey)")
def vector_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")

    def vector(flag: str) -> DataFrame:
        return lines.where(F.col("l_returnflag") == flag).groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").alias("value"))

    return arrays.delta(vector("R"), vector("A"), 2).select(F.round("delta", 6).alias("delta"))


@_register("SELECT l_suppkey AS id, round(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 10) AS value FROM lineitem GROUP BY l_suppkey")
def vector_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.sum("l_quantity").alias("value"))
    return arrays.scaled(v).select("id", F.round("value", 10).alias("value"))


def _event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of a graph of users and days: sign-ups and views add, errors remove."""
    op = F.when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "purchase", "add_dup").otherwise("add")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), op.alias("op"), F.col("user_id").alias("src"), F.dayofmonth("ts").cast("bigint").alias("dst"))


@_register("SELECT user_id AS src, CAST(day(ts) AS BIGINT) AS dst FROM events WHERE event_type <> 'purchase' GROUP BY 1, 2 HAVING arg_max(event_type, event_id) <> 'error'")
def dynamic_last_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamic.last_state(_event_log(spark, sf_dir))


@_register()
def dynamic_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamic.fold(_event_log(spark, sf_dir)).edges.groupBy("src", "dst").agg(F.count("*").alias("copies"))
