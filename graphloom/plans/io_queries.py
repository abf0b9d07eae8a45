"""Registered queries of sources, sinks, numberings and single functions, and their SQL.

Queries of files write a derived graph below the shared folder and read it back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import arrays, counters, labels, nodes
from ..graph import GraphDir, PropertyGraph, StoredDir
from ..operators import bipartite, partition, traverse
from ..sources import lines as text_lines
from ..sources import readers, writers
from ..sources.numberers import Numbering
from ..streaming import dynamic
from .derive import part_graph, supplier_graph, supplier_parts, table, user_edges, user_graph
from .queries import IN, OUT, SQL, _event_log, _register, _with
from .storage import remove, scratch

_LIST = "string_agg(CAST({} AS VARCHAR), ',' ORDER BY {})"


def _text(column: str) -> F.Column:
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(column)


def _one_file(df: DataFrame, folder: str, name: str) -> None:
    """The single column of ``df`` as one text file of this name: for the small files of label tables."""
    spark = df.sparkSession
    df.coalesce(1).write.text(f"{folder}/_{name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    part = next(s.getPath() for s in fs.listStatus(path(f"{folder}/_{name}")) if s.getPath().getName().startswith("part-"))
    fs.rename(part, path(f"{folder}/{name}"))
    remove(spark, f"{folder}/_{name}")


# Readers and writers

_EDGES = _with("supplier", "SELECT src, dst FROM e")


@_register(_EDGES)
def adjacency_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacency lists in three files, read back."""
    path = scratch(spark, "adjacency")
    writers.write_graph(supplier_graph(spark, sf_dir), path, chunks=3)
    return readers.read_adjacency(spark, path, "part-")[0].edges.select("src", "dst")


@_register(_with("part", "SELECT v.id, count(e.dst) AS degree FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id"))
def adjacency_files_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in order of id, with isolated nodes; degrees of what is read back."""
    path = scratch(spark, "adjacency")
    writers.write_graph(part_graph(spark, sf_dir), path, chunks=4, sort_by_id=True, separator="\t")
    return readers.read_adjacency(spark, path, "part-", "\t")[0].degrees(OUT)


@_register(_EDGES)
def adjacency_gzip_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed adjacency files."""
    path = scratch(spark, "adjacency")
    lists = supplier_graph(spark, sf_dir).adjacency(OUT)
    lists.repartition(2).select(writers.node_text(" ").alias("value")).write.option("compression", "gzip").text(path)
    return readers.read_adjacency(spark, path, "part-")[0].edges.select("src", "dst")


@_register(_with("supplier", "SELECT 's' || src AS src, 's' || dst AS dst FROM e"))
def adjacency_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacency lists of names, which the reader numbers; shown as names again."""
    path = scratch(spark, "adjacency")
    lists = supplier_graph(spark, sf_dir).adjacency(OUT)
    named = lists.select(F.concat(F.lit("s"), "id").alias("id"), F.transform("nbrs", lambda x: F.concat(F.lit("s"), x)).alias("nbrs"))
    named.repartition(2).select(writers.node_text(" ").alias("value")).write.text(path)
    graph, names = readers.read_adjacency(spark, path, "part-", kind="string")
    return names.decode(names.decode(graph.edges, "src", "a"), "dst", "b").select(F.col("a").alias("src"), F.col("b").alias("dst"))


@_register(_EDGES)
def edge_list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "edges")
    writers.write_graph(supplier_graph(spark, sf_dir), path, adjacency=False, chunks=2)
    return readers.read_edges(spark, path, "part-")[0].edges.select("src", "dst")


@_register(_with("user", "SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS INTEGER) AS pos FROM e"))
def edge_list_without_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line twice; duplicates go and neighbours are sorted."""
    path = scratch(spark, "edges")
    edges = user_edges(spark, sf_dir)
    edges.unionByName(edges).select(F.concat_ws(",", "src", "dst").alias("value")).write.text(path)
    return readers.read_edges(spark, path, "part-", ",", remove_duplicates=True, sort_neighbors=True)[0].edges


@_register(_with("user", f"SELECT v.id, coalesce({_LIST.format('e.dst', 'e.dst')}, '') AS nbrs FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id"))
def edge_list_of_inbound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge list whose first ids own inbound lists (stored as those only)."""
    path = scratch(spark, "edges")
    user_edges(spark, sf_dir).select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)
    graph = readers.read_edges(spark, path, "part-", stored=StoredDir.ONLY_IN, sort_neighbors=True)[0]
    return graph.adjacency(IN).select("id", _text("nbrs"))


@_register(_with("user", "SELECT 'u' || src AS src, 'u' || dst AS dst FROM e"))
def edge_list_of_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "edges")
    user_edges(spark, sf_dir).select(F.concat(F.lit("u"), "src", F.lit(" u"), "dst").alias("value")).write.text(path)
    graph, names = readers.read_edges(spark, path, "part-", kind="string")
    return names.decode(names.decode(graph.edges, "src", "a"), "dst", "b").select(F.col("a").alias("src"), F.col("b").alias("dst"))


@_register(_with("user", "SELECT count(*) AS edges, 3 AS files FROM e"))
def edge_list_in_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An edge list written again in three files."""
    path = scratch(spark, "edges")
    user_edges(spark, sf_dir).select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(f"{path}/all")
    writers.edges_to_chunks(spark, f"{path}/all", f"{path}/cut", 3, "part-")
    return text_lines.lines(spark, f"{path}/cut", "part-").agg(F.count("*").alias("edges"), F.countDistinct("file").cast("int").alias("files"))


@_register("SELECT ',' AS separator")
def sniffed_separator(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "edges")
    user_edges(spark, sf_dir).select(F.concat_ws(",", "src", "dst").alias("value")).write.text(path)
    return spark.range(1).select(F.lit(readers.sniff_separator(spark, path, "part-")).alias("separator"))


@_register("SELECT n_nationkey || ' ' || n_name AS value FROM nation")
def lines_without_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "lines")
    nation = table(spark, sf_dir, "nation").select(F.concat_ws(" ", F.lit(" "), "n_nationkey", "n_name").alias("line"))
    nation.select(F.explode(F.array(F.lit("# a comment"), F.lit("  "), F.col("line"))).alias("value")).write.text(path)
    return text_lines.lines(spark, path, "part-").select("value")


@_register(_with("part", f"SELECT v.id, v.id || ' ' || count(e.dst) || coalesce(chr(10) || string_agg(CAST(e.dst AS VARCHAR), chr(10) ORDER BY e.dst), '') AS text FROM v LEFT JOIN e ON e.src = v.id GROUP BY v.id"))
def node_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return part_graph(spark, sf_dir).adjacency(OUT).select("id", writers.node_text().alias("text"))


@_register(_EDGES)
def binary_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The binary format of compressed sparse rows, in several files, read back."""
    path = scratch(spark, "csr")
    writers.write_csr(supplier_graph(spark, sf_dir), path, nodes_per_file=16)
    return writers.read_csr(spark, path).edges.select("src", "dst")


@_register(_with("part", "SELECT src, dst, CAST(row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS INTEGER) AS pos FROM e"))
def native_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The native store: edges in hash partitions of their source."""
    path = scratch(spark, "native")
    writers.write_parquet(part_graph(spark, sf_dir), path, 8)
    return writers.read_parquet(spark, path).edges


@_register("SELECT 'size' AS name, CAST(p_partkey AS BIGINT) AS id, CAST(p_size AS VARCHAR) AS value FROM part UNION ALL SELECT 'brand', p_partkey, p_brand FROM part")
def label_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of parts as files by name and type, read back as one table."""
    path = scratch(spark, "labels")
    parts = table(spark, sf_dir, "part")
    _one_file(parts.select(F.concat_ws(" ", "p_partkey", "p_size").alias("value")), path, "parts_of_size_int.txt")
    _one_file(parts.select(F.concat_ws(" ", "p_partkey", "p_brand").alias("value")), path, "parts_of_brand_string.txt")
    found = readers.read_labels(spark, path, "parts")
    size, brand = (found[k].select(F.lit(k[0]).alias("name"), "id", F.col("value").cast("string").alias("value")) for k in (("size", "int"), ("brand", "string")))
    return size.unionByName(brand)


# Numberings

_NAMES = "SELECT DISTINCT c_mktsegment || '-' || c_nationkey AS ext FROM customer"


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.concat_ws("-", "c_mktsegment", "c_nationkey").alias("ext"))


@_register(f"SELECT ext, row_number() OVER (ORDER BY ext) - 1 AS id FROM ({_NAMES})")
def numbering_sequential(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Numbering.sequential(_names(spark, sf_dir)).table


@_register("SELECT r_name AS name, count(*) AS nations FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def numbering_explicit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names encoded by a given numbering, counted by number, and decoded."""
    numbers = Numbering.explicit(table(spark, sf_dir, "region").select(F.col("r_name").alias("ext"), (F.col("r_regionkey") * 10).alias("id")))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = numbers.encode(nations.select("r_name"), "r_name", "number").groupBy("number").agg(F.count("*").alias("nations"))
    return numbers.decode(counts, "number", "name").select("name", "nations")


@_register("SELECT c_nationkey || '' AS ext, CAST(c_nationkey * 7 AS BIGINT) AS id FROM customer GROUP BY c_nationkey")
def numbering_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A numbering from lines ``name number``."""
    path = scratch(spark, "numbering")
    keys = table(spark, sf_dir, "customer").select("c_nationkey").distinct()
    keys.select(F.concat_ws(" ", "c_nationkey", F.col("c_nationkey") * 7).alias("value")).write.text(f"{path}/numbers")
    return Numbering.from_file(spark, path, "numbers").table


# Graphs and node-local functions


@_register(_with("supplier", f"SELECT v.id, coalesce({_LIST.format('e.src', 'e.src')}, '') AS nbrs FROM v LEFT JOIN e ON e.dst = v.id GROUP BY v.id"))
def transposed_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    turned = PropertyGraph.from_edges(supplier_graph(spark, sf_dir).transposed().edges.select("src", "dst"))
    return turned.adjacency(OUT).select("id", _text("nbrs"))


@_register(_with("supplier", f"SELECT CAST(7 AS BIGINT) AS id, (SELECT {_LIST.format('dst', 'dst')} FROM e WHERE src = 7) AS out_nbrs, (SELECT {_LIST.format('src', 'src')} FROM e WHERE dst = 7) AS in_nbrs"))
def one_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return supplier_graph(spark, sf_dir).get_node(7).select("id", _text("out_nbrs"), _text("in_nbrs"))


@_register(_with("part", "SELECT count(*) AS entries, CAST(0 AS BIGINT) AS inbound FROM e"))
def stored_directions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph that stores outbound lists shows no inbound ones."""
    g = part_graph(spark, sf_dir, StoredDir.ONLY_OUT)
    return g.links(OUT).agg(F.count("*").alias("entries")).crossJoin(g.links(IN).agg(F.count("*").alias("inbound")))  # one row each


@_register(_with("part", "SELECT 4 + 12 * max(id) + 4 * 2 * (SELECT count(*) FROM e) AS bytes FROM v"))
def storage_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(1).select(F.lit(part_graph(spark, sf_dir).storage_estimate()).cast("bigint").alias("bytes"))


@_register(_with("part", "SELECT (SELECT count(*) FROM e WHERE src = 5) AS out_count, (SELECT count(*) FROM e WHERE dst = 5) AS in_count, CAST(0 AS BIGINT) AS missing"))
def neighbor_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = part_graph(spark, sf_dir)
    n = [nodes.neighbor_count(g, 5, OUT), nodes.neighbor_count(g, 5, IN), nodes.neighbor_count(g, -1, OUT)]
    return spark.range(1).select(*[F.lit(x).cast("bigint").alias(c) for x, c in zip(n, ("out_count", "in_count", "missing"))])


@_register(_with("part", "SELECT id FROM v WHERE id NOT IN (1, 2, 3)"))
def candidates_without_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.without(part_graph(spark, sf_dir).vertices, [1, 2, 3])


@_register(_with("part", "SELECT id FROM v WHERE id NOT IN (SELECT p_partkey FROM part WHERE p_size > 30)"))
def id_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return arrays.difference(part_graph(spark, sf_dir).vertices, table(spark, sf_dir, "part").where("p_size > 30").select(F.col("p_partkey").cast("bigint").alias("id")))


@_register(_with("supplier", "SELECT a.id, count(*) FILTER (WHERE x.dst IS NOT NULL AND y.dst IS NOT NULL) AS both_sides, count(*) FILTER (WHERE x.dst IS NOT NULL OR y.dst IS NOT NULL) AS either_side, count(*) FILTER (WHERE b.id = 3 AND x.dst IS NOT NULL) > 0 AS has_three FROM v a CROSS JOIN v b LEFT JOIN e x ON x.src = a.id AND x.dst = b.id LEFT JOIN e y ON y.dst = a.id AND y.src = b.id GROUP BY a.id"))
def sorted_list_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersection and union of each node's out- and in-list, and membership."""
    g = supplier_graph(spark, sf_dir)
    both = g.adjacency(OUT).withColumnRenamed("nbrs", "a").join(g.adjacency(IN).withColumnRenamed("nbrs", "b"), "id")
    size = lambda c: F.size(c).cast("bigint")
    return both.select("id", size(arrays.sorted_intersection(F.col("a"), F.col("b"))).alias("both_sides"), size(arrays.sorted_union(F.col("a"), F.col("b"))).alias("either_side"), arrays.sorted_exists(F.col("a"), 3).alias("has_three"))


@_register("SELECT CAST(p_partkey AS BIGINT) AS id, CASE WHEN p_size > 25 THEN 'large' ELSE p_brand END AS value FROM part WHERE p_size <> 7")
def label_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label table after new values and removals."""
    parts = table(spark, sf_dir, "part")
    ids = F.col("p_partkey").cast("bigint").alias("id")
    brand = parts.select(ids, F.col("p_brand").alias("value"))
    changed = labels.put(brand, parts.where("p_size > 25").select(ids, F.lit("large").alias("value")))
    return labels.removed(changed, parts.where("p_size = 7").select(ids))


@_register(_with("part", "SELECT id, id IN (SELECT p_partkey FROM part WHERE p_size > 40) AS big FROM v"))
def label_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    big = labels.flag(table(spark, sf_dir, "part").where("p_size > 40").select(F.col("p_partkey").cast("bigint").alias("id")))
    return labels.attached(part_graph(spark, sf_dir).vertices, big, "big", False)


@_register(_with("part", "SELECT id, score FROM (SELECT src AS id, count(*) AS score FROM e GROUP BY src) ORDER BY score DESC, id LIMIT 10"))
def top_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    return counters.top_k(part_graph(spark, sf_dir).degrees(OUT).withColumnRenamed("degree", "score"), 10)


@_register("SELECT o_custkey AS id, o_orderkey AS other, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 2")
def top_two_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: each customer's two largest orders."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("other"), F.col("o_totalprice").alias("score"))
    return counters.top_k_per(rows, 2, "id", "score", "other").select("id", "other", "rank")


# Traversals, bipartite graphs, partitions, dynamic graphs


@_register(_with("supplier", ", r(id, depth) AS (SELECT CAST(7 AS BIGINT), 0 UNION SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 2) SELECT (SELECT count(DISTINCT id) FROM r) AS nodes, (SELECT CAST(max(d) AS INTEGER) FROM (SELECT min(depth) AS d FROM r GROUP BY id)) AS depth"))
def bfs_walk_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    walked = traverse.bfs_walk(supplier_graph(spark, sf_dir), 7, OUT, traverse.Limits(max_depth=2))
    return walked.agg(F.count("*").alias("nodes"), F.max("depth").cast("int").alias("depth"))


@_register(_with("user", ", r(id, depth) AS (SELECT CAST(3 AS BIGINT), 0 UNION ALL SELECT e.dst, r.depth + 1 FROM r JOIN e ON e.src = r.id WHERE r.depth < 1) SELECT id, count(*) AS visits FROM r GROUP BY id"))
def walk_visit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traverse.walk_counts(user_graph(spark, sf_dir), 3, OUT, traverse.Limits(max_depth=1), every_path=True)[0]


_LR = "WITH e AS (SELECT DISTINCT -l_suppkey AS src, l_partkey AS dst FROM lineitem)"


@_register(f"{_LR}, n AS (SELECT src AS id FROM e UNION SELECT dst FROM e) SELECT n.id, count(e.dst) AS degree FROM n LEFT JOIN e ON e.src = n.id GROUP BY n.id")
def bipartite_as_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left ids are shown negated."""
    e = supplier_parts(spark, sf_dir)
    lr = e.select(F.col("left").cast("bigint").alias("src"), F.col("right").cast("bigint").alias("dst"), F.lit(0).alias("pos"))
    both = bipartite.BipartiteGraph(lr.select(F.col("src").alias("id")).distinct(), lr.select(F.col("dst").alias("id")).distinct(), lr, None)
    return both.as_graph().degrees(OUT)


@_register(_with("part", "SELECT CAST(src % 3 AS INTEGER) AS instance, count(DISTINCT src) AS nodes, count(*) AS edges FROM e GROUP BY 1"))
def partition_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A graph split by source into folders of adjacency files, read back by instance."""
    path = scratch(spark, "instances")
    g = PropertyGraph(part_graph(spark, sf_dir).edges.select(F.col("src").alias("id")).distinct(), part_graph(spark, sf_dir).edges, StoredDir.ONLY_OUT)
    partition.split(g, lambda x: partition.hash_source(x, 3), path)
    out = None
    for i in range(3):
        lists = readers.adjacency_lists(spark, f"{path}/instance={i}", "part-")
        one = lists.agg(F.lit(i).alias("instance"), F.count("*").alias("nodes"), F.sum(F.size("edges")).cast("bigint").alias("edges"))
        out = one if out is None else out.unionByName(one)
    return out


_FOLD = """WITH RECURSIVE log AS (
  SELECT user_id AS src, CAST(day(ts) AS BIGINT) AS dst, CASE event_type WHEN 'error' THEN 'remove' WHEN 'purchase' THEN 'add_dup' ELSE 'add' END AS op,
    row_number() OVER (PARTITION BY user_id, day(ts) ORDER BY event_id) AS k FROM events
), f(src, dst, k, n) AS (
  SELECT src, dst, k, CAST(CASE op WHEN 'remove' THEN 0 ELSE 1 END AS BIGINT) FROM log WHERE k = 1
  UNION ALL
  SELECT l.src, l.dst, l.k, CASE l.op WHEN 'remove' THEN greatest(f.n - 1, 0) WHEN 'add_dup' THEN f.n + 1 ELSE greatest(f.n, 1) END FROM f JOIN log l ON l.src = f.src AND l.dst = f.dst AND l.k = f.k + 1
) SELECT src, dst, arg_max(n, k) AS copies FROM f GROUP BY src, dst HAVING arg_max(n, k) > 0"""


SQL["dynamic_fold"] = _FOLD


@_register("SELECT DISTINCT user_id AS src, CAST(day(ts) AS BIGINT) AS dst FROM events")
def dynamic_mutual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mutual graph that only grows: each change is made in both directions; one of them is shown."""
    grown = _event_log(spark, sf_dir).select("seq", F.lit("add").alias("op"), (F.col("src") + 1000).alias("src"), "dst")
    edges = dynamic.fold(grown, StoredDir.MUTUAL).edges
    return edges.where("src >= 1000").select((F.col("src") - 1000).alias("src"), "dst")
