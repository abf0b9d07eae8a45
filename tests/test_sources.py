import gzip

import pytest

from graphloom.graph import GraphDir, PropertyGraph, StoredDir
from graphloom.sources import numberers, readers, writers
from graphloom.streaming import dynamic

G6 = {10: [11, 12, 13], 11: [12, 14], 12: [14], 13: [12, 14], 14: [15], 15: [10, 11]}
OUT = GraphDir.OUT


def lists(g, d=OUT):
    return {r.id: list(r.nbrs) for r in g.adjacency(d).collect()}


def put(path, name, text):
    path.mkdir(exist_ok=True)
    if name.endswith(".gz"):
        with gzip.open(path / name, "wt") as f:
            f.write(text)
    else:
        (path / name).write_text(text)
    return str(path)


def test_adjacency_files(spark, tmp_path):
    d = put(tmp_path / "g", "toy_adj_1.txt", "# a comment\n10 3\n11\n12\n13\n\n11 2\n12\n14\n12 1\n14\n")
    put(tmp_path / "g", "toy_adj_2.txt.gz", "13 2\n12\n14\n14 1\n15\n15 2\n10\n11\n")
    put(tmp_path / "g", "other.txt", "nonsense\n")
    g, numbering = readers.read_adjacency(spark, d, "toy_adj")
    assert lists(g) == G6 and numbering is None
    for bad in ("10 2\n11\n", "10\n11\n"):
        with pytest.raises(Exception, match="lacks|no count"):
            readers.adjacency_lists(spark, put(tmp_path / f"bad{len(bad)}", "x.txt", bad)).count()


def test_string_ids(spark, tmp_path):
    d = put(tmp_path / "s", "g.txt", "a 2\nc\nb\nb 0\nc 1\na\nz 0\n")
    g, n = readers.read_adjacency(spark, d, "g", kind="string")
    names = {r.id: r.ext for r in n.table.collect()}
    assert {names[k]: [names[x] for x in v] for k, v in lists(g).items()} == {"a": ["c", "b"], "b": [], "c": ["a"], "z": []}
    assert sorted(names) == [0, 1, 2, 3]
    assert {r.ext for r in n.decode(g.vertices, "id", "ext").collect()} == {"a", "b", "c", "z"}


def test_edge_files(spark, tmp_path):
    d = put(tmp_path / "e", "list.txt", "# edges\n1 2\n1 3\n2 3\n3 4\n4 1\n1 2\n")
    g, _ = readers.read_edges(spark, d, "list")
    assert lists(g) == {1: [2, 3, 2], 2: [3], 3: [4], 4: [1]}
    g, _ = readers.read_edges(spark, d, "list", remove_duplicates=True)
    assert lists(g)[1] == [2, 3]
    g, _ = readers.read_edges(spark, d, "list", stored=StoredDir.ONLY_IN)
    assert lists(g, GraphDir.IN)[1] == [2, 3, 2] and lists(g)[1] == []
    d = put(tmp_path / "c", "list.txt", "9000000001,b2\n9000000001,a1\nb2,a1\n")
    g, n = readers.read_edges(spark, d, separator=",", kind="string", sort_neighbors=True)
    names = {r.id: r.ext for r in n.table.collect()}
    assert {names[k]: [names[x] for x in v] for k, v in lists(g).items()} == {"9000000001": ["a1", "b2"], "a1": [], "b2": ["a1"]}
    assert readers.sniff_separator(spark, d) == ","
    d = put(tmp_path / "neg", "x.txt", "-5 3\n3 -7\n")
    g, n = readers.read_edges(spark, d)
    assert {r.id for r in g.vertices.collect()} == {-5, 3, -7}
    with pytest.raises(Exception, match="no separator"):
        readers.read_edges(spark, put(tmp_path / "bad", "x.txt", "12\n"))[0].edges.collect()
    with pytest.raises(Exception):
        readers.read_edges(spark, str(tmp_path / "missing"))[0].edge_count()


def test_numberings(spark, tmp_path):
    d = put(tmp_path / "n", "numbering.txt", "alice 3\nbob 1\n")
    n = numberers.Numbering.from_file(spark, d, "numbering.txt")
    ids = spark.createDataFrame([("bob",), ("alice",)], "ext string")
    assert {(r.ext, r.id) for r in n.encode(ids, "ext", "id").collect()} == {("bob", 1), ("alice", 3)}
    with pytest.raises(Exception, match="no number"):
        n.encode(spark.createDataFrame([("eve",)], "ext string"), "ext", "id").collect()
    for text in ("a 1\nb 1\n", "a 1\na 2\n"):
        put(tmp_path / "n", "bad.txt", text)
        with pytest.raises(ValueError):
            numberers.Numbering.from_file(spark, d, "bad.txt")
    seq = numberers.Numbering.sequential(spark.range(5, 1000, 7).selectExpr("id as ext"))
    rows = sorted((r.ext, r.id) for r in seq.table.collect())
    assert [i for _, i in rows] == list(range(len(rows)))


def test_labels(spark, tmp_path):
    d = put(tmp_path / "l", "toy_labels_age_int.txt", "10 5\n11 7\n")
    put(tmp_path / "l", "toy_labels_city_string.txt", "10 new york\n")
    put(tmp_path / "l", "toy_labels_x_double.txt", "10 1.5\n")
    got = readers.read_labels(spark, d, "toy_labels")
    assert sorted(got) == [("age", "int"), ("city", "string")]
    assert {(r.id, r.value) for r in got["age", "int"].collect()} == {(10, 5), (11, 7)}
    assert got["city", "string"].first().value == "new york"


@pytest.mark.parametrize("adjacency", [True, False])
def test_round_trip(spark, tmp_path, adjacency):
    g = PropertyGraph.from_dict(spark, G6)
    path = str(tmp_path / "out")
    writers.write_graph(g, path, adjacency, chunks=2, sort_by_id=True)
    read = readers.read_adjacency if adjacency else readers.read_edges
    assert lists(read(spark, path, "part-")[0]) == G6
    if adjacency:
        first = sorted(r.value for r in spark.read.text(path).collect())
        assert "10 3" in first and len(first) == 17
    again = str(tmp_path / "again")
    if not adjacency:
        writers.edges_to_chunks(spark, path, again, 3, "part-")
        assert lists(readers.read_edges(spark, again, "part-")[0]) == G6


def test_binary_and_parquet(spark, tmp_path):
    g = PropertyGraph.from_dict(spark, {1: [2, 3], 3: [1, 2], 5: [1]})
    writers.write_csr(g, str(tmp_path / "csr"), nodes_per_file=4)
    back = writers.read_csr(spark, str(tmp_path / "csr"))
    assert lists(back) == {1: [2, 3], 2: [], 3: [1, 2], 4: [], 5: [1], 0: []}
    writers.write_parquet(g, str(tmp_path / "pq"), 2)
    assert lists(writers.read_parquet(spark, str(tmp_path / "pq"))) == {1: [2, 3], 2: [], 3: [1, 2], 5: [1]}


LOG = [("add", 1, 2), ("add", 1, 2), ("add_dup", 1, 2), ("remove", 1, 2), ("add", 2, 3), ("remove", 2, 3), ("remove", 9, 9), ("node", 7, None), ("add_dup", 3, 1), ("add", 1, 4)]


def replay(log, mutual=False):
    edges = []
    for op, a, b in log:
        for x, y in ((a, b), (b, a)) if mutual and op != "node" else ((a, b),):
            if op == "add_dup" or (op == "add" and (x, y) not in edges):
                edges.append((x, y))
            elif op == "remove" and (x, y) in edges:
                edges.remove((x, y))
    return sorted(edges)


def test_fold(spark):
    log = spark.createDataFrame([(k, *x) for k, x in enumerate(LOG)], dynamic.LOG)
    for stored in (StoredDir.BOTH_IN_OUT, StoredDir.MUTUAL):
        g = dynamic.fold(log, stored)
        assert sorted((r.src, r.dst) for r in g.edges.collect()) == replay(LOG, stored is StoredDir.MUTUAL)
        assert {r.id for r in g.vertices.collect()} == {1, 2, 3, 4, 7}
    start = PropertyGraph.from_dict(spark, {1: [2, 2], 8: []})
    g = dynamic.fold(log, initial=start)
    assert sorted((r.src, r.dst) for r in g.edges.collect()) == [(1, 2), (1, 2), (1, 4), (3, 1)] and 8 in {r.id for r in g.vertices.collect()}
    simple = log.where("op in ('add', 'remove')")
    assert sorted((r.src, r.dst) for r in dynamic.last_state(simple).collect()) == [(1, 4)]
    assert dynamic.edge_counts(log).first().asDict() == {"nodes": 5, "edges": 3}


def test_stream(spark, tmp_path):
    src = str(tmp_path / "log")
    for k in range(0, len(LOG), 4):
        spark.createDataFrame([(k + i, *x) for i, x in enumerate(LOG[k : k + 4])], dynamic.LOG).coalesce(1).write.mode("append").parquet(src)
    log = spark.readStream.schema(dynamic.LOG).option("maxFilesPerTrigger", 1).parquet(src)
    q = dynamic.stream(log).writeStream.outputMode("update").format("memory").queryName("dyn").start()
    q.processAllAvailable()
    rows = spark.table("dyn").collect()
    q.stop()
    state = {}
    for r in rows:
        state[r.src, r.dst] = r.copies
    want = {}
    for e in replay(LOG):
        want[e] = want.get(e, 0) + 1
    assert {k: v for k, v in state.items() if v} == want
    plain = dynamic.append_only(spark.createDataFrame([(k, *x) for k, x in enumerate(LOG)], dynamic.LOG))
    assert plain.count() == 6
