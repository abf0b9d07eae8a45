from graphloom import examples
from graphloom.graph import PropertyGraph


def test_programs(spark, tmp_path):
    assert examples.hello_graph(spark, 4).first().asDict() == {"nodes": 4, "edges": 12, "stored_edges": 24, "max_id": 3}
    visits = examples.walk_demo(spark, steps=2000)
    assert visits.count() == 10
    assert examples.top_visited(visits, 3).count() == 3
    assert 0 < examples.mutual_share(spark, 60, 10) < 0.5
    sparse = PropertyGraph.from_dict(spark, {5: [90_000], 90_000: [7]})
    assert examples.renumbering_saving(sparse) == 12 * (90_000 - 2)
    examples.write_random(spark, str(tmp_path / "g"), 50, 4, 3)
    g = examples.load_edges(spark, str(tmp_path / "g"), "part-")
    assert g.edge_count() > 100


def test_labels_and_partitions(spark, tmp_path):
    d = tmp_path / "in"
    d.mkdir()
    (d / "toy_1.txt").write_text("1 2\n2\n3\n3 1\n1\n")
    (d / "labels_age_int.txt").write_text("1 44\n")
    assert examples.load_and_label(spark, str(d), "toy", "labels", 1, "age", "int") == 44
    examples.cross_partition(spark, str(d), "toy", str(tmp_path / "parts"), 2)
    assert {r.value for r in spark.read.text(str(tmp_path / "parts/instance=1")).collect()} >= {"1 2", "3 1"}
