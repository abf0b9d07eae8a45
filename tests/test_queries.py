import os

import pytest

import __spark_entry__ as entry
from graphloom.plans import derive, io_queries, queries  # noqa: F401

SF = "/root/testdata/sf0.001"
HAVE = os.path.isdir(SF)


@pytest.mark.skipif(not HAVE, reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_runs_and_agrees_with_sql(spark, name):
    import duckdb

    got = queries.QUERIES[name](spark, SF).toPandas()
    if name not in queries.SQL:
        assert len(got)
        return
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    want = con.execute(queries.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)

    def rows(df):
        clean = [tuple(None if x != x else round(float(x), 7) if isinstance(x, float) else x for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None)]
        return sorted(clean, key=repr)

    assert rows(got) == rows(want)


@pytest.mark.skipif(not HAVE, reason="needs the driver's tables")
def test_entry(spark):
    ranks = entry.entry(spark).collect()
    assert ranks and sum(r["rank"] for r in ranks) == pytest.approx(1, abs=1e-6)


@pytest.mark.skipif(not HAVE, reason="needs the driver's tables")
def test_top_paths_do_not_derive_the_whole_graph(spark, monkeypatch):
    from graphloom.operators import walk

    tables = []
    monkeypatch.setattr(walk, "written", lambda df, name, f=walk.written: tables.append(name) or f(df, name))
    got = sorted(queries.random_walk_top_paths(spark, SF).collect())
    assert "walk-links" not in tables
    monkeypatch.setattr(derive, "BROADCAST_GROUPS", 0)  # orders are too many
    assert got == sorted(queries.random_walk_top_paths(spark, SF).collect()) and "walk-links" in tables


def test_part_edges_of_given_parts(spark, tmp_path):
    lines = [(o, (o * 5 + k * k) % 23 if (o + k) % 11 else None, k % 3, k) for o in range(40) for k in range(1, 1 + o % 6)]
    lines += [(None, part, 0, k) for k, part in enumerate((3, 4, 3, None, 4, 9, 9, 3))]  # an order too, as for SQL
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    g = derive.part_graph(spark, str(tmp_path))
    everything = sorted(g.links().collect())
    for some in ([3], [4, 9, 17], list(range(23)), [99]):
        ids = spark.createDataFrame([(i,) for i in some], "id bigint")
        want = [r for r in everything if r.id in some]
        assert sorted(g.links_from(ids).collect()) == want and bool(want) == (some != [99])
    assert g.transposed().links_from(ids) is None and g.links_from(ids, queries.IN) is None


def test_each_oracle_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.SQL) <= set(queries.QUERIES)
