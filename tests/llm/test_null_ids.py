"""Null ids, and columns of other tables' names, in every operator that takes documents."""

import public_tokenizers
import pytest

from graphloom.llm import exact_dedup, jaccard_join, language_id, packing, quality, sentence_pieces, sharding, sketches, suffix_dedup

SCHEMA = "doc_id long, text string, lang string, id int, n long, digest string, order string, `group` string"
LONG = "a long passage of words that is repeated in several rows of this small table of documents " * 4


@pytest.fixture(scope="module")
def docs(spark):
    texts = [(None, "same text"), (1, "same text"), (None, "alone here"), (2, None), (None, None), (3, LONG + "x"), (None, "y" + LONG), (4, "z")]
    return spark.createDataFrame([(i, t, "en", 1, 2, "d", "o", "g") for i, t in texts], SCHEMA)


def test_all(spark, docs):
    assert sharding.assign(docs, 4).count() == 8
    assert sketches.fingerprints(docs).count() == 8
    assert sketches.edit_study(docs).count() == 8
    assert packing.packed(docs, public_tokenizers.path("word_bpe_49k.json")).count() >= 8
    assert sentence_pieces.encoded(docs, public_tokenizers.path("piece_bpe_32k.model")).count() == 8
    assert language_id.predicted(docs, language_id.fit(docs)).count() == 8
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classified(docs, labels).collect()
    assert len(got) == 8 and sum(r.perplexity is None for r in got) == 2


def test_copies(docs):
    got = exact_dedup.groups(docs, keep="largest").collect()
    assert sorted((r.id or 0, r.keep_id or 0, r.group_size) for r in got) == sorted([(0, 1, 2), (1, 1, 2), (0, 0, 1), (2, 2, 2), (0, 2, 2), (3, 3, 1), (0, 0, 1), (4, 4, 1)])
    assert sum(r.kept for r in got) == 6
    assert exact_dedup.deduplicated(docs).count() == 6
    got = jaccard_join.classes(docs, k=3, num=90).collect()
    assert sorted((r.id or 0, r.component or 0) for r in got if r.n_shingles == 1) == [(0, 0), (0, 1), (1, 1), (4, 4)]


def test_repeats(docs):
    got = {(r.id, r.n_bytes): [tuple(s) for s in r.spans] for r in suffix_dedup.spans(docs).collect()}
    n = len(LONG)
    assert got[3, n + 1] == [(0, n)] and got[None, n + 1] == [(1, n + 1)]
    assert suffix_dedup.stripped(docs).where("id is null and kept is not null").first().kept == b"y"
    left = suffix_dedup.cleaned(docs)
    assert sorted((r.doc_id or 0, r.text) for r in left.collect() if r.text and len(r.text) < 3) == [(0, "y"), (3, "x"), (4, "z")]


@pytest.fixture(scope="module")
def many(spark):
    """Null ids with one text, null ids with different texts, and one id with different texts, at volume."""
    n = 2000
    rows = [(None, "hot text of six or seven words")] * n + [(None, f"w{i} alone in this row only") for i in range(n)] + [(5, f"v{i} other words of row {i}") for i in range(n)]
    return spark.createDataFrame([(i, t, "en", 1, 2, "d", "o", "g") for i, t in rows], SCHEMA).repartition(4)


def test_many_rows_share_an_id(spark, many):
    n = many.count()
    by = sharding.assign(many, 16).groupBy("shard").agg({"size": "sum", "*": "count"}).collect()
    sizes = [r["sum(size)"] for r in by]
    assert len(by) == 16 and sum(r["count(1)"] for r in by) == n and max(sizes) < 1.03 * min(sizes)
    assert sketches.edit_study(many).count() == n
    got = jaccard_join.classes(many, k=3, num=90).collect()
    assert len(got) == n and all(r.component == r.id for r in got)
    assert jaccard_join.representatives(many).count() == n
    got = exact_dedup.groups(many).collect()
    assert len(got) == n and sum(r.kept for r in got) == n - 1999 and {r.group_size for r in got} == {1, 2000}
    assert exact_dedup.deduplicated(many).count() == n - 1999


def test_pairs_follow_the_table_where_ids_are_equal(spark):
    rows = [(2, "b"), (1, "a"), (None, "n"), (None, "m"), (1, "c")]
    got = sketches.edit_study(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert [r.id for r in sorted(got, key=lambda r: (r.id is None, r.id))] == [1, 1, 2, None, None]


def test_near_copies_with_null_ids(spark):
    words = [f"w{i}" for i in range(80)]
    rows = [(None, " ".join(words)), (None, " ".join(words[1:])), (None, "quite another text"), (7, None), (None, None), (9, " ".join(words[2:]))]
    left = jaccard_join.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, len(r.text or "")) for r in left), key=str) == sorted([(9, len(rows[5][1])), (None, 18), (7, 0), (None, 0)], key=str)
