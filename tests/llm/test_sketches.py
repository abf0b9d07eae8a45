import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import sketches


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], "doc_id long, text string, range int, halo string, hashes int")


def fixture(seed=1, n=60):
    r = random.Random(seed)
    texts = [None, "", "  ", "one", "é ü", "a b c d e", "a b c d e"] + [" ".join(f"w{r.randrange(400)}" for _ in range(r.randrange(1, 300))) for _ in range(n)] + ["long word " * 30_000]
    rows = list(enumerate(texts))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("per", [1, 7, 4096])
def test_edit_study(spark, monkeypatch, per):
    monkeypatch.setattr(sketches, "ROWS_PER_RANGE", per)
    rows = fixture()
    got = {r.id: r for r in sketches.edit_study(table(spark, rows)).collect()}
    order = sorted(rows)
    assert len(got) == len(rows)
    for (i, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        t, nxt = t or "", nxt or ""
        n = len(t) // 2
        changed = t[: len(t) - n] + nxt[:n]
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        own, new, far = sketches.sketch(pa.array([t, changed, nxt]))
        assert got[i].fingerprint == sketches.text_of(own) and got[i].edited_fingerprint == sketches.text_of(new)
        assert got[i].near_edited == sketches.containment(own, new) and got[i].near_next == sketches.containment(own, far)
    assert sketches.edit_study(table(spark, [])).count() == 0


def test_repeated_rows(spark):
    got = sketches.edit_study(table(spark, [(1, "a b c"), (1, "a b c"), (2, "d")])).collect()
    assert sorted((r.id, r.near_next) for r in got) == [(1, 0.0), (1, 1.0), (2, 0.0)]
    alone = sketches.edit_study(table(spark, [(5, "a b c d")])).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0


def test_containment_is_near_the_truth():
    r = random.Random(2)
    for _ in range(20):
        small = [f"w{r.randrange(10**6)}" for _ in range(400)]
        cut = r.randrange(400)
        large = small[:cut] + [f"v{r.randrange(10**6)}" for _ in range(8000)]
        a, b = sketches.sketch(pa.array([" ".join(small), " ".join(large)]))
        assert abs(sketches.containment(a, b) - cut / 400) < 0.2


def test_sketches_merge(spark):
    rows = [(1, "a b c d e f g h i j"), (2, "k l m n o p q r s t")]
    prints = sketches.fingerprints(table(spark, rows), fraction=1.0)
    whole = sketches.merged(prints.withColumn("all", F.lit(1)), "all", 1.0).first().hashes
    assert sorted(whole) == sorted(x for r in prints.collect() for x in r.hashes)
    one = sketches.fingerprints(table(spark, rows[:1]), fraction=1.0).first().hashes
    assert np.array_equal(np.sort(np.array(one)), np.array(sorted(one)))


def _signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


@pytest.mark.parametrize("fraction", [0.25, 0.02, 0.75])
def test_merged_sketch_is_that_of_the_union(spark, fraction):
    r = random.Random(6)
    pairs = [[" ".join(f"w{r.randrange(500)}" for _ in range(n)) for n in (4 + r.randrange(3), r.choice((3, 8, 60)))] for _ in range(120)]
    rows = [(g, t) for g, p in enumerate(pairs) for t in p]
    prints = sketches.fingerprints(table(spark, rows), fraction=fraction)
    got = {x.id: x.hashes for x in sketches.merged(prints, "id", fraction).collect()}
    for g, p in enumerate(pairs):
        hashes = np.unique(np.concatenate([sketches.shingles(*sketches.words(*sketches.utf8(pa.array([t]))), sketches.WORDS)[0] for t in p]))
        low = hashes[hashes < sketches._limit(fraction)]
        assert got[g] == [_signed(int(x)) for x in (low if len(low) else hashes[:1])]


def test_containment_of_columns(spark):
    r = random.Random(7)
    texts = ["a b c d e", "x", ""] + [" ".join(f"w{r.randrange(60)}" for _ in range(r.randrange(1, 90))) for _ in range(30)]
    t = sketches.fingerprints(table(spark, list(enumerate(texts))))
    found = t.alias("x").join(t.alias("y"), F.col("x.id") <= F.col("y.id")).select(F.col("x.id").alias("i"), F.col("y.id").alias("j"), sketches.contained(F.col("x.hashes"), F.col("y.hashes")).alias("c"))
    own = sketches.sketch(pa.array(texts))
    for row in found.collect():
        assert row.c == sketches.containment(own[row.i], own[row.j])
