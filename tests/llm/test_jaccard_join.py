import random
import re

import numpy as np
import pytest

from graphloom.llm import components as cc
from graphloom.llm import jaccard_join as jj

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, uid int, hashes string, n int, root int")


def shingle_set(t, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows, k, num, den):
    sets = [shingle_set(t, k) for _, t in rows]
    at = list(range(len(rows)))

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                at[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(d, low.get(root(i), d))
    return sorted((d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows))


def fixture(seed, n=25):
    r = random.Random(seed)
    texts = [None, "", " \n", "one", "One", "two words", "two  words", "É é", "a b c", "a b c d"]
    passage = [f"p{i}" for i in range(60)]
    for _ in range(n):
        base = [f"W{r.randrange(500)}" for _ in range(r.randrange(2, 260))]
        if r.random() < 0.3:
            base += passage
        for _ in range(r.randrange(1, 6)):
            w = list(base)
            for _ in range(r.randrange(0, 1 + len(w) // 25)):
                p = r.randrange(len(w))
                w[p : p + r.randrange(2)] = [f"n{r.randrange(50)}"]
            texts.append(" ".join(w))
    texts.append("same text " * 20_000)
    ids = r.sample(range(10_000), len(texts))
    return list(zip(ids, texts))


def test_bounds_of_folded_vectors():
    r = np.random.default_rng(8)
    for _ in range(100):
        a = np.unique(r.integers(0, 2**63, int(r.integers(1, 3000)), dtype=np.uint64))
        b = np.unique(np.concatenate([a[: int(r.integers(0, len(a) + 1))], r.integers(0, 2**63, int(r.integers(1, 900)), dtype=np.uint64)]))
        dims = jj.dims_for(np.array([len(a), len(b)]))
        flat, base = jj.vectors(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), dims)
        d = int(dims.min())
        x, y = jj._folded(flat[: base[1]], d), jj._folded(flat[base[1] :], d)
        assert x.sum() == len(a) and np.minimum(x, y).sum() >= len(np.intersect1d(a, b))


@pytest.mark.parametrize("seed,k,num,den,tile", [(1, 3, 90, 100, 4096), (2, 3, 90, 100, 3), (3, 5, 80, 100, 4096)])
def test_classes(spark, seed, k, num, den, tile):
    rows = fixture(seed)
    got = jj.classes(table(spark, rows).repartition(3), k=k, num=num, den=den, tile_sets=tile).collect()
    assert sorted((r.id, r.n_shingles, r.component) for r in got) == brute(rows, k, num, den)


@pytest.mark.parametrize("tile", [4096, 3])
def test_links(spark, tile):
    base = [f"w{i}" for i in range(60)]
    edit = lambda *at: " ".join("x" if i in at else w for i, w in enumerate(base))
    # Edits at the ends: texts of a chain link with some of the others, those of a clique with all.
    rows = [(1, None), (2, edit()), (3, edit()), *[(10 + i, edit(*range(i))) for i in range(1, 9)], *[(30 + i, edit(59 - i)) for i in range(6)], (50, "a b c")]
    sets = [shingle_set(t, 3) for _, t in rows]
    linked = lambda a, b: a and b and a != b and 100 * len(a & b) >= 90 * len(a | b)
    want = [(i, sum(bool(a) and a == b for b in sets) - bool(a), sum(bool(linked(a, b)) for b in sets)) for (i, _), a in zip(rows, sets)]
    assert len({x[2] for x in want}) > 3
    got = jj.classes(table(spark, rows).repartition(3), k=3, num=90, den=100, tile_sets=tile, links=True).collect()
    assert sorted((r.id, r.copies, r.links) for r in got) == want
    assert sorted((r.id, r.n_shingles, r.component) for r in got) == brute(rows, 3, 90, 100)


def test_empty(spark):
    assert jj.classes(table(spark, [])).count() == 0
    got = jj.classes(table(spark, [(1, "a b c"), (1, "a b c"), (2, None)]), k=3, num=90).collect()
    assert sorted((r.id, r.n_shingles, r.component) for r in got) == [(1, 1, 1), (1, 1, 1), (2, 0, 2)]


def test_linked_sets_share_a_signature():
    r = np.random.default_rng(6)
    for num, den in ((90, 100), (80, 100)):
        for _ in range(300):
            n = int(r.integers(1, 300))
            a = r.integers(0, 2**63, n, dtype=np.uint64)
            cut = int(r.integers(0, 1 + n // 8))
            b = np.concatenate([a[cut:], r.integers(0, 2**63, int(r.integers(0, 1 + n // 12)), dtype=np.uint64)])
            a, b = np.unique(a), np.unique(b)
            both = len(np.intersect1d(a, b))
            if not len(b) or den * both < num * (len(a) + len(b) - both) or (len(a) == len(b) == both):
                continue
            s, at = jj.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), num, den)
            assert len(np.intersect1d(s[: at[1]], s[at[1] :]))


def test_member_lists(monkeypatch):
    import pyarrow as pa

    r = random.Random(9)
    for most in (3, 4096):
        monkeypatch.setattr(jj, "MEMBERS", most)
        for _ in range(50):
            rows = sorted({(r.randrange(12), r.randrange(40)) for _ in range(r.randrange(1, 120))})
            cut = sorted(r.choices(range(len(rows) + 1), k=3))
            parts = [rows[a:b] for a, b in zip([0, *cut], [*cut, len(rows)])]
            batches = [pa.record_batch({"s": pa.array([x for x, _ in p], pa.int64()), "uid": pa.array([y for _, y in p], pa.int64())}) for p in parts]
            by = {}
            for s, u in rows:
                by.setdefault(s, set()).add(u)
            got = [(x, set(m)) for b in jj._member_lists(iter(batches)) for x, m in zip(b.column("list").to_pylist(), b.column("members").to_pylist())]
            assert sorted(sorted(m) for x, m in got if x is not None) == sorted(sorted(m) for m in by.values() if 1 < len(m) <= most)
            long = [m for m in by.values() if len(m) > most]
            for m in long:
                inside = [g for x, g in got if x is None and g <= m]
                assert set().union(*inside) == m and len({min(g) for g in inside}) <= max(1, len(inside))


def test_tree_lets_no_link_go():
    r = np.random.default_rng(7)
    v = r.integers(0, 9, (300, jj.DIMS))
    v[100:200] = np.maximum(v[:100] + r.integers(-1, 2, (100, jj.DIMS)) * (r.random((100, jj.DIMS)) < 0.1), 0)
    n = v.sum(axis=1)
    tree = jj.CountTree(v, n)
    for i in range(300):
        bound = np.minimum(v[i], v).sum(axis=1)
        want = set(np.flatnonzero(bound * 190 >= 90 * (n[i] + n)).tolist())
        assert want <= set(tree.order[tree.near(v[i], int(n[i]), 90, 100)].tolist())


def test_components(spark):
    r = random.Random(8)
    edges = [(i, i + 1) for i in range(200, 300)] + [(r.randrange(60), r.randrange(60)) for _ in range(35)] + [(1000, 1000 + i) for i in range(50)]
    got = {x.node: x.root for x in cc.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    at = {}
    for a, b in edges:
        if a != b:
            at.setdefault(a, {a}), at.setdefault(b, {b})
            if at[a] is not at[b]:
                s = at[a] | at[b]
                for x in s:
                    at[x] = s
    assert set(got) == set(at)
    for x, s in at.items():
        assert {y for y in got if got[y] == got[x]} == s
