import random
from collections import defaultdict

import numpy as np
import pytest

from graphloom.llm import suffix_dedup

SCHEMA = "doc_id long, text string, uid int, digest string, spans int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2) for i, t in rows], SCHEMA)


def brute(texts, least):
    """For each text the covered runs, by a table of all its windows."""
    seen = defaultdict(int)
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for p in range(len(b) - least + 1):
            seen[b[p : p + least]] += 1
    out = []
    for b in raw:
        cover = np.zeros(len(b) + 2, np.int8)
        for p in range(len(b) - least + 1):
            if seen[b[p : p + least]] > 1:
                cover[p + 1 : p + 1 + least] = 1
        edge = np.flatnonzero(np.diff(cover)).reshape(-1, 2)
        out.append([tuple(x) for x in edge.tolist()])
    return out


def fixture(seed, least):
    r = random.Random(seed)
    new = lambda n: "".join(r.choice("abcé\0 ") for _ in range(n))
    shared = [new(least + k) for k in (-5, -1, 0, 1, 50, 400)]
    texts = [None, "", "x" * (least - 1), "y" * least, "z" * 3 * least, "z" * 5 * least, "ab" * 4 * least]
    for _ in range(60):
        texts.append(new(r.randrange(80)).join([""] + r.sample(shared, 2) + [new(50)]))
    texts += [new(3 * least)] * 2 + [new(4000) + shared[-1] + new(10)]
    return list(enumerate(texts)) + [(5000, new(3 * least))] * 2


@pytest.mark.parametrize("seed,many", [(1, 10_000), (2, 3)])
def test_spans(spark, seed, many):
    least = 40
    rows = fixture(seed, least)
    want = brute([t for _, t in rows], least)
    got = suffix_dedup.spans(table(spark, rows).repartition(3), least=least, many=many).collect()
    assert sorted((r.id, [tuple(s) for s in r.spans]) for r in got) == sorted((i, w) for (i, _), w in zip(rows, want))


def test_what_is_kept(spark):
    least = 40
    rows = [x for x in fixture(3, least) if x[0] < 5000]
    want = brute([t for _, t in rows], least)
    got = {r.id: r for r in suffix_dedup.stripped(table(spark, rows), least=least).collect()}
    for (i, t), cuts in zip(rows, want):
        b = (t or "").encode()
        left = b"".join(b[x:y] for x, y in zip([0, *(c[1] for c in cuts)], [*(c[0] for c in cuts), len(b)]))
        r = got[i]
        mine = bytes(r.kept) if r.kept is not None else (b"" if r.spans else b)
        assert mine == left
    assert suffix_dedup.stripped(table(spark, [])).count() == 0


def test_intervals_by_brute_force():
    r = random.Random(4)
    for _ in range(200):
        lcp = np.array([0] + [r.randrange(6) for _ in range(30)])
        want = set()
        for lo in range(len(lcp)):
            for hi in range(lo + 1, len(lcp)):
                d = int(lcp[lo + 1 : hi + 1].min())
                if d >= 2 and lcp[lo] < d and (hi + 1 == len(lcp) or lcp[hi + 1] < d):
                    want.add((d, lo, hi))
        assert sorted(suffix_dedup.intervals(lcp, 2)) == sorted(want)


def joined(pieces):
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([0, *map(len, pieces)])


def some_pieces(r):
    made = {bytes(r.randrange(r.choice((1, 2, 3))) for _ in range(r.randrange(1, 60))) for _ in range(r.randrange(1, 6))}
    base = bytes(r.randrange(2) for _ in range(50))
    made |= {base[r.randrange(10) :] + bytes([r.randrange(3)]) * r.randrange(1, 9) for _ in range(r.randrange(4))}
    return sorted(made, key=lambda _: r.random())


def test_enhanced_suffix_array():
    r = random.Random(5)
    for _ in range(200):
        pieces, least = some_pieces(r), r.randrange(1, 12)
        data, bounds = joined(pieces)
        order, lcp = suffix_dedup.enhanced_suffix_array(data, bounds, least)
        rest = {int(b) + k: p[k:] for b, p in zip(bounds, pieces) for k in range(len(p))}
        assert sorted(order.tolist()) == sorted(at for at, x in rest.items() if len(x) >= least)
        names = [rest[p] for p in order.tolist()]
        for i in range(1, len(names)):
            a, b = names[i - 1], names[i]
            assert lcp[i] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
        # Equal prefixes of least bytes or more are together, so the least of all neighbours' is that of each two.
        for i in range(len(names)):
            for j in range(i + 1, min(len(names), i + 20)):
                a, b = names[i], names[j]
                n = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
                assert n == lcp[i + 1 : j + 1].min() or n < least


def maximal_by_brute_force(pieces, least):
    """Repeated strings whose occurrences can't all be extended by one byte, with all occurrences."""
    where = defaultdict(set)
    for k, p in enumerate(pieces):
        for i in range(len(p)):
            for j in range(i + least, len(p) + 1):
                where[p[i:j]].add((k, i))
    out = {}
    for x, at in where.items():
        if len(at) > 1:
            left = {pieces[k][i - 1] if i else (k, i) for k, i in at}
            right = {pieces[k][i + len(x)] if i + len(x) < len(pieces[k]) else (k, i) for k, i in at}
            if len(left) > 1 and len(right) > 1:
                out[x] = at
    return out


def test_maximal_repeats_by_brute_force():
    r = random.Random(6)
    seen = 0
    for _ in range(300):
        pieces, least = some_pieces(r), r.randrange(1, 12)
        groups, found = suffix_dedup.maximal_repeats(pieces, least)
        raw = b"".join(pieces)
        names = [raw[at : at + n] for n, _, at in groups]
        got = {x: set() for x in names}
        assert len(got) == len(names)
        for g, k, at in found:
            while g >= 0:  # an occurrence of a group is one of those above it
                assert pieces[k][at : at + groups[g][0]] == names[g]
                got[names[g]].add((k, at))
                g = groups[g][1]
        want = maximal_by_brute_force(pieces, least)
        assert got == want
        seen += len(want)
    assert seen > 1000


@pytest.mark.parametrize("many", [2000, 3])
def test_repeat_groups(spark, many):
    least = 40
    rows = [x for x in fixture(7, least) if x[0] < 5000] + [(None, "q" + fixture(7, least)[10][1])]
    raw = {i: (t or "").encode() for i, t in rows}
    got = suffix_dedup.repeat_groups(table(spark, rows).repartition(3), least=least, many=many).collect()
    by, above, named = defaultdict(set), {}, {}
    for x in got:
        name = raw[x.id][x.place : x.place + x.length]
        assert len(name) == x.length >= least and named.setdefault(x.group, name) == name
        by[x.group].add((x.id, x.place))
        above[x.group] = x.parent
    whole = {g: set(at) for g, at in by.items()}
    for g, at in by.items():
        while (g := above.get(g)) is not None:
            whole[g] = whole.get(g, set()) | at
    assert all(len(at) > 1 for at in whole.values())
    # Each repeated window is in an occurrence, and each occurrence is of repeated windows.
    covered = {i: np.zeros(len(b) + 1, bool) for i, b in raw.items()}
    for x in got:
        covered[x.id][x.place : x.place + x.length] = True
    copies = {b for b in raw.values() if list(raw.values()).count(b) > 1}
    for (i, b), want in zip(raw.items(), brute([t for _, t in rows], least)):
        edge = np.flatnonzero(np.diff(np.append(False, covered[i]).astype(np.int8)))
        assert b in copies or [tuple(e) for e in edge.reshape(-1, 2).tolist()] == want
    assert suffix_dedup.repeat_groups(table(spark, [])).count() == 0


def test_long_texts_are_cut_into_parts(spark, monkeypatch):
    least = 40
    monkeypatch.setattr(suffix_dedup, "CHUNK", 100)
    rows = fixture(8, least)
    want = brute([t for _, t in rows], least)
    for batches in (suffix_dedup._parts(np.array([0, 3, 1000, 1100]), least),):
        assert [(i, j, x, y) for i, j, x, y, _ in batches][:3] == [(0, 1, 0, 3), (1, 2, 3, 142), (1, 2, 103, 242)]
    got = suffix_dedup.spans(table(spark, rows).repartition(3), least=least).collect()
    assert sorted((r.id, [tuple(s) for s in r.spans]) for r in got) == sorted((i, w) for (i, _), w in zip(rows, want))


def test_blank_rows_go_when_they_are_what_is_left(spark):
    shared = "many words of a passage " * 12
    rows = [(1, f"\n\t {shared}\r\n"), (2, f"x{shared}"), (3, "\n\n"), (None, f"y{shared}"), (None, "alone"), (1, "else"), (4, None)]
    got = sorted(((r.doc_id, r.text) for r in suffix_dedup.cleaned(table(spark, rows)).collect()), key=str)
    assert got == sorted([(2, "x"), (3, "\n\n"), (None, "y"), (None, "alone"), (1, "else"), (4, None)], key=str)
