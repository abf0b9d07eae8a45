import itertools
import random

import numpy as np
import pytest

from graphloom.llm import packing


def table(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2, 3) for i, t in rows], "doc_id long, text string, row int, tokens string, n int, pieces int")


def path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def texts(seed=1, n=300):
    r = random.Random(seed)
    bits = ["É", "ÇÀ", "Ñandú...", "×", "÷", "straße,", "naïve!?", "x'll", "(a)", "é,", "K", "Hello", "hello,", "don't", "1234", "é", "é", "日本語", "\U0001f600", "\x1c", "\x85", "\xa0", " ", "\t", "\n", "  ", " ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "İ", "Σ", "ς", "a", "́", "!!", "word_1", "\0"]
    out = [None, "", " ", "\n"] + ["".join(r.choices(bits, k=r.randrange(1, 60))) for _ in range(n)]
    return out + ["many words here " * 6000, "x" * 20_000]


def test_tokens_are_those_of_the_library(spark):
    from tokenizers import Tokenizer

    assert packing.words_hold(path())
    t = Tokenizer.from_file(path())
    rows = list(enumerate(texts()))
    got = {r.id: np.frombuffer(r.tokens, "<u2").tolist() for r in packing.tokenized(table(spark, rows), path(), 2).collect()}
    for i, x in rows:
        assert got[i] == [*t.encode(x or "", add_special_tokens=False).ids, 2], repr(x)


@pytest.mark.parametrize("size,lane", [(64, 50), (4096, 200_000)])
def test_packed(spark, monkeypatch, size, lane):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "ROWS_PER_LANE", lane)
    t = Tokenizer.from_file(path())
    rows = list(enumerate(texts(2))) + [(7, "again")] * 2
    got = packing.packed(table(spark, rows).repartition(3), path(), size=size).collect()
    docs, seqs = {}, {}
    for p in got:
        assert len(p.ids) == 4 * p.length > 0
        docs.setdefault(p.id, []).append(p)
        seqs.setdefault(p.sequence, []).append((p.offset, p.length))
    for i, x in rows:
        if i == 7:
            continue
        pieces = sorted(docs[i], key=lambda p: p.start)
        assert [p.start for p in pieces] == [0, *itertools.accumulate(p.length for p in pieces)][:-1]
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(b"".join(p.ids for p in pieces), "<u4").tolist() == ids and pieces[0].n == len(ids)
    assert sorted(p.start for p in docs[7]).count(0) == 3
    for s in seqs.values():
        s.sort()
        total = sum(n for _, n in s)
        assert [o for o, _ in s] == [0, *itertools.accumulate(n for _, n in s)][:-1]
        assert total == size or (total < size and total & (total - 1) == 0)
    assert packing.packed(table(spark, []), path()).count() == 0


def test_fill_is_the_closest():
    r = random.Random(3)
    for _ in range(300):
        room = r.randrange(1, 25)
        counts = [0] + [r.choice([0, 0, 1, 2]) for _ in range(room)]
        sums = {0}
        for length, n in enumerate(counts):
            for _ in range(n):
                sums |= {s + length for s in sums}
        take = packing.best_fill(counts, room)
        assert all(0 < n <= counts[k] for k, n in take.items())
        assert sum(k * n for k, n in take.items()) == max(s for s in sums if s <= room)


def test_plan_holds_each_item_once():
    r = random.Random(4)
    for _ in range(40):
        size = r.choice([8, 16, 64])
        hist = {k: r.randrange(0, 9) for k in range(1, size)}
        rows, windows, loose = packing.plan(hist, size)
        per = {}
        for length, first, n, _, _ in rows.tolist():
            per.setdefault(length, []).append((first, n))
        assert loose + windows * size == sum(k * v for k, v in hist.items())
        for length, x in per.items():
            assert x[0][0] == 0 and [f for f, _ in x] == sorted(f for f, _ in x)
