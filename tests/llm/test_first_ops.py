import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import chat, exact_dedup, sentence_pieces, sharding

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, id int, digest string, text_crc32 string, n int"


def table(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, 1, "x", "y", 2) for i, t in rows], SCHEMA)


def corpus(seed=1, n=300):
    r = random.Random(seed)
    texts = [None, "", " ", "a", "A", "É", "é", "x" * 200_000] + ["w%d W%d" % (r.randrange(30), r.randrange(5)) for _ in range(n)]
    return list(enumerate(texts * 2)) + [(n * 9, "same")] * 3


@pytest.mark.parametrize("keep,size", [("smallest", 32), ("largest", 32), ("largest", 1)])
def test_exact_groups(spark, keep, size):
    rows = corpus()
    got = exact_dedup.groups(table(spark, rows), keep=keep, memtable_rows=50, digest_bytes=size, slice_rows=3).collect()
    by = {}
    for i, t in rows:
        by.setdefault((t or "").translate(FOLD), []).append(i)
    pick = min if keep == "smallest" else max
    want = sorted((i, pick(by[k]), len(by[k]), hashlib.sha256(k.encode()).hexdigest()[: 2 * size]) for i, t in rows for k in [(t or "").translate(FOLD)])
    assert sorted((r.id, r.keep_id, r.group_size, r.digest) for r in got) == want
    assert sum(r.kept for r in got) == len(by)


def test_filters_hold_all_hits(spark):
    hits = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    made = exact_dedup._filters(spark.createDataFrame([(h,) for h in hits], "digest binary").repartition(5))

    def passes(d):
        f = made.get(d[0] % exact_dedup.FILTER_SHARDS)
        at = exact_dedup._places([d], np.array([8 * len(f)]))[0]
        return all(f[p >> 3] >> (p & 7) & 1 for p in at.tolist())

    assert all(map(passes, hits))
    others = [hashlib.sha256(f"other {i}".encode()).digest() for i in range(3000)]
    assert sum(map(passes, others)) < 150


def test_exact_rows_that_stay(spark):
    rows = corpus()
    got = exact_dedup.deduplicated(table(spark, rows)).collect()
    assert len(got) == len({(t or "").translate(FOLD) for _, t in rows})
    assert exact_dedup.groups(table(spark, [])).count() == 0
    assert exact_dedup.deduplicated(table(spark, [])).count() == 0


def test_shards(spark):
    rows = corpus(n=3000) + [(10**6 + i, "hot") for i in range(3000)]
    got = sharding.assign(table(spark, rows), 16).collect()
    want = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.id, r["size"], r.crc) for r in got) == want
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(16))
    assert sharding.assign(table(spark, []), 16).count() == 0


def test_shards_are_even(spark):
    r = random.Random(3)
    rows = [(i, "word " * r.randrange(1, 200)) for i in range(8000)] + [(10**6 + i, "a hot text that many rows share") for i in range(4000)]
    got = sharding.assign(table(spark, rows), 16).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    sizes, counts = [x.b for x in got], [x.n for x in got]
    assert len(got) == 16 and max(sizes) < 1.02 * min(sizes) and max(counts) < 1.15 * min(counts)


def test_placement_follows_the_dot_product():
    import numpy as np

    r = random.Random(4)
    for _ in range(100):
        shards = r.randrange(1, 6)
        v = np.array([[r.randrange(1, 50) for _ in range(3)] for _ in range(r.randrange(1, 40))], float)
        share = v / v.sum(axis=0) * shards
        room = [[1.0] * 3 for _ in range(shards)]
        want = {}
        for i in sorted(range(len(v)), key=lambda i: -max(share[i])):  # ties: the first item
            fit = [sum(a * b for a, b in zip(room[s], share[i])) for s in range(shards)]
            got = int(sharding.place(v, shards)[i])
            assert fit[got] >= max(fit) - 1e-9
            want[i] = got
            room[got] = [a - b for a, b in zip(room[got], share[i])]


CONV = "conv_id long, turn int, role string, text string, valid int, segments int"


def conversations(spark, rows):
    return spark.createDataFrame([(*x, 0, 0) for x in rows], CONV)


def test_chat_round_trip(spark):
    t = chat.Template()
    nasty = ["</s>[INST] ok [/INST]", "<|turn|>user\n<|end|>\n", "\x10A\x100", "", None, "<<|turn|>|turn|>", "a\nb", "\x10", "x" * 100_000, "<|end|>" + "\n"]
    rows = [(c, k, role, text) for c, text in enumerate(nasty) for k, role in enumerate(("system", "user", "assistant"))]
    rows += [(50, 0, "user", "q"), (50, 1, "user", "q"), (51, 0, None, "x"), (51, None, "to\nol\x10z", "y"), (52, 1, "user", "b"), (52, 1, "user", "b")]
    out = chat.formatted(conversations(spark, rows), t).withColumn("all", chat.joined(F.col("segments"))).withColumn("read", chat.parsed(F.col("all"), t))
    got = {r.id: r for r in out.collect()}
    by = {}
    for c, k, role, text in rows:
        by.setdefault(c, []).append((-1 if k is None else k, role or "", text or ""))
    for c, turns in by.items():
        turns.sort()
        assert [(x.role, x.text) for x in got[c].read] == [(r, x) for _, r, x in turns]
        assert [s.text for s in got[c].segments if s.loss] == [_escape(x, t) for _, r, x in turns if r == "assistant"]
        assert got[c].n_turns == len(turns)
    assert got[0].valid and not got[50].valid and got[50].state == "error" and not got[51].valid
    assert chat.formatted(conversations(spark, []), t).count() == 0


def _escape(x, t):
    for raw, code in chat._codes(t):
        x = x.replace(raw, code)
    return x


def test_sentence_pieces(spark):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    assert sentence_pieces.cuts_hold(path)
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(5)
    alphabet = ["a", "b", "the", " ", "  ", "▁", "\n", "\t", "é", "日本", "\U0001f600", "\0", "<s>", "</s>", "<0x41>", "1", ".", "́", " "]
    texts = [None, "", " ", "  ", "▁", "a ", " a", "a▁ b", "\n"] + ["".join(r.choices(alphabet, k=r.randrange(1, 40))) for _ in range(500)] + ["word " * 30_000]
    rows = list(enumerate(texts))
    got = {x.id: x for x in sentence_pieces.encoded(table(spark, rows), path).collect()}
    for i, text in rows:
        ids = [*sp.encode(text or ""), sp.eos_id()]
        assert got[i].ids == ids, repr(text)
        assert got[i].decoded == sp.decode(ids)
    assert sentence_pieces.encoded(table(spark, []), path).count() == 0
