import random
import re

import numpy as np
import pytest

import corpus_pipeline
from graphloom.llm import suffix_dedup

SYLLABLES = ["the", "ing", "th", "er", "ly", "on", "re", "an", "ed"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid int, n int"


def prose(r, n):
    return " ".join("".join(r.choices(SYLLABLES, k=r.randrange(2, 5))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(1)
    clean = [prose(r, r.randrange(60, 200)) for _ in range(300)]
    passage = prose(r, 80)
    near = [" ".join(w if k != 10 * i + 5 else "changed" for k, w in enumerate(clean[7].split())) for i in range(4)]
    texts = clean + [clean[3].upper(), clean[3], clean[3]] + near + [f"{prose(r, 50)} {passage} {prose(r, 50)}" for _ in range(6)]
    texts += ["".join(r.choices("!#%&XYZQ ", k=300)) for _ in range(15)] + [None, "", " "]
    rows = [(i, t, "en", "s", len(t or ""), 1, 2) for i, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("data"))
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(300)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path, texts, passage


def test_stages(spark, corpus):
    path, texts, passage = corpus
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = corpus_pipeline.written(stage(spark, docs, path), "test-stage")
        assert docs.columns == before, name
        kept.append({r.doc_id: r.text for r in docs.collect()})
    quality, exact, near, suffix = kept
    assert len(set(range(300)) & set(quality)) >= 295 and not {i for i, t in enumerate(texts) if i >= 313} & set(quality)
    folded = {i: t.lower() for i, t in quality.items()}
    assert set(exact) == {max(j for j in folded if folded[j] == t) for t in set(folded.values())}
    assert len({7, 303, 304, 305, 306} & set(near)) == 1 and len(near) >= len(exact) - 4
    assert all(passage[10:-10] not in t for t in suffix.values())
    assert all(suffix[i] == near[i] for i in near if i < 300 and passage not in near[i])
    assert all(len(t) == n for t, n in ((r.text, r.n_chars) for r in docs.collect()))

    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert {p.doc_id for p in pieces} == set(suffix)
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(corpus_pipeline.tokenizer("word_bpe_49k.json"))
    by = {}
    for p in sorted(pieces, key=lambda p: p.start):
        by[p.doc_id] = by.get(p.doc_id, b"") + bytes(p.ids)
    for i, x in suffix.items():
        assert np.frombuffer(by[i], "<u4").tolist() == [*t.encode(x, add_special_tokens=False).ids, 2]


def test_run_gives_the_last_stage(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert out.columns[:3] == ["doc_id", "start", "length"] and out.count() > 250


def test_cleaned_cuts_no_character_in_two(spark):
    shared = "é" * 120
    rows = [(1, f"aé{shared}b", "en", "s", 0, 1, 2), (2, f"cé{shared}d", "en", "s", 0, 1, 2), (3, "alone", "en", "s", 0, 1, 2), (3, shared, "en", "s", 0, 1, 2), (4, None, None, None, None, None, None)]
    got = sorted((r.doc_id, r.text or "") for r in suffix_dedup.cleaned(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(1, "ab"), (2, "cd"), (3, "alone"), (4, "")]
    assert re.fullmatch("[a-z]+", got[0][1])
