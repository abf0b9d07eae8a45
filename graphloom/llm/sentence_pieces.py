"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of the vocabulary has a white-space marker behind another
character, no merge can cross from a character to a following marker.  A text
can then be cut before each run of markers, and each distinct chunk (a marked
word) needs to be segmented once; the ids are joined back by position.  Each
task keeps its table of chunks, emptied when it has reached a fixed size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, id_text, lists, utf8

MARK = "▁"
#: Distinct chunks that a task remembers.
TABLE = 200_000
#: A text is cut where a character other than a marker is followed by a marker, or by a space.
_CUT = re.compile(f"[ {MARK}]*[^ {MARK}]+|[ {MARK}]+")


@lru_cache(maxsize=2)
def _processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def cuts_hold(path: str) -> bool:
    """Whether the model lets texts be cut into marked words: a BPE model without text
    normalisation, with a leading marker, whose pieces have markers at their start only."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.ParseFromString(_processor(path).serialized_model_proto())
    n = m.normalizer_spec
    plain = not n.precompiled_charsmap and n.add_dummy_prefix and not n.remove_extra_whitespaces and n.escape_whitespaces
    user = any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in m.pieces)
    return m.trainer_spec.model_type == pb.TrainerSpec.BPE and plain and not user and not any(re.search(f"[^{MARK}]{MARK}", p.piece) for p in m.pieces)


def _coder(path: str, end: bool, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = _processor(path)
        eos = [sp.eos_id()] if end else []
        table: dict[str, list[int]] = {}
        for b in batches:
            _, off = utf8(b.column("text"))
            for i, j in chunks(off, 4 << 20):
                part = b.slice(i, j - i)
                texts = part.column("text").to_pylist()
                if whole:
                    rows = [ids + eos for ids in sp.encode(texts, num_threads=1)]
                else:
                    # The leading marker that the library adds is that of the first chunk.
                    cut = [_CUT.findall(" " + x) if x else [] for x in texts]
                    if len(table) > TABLE:
                        table.clear()
                    new = list({c for x in cut for c in x if c not in table})
                    # The library marks a chunk itself, so its first space goes; but it doesn't mark an empty one.
                    table.update(zip(new, sp.encode([c[1:] for c in new], num_threads=1)))
                    table[" "] = table[MARK] = [sp.piece_to_id(MARK)]
                    rows = []
                    for x in cut:
                        ids: list[int] = []
                        for c in x:
                            ids += table[c]
                        rows.append(ids + eos)
                said = sp.decode(rows, num_threads=1) if rows else []
                flat = np.fromiter(chain.from_iterable(rows), np.int32, sum(map(len, rows)))
                ends = np.cumsum([len(r) for r in rows])
                yield pa.record_batch({"id": part.column("id"), "ids": lists(flat, ends, pa.int32()), "decoded": pa.array(said, pa.string())})

    return run


def encoded(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", end: bool = True) -> DataFrame:
    """One row per row of ``df``: id, ids (with an end id where ``end``) and decoded (the library's
    text for these ids).  Null text counts as empty and has the end id alone.  Whole texts are used.

    ``model`` is the path of the vocabulary on each machine.  A model whose pieces may cross
    white-space markers is run on whole texts instead.  An empty table gives no rows; other columns
    of ``df`` are not read.
    """
    rows = id_text(df, id_col, text_col)
    return rows.mapInArrow(_coder(model, end, not cuts_hold(model)), "id long, ids array<int>, decoded string")
