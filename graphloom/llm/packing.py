"""Packing of token sequences by minimum bin slack.

A document gives as many full windows as it has room for, and an item of what
remains.  Only the number of items of each length matters for the plan, so the
driver works on a histogram with fewer entries than a window has tokens:

* the largest length left opens a window; a subset-sum dynamic program over a
  bitset finds the multiset of remaining lengths that fills it closest to
  capacity, and going back through the program gives the count of each length;
* the same window is repeated as often as the counts allow;
* a length whose window cannot be filled exactly is set aside.

What was set aside is laid end to end and cut at the window borders, and the
last, partial window is cut into powers of two.  Items find their place by
their rank among the items of their length, which is computed without bringing
a length's items together.
"""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import chunks, id_text, kept, release, utf8, written

#: Words that a task remembers the ids of.
TABLE = 400_000
CHUNK = 1 << 20
#: Items that are numbered in one task, on average.
ROWS_PER_LANE = 200_000


# Tokens ------------------------------------------------------------------------------------------


@lru_cache(maxsize=4)
def _tokenizer(path: str, special: bool = True):
    """The tokenizer as the library has it, or (not ``special``) one that takes the strings of special
    tokens for ordinary text: for words, which may get such a form only by lower-casing."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not special
    return t


@lru_cache(maxsize=2)
def _specials(path: str) -> list[bytes]:
    """The strings that the library takes for special tokens: texts that hold one are encoded whole."""
    return [t.content.encode() for t in _tokenizer(path, False).get_added_tokens_decoder().values()]


def _let_go() -> None:
    """Free the tokenizers at the end of a task: idle workers stay alive."""
    for made in (_tokenizer, _plain_tokenizer, _specials):
        made.cache_clear()
    release()


@lru_cache(maxsize=2)
def words_hold(path: str) -> bool:
    """Whether a text's ids are those of its words, cut at ASCII white space: white space is dropped
    by the pre-tokenizer, and no normaliser looks across it."""
    with open(path) as f:
        spec = json.load(f)
    norm = spec.get("normalizer") or {"type": "Sequence", "normalizers": []}
    norms = norm.get("normalizers", [norm])
    lowers = any(n["type"] == "Lowercase" for n in norms)
    plain = lowers and all(n["type"] in ("NFC", "Lowercase") or (n["type"] == "Replace" and n["pattern"] == {"Regex": "\\s+"} and n["content"] == " ") for n in norms)
    pre = spec.get("pre_tokenizer") or {}
    first = pre.get("pretokenizers", [pre])[0]
    drops = first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") is True
    alternatives = str(first.get("pattern", {}).get("Regex", "")).split("|")
    spaceless = all(a.startswith("'") or a in ("[\\p{L}]+", "[\\p{N}]", "[^\\s\\p{L}\\p{N}]+") for a in alternatives)
    return plain and drops and spaceless and not spec.get("post_processor")


#: ASCII letters and digits; marks that often end a word; white space.
_ALNUM, _MARK, _BLANK = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(97, 123)]] = True
_MARK[list(b".,;:!?")] = True
_BLANK[list(b" \t\n\x0b\x0c\r")] = True
#: Second bytes of the letters U+00DF to U+00FF, after 0xC3.
_ACCENTED = np.zeros(256, bool)
_ACCENTED[[*range(0x9F, 0xB7), *range(0xB8, 0xC0)]] = True
#: A word by itself that is put between words; words that hold it are encoded alone.
_BETWEEN = "\x01"


class _Words(dict):
    """A number for each distinct word, given when it is first looked up, and its ids by number."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []
        self.ids: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n

    def learn(self, path: str, kind: str) -> None:
        for k in range(0, len(self.new), 20_000):
            self.ids += _encoded_words(path, self.new[k : k + 20_000], kind)
        self.new = []


def _lowered(data: np.ndarray) -> np.ndarray:
    """A-Z and their accented forms up to U+00DE in lower case, as the tokenizer has them."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    second = np.zeros(len(data), bool)
    second[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    low[second] += 32
    return low


def _marked_ends(low: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The places of single marks that end a word (or a text) after a plain letter or a digit: there
    the pre-tokenizer cuts as well.  With a space put before them, words are seen again more often."""
    after = np.ones(len(low), bool)
    after[:-1] = _BLANK[low[1:]]
    after[ends[ends > 0] - 1] = True
    before = np.zeros(len(low), bool)
    before[1:] = _ALNUM[low[:-1]]
    before[2:] |= _ACCENTED[low[1:-1]] & (low[:-2] == 0xC3)
    starts = ends[:-1]
    before[starts[starts < len(low)]] = False
    before[starts[starts + 1 < len(low)] + 1] &= _ALNUM[low[starts[starts + 1 < len(low)]]]
    return np.flatnonzero(_MARK[low] & after & before)


def _plain(words: list[bytes]) -> np.ndarray:
    """Which words have lower-case letters up to U+00FF only (of which the normaliser changes none)."""
    data = np.frombuffer(b" ".join(words), np.uint8)
    letter = (data >= 97) & (data <= 122)
    pair = (data[:-1] == 0xC3) & _ACCENTED[data[1:]]
    letter[:-1] |= pair
    letter[1:] |= pair
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(sizes + 1) - sizes - 1
    letter[starts[1:] - 1] = True  # the spaces between
    return np.logical_and.reduceat(letter, starts)


@lru_cache(maxsize=2)
def _plain_tokenizer(path: str):
    """The model of the tokenizer without its normaliser and pre-tokenizer, the byte-level alphabet,
    and for each id whether it ends a pre-token; None if these aren't of the known kind."""
    from tokenizers import Tokenizer, pre_tokenizers

    with open(path) as f:
        spec = json.load(f)
    model = spec["model"]
    pres = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    levels = [p for p in pres if p["type"] == "ByteLevel" and not p["add_prefix_space"] and not p["use_regex"]]
    if model["type"] != "BPE" or len(pres) != 2 or len(levels) != 1 or not model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return None
    # Bytes that print stand for themselves, the others for the code points from 256.
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printed)]
    alphabet = {b: chr(b) for b in printed} | {b: chr(256 + k) for k, b in enumerate(others)}
    del alphabet[32]  # stays between words
    t = Tokenizer(_tokenizer(path, False).model)
    t.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    ends = np.zeros(t.get_vocab_size(), bool)
    for token, k in t.get_vocab().items():
        ends[k] = token.endswith(model["end_of_word_suffix"])
    return t, alphabet, ends


def _encoded_words(path: str, words: list[bytes], kind: str) -> list[bytes]:
    """The ids of each word, by a few calls for all."""
    t, plain = _tokenizer(path, False), _plain_tokenizer(path)
    out: list[bytes | None] = [None] * len(words)
    if plain:
        model, alphabet, ends = plain
        found = np.flatnonzero(_plain(words)).tolist() if words else []
        for k in range(0, len(found), 1000):
            part = found[k : k + 1000]
            text = b" ".join([words[i] for i in part]).decode("latin-1").translate(alphabet)
            ids = np.array(model.encode_batch_fast([text], add_special_tokens=False)[0].ids, kind)
            last = np.flatnonzero(ends[ids]) + 1
            raw, size, left = ids.tobytes(), ids.itemsize, 0
            for i, right in zip(part, last.tolist(), strict=True):
                out[i] = raw[left * size : right * size]
                left = right
    rest = [i for i, x in enumerate(out) if x is None]
    own = t.encode(_BETWEEN, add_special_tokens=False).ids
    texts = [words[i].decode() for i in rest]
    if len(own) != 1 or any(_BETWEEN in x for x in texts):
        for i, e in zip(rest, t.encode_batch_fast(texts, add_special_tokens=False)):
            out[i] = np.array(e.ids, kind).tobytes()
    elif rest:
        ids = np.array(t.encode_batch_fast([f" {_BETWEEN} ".join(texts)], add_special_tokens=False)[0].ids, kind)
        cut = np.flatnonzero(ids == own[0]).tolist()
        raw, size = ids.tobytes(), ids.itemsize
        for i, x, y in zip(rest, [-1, *cut], [*cut, len(ids)], strict=True):
            out[i] = raw[(x + 1) * size : y * size]
    return out


def _holding(raw: bytes, at: np.ndarray, strings: list[bytes]) -> set[int]:
    """The rows that hold one of ``strings``."""
    found = [m.start() for x in strings if x in raw for m in re.finditer(re.escape(x), raw)]
    return set((np.searchsorted(at, found, side="right") - 1).tolist()) if found else set()


def _tokens(path: str, end: int, whole: bool, width: int):
    kind = f"<u{width}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = np.array([end], kind).tobytes()
        table = _Words()
        gc.disable()  # words make no cycles
        for b in batches:
            data, off = utf8(b.column("text"))
            for i, j in chunks(off, CHUNK):
                part, at = data[off[i] : off[j]], off[i : j + 1] - off[i]
                if whole:
                    texts = b.column("text").slice(i, j - i).to_pylist()
                    out = [np.array(e.ids, kind).tobytes() + tail for e in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
                else:
                    special = _holding(part.tobytes(), at, _specials(path))
                    low = _lowered(part)
                    marks = _marked_ends(low, at)
                    raw = np.insert(low, marks, 32).tobytes()
                    bounds = (at + np.searchsorted(marks, at)).tolist()
                    cut = [[] if r in special else raw[x:y].split() for r, (x, y) in enumerate(zip(bounds, bounds[1:]))]
                    if len(table) > TABLE:
                        table = _Words()
                    numbers = [list(map(table.__getitem__, x)) for x in cut]
                    table.learn(path, kind)
                    known = table.ids.__getitem__
                    out = [b"".join(map(known, x)) + tail for x in numbers]
                    for r in special:
                        out[r] = np.array(_tokenizer(path).encode(b.column("text")[i + r].as_py() or "", add_special_tokens=False).ids, kind).tobytes() + tail
                yield pa.record_batch({"id": b.column("id").slice(i, j - i), "n": pa.array([len(x) // width for x in out], pa.int64()), "tokens": pa.array(out, pa.binary())})
        del table
        gc.enable()
        _let_go()

    return run


def token_width(path: str) -> int:
    """Bytes of a stored id: 2 where the whole vocabulary fits."""
    return 2 if _tokenizer(path, False).get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4


def tokenized(df: DataFrame, path: str, end: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, n (tokens) and tokens (little-endian ids of :func:`token_width`
    bytes), each text's ids followed by the id ``end``.  Null counts as empty."""
    rows = id_text(df, id_col, text_col)
    return rows.mapInArrow(_tokens(path, end, not words_hold(path), token_width(path)), "id long, n long, tokens binary")


# Plan --------------------------------------------------------------------------------------------


def best_fill(counts: list[int], room: int) -> dict[int, int]:
    """How many items of each length (of ``counts[length]``) come closest to ``room`` from below."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in range(room, 0, -1):
        most = min(counts[length], room // length)
        if not most:
            continue
        steps.append((length, most, reach))
        left, some = most, 1
        while left:
            some = min(some, left)
            reach |= (reach << (length * some)) & mask
            left -= some
            some *= 2
        if reach >> room & 1:
            break
    best, take = reach.bit_length() - 1, {}
    for length, most, before in reversed(steps):
        n = next(k for k in range(most + 1) if best >= length * k and before >> (best - length * k) & 1)
        if n:
            take[length] = n
            best -= length * n
    return take


def plan(hist: dict[int, int], size: int) -> tuple[np.ndarray, int, int]:
    """Places of items by length and rank, the number of windows, and the tokens that are set aside.

    A row of places: length, first rank, items of this length in the window (0: set aside), first
    window (or the place among what is set aside), first offset.  Rows are in order of length and rank.
    """
    counts = [0] * (size + 1)
    for length, n in hist.items():
        counts[length] = n
    used, rows, aside, windows = [0] * (size + 1), [], [], 0
    top = size - 1
    while top:
        if not counts[top]:
            top -= 1
            continue
        counts[top] -= 1
        take = best_fill(counts, size - top)
        counts[top] += 1
        take[top] = take.get(top, 0) + 1
        if sum(k * v for k, v in take.items()) < size:
            aside.append((top, counts[top]))
            counts[top] = 0
            continue
        times = min(counts[k] // v for k, v in take.items())
        offset = 0
        for length, n in sorted(take.items(), reverse=True):
            rows.append((length, used[length], n, windows, offset))
            used[length] += n * times
            counts[length] -= n * times
            offset += length * n
        windows += times
    place = 0
    for length, n in aside:
        rows.append((length, used[length], 0, place, 0))
        place += length * n
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return table, windows, place


def _placed(sent, size: int):
    """The pieces of each document: start, length, sequence, offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, windows, loose = sent.value
        keys = (table[:, 0] << 44) | table[:, 1]
        full, rest = divmod(loose, size)
        # What is left after the last full window of loose tokens goes into windows of powers of two.
        powers = [1 << p for p in range(rest.bit_length() - 1, -1, -1) if rest >> p & 1]
        edges = np.cumsum([0, *powers]) + full * size
        base = windows + full + len(powers)
        kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("sequence", pa.int64()), ("offset", pa.int64())]))
        for b in batches:
            row, n, rank, before = (b.column(c).to_numpy(zero_copy_only=False) for c in ("row", "n", "rank", "before"))
            out = []
            for n_, rank_, before_ in zip(n.tolist(), rank.tolist(), before.tolist()):
                whole, length = divmod(n_, size)
                pieces = [(k * size, size, base + before_ + k, 0) for k in range(whole)]
                if length:
                    x = table[int(np.searchsorted(keys, (length << 44) | rank_, side="right")) - 1].tolist()
                    if x[2]:
                        w, slot = divmod(rank_ - x[1], x[2])
                        pieces.append((whole * size, length, x[3] + w, x[4] + slot * length))
                    else:
                        at, start, left = x[3] + (rank_ - x[1]) * length, whole * size, length
                        while left:
                            if at < full * size:
                                s, o = divmod(at, size)
                                room, s = size - o, windows + s
                            else:
                                p = int(np.searchsorted(edges, at, side="right")) - 1
                                s, o, room = windows + full + p, at - int(edges[p]), int(edges[p + 1]) - at
                            part = min(left, room)
                            pieces.append((start, part, s, o))
                            at, start, left = at + part, start + part, left - part
                out.append([dict(zip(("start", "length", "sequence", "offset"), p)) for p in pieces])
            yield pa.record_batch({"row": pa.array(row, pa.int64()), "pieces": pa.array(out, kind)})

    return run


def places(sizes: DataFrame, size: int) -> DataFrame:
    """row, pieces of all documents of ``sizes`` (row: unique; n: tokens, 1 or more), in sequences of
    ``size`` tokens; shorter ones have a power of two."""
    spark = sizes.sparkSession
    rest = F.col("n") % size
    hist = {r["rest"]: r["count"] for r in sizes.groupBy(rest.alias("rest")).count().collect()}  # size rows at most
    rows = sum(hist.values())
    hist.pop(0, None)
    sent = spark.sparkContext.broadcast(plan(hist, size))
    lanes = max(1, rows // ROWS_PER_LANE)
    items = sizes.select("row", "n", rest.alias("rest"), F.pmod(F.xxhash64("row"), F.lit(lanes)).alias("lane"), F.floor(F.col("n") / size).alias("whole"))
    earlier = Window.unboundedPreceding, -1
    counted = items.groupBy("rest", "lane").agg(F.count("*").alias("count"), F.sum("whole").alias("whole"))
    counted = kept(counted)
    by_rest = counted.select("rest", "lane", F.coalesce(F.sum("count").over(Window.partitionBy("rest").orderBy("lane").rowsBetween(*earlier)), F.lit(0)).alias("rank_base"))
    # Full windows: their number in the lanes before, and in the lengths before within a lane.
    lane_sums = counted.groupBy("lane").agg(F.sum("whole").alias("whole")).withColumn("all", F.lit(0))
    lane_base = lane_sums.select("lane", F.coalesce(F.sum("whole").over(Window.partitionBy("all").orderBy("lane").rowsBetween(*earlier)), F.lit(0)).alias("lane_base"))
    in_lane = counted.select("rest", "lane", F.coalesce(F.sum("whole").over(Window.partitionBy("lane").orderBy("rest").rowsBetween(*earlier)), F.lit(0)).alias("whole_base"))
    base = by_rest.join(in_lane, ["rest", "lane"]).join(lane_base, "lane")
    own = Window.partitionBy("rest", "lane").orderBy("row")
    ranked = items.withColumn("inner", F.row_number().over(own) - 1).withColumn("run", F.coalesce(F.sum("whole").over(own.rowsBetween(*earlier)), F.lit(0)))
    found = ranked.join(base, ["rest", "lane"]).select("row", "n", (F.col("rank_base") + F.col("inner")).cast("long").alias("rank"), (F.col("lane_base") + F.col("whole_base") + F.col("run")).cast("long").alias("before"))
    return found.mapInArrow(_placed(sent, size), "row long, pieces array<struct<start:long,length:long,sequence:long,offset:long>>")


def _sliced(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("id", "n", "start", "length", "sequence", "offset", "ids")
        for b in batches:
            ids, n = b.column("id").to_pylist(), b.column("n").to_pylist()
            rows, size = [], 0
            for i, m, tokens, pieces in zip(ids, n, b.column("tokens"), b.column("pieces").to_pylist()):
                wide = np.frombuffer(tokens.as_buffer(), f"<u{width}").astype("<u4").tobytes()
                for p in pieces:
                    x = wide[4 * p["start"] : 4 * (p["start"] + p["length"])]
                    rows.append((i, m, p["start"], p["length"], p["sequence"], p["offset"], x))
                size += len(wide)
                if size > 4 << 20:
                    yield pa.record_batch([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, zip(*rows))], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.record_batch([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, zip(*rows))], names=names)
        release()

    return run


def packed(df: DataFrame, path: str, end: int = 2, size: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: id, n (tokens of its document), start, length, sequence, offset and ids (the
    piece's tokens as little-endian 32-bit numbers).

    Each document (null text: empty) is its text's ids and the id ``end``; every token is in one
    piece.  Sequences have ``size`` tokens, but for some of powers of two, so none needs padding.
    Repeated rows are documents of their own.  An empty table gives no rows; other columns of ``df``
    are not read.
    """
    tokens = written(tokenized(df, path, end, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pack-tokens")
    where = places(tokens.select("row", "n"), size)
    joined = tokens.join(where, "row").select("id", "n", "tokens", "pieces")
    return joined.mapInArrow(_sliced(token_width(path)), "id long, n long, start long, length long, sequence long, offset long, ids binary")
