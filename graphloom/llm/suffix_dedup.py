"""Repeated passages by enhanced suffix arrays and their common-prefix intervals.

A suffix array of a whole corpus does not fit in one place, so texts are cut into
pieces such that equal passages meet:

1.  Each window of ``least`` bytes has an *anchor*: the k-gram with the smallest
    hash in it.  Windows with equal bytes have equal anchors at equal offsets,
    and a run of neighbouring windows that share one is a *piece* (with all bytes
    of its windows).  Texts that are equal as a whole are represented once, with
    their number; long texts are cut in parts whose windows follow each other.
2.  Only anchors that occur twice or more can be in a repeated window.  Pieces at
    such anchors are told apart by a digest of their bytes.  A task sends
    different bytes once, with their number, and each occurrence without bytes.
3.  A task sorts all suffixes of the different pieces of whole anchors (by
    doubling the length by which ranks are known), takes the common prefixes of
    neighbours at full length, and scans them with a stack for the interval tree.
    An interval whose occurrences differ in what is on their left is a maximal
    repeat of the pieces; its occurrences are the leaves below it.  A piece that
    occurs twice or more is one by itself.
4.  An anchor with very many occurrences is dealt out by the content of windows:
    its windows are pieces of their own, without other bytes to sort.
5.  The bytes that occurrences of maximal repeats cover are merged and cut out.

A repeat that is longer than the pieces it runs through comes as one group for
each of them, overlapping by ``least`` - 1 bytes or more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import NO_ID, bounded, chunks, id_text, kept, known_ids, lists, release, shown_ids, text_hash, utf8, written
from .shingles import mix, stream

LEAST = 200
K = 32
#: Bytes of text that are hashed at once; longer texts are cut into parts of as many windows.
CHUNK = 1 << 18
#: Bytes of pieces whose suffixes are sorted at once, if they are of several anchors.
SORTED = 1 << 19
#: Occurrences of an anchor beyond which it is dealt out by window content: what one anchor brings to a
#: task is bounded by as many pieces.  The covered bytes are the same.
MANY = 2_000
#: Different pieces that a task remembers before it sends them.
REMEMBERED = 50_000

_BYTE = stream(256, 11)


def kgrams(data: np.ndarray) -> np.ndarray:
    """The hash of the K bytes from each place (the last K-1 places have none)."""
    h, n = _BYTE[data], 1
    while n < K:
        h = h[: len(h) - n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n) + h[n:]
        n *= 2
    return mix(h)


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of x[i:i+w] for each i, by minima from the block borders."""
    n = len(x) - w + 1
    padded = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1 : w - 1 + n])


def runs(data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with a common anchor: row, first window, last window (both as places in
    ``data``), hash of the anchor."""
    sizes = np.diff(offsets)
    none = np.zeros(0, np.int64)
    if len(data) < least or not (sizes >= least).any():
        return none, none, none, none.astype(np.uint64)
    h = kgrams(data)
    places = np.arange(len(h), dtype=np.uint64)
    low = _window_min((h & np.uint64(0xFFFFFFFF00000000)) | places, least - K + 1)
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    starts = np.arange(len(anchor))
    row = np.searchsorted(offsets, starts, side="right") - 1
    valid = starts + least <= offsets[row + 1]
    at, row, anchor = starts[valid], row[valid], anchor[valid]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    return row[first], at[first], at[last], h[anchor[first]]


def _parts(off: np.ndarray, least: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Rows i to j and the bytes x to y of them that are taken together, and the place of x in its row: short
    rows together, rows beyond CHUNK in parts of as many windows (which overlap by ``least`` - 1 bytes)."""
    for i, j in chunks(off, CHUNK):
        x, y = int(off[i]), int(off[j])
        if j > i + 1 or y - x <= 2 * CHUNK:
            yield i, j, x, y, 0
        else:
            for place in range(0, y - x - least + 1, CHUNK):
                yield i, j, x + place, min(x + place + CHUNK + least - 1, y), place


def _bounds(off: np.ndarray, i: int, j: int, x: int, y: int) -> np.ndarray:
    return off[i : j + 1] - x if j > i + 1 else np.array([0, y - x], np.int64)


def _counted(row: np.ndarray, key: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different keys of each row in order, and how often they are there."""
    order = np.lexsort((key, row))
    row, key, times = row[order], key[order], times[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    return row[first], key[first], np.add.reduceat(times, first) if len(first) else times


def _anchors(least: int):
    """For each text: its digest, its size, its anchors and the number of runs of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column("text"))
            pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for i, j, x, y, _ in _parts(off, least):
                row, _, _, key = runs(data[x:y], _bounds(off, i, j, x, y), least)
                pending.append(_counted(row, key, np.ones(len(row), np.int64)))
                if j == i + 1 and y < off[j]:
                    continue  # more parts of this text
                row, key, times = pending[0] if len(pending) == 1 else _counted(*(np.concatenate(x) for x in zip(*pending)))
                pending = []
                cut = off[i : j + 1].tolist()
                digest = [hashlib.sha256(data[p:q]).digest() for p, q in zip(cut, cut[1:])]
                ends = np.searchsorted(row, np.arange(j - i), side="right")
                yield pa.record_batch({"id": b.column("id").slice(i, j - i), "h": b.column("h").slice(i, j - i), "digest": pa.array(digest, pa.binary()), "n_bytes": pa.array(np.diff(off[i : j + 1])), "anchors": lists(key.view(np.int64), ends, pa.int64()), "times": lists(times, ends, pa.int64())})
        release()

    return run


#: What _cut gives: occurrences (uid, place, windows, and c1, c2: the digest of the piece's bytes), repeats that one part
#: shows by itself (uid, place, windows), and different pieces (key to meet by, c1, c2, n: how often, bytes).
CUT = "key long, c1 long, c2 long, uid long, place long, windows long, n long, bytes binary"


def _joined(uid: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges of windows of a text that follow each other or overlap, as one."""
    order = np.lexsort((lo, uid))
    uid, lo, hi = uid[order], lo[order], hi[order]
    top = np.maximum.accumulate(hi + uid * (1 << 40)) - uid * (1 << 40)  # texts are shorter
    new = np.append(True, (uid[1:] != uid[:-1]) | (lo[1:] > top[:-1]))
    first = np.flatnonzero(new)
    return uid[first], lo[first], np.append(top[first[1:] - 1], top[-1])


def _cut(least: int, joined: bool):
    """Pieces at the anchors of ``anchors``; windows at anchors of ``many``.  ``joined``: occurrences that a
    part shows to be repeated come as ranges, where it has several of a piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list] = {}  # digest: key, windows, n, bytes

        def sent() -> pa.RecordBatch:
            c = np.frombuffer(b"".join(table), np.int64).reshape(-1, 2)
            key, windows, n, data = zip(*table.values())
            none = pa.nulls(len(n), pa.int64())
            return pa.record_batch([pa.array(key, pa.int64()), pa.array(c[:, 0]), pa.array(c[:, 1]), none, none, pa.array(windows, pa.int64()), pa.array(n, pa.int64()), pa.array(data, pa.binary())], names=names)

        names = [x.split()[0] for x in CUT.split(", ")]
        for b in batches:
            _, first_row = np.unique(b.column("uid").to_numpy(), return_index=True)
            if len(first_row) < b.num_rows:  # rows that repeat an id and text give the same
                b = b.take(pa.array(np.sort(first_row)))
            data, off = utf8(b.column("text"))
            uids = b.column("uid").to_numpy()
            for i, j, begin, end, base in _parts(off, least):
                at = _bounds(off, i, j, begin, end)
                wanted = np.unique(b.column("anchors").slice(i, j - i).flatten().to_numpy().view(np.uint64))
                many = np.unique(b.column("many").slice(i, j - i).flatten().to_numpy().view(np.uint64))
                row, first, last, key = runs(data[begin:end], at, least)
                split = np.isin(key, many)
                keep = np.isin(key, wanted) & ~split
                raw = data[begin:end].tobytes()
                found: dict[bytes, list[tuple[int, int, int]]] = {}

                def met(r: int, x: int, y: int, k: int | None) -> None:
                    w = raw[x : y + least]
                    c = hashlib.blake2b(w, digest_size=16).digest()
                    found.setdefault(c, []).append((r, x, y))
                    own = table.get(c)
                    if own is None:
                        # Windows of their own meet by content, and no bytes are sorted.
                        table[c] = [int.from_bytes(c[:8], "little", signed=True), y - x + 1, 1, None] if k is None else [k, y - x + 1, 1, w]
                    else:
                        own[2] += 1

                for r, x, y, k in zip(row[keep].tolist(), first[keep].tolist(), last[keep].tolist(), key[keep].view(np.int64).tolist()):
                    met(r, x, y, k)
                for r, x, y in zip(row[split].tolist(), first[split].tolist(), last[split].tolist()):
                    for p in range(x, y + 1):
                        met(r, p, p, None)
                if len(table) >= REMEMBERED:
                    yield sent()
                    table = {}
                once = [(c, *x) for c, hits in found.items() if len(hits) == 1 or not joined for x in hits]
                again = [x for hits in found.values() if len(hits) > 1 for x in hits] if joined else []
                begins = at[:-1] - base
                if once:
                    c = np.frombuffer(b"".join([x[0] for x in once]), np.int64).reshape(-1, 2)
                    r, x, y = (np.array(v, np.int64) for v in list(zip(*once))[1:])
                    none = pa.nulls(len(r), pa.int64())
                    yield pa.record_batch([none, pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(uids[i:j][r]), pa.array(x - begins[r]), pa.array(y - x + 1), none, pa.nulls(len(r), pa.binary())], names=names)
                if again:
                    r, x, y = (np.array(v, np.int64) for v in zip(*again))
                    r, lo, hi = _joined(r, x - begins[r], y + 1 - begins[r])
                    none = pa.nulls(len(r), pa.int64())
                    yield pa.record_batch([none, none, none, pa.array(uids[i:j][r]), pa.array(lo), pa.array(hi - lo), none, pa.nulls(len(r), pa.binary())], names=names)
        if table:
            yield sent()
        table = {}
        release()

    return run


def enhanced_suffix_array(data: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes of the pieces ``data[bounds[k]:bounds[k + 1]]`` that have ``least`` bytes or more, such that
    those with a common prefix are together, and the common prefix of each with the one before (0 for the first).

    Ranks by 8 bytes are doubled until they are unique; the ranks of each round are kept and tell common
    prefixes at full length.  The end of a piece is like nothing else, so no prefix goes beyond it.
    """
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    stop = np.repeat(bounds[1:], np.diff(bounds))
    left = (stop - np.arange(n)).astype(np.int64)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | np.where(left > k, padded[k : n + k], 0).astype(np.uint64)
    h = 8
    order = np.lexsort((np.minimum(left, h), word))
    new = np.ones(n, bool)
    new[1:] = (word[order[1:]] != word[order[:-1]]) | (left[order[1:]] < h) | (left[order[:-1]] < h)
    begins = new
    slot = np.flatnonzero(begins)
    rank = np.empty(n, np.int32)
    rank[order] = np.repeat(slot, np.diff(np.append(slot, n)))
    levels = [(h, rank)]
    while len(slot) < n and h < int(left.max(initial=0)):
        size = np.diff(np.append(slot, n))
        at = np.flatnonzero(np.repeat(size > 1, size))  # slots of what is not alone yet
        own = order[at]
        second = np.where(left[own] > h, rank[np.minimum(own + h, n - 1)].astype(np.int64) + 1, 0)
        both = rank[own].astype(np.int64) * (n + 1) + second
        sort = np.argsort(both, kind="stable")
        own, both = own[sort], both[sort]
        order[at] = own
        h *= 2
        differ = np.ones(len(at), bool)
        differ[1:] = (both[1:] != both[:-1]) | (left[own[1:]] < h) | (left[own[:-1]] < h)
        first = at[np.flatnonzero(differ)]
        rank = rank.copy()
        rank[own] = np.repeat(first, np.diff(np.append(np.flatnonzero(differ), len(at))))
        levels.append((h, rank))
        begins[first] = True
        slot = np.flatnonzero(begins)
    order = order[left[order] >= least]
    a, b = order[:-1], order[1:]
    same = np.zeros(len(a), np.int64)
    room = np.minimum(left[a], left[b]) if n else same
    for h, rank in reversed(levels):
        x, y = np.minimum(a + same, n - 1), np.minimum(b + same, n - 1)
        same += np.where((same < room) & (rank[x] == rank[y]), h, 0)
    x, y = np.minimum(a + same, n - 1), np.minimum(b + same, n - 1)
    differ = np.where(same < room, word[x] ^ word[y], np.uint64(1 << 63)) if n else np.zeros(0, np.uint64)
    extra = np.zeros(len(a), np.int64)
    for k in range(1, 8):
        extra += (differ >> np.uint64(64 - 8 * k)) == 0
    lcp = np.zeros(len(order), np.int64)
    lcp[1:] = np.minimum(same + np.where(same < room, extra, 0), room)
    return order, lcp


def intervals(lcp: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """All intervals (depth, first, last) of suffixes with a common prefix of depth ``least`` or
    more, children before parents, by one scan with a stack."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []
    for place, depth in enumerate([*lcp.tolist(), 0]):
        depth, left = depth if depth >= least else 0, place - 1
        while stack and stack[-1][0] > depth:
            d, left = stack.pop()
            out.append((d, left, place - 1))
        if depth and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))
    return out


def maximal_repeats(pieces: list[bytes], least: int) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The maximal repeats of ``least`` bytes or more of different pieces, as the part of the interval tree
    that is left-diverse: groups (length, parent, suffix: a place in the joined pieces where it occurs) and
    occurrences (group, piece, offset).

    An occurrence is told for the longest group that it belongs to; it is one of all groups above that one
    (parent: -1 for none) as well, so that the whole tree takes no more room than the suffixes.
    """
    bounds = np.cumsum([0, *map(len, pieces)])
    data = np.frombuffer(b"".join(pieces), np.uint8)
    order, lcp = enhanced_suffix_array(data, bounds, least)
    piece = np.searchsorted(bounds, order, side="right") - 1
    inner = order - bounds[piece]
    # What is on the left: a byte, or the beginning of a piece, which is like nothing else.
    near = np.where(inner > 0, data[np.maximum(order - 1, 0)].astype(np.int64), 256 + np.arange(len(order)))
    deep = lcp >= least
    # Of suffixes with a common prefix, those that all go on to the left hold no maximal repeat.
    top = np.flatnonzero(~deep)
    size = np.diff(np.append(top, len(lcp)))
    diverse = size > 1
    if len(top):
        diverse &= np.minimum.reduceat(near, top) != np.maximum.reduceat(near, top)
    groups: list[tuple[int, int, int]] = []
    found: list[tuple[int, int, int]] = []
    for begin, many in zip(top[diverse].tolist(), size[diverse].tolist()):
        local = near[begin : begin + many]
        part = lcp[begin : begin + many].copy()
        part[0] = 0
        own = np.full(many, -1)  # the longest group of each suffix
        above: list[tuple[int, int, int]] = []  # groups without a parent so far: group, lo, hi
        for depth, lo, hi in intervals(part, least):
            seen = local[lo : hi + 1]
            if (seen == seen[0]).all():
                continue
            g = len(groups)
            groups.append((depth, -1, int(order[begin + lo])))
            while above and above[-1][1] >= lo:
                child = above.pop()[0]
                groups[child] = (groups[child][0], g, groups[child][2])
            above.append((g, lo, hi))
            view = own[lo : hi + 1]
            view[view < 0] = g
        for k in np.flatnonzero(own >= 0).tolist():
            found.append((int(own[k]), int(piece[begin + k]), int(inner[begin + k])))
    return groups, found


#: What _repeats gives: of a piece (c1, c2), a repeated range of bytes and the group (g: digest of the repeated bytes) that
#: it is an occurrence of; parent: the group above.
REPEATS = "c1 long, c2 long, lo long, hi long, g binary, parent binary"


def _repeats(least: int):
    def solved(held: list[list]) -> Iterator[tuple]:
        """Of the different pieces (c1, c2, windows, n, bytes) of whole anchors."""
        for c1, c2, windows, n, data in held:
            if n > 1:
                name = hashlib.blake2b(data, digest_size=16).digest() if data is not None else np.array([c1, c2]).tobytes()
                yield c1, c2, 0, windows + least - 1, name, None
        some = [x for x in held if x[4] is not None]
        if len(some) < 2:
            return
        raw = b"".join([x[4] for x in some])
        groups, found = maximal_repeats([x[4] for x in some], least)
        name = [hashlib.blake2b(raw[p : p + n], digest_size=16).digest() for n, _, p in groups]
        for g, k, at in found:
            n, parent, _ = groups[g]
            yield some[k][0], some[k][1], at, at + n, name[g], name[parent] if parent >= 0 else None

    def told(rows: list[tuple]) -> pa.RecordBatch:
        c1, c2, lo, hi, g, parent = zip(*rows)
        return pa.record_batch({"c1": pa.array(c1, pa.int64()), "c2": pa.array(c2, pa.int64()), "lo": pa.array(lo, pa.int64()), "hi": pa.array(hi, pa.int64()), "g": pa.array(g, pa.binary()), "parent": pa.array(parent, pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = []
        size, begin = 0, 0  # begin: where the last anchor begins in ``held``
        last: tuple | None = None
        for b in batches:
            out: list[tuple] = []
            for key, c1, c2, windows, n, data in zip(*(b.column(c).to_pylist() for c in ("key", "c1", "c2", "windows", "n", "bytes"))):
                if last == (key, c1, c2):  # the same piece, from another task
                    held[-1][3] += n
                    continue
                if last is None or last[0] != key:
                    if len(held) - begin == 1 and held[-1][3] == 1:
                        size -= len(held.pop()[4] or b"")  # an anchor with one piece that occurs once
                    if size >= SORTED:
                        out += solved(held)
                        held, size = [], 0
                    begin = len(held)
                last = key, c1, c2
                held.append([c1, c2, windows, n, data])
                size += len(data or b"") + 100
            if out:
                yield told(out)
        if held and (out := list(solved(held))):
            yield told(out)
        held = []
        release()

    return run


def _pieces(df: DataFrame, id_col: str, text_col: str, least: int, many: int, joined: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Rows (id, h, digest, n_bytes), different texts (uid, digest, n), and of these what :func:`_cut` and
    :func:`_repeats` give."""
    if least < K:
        raise ValueError(f"least must be {K} or more")
    rows = known_ids(id_text(df, id_col, text_col)).withColumn("h", text_hash("text"))
    told = kept(rows.mapInArrow(_anchors(least), "id long, h long, digest binary, n_bytes long, anchors array<long>, times array<long>"))
    texts = told.where(F.col("n_bytes") >= least).groupBy("digest").agg(F.min("id").alias("rep"), F.first("h").alias("h"), F.count("*").alias("n"), F.first(F.struct("anchors", "times")).alias("all"))
    texts = written(texts.select("digest", "rep", "h", "n", "all.anchors", "all.times", F.monotonically_increasing_id().alias("uid")), "suffix-texts")
    each = texts.select("uid", F.explode(F.arrays_zip("anchors", "times")).alias("x")).select("uid", F.col("x.anchors").alias("anchor"), "x.times")
    counts = each.groupBy("anchor").agg(F.sum("times").alias("n")).where("n > 1").select("anchor", (F.col("n") > many).alias("is_many"))
    hot = each.join(counts, "anchor").groupBy("uid").agg(F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(F.col("is_many"), F.col("anchor"))).alias("many"))
    wanted = written(hot.join(texts.select("uid", "rep", "h", "digest"), "uid"), "suffix-wanted")
    # Rows that share an id meet their text by its hash; of rows that repeat both, one counts.
    few = rows.join(bounded(wanted.select(F.col("rep").alias("id"), "h").distinct()), ["id", "h"], "left_semi")
    found = few.join(wanted, [few.id == wanted.rep, few.h == wanted.h]).select("uid", "text", "anchors", "many")
    cut = kept(found.mapInArrow(_cut(least, joined), CUT))
    classes = cut.where("n is not null").select("key", "c1", "c2", "windows", "n", "bytes")
    repeats = classes.repartition("key").sortWithinPartitions("key", "c1", "c2").mapInArrow(_repeats(least), REPEATS)
    return told, texts, cut, repeats


def spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, many: int = MANY) -> DataFrame:
    """One row per row of ``df``: id, n_bytes, digest (SHA-256 of the text) and spans, an array of
    lo, hi: the maximal runs of bytes that occurrences of maximal repeats cover, which are those of strings
    of ``least`` bytes that also start elsewhere (in this or another row; overlaps count).

    Null text counts as empty; texts shorter than ``least`` have no spans; copies of a text of that
    size or longer are wholly covered, and so are rows that repeat an id and its text.  Matches never
    cross rows.  Null ids are ids like others.  An empty table gives no rows; other columns of ``df`` are not read.
    """
    return shown_ids(_spans(df, id_col, text_col, least, many)).select("id", "n_bytes", "digest", "spans")


def _spans(df: DataFrame, id_col: str, text_col: str, least: int, many: int = MANY) -> DataFrame:
    """As :func:`spans`, with h (a hash of the text) and NO_ID for null ids."""
    told, texts, cut, repeats = _pieces(df, id_col, text_col, least, many, True)
    # Ranges of different pieces, which are few, go to the places where the pieces occur.
    ranges = repeats.groupBy("c1", "c2").agg(F.collect_set(F.struct("lo", "hi")).alias("ranges"))
    occurs = cut.where("uid is not null and c1 is not null").select("c1", "c2", "uid", "place")
    there = occurs.join(ranges, ["c1", "c2"]).select("uid", F.transform("ranges", lambda r: F.struct((F.col("place") + r["lo"]).alias("lo"), (F.col("place") + r["hi"]).alias("hi"))).alias("runs"))
    sure = cut.where("uid is not null and c1 is null").select("uid", F.array(F.struct(F.col("place").alias("lo"), (F.col("place") + F.col("windows") + (least - 1)).alias("hi"))).alias("runs"))
    covered = there.unionByName(sure).groupBy("uid").agg(F.flatten(F.collect_list("runs")).alias("runs"))
    merged = covered.mapInArrow(_merged, "uid long, spans array<struct<lo:long,hi:long>>")
    by_text = merged.join(texts.select("uid", "digest"), "uid").select("digest", "spans")
    copied = texts.where("n > 1").select("digest", F.lit(True).alias("copied"))
    marked = by_text.join(copied, "digest", "full")
    out = told.select("id", "h", "n_bytes", "digest").join(marked, "digest", "left")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("lo"), F.col("n_bytes").alias("hi")))
    return out.select("id", "h", "n_bytes", "digest", F.when(F.col("copied"), whole).otherwise(F.coalesce("spans", F.expr("cast(array() as array<struct<lo:long,hi:long>>)"))).alias("spans"))


def repeat_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, many: int = MANY) -> DataFrame:
    """The groups of maximal repeats with their occurrences, one row per occurrence: group (a digest of the
    repeated bytes), length, parent (the next longest group whose bytes begin these, or null), id, digest
    (of the text), place.

    An occurrence is listed for the longest group that it belongs to, and is one of the groups above it
    too.  Groups are maximal in the pieces that texts are cut into: see the module's text.  Where a text
    has copies each has the occurrences; a text that is repeated only as a whole has none of its own.
    Null text counts as empty; an empty table gives no rows.
    """
    told, texts, cut, repeats = _pieces(df, id_col, text_col, least, many, False)
    occurs = cut.where("uid is not null").select("c1", "c2", "uid", "place")
    there = occurs.join(repeats, ["c1", "c2"]).select(F.col("g").alias("group"), (F.col("hi") - F.col("lo")).alias("length"), "parent", "uid", (F.col("place") + F.col("lo")).alias("place"))
    by_text = there.join(texts.select("uid", "digest"), "uid").drop("uid").distinct()
    return shown_ids(told.select("id", "digest").join(by_text, "digest").select("group", "length", "parent", "id", "digest", "place"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))
    for b in batches:
        out = []
        for x in b.column("runs").to_pylist():
            flat: list[list[int]] = []
            for lo, hi in sorted((y["lo"], y["hi"]) for y in x):
                if flat and lo <= flat[-1][1]:
                    flat[-1][1] = max(flat[-1][1], hi)
                else:
                    flat.append([lo, hi])
            out.append([{"lo": lo, "hi": hi} for lo, hi in flat])
        yield pa.record_batch({"uid": b.column("uid"), "spans": pa.array(out, kind)})


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = utf8(b.column("text"))
        at, raw = off.tolist(), data.tobytes()
        out = []
        for x, y, cuts in zip(at, at[1:], b.column("spans").to_pylist()):
            left, parts = 0, []
            for c in cuts:
                parts.append(raw[x + left : x + c["lo"]])
                left = c["hi"]
            parts.append(raw[x + left : y])
            out.append(b"".join(parts))
        yield pa.record_batch([pa.array(out, pa.binary()) if c == "kept" else b.column(c) for c in ("id", "n_bytes", "spans", "digest", "kept")], names=["id", "n_bytes", "spans", "digest", "kept"])


def stripped(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """As :func:`spans`, with kept: the remaining bytes where some but not all bytes go, else null
    (nothing goes if there are no spans)."""
    told = written(_spans(df, id_col, text_col, least), "suffix-spans")
    part = (F.size("spans") > 0) & ~((F.size("spans") == 1) & (F.col("spans")[0]["lo"] == 0) & (F.col("spans")[0]["hi"] == F.col("n_bytes")))
    rest = told.where(~part).withColumn("kept", F.lit(None).cast("binary")).drop("h")
    # Rows that repeat an id and text are cut each, by one set of spans.
    some = bounded(written(told.where(part).dropDuplicates(["id", "h"]), "suffix-cut"))
    rows = known_ids(id_text(df, id_col, text_col)).withColumn("h", text_hash("text"))
    cut = rows.join(some, ["id", "h"]).mapInArrow(_kept, "id long, n_bytes long, spans array<struct<lo:long,hi:long>>, digest binary, kept binary")
    return shown_ids(rest.select("id", "n_bytes", "spans", "digest", "kept").unionByName(cut))


@F.arrow_udf(StringType())
def _text_left(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, cuts in zip(text.to_pylist(), spans.to_pylist()):
        raw, left, parts = t.encode(), 0, []
        for c in cuts:
            parts.append(raw[left : c["lo"]])
            left = c["hi"]
        parts.append(raw[left:])
        out.append(b"".join(parts).decode(errors="ignore"))  # a character that was cut in two goes
    return pa.array(out, pa.string())


def cleaned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """``df`` with all its columns, its texts without the bytes of repeated passages.

    Rows go of which nothing but ASCII white space is left; rows without a repeated passage stay as they
    are, null and blank ones too.  Rows are matched by id (null as well) and text.  An empty table gives no rows.
    """
    changed = _spans(df, id_col, text_col, least).where(F.size("spans") > 0).groupBy("id", "h").agg(F.first("spans").alias("__spans"))
    changed = bounded(written(changed.withColumnsRenamed({"id": "__id", "h": "__h"}), "changed-texts"))
    own = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    found = df.join(changed, (own == F.col("__id")) & (text_hash(text_col) == F.col("__h")), "left")
    none = F.expr("cast(array() as array<struct<lo:long,hi:long>>)")
    # Not deterministic to the optimizer: else it copies the call into the filter below, and a task runs two Python workers.
    left = _text_left.asNondeterministic()
    text = F.when(F.col("__spans").isNull(), F.col(f"`{text_col}`")).otherwise(left(F.when(F.col("__spans").isNull(), F.lit("")).otherwise(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), F.coalesce("__spans", none)))
    out = found.withColumn(text_col, text).where(F.col("__spans").isNull() | F.col(f"`{text_col}`").rlike("[^ \\t-\\r]"))
    return out.select(*[f"`{c}`" for c in df.columns])
