"""N-gram Jaccard join with count-vector R-trees.

A text's set is that of its distinct word shingles.  Two texts link when
``den * intersection >= num * union``.

Shingles are hashed into groups.  Equal sets are one point.  To bring near
points together on a cluster, sizes are cut into bands and each band has so many
groups that two linked sets must have equal contents in some of them; each set
sends a signature per group, for its band and the next one.  Sets that share a
signature and whose count vectors let them link form clusters.

The counts per group are points of an R-tree, within a signature's members and
within a cluster.  The overlap of
two sets is at most the sum of their coordinate minima, and the same holds for
a point and the upper corner of a node, so whole nodes are set aside; pairs
that survive are verified on their shingles, unless they are connected already.
Clusters that are large are cut into tiles, which are joined pair by pair where
they are not connected as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, chunks, id_text, kept, known_ids, lists, release, shown_ids, text_hash, utf8, without, written
from .components import components
from .shingles import lower_ascii, mix, shingles, words

CHUNK = 1 << 20
#: Coordinates of a count vector: a power of two, so many at least, and one for so many shingles.
DIMS, PER_DIM = 64, 8
FANOUT = 16
#: Shingles (of all sets together) and sets that one tile holds on average.
TILE_SHINGLES, TILE_SETS = 2_000_000, 4096


def bands(num: int, den: int, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least size of each band up to size ``top`` (and two beyond), its number of groups (0 if only
    equal sets link) and the number of groups in which linked sets are equal at least.

    Linked sets are in the same band or in neighbouring ones, and differ in ``differ`` shingles at most,
    so all but as many groups are equal.  There are enough of these that some will have contents: more
    than the groups that are empty by chance.
    """
    least = [1]
    while least[-1] <= top or len(least) < 3:
        least.append(max(least[-1] + 1, -(-least[-1] * den // num)))
    least += [max(least[-1] + 1, -(-least[-1] * den // num))]
    groups, equal = [], []
    for k, above in enumerate(least[1:]):
        differ = (den - num) * 2 * (above - 1) // (den + num)
        smallest, extra = least[max(0, k - 1)], 2
        for _ in range(3):
            empty = (differ + extra) * np.exp(-smallest / (differ + extra))
            extra = 2 + int(np.ceil(empty + 5 * np.sqrt(empty)))
        groups.append(differ + extra if differ else 0)
        equal.append(extra)
    return np.array(least[:-1]), np.array(groups), np.array(equal)


def sets_of(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of each row in order, and each row's first one (with the end)."""
    h, bounds = shingles(*words(lower_ascii(data), offsets), k)
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((h, row))
    h = h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(bounds)))


def digests(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits for each set."""
    out = []
    for seed in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(mix(h ^ np.uint64(seed)), out=total[1:])
        out.append((total[bounds[1:]] - total[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def signatures(h: np.ndarray, bounds: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """All signatures of each set, and each set's first one (with the end)."""
    sizes = np.diff(bounds)
    least, groups, equal = bands(num, den, int(sizes.max(initial=1)))
    row = np.repeat(np.arange(len(sizes)), sizes)
    own = np.searchsorted(least, sizes, side="right") - 1
    found, owner = [], []
    for up in (0, 1):
        band = np.maximum(own, 0) + up
        n = np.where(sizes > 0, groups[band], 0)
        base = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=base[1:])
        take = n[row] > 0
        x, r = h[take], row[take]
        slot = base[r] + ((x >> np.uint64(16)) % n[r].astype(np.uint64)).astype(np.int64)
        total = np.zeros(int(base[-1]), np.uint64)
        np.add.at(total, slot, mix(x ^ np.uint64(0x2545F4914F6CDD1D)))
        empty = np.bincount(slot, minlength=len(total)) == 0
        set_of = np.repeat(np.arange(len(n)), n)
        # If the equal groups of linked sets are all empty, both have that many empty groups or more, and the
        # first one in common is among the first of each that are sent here.
        spare = np.bincount(set_of[empty], minlength=len(n)) - equal[band] + 1
        before = np.cumsum(empty) - empty
        nth = before - before[np.minimum(base[set_of], len(before) - 1)] if len(before) else before
        keep = ~empty | (nth < spare[set_of])
        place = np.arange(len(total)) - base[set_of]
        tag = mix((band[set_of] * 1_000_003 + place).astype(np.uint64))
        found.append(mix(total ^ tag)[keep])
        owner.append(set_of[keep])
    value, who = np.concatenate(found), np.concatenate(owner)
    order = np.argsort(who, kind="stable")
    return value[order].view(np.int64), np.searchsorted(who[order], np.arange(len(sizes) + 1))


class CountTree:
    """An R-tree, packed bottom-up, over count vectors; leaves and nodes hold FANOUT entries."""

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray):
        # Neighbours in size and along a fixed projection go into the same leaf.
        slab = np.argsort(sizes, kind="stable")
        width = max(FANOUT, int(np.sqrt(len(sizes) * FANOUT)))
        along = vectors @ np.where(np.arange(vectors.shape[1]) % 2, 1, -1)
        rank = np.empty(len(sizes), np.int64)
        rank[slab] = np.arange(len(sizes)) // width
        self.order = np.lexsort((along, rank))
        v, n = vectors[self.order], sizes[self.order]
        self.levels = [(v, n, n)]
        while len(self.levels[-1][0]) > FANOUT:
            high, low_n, high_n = self.levels[-1]
            cut = np.arange(0, len(high), FANOUT)
            self.levels.append((np.maximum.reduceat(high, cut), np.minimum.reduceat(low_n, cut), np.maximum.reduceat(high_n, cut)))

    def near(self, vector: np.ndarray, size: int, num: int, den: int, after: int = -1) -> np.ndarray:
        """Places (in ``order``) beyond ``after`` whose overlap bound lets them link."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low_n, high_n = self.levels[depth]
            if depth < len(self.levels) - 1:
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < len(high)]
            nodes = nodes[(nodes + 1) * FANOUT**depth > after + 1]
            a, b = low_n[nodes], high_n[nodes]
            nodes = nodes[(a * num <= size * den) & (b * den >= size * num)]
            bound = np.minimum(vector, high[nodes]).sum(axis=1)
            need = num * (size + np.maximum(low_n[nodes], -(-size * num // den)))
            nodes = nodes[bound * (num + den) >= need]
        return nodes


def local_join(sets: list[np.ndarray], num: int, den: int, labels: np.ndarray | None = None, side: np.ndarray | None = None) -> np.ndarray:
    """For each set the number of a set that it is connected with, equal for connected ones.
    ``labels``: what is connected already; ``side``: only sets of different sides are compared."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    d = int(dims_for(sizes.min(keepdims=True))[0])
    counts = vectors(np.concatenate(sets), np.append(0, np.cumsum(sizes)), np.full(m, d))[0].reshape(m, d).astype(np.int32)
    tree = CountTree(counts, sizes)
    order = tree.order
    group = np.unique(labels, return_inverse=True)[1][order] if labels is not None else np.arange(m)
    sides = side[order] if side is not None else None
    for p in range(m):
        a = sets[order[p]]
        near = tree.near(counts[order[p]], len(a), num, den, p)
        near = near[near > p]
        if sides is not None:
            near = near[sides[near] != sides[p]]
        for q in near[group[near] != group[p]].tolist():
            if group[q] == group[p]:
                continue
            b = sets[order[q]]
            both = len(np.intersect1d(a, b, assume_unique=True))
            if den * both >= num * (len(a) + len(b) - both):
                group[group == group[q]] = group[p]
    root = np.empty(m, np.int64)
    root[order] = order[np.unique(group, return_index=True)[1]][np.unique(group, return_inverse=True)[1]]
    return root


def local_links(sets: list[np.ndarray], weights: np.ndarray, num: int, den: int, side: np.ndarray | None = None) -> np.ndarray:
    """For each set the total weight of the others that it links with: all pairs that the overlap bounds
    leave are verified.  ``side``: only sets of different sides are compared."""
    m = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    d = int(dims_for(sizes.min(keepdims=True))[0])
    counts = vectors(np.concatenate(sets), np.append(0, np.cumsum(sizes)), np.full(m, d))[0].reshape(m, d).astype(np.int32)
    tree = CountTree(counts, sizes)
    order = tree.order
    out = np.zeros(m, np.int64)
    for p in range(m):
        i = order[p]
        near = tree.near(counts[i], int(sizes[i]), num, den, p)
        near = order[near[near > p]]
        if side is not None:
            near = near[side[near] != side[i]]
        for j in near.tolist():
            both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
            if den * both >= num * (sizes[i] + sizes[j] - both):
                out[i] += weights[j]
                out[j] += weights[i]
    return out


def _vector_column(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    flat, base = vectors(h, bounds, dims_for(np.diff(bounds)))
    raw, at = flat.tobytes(), (2 * base).tolist()
    return pa.array([raw[x:y] for x, y in zip(at, at[1:])], pa.binary())


def _once(b: pa.RecordBatch, *key: str) -> pa.RecordBatch:
    """The first row of each key in a batch."""
    _, first = np.unique(np.stack([b.column(c).to_numpy() for c in key], axis=1), axis=0, return_index=True)
    return b if len(first) == b.num_rows else b.take(pa.array(np.sort(first)))


def _points(k: int, full: bool):
    """id, h, n and two digests of each text's set, and its shingles or (not ``full``) its count vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = _once(b, "id", "h") if full else b
            data, off = utf8(b.column("text"))
            for i, j in chunks(off, CHUNK):
                h, bounds = sets_of(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                d1, d2 = digests(h, bounds)
                out = {"id": b.column("id").slice(i, j - i), "h": b.column("h").slice(i, j - i), "n": pa.array(np.diff(bounds)), "d1": pa.array(d1), "d2": pa.array(d2)}
                more = {"hashes": lists(h.view(np.int64), bounds[1:], pa.int64())} if full else {"vector": _vector_column(h, bounds)}
                yield pa.record_batch(out | more)
        release()

    return run


def _signed(k: int, num: int, den: int):
    """The signatures of the texts that have the set they are asked for: uid, s."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = _once(b, "uid")
            data, off = utf8(b.column("text"))
            uid, a1, a2 = (b.column(c).to_numpy() for c in ("uid", "d1", "d2"))
            for i, j in chunks(off, CHUNK):
                h, bounds = sets_of(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                d1, d2 = digests(h, bounds)
                values, ends = signatures(h, bounds, num, den)
                who = np.repeat(np.arange(j - i), np.diff(ends))
                keep = ((d1 == a1[i:j]) & (d2 == a2[i:j]))[who]
                yield pa.record_batch({"uid": pa.array(uid[i:j][who[keep]]), "s": pa.array(values[keep])})
        release()

    return run


#: Members of a signature up to which they are checked together; those of larger ones are taken as candidates.
MEMBERS = 4096


def _member_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of signature and uid: the members of each signature that has several, with a
    digest of the list.  Longer lists come in parts that share their first member (and have no digest)."""
    def told(members: list[np.ndarray], whole: list[bool]) -> pa.RecordBatch:
        keys = [np.frombuffer(hashlib.blake2b(m.tobytes(), digest_size=16).digest(), np.int64).tolist() if w else (None, None) for m, w in zip(members, whole)]
        one, two = zip(*keys)
        return pa.record_batch({"list": pa.array(one, pa.int64()), "more": pa.array(two, pa.int64()), "members": lists(np.concatenate(members), np.cumsum([len(m) for m in members]), pa.int64())})

    held_s, held, long = None, np.zeros(0, np.int64), False
    for b in batches:
        s, u = b.column("s").to_numpy(), b.column("uid").to_numpy()
        new = np.ones(len(s), bool)  # a row that repeats an id and text may have sent its signatures again
        new[1:] = (s[1:] != s[:-1]) | (u[1:] != u[:-1])
        if len(s) and s[0] == held_s and len(held) and u[0] == held[-1]:
            new[0] = False
        s, u = s[new], u[new]
        if not len(s):
            continue
        cut = np.flatnonzero(s[1:] != s[:-1]) + 1
        bounds = np.concatenate([[0], cut, [len(s)]])
        out, whole = [], []
        if s[0] == held_s:
            held = np.concatenate([held, u[: bounds[1]]])
            start = 1
        else:
            start = 0
        if start < len(bounds) - 1 or len(bounds) > 2:  # what is held is complete
            if len(held) > 1:
                out.append(held)
                whole.append(not long and len(held) <= MEMBERS)
            held, long = np.zeros(0, np.int64), False
            sizes = np.diff(bounds)
            for k in (np.flatnonzero(sizes[start:-1] > 1) + start).tolist():
                out.append(u[bounds[k] : bounds[k + 1]])
                whole.append(sizes[k] <= MEMBERS)
            held, held_s = u[bounds[-2] :], s[-1]
        if len(held) > MEMBERS:
            out.append(held)
            whole.append(False)
            held, long = held[:1], True
        if out:
            yield told(out, whole)
    if len(held) > 1:
        yield told([held], [not long and len(held) <= MEMBERS])


def dims_for(sizes: np.ndarray) -> np.ndarray:
    """Coordinates for sets of these sizes.  With a fixed number, the counts of long texts would all
    look alike."""
    need = np.maximum(sizes // PER_DIM, DIMS)
    return np.left_shift(1, np.ceil(np.log2(need)).astype(np.int64))


def vectors(h: np.ndarray, bounds: np.ndarray, dims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each set's shingles in ``dims`` groups (by set), flat, and each set's first one (with the end)."""
    base = np.append(0, np.cumsum(dims))
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    at = base[row] + ((h >> np.uint64(24)) & (dims[row] - 1).astype(np.uint64)).astype(np.int64)
    return np.bincount(at, minlength=int(base[-1])).astype(np.uint16), base


def _folded(v: np.ndarray, dims: int) -> np.ndarray:
    """Fewer coordinates of a vector: those with the same last bits are added."""
    return v.reshape(-1, dims).sum(axis=0, dtype=np.int32)


def _near_members(num: int, den: int):
    """Of rows in order of list: members whose overlap bounds let them link, directly or by others, as
    pairs with one of them."""

    def pairs(uid: np.ndarray, n: np.ndarray, flat: np.ndarray, at: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        dims, out = np.diff(at), []
        sizes = np.diff(first)
        two = first[:-1][sizes == 2]
        same = dims[two] == dims[two + 1]
        for d in np.unique(dims[two[same]]).tolist():
            i = two[same & (dims[two] == d)]
            for k in range(0, len(i), max(1, (1 << 20) // d)):
                x = i[k : k + max(1, (1 << 20) // d)]
                cols = np.arange(d)
                bound = np.minimum(flat[at[x][:, None] + cols], flat[at[x + 1][:, None] + cols]).sum(axis=1, dtype=np.int64)
                near = x[bound * (num + den) >= num * (n[x] + n[x + 1])]
                out += zip(uid[near].tolist(), uid[near + 1].tolist())
        more = np.concatenate([two[~same], first[:-1][sizes > 2]])
        stop = dict(zip(first[:-1].tolist(), first[1:].tolist()))
        for lo in more.tolist():
            hi = stop[lo]
            d = int(dims[lo:hi].min())
            v = np.stack([_folded(flat[at[r] : at[r + 1]], d) for r in range(lo, hi)])
            tree, group = CountTree(v, n[lo:hi]), np.arange(hi - lo)
            for p in range(hi - lo):
                i = tree.order[p]
                near = tree.near(v[i], int(n[lo + i]), num, den, p)
                near = near[(near > p) & (group[near] != group[p])]
                if len(near):
                    group[np.isin(group, group[near])] = group[p]
            head = tree.order[np.unique(group, return_index=True)[1]][np.unique(group, return_inverse=True)[1]]
            out += [(int(uid[lo + a]), int(uid[lo + b])) for a, b in zip(head.tolist(), tree.order.tolist()) if a != b]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def starts(t: pa.Table) -> np.ndarray:
            one, two = t.column("list").to_numpy(), t.column("more").to_numpy()
            return np.flatnonzero(np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1])))

        def solved(t: pa.Table) -> Iterator[pa.RecordBatch]:
            first = np.append(starts(t), t.num_rows)
            data, off = utf8(t.column("vector").combine_chunks().cast(pa.large_binary()) if t.column("vector").num_chunks != 1 else t.column("vector").chunk(0))
            found = pairs(t.column("uid").to_numpy(), t.column("n").to_numpy(), np.frombuffer(data.tobytes(), np.uint16), off // 2, first)
            if found:
                a, b = zip(*found)
                yield pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            last = int(starts(t)[-1])
            if last:
                yield from solved(t.slice(0, last).combine_chunks())
            held = t.slice(last)
        if held is not None:
            yield from solved(held.combine_chunks())
        held = None
        release()

    return run


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """The rows of each key, of batches that are sorted by it."""
    held: list[pa.RecordBatch] = []
    held_key = None
    for b in batches:
        if not b.num_rows:
            continue
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for c in key:
            x = b.column(c).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        cut = [*np.flatnonzero(new).tolist(), b.num_rows]
        for x, y in zip(cut, cut[1:]):
            part = b.slice(x, y - x)
            now = tuple(part.column(c)[0].as_py() for c in key)
            if held and now != held_key:
                yield pa.Table.from_batches(held)
                held = []
            held_key = now
            held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _tile(t: pa.Table) -> tuple[pa.Table, np.ndarray, list[np.ndarray]]:
    """The rows of a tile (or of two), their uids and sets."""
    t = t.combine_chunks()
    uid = t.column("uid").to_numpy()
    _, first = np.unique(uid, return_index=True)  # rows that repeat an id and text
    t = t.take(pa.array(first))
    col = t.column("hashes").combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    off = col.offsets.to_numpy()
    flat = col.values.to_numpy().view(np.uint64)
    return t, uid[first], [flat[x:y] for x, y in zip(off[:-1].tolist(), off[1:].tolist())]


def _count_tiles(num: int, den: int):
    """uid, links of sorted rows (cluster, i, j, tile, uid, copies, hashes): links within a tile (i = j) or
    between two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ["cluster", "i", "j"]):
            t, uid, sets = _tile(t)
            side = None if t.column("i")[0] == t.column("j")[0] else t.column("tile").to_numpy()
            yield pa.record_batch({"uid": pa.array(uid), "links": pa.array(local_links(sets, t.column("copies").to_numpy(), num, den, side))})
        release()

    return run


def _tiles(tile_shingles: int, tile_sets: int):
    return F.ceil(F.greatest(F.col("shingles") / tile_shingles, F.col("sets") / tile_sets)).cast("int")


def _all_links(near: DataFrame, copies: DataFrame, num: int, den: int, tile_shingles: int, tile_sets: int) -> DataFrame:
    """uid, links of all sets ``near`` (cluster, uid, n, hashes): every pair of tiles of a cluster is joined,
    whatever is connected, and each link counts as often as the other set has rows (``copies``)."""
    sizes = near.groupBy("cluster").agg(F.sum("n").alias("shingles"), F.count("*").alias("sets"))
    tiles = written(sizes.select("cluster", _tiles(tile_shingles, tile_sets).alias("tiles")), "cluster-tiles")
    tiled = near.join(tiles, "cluster").join(copies, "uid").withColumn("tile", F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int"))
    other = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    pairs = other.select("cluster", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"), "tile", "uid", "copies", "hashes")
    key = ["cluster", "i", "j"]
    found = pairs.repartition(*key).sortWithinPartitions(*key).mapInArrow(_count_tiles(num, den), "uid long, links long")
    return written(found.groupBy("uid").agg(F.sum("links").alias("links")), "links")


def _join_tiles(num: int, den: int, key: list[str], paired: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, key):
            t, uid, sets = _tile(t)
            labels = t.column("root").to_numpy() if paired else None
            root = local_join(sets, num, den, labels, t.column("tile").to_numpy() if paired else None)
            yield pa.record_batch({"uid": pa.array(uid), "root": pa.array(uid[root])})
        release()

    return run


def _linked(sets: DataFrame, num: int, den: int, tile_shingles: int, tile_sets: int) -> DataFrame:
    """uid, root of all sets (cluster, uid, n, hashes), where sets can link within a cluster only."""
    sizes = sets.groupBy("cluster").agg(F.sum("n").alias("shingles"), F.count("*").alias("sets"))
    large = written(sizes.withColumn("tiles", _tiles(tile_shingles, tile_sets)).where("tiles > 1").select("cluster", "tiles"), "large-clusters")
    single = large.isEmpty()
    tiled = sets.withColumn("tile", F.lit(0)) if single else sets.join(large, "cluster", "left").withColumn("tile", F.coalesce(F.pmod(F.xxhash64("uid"), F.col("tiles")).cast("int"), F.lit(0)))
    if not single:
        tiled = written(tiled, "tiled-sets")

    def joined(df: DataFrame, key: list[str], paired: bool) -> DataFrame:
        return df.repartition(*key).sortWithinPartitions(*key).mapInArrow(_join_tiles(num, den, key, paired), "uid long, root long")

    labels = written(joined(tiled.select("cluster", "tile", "uid", "hashes"), ["cluster", "tile"], False), "tile-labels")
    if single:
        return labels
    # First the roots of a large cluster's tiles among themselves: in a group of near copies that connects most.
    in_large = tiled.where("tiles is not null").join(labels, "uid")
    heads = in_large.where("uid = root").select("cluster", "uid", "n", "hashes")
    merges = labels.select(F.col("uid").alias("a"), F.col("root").alias("b"))
    if heads.count() < in_large.count():
        merges = merges.unionByName(_linked(written(heads, "heads"), num, den, tile_shingles, tile_sets).select(F.col("uid").alias("a"), F.col("root").alias("b")))
    now = components(merges)
    labels = written(labels.join(now, labels.uid == now.node, "left").select("uid", F.coalesce(now.root, labels.root).alias("root")), "labels")
    # Then all pairs of tiles that are not one and the same component.
    in_large = tiled.where("tiles is not null").join(labels, "uid").select("cluster", "tile", "uid", "hashes", "root")
    state = written(in_large.groupBy("cluster", "tile").agg(F.min("root").alias("low"), F.max("root").alias("high")), "tile-state")
    x, y = state.alias("x"), state.alias("y")
    open_pair = (F.col("x.cluster") == F.col("y.cluster")) & (F.col("x.tile") < F.col("y.tile")) & ((F.col("x.low") != F.col("y.low")) | (F.col("x.low") != F.col("x.high")) | (F.col("y.low") != F.col("y.high")))
    pairs = x.join(y, open_pair).select(F.col("x.cluster").alias("cluster"), F.col("x.tile").alias("i"), F.col("y.tile").alias("j"))
    ends = pairs.select("cluster", "i", "j", F.explode(F.array("i", "j")).alias("tile"))
    found = joined(in_large.join(ends, ["cluster", "tile"]), ["cluster", "i", "j"], True)
    edges = labels.select(F.col("uid").alias("a"), F.col("root").alias("b")).unionByName(found.select(F.col("uid").alias("a"), F.col("root").alias("b")))
    final = components(edges)
    return written(labels.join(final, labels.uid == final.node, "left").select("uid", F.coalesce(final.root, labels.root).alias("root")), "labels")


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and h (a hash of the text, which tells rows apart that share an id)."""
    return known_ids(id_text(df, id_col, text_col)).withColumn("h", text_hash("text"))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100, tile_shingles: int = TILE_SHINGLES, tile_sets: int = TILE_SETS, links: bool = False) -> DataFrame:
    """One row per row of ``df``: id, n_shingles (of its set) and component (the smallest id that is
    reachable by links, its own included).  By default five-word shingles and a similarity of 0.8.

    With ``links`` also copies (the number of other rows with the same set) and links (the number of rows
    with another set that it links with): then all candidate pairs are verified, also connected ones.

    A-Z are lower-cased; words are runs of bytes other than ASCII white space; a text of fewer than k
    words has its whole sequence as one shingle.  Null, empty and blank texts have no shingles and
    link with nothing.  Repeated ids and null ids (which come after all others) are rows of their own.  An
    empty table gives no rows; other columns of ``df`` are not read.
    """
    found = _classes(df, id_col, text_col, k, num, den, tile_shingles, tile_sets, links)
    more = ["copies", "links"] if links else []
    return shown_ids(found.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"), *more), "id", "component")


def _classes(df: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int, tile_shingles: int = TILE_SHINGLES, tile_sets: int = TILE_SETS, links: bool = False) -> DataFrame:
    """As :func:`classes`, also with h (the text's hash) and low_h (that of the class's first row: the
    one with the smallest id and, among these, the smallest hash); null ids are NO_ID, and component and
    low_h are null for rows without shingles."""
    rows = _texts(df, id_col, text_col)
    points = kept(rows.mapInArrow(_points(k, False), "id long, h long, n long, d1 long, d2 long, vector binary"))
    key = ["d1", "d2", "n"]
    first = F.min(F.struct("id", "h")).alias("first")
    sets = points.where("n > 0").groupBy(*key).agg(first, F.min("vector").alias("vector"), F.count("*").alias("copies"))
    sets = sets.select(*key, "vector", "copies", F.col("first.id").alias("rep"), F.col("first.h").alias("rep_h"))
    sets = written(sets.withColumn("uid", F.monotonically_increasing_id()), "sets")
    # One text of each set is read again and sends its signatures.  Rows that share an id meet by their text.
    asked = rows.join(bounded(sets.select("uid", "d1", "d2", F.col("rep").alias("id"), F.col("rep_h").alias("h"))), ["id", "h"])
    sent = asked.select("uid", "d1", "d2", "text").mapInArrow(_signed(k, num, den), "uid long, s long")
    found = kept(sent.repartition("s").sortWithinPartitions("s", "uid").mapInArrow(_member_lists, "list long, more long, members array<long>"))
    # Near copies share most of their signatures: the same list of members counts once.
    once = found.where("list is not null").groupBy("list", "more").agg(F.first("members").alias("members"))
    rows_of = once.select("list", "more", F.explode("members").alias("uid")).join(sets.select("uid", "n", "vector"), "uid")
    pairs = rows_of.repartition("list", "more").sortWithinPartitions("list", "more", "uid").mapInArrow(_near_members(num, den), "a long, b long")
    many = found.where("list is null").select(F.col("members")[0].alias("a"), F.explode("members").alias("b"))
    clusters = components(pairs.unionByName(many))
    member = written(sets.join(clusters, sets.uid == clusters.node).select("uid", "rep", "rep_h", *key, F.col("root").alias("cluster")), "members")
    few = rows.join(bounded(member.select(F.col("rep").alias("id"), F.col("rep_h").alias("h")).distinct()), ["id", "h"], "left_semi")
    full = few.mapInArrow(_points(k, True), "id long, h long, n long, d1 long, d2 long, hashes array<long>").withColumnsRenamed({"id": "rep", "h": "rep_h"})
    # Rows that repeat an id and text give the same set again: batches and tiles take it once.
    near = kept(full.join(member, ["rep", "rep_h", *key]).select("cluster", "uid", "n", "hashes"))
    linked = _linked(near, num, den, tile_shingles, tile_sets)
    rooted = linked.join(member.select("uid", "rep", "rep_h"), "uid")
    low = rooted.groupBy("root").agg(F.min(F.struct("rep", "rep_h")).alias("low"))
    known = rooted.join(low, "root").select("uid", "low")
    own = F.struct("rep", "rep_h")
    by_set = sets.select("uid", "rep", "rep_h", *key).join(known, "uid", "left").select(*key, F.coalesce("low", own).alias("low"))
    columns = ["id", "h", "n", F.col("low.rep").alias("component"), F.col("low.rep_h").alias("low_h")]
    if links:
        counted = _all_links(near, sets.select("uid", "copies"), num, den, tile_shingles, tile_sets)
        more = sets.select("uid", *key, "copies").join(counted, "uid", "left").select(*key, "copies", F.coalesce("links", F.lit(0)).alias("links"))
        by_set = by_set.join(more, key)
        columns += [F.coalesce(F.col("copies") - 1, F.lit(0)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links")]
    return points.select("id", "h", *key).join(by_set, key, "left").select(*columns)


def representatives(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``df`` that come first in their class (by id, null ids last, then by a hash of the text),
    with all their columns.  Rows without words stay; rows that repeat the first one's id and text stay
    with it.  An empty table gives no rows."""
    found = _classes(df, id_col, text_col, k, num, den)
    gone = found.where("id <> component or h <> low_h").select("id", "h").distinct()
    return without(df, written(gone, "near-copies"), id_col, text_col)
