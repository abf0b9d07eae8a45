"""Exact deduplication by a log-structured merge index over text digests.

Every task fills a memtable of digests.  A full memtable is flushed as a sorted
run that holds each digest once, with its smallest order key and its number of
rows, so a text copied a billion times leaves a single entry per run.
Compaction merges the sorted runs of a digest range in one pass over them,
keeping the smallest key.  Digests held by more than one row are *hits*.  Each
digest shard has a filter over its hits, sized by their number up to a bound; a
second scan sets aside the rows that no filter lets pass.

What passes receives byte verification.  Rows are dealt out by digest, hot
digests in slices of rows, and in order of their keys; each row is compared with
the first of its slice, and the first ones of a digest's slices with each other.
Digests whose rows differ (a collision) are grouped anew by the bytes themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import NO_ID, bounded, chunks, id_text, kept, known_ids, release, utf8, written

#: A-Z to a-z, all other bytes as they are.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Bytes of text that are digested at once.
CHUNK = 4 << 20
#: Digest shards, each with a filter of so many bits per hit; all filters together have MOST_BITS (64 MB) at most, so
#: that what is broadcast is bounded.  Fuller filters let more rows pass, which changes no result.
FILTER_SHARDS, BITS_PER_HIT, MOST_BITS = 64, 12, 1 << 29
_PROBES = 4
#: Rows of a digest from which it is cut into slices, at least, and the rows of a slice.
SLICE_ROWS = 2048
#: Digests that may be cut, at most: those with more rows than one in so many of all rows that are copies.
MOST_HOT = 4096


def _digests(column: pa.Array, size: int) -> list[bytes]:
    data, off = utf8(column)
    out = []
    for i, j in chunks(off, CHUNK):
        raw = data[off[i] : off[j]].tobytes().translate(_FOLD)
        at = (off[i : j + 1] - off[i]).tolist()
        out += [hashlib.sha256(raw[a:b]).digest()[:size] for a, b in zip(at, at[1:])]
    return out


def _memtables(size: int, most: int):
    def flush(keys: list[bytes], order: list[np.ndarray]) -> pa.RecordBatch:
        k = np.array(keys, dtype=f"V{size}").view(np.uint8).reshape(len(keys), size)
        o = np.concatenate(order)
        rank = np.lexsort((o, *k.T[::-1]))
        k, o = k[rank], o[rank]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(k)))
        held = pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(first), [None, pa.py_buffer(np.ascontiguousarray(k[first]).tobytes())])
        return pa.record_batch({"digest": held.cast(pa.binary()), "best": pa.array(o[first]), "n": pa.array(n)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[bytes] = []
        order: list[np.ndarray] = []
        for b in batches:
            keys += _digests(b.column("text"), size)
            order.append(b.column("order").to_numpy(zero_copy_only=False))
            if len(keys) >= most:
                yield flush(keys, order)
                keys, order = [], []
        if keys:
            yield flush(keys, order)
        keys, order = [], []
        release()

    return run


def _compacted(size: int):
    """Merge entries that come in order of digest: the smallest key and the number of rows of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[bytes, int, int] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            raw, _ = utf8(b.column("digest"))
            k = raw.reshape(-1, size)
            best, n = b.column("best").to_numpy(), b.column("n").to_numpy()
            new = np.append(True, (k[1:] != k[:-1]).any(axis=1))
            first = np.flatnonzero(new)
            digest = [k[i].tobytes() for i in first.tolist()]
            best, n = np.minimum.reduceat(best, first).tolist(), np.add.reduceat(n, first).tolist()
            if held is not None and held[0] == digest[0]:
                best[0], n[0] = min(best[0], held[1]), n[0] + held[2]
            elif held is not None:
                digest, best, n = [held[0], *digest], [held[1], *best], [held[2], *n]
            held = digest.pop(), best.pop(), n.pop()
            yield pa.record_batch({"digest": pa.array(digest, pa.binary()), "best": pa.array(best, pa.int64()), "n": pa.array(n, pa.int64())})
        if held is not None:
            yield pa.record_batch({"digest": pa.array([held[0]], pa.binary()), "best": pa.array([held[1]], pa.int64()), "n": pa.array([held[2]], pa.int64())})

    return run


def _shard(digest: Column) -> Column:
    return F.conv(F.hex(F.substring(digest, 1, 1)), 16, 10).cast("int") % FILTER_SHARDS


def _places(digests: list[bytes], bits: np.ndarray) -> np.ndarray:
    """The bits of each digest in a filter of ``bits`` (a power of two, for each digest): sums of two
    numbers from the digest."""
    raw = np.frombuffer(b"".join(d[:16].ljust(16, b"\0") for d in digests), ">u8").astype(np.uint64).reshape(-1, 2)
    steps = raw[:, :1] + np.arange(_PROBES, dtype=np.uint64) * (raw[:, 1:] | np.uint64(1)) + (raw[:, :1] >> np.uint64(32))
    return (steps & (bits[:, None] - 1).astype(np.uint64)).astype(np.int64)


def _filters(hits: DataFrame) -> dict[int, np.ndarray]:
    """For each digest shard that has hits, a filter (bytes of a bit set) made on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, np.ndarray] = {}
        for b in batches:
            digests, shards, bits = b.column("digest").to_pylist(), b.column("shard").to_numpy(), b.column("bits").to_numpy()
            at = _places(digests, bits)
            for s in np.unique(shards).tolist():
                own = shards == s
                f = made.setdefault(s, np.zeros(int(bits[own][0]) // 8, np.uint8))
                p = at[own].ravel()
                np.bitwise_or.at(f, p >> 3, np.left_shift(1, p & 7).astype(np.uint8))
        if made:
            yield pa.record_batch({"shard": pa.array(list(made), pa.int32()), "bits": pa.array([f.tobytes() for f in made.values()], pa.binary())})

    sharded = hits.select("digest", _shard(F.col("digest")).alias("shard"))
    counts = sharded.groupBy("shard").count()
    size = F.least(F.pow(2, F.ceil(F.log2(F.col("count") * BITS_PER_HIT))), F.lit(MOST_BITS // FILTER_SHARDS)).cast("long")
    sized = sharded.join(F.broadcast(counts.select("shard", F.greatest(size, F.lit(64)).alias("bits"))), "shard")  # FILTER_SHARDS rows
    # One row of bounded size for each shard.
    return {r.shard: np.frombuffer(r.bits, np.uint8) for r in sized.repartition("shard").mapInArrow(run, "shard int, bits binary").collect()}


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", memtable_rows: int = 1 << 16, digest_bytes: int = 32, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """One row per row of ``df``: id, keep_id, group_size, kept, digest (lowercase hex, SHA-256 of
    the folded text, cut to ``digest_bytes``).

    Texts are equal when identical after lower-casing A-Z; null counts as empty, and all empty texts
    are one group.  The row with the smallest (or largest) id stays (one with a null id only if there
    is no other).  Of rows that repeat the same id
    and text exactly one is kept.  An empty table gives no rows; other columns of ``df`` are not read.
    """
    sign = {"smallest": 1, "largest": -1}[keep]
    rows = id_text(df, id_col, text_col).withColumn("order", F.coalesce(F.col("id") * sign, F.lit(NO_ID)))
    runs = rows.select("order", "text").mapInArrow(_memtables(digest_bytes, memtable_rows), "digest binary, best long, n long")
    index = runs.repartition("digest").sortWithinPartitions("digest").mapInArrow(_compacted(digest_bytes), "digest binary, best long, n long")
    hits = written(index.where("n > 1"), "dedup-hits")
    sent = df.sparkSession.sparkContext.broadcast(_filters(hits))
    placed = rows.withColumn("row", F.monotonically_increasing_id())
    table = kept(placed.mapInArrow(_probed(digest_bytes, sent), "id long, order long, row long, digest binary, folded binary, hit boolean"))

    # Byte verification.
    copied = hits.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    many = max(slice_rows, copied // MOST_HOT)
    hot = F.broadcast(hits.where(F.col("n") > many).select("digest", F.ceil(F.col("n") / slice_rows).cast("int").alias("slices")))  # MOST_HOT rows
    probed = table.where("hit").join(hot, "digest", "left")
    sliced = probed.withColumn("slice", F.coalesce(F.pmod(F.xxhash64("row"), F.col("slices")).cast("int"), F.lit(0)))
    sliced = sliced.select("digest", "slice", "order", "id", "folded", F.col("slices").isNotNull().alias("cut"))
    dealt = sliced.repartition("digest", "slice").sortWithinPartitions("digest", "slice", "order")
    checked = written(dealt.mapInArrow(_verified, "id long, order long, digest binary, same boolean, first binary"), "dedup-checked")
    firsts = checked.where("first is not null").select("digest", F.lit(0).alias("slice"), "order", "id", F.col("first").alias("folded"), F.lit(False).alias("cut"))
    across = firsts.repartition("digest").sortWithinPartitions("digest", "order").mapInArrow(_verified, "id long, order long, digest binary, same boolean, first binary")
    differ = written(checked.where("not same").select("digest").unionByName(across.where("not same").select("digest")).distinct(), "dedup-collisions")

    told = checked.drop("first").join(hits, "digest", "left")
    alone = table.where("not hit").select("id", "digest").unionByName(told.where("n is null").select("id", "digest"))
    alone = alone.select("id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    copies = told.where("n is not null").select("id", "order", "best", F.col("n").alias("group_size"), "digest")
    if not differ.isEmpty():
        other = table.where("hit").join(differ, "digest", "left_semi").join(hits.select("digest"), "digest", "left_semi")
        regrouped = other.groupBy("digest", "folded").agg(F.min("order").alias("own_best"), F.count("*").alias("group_size"))
        differing = other.join(regrouped, ["digest", "folded"]).select("id", "order", F.col("own_best").alias("best"), "group_size", "digest")
        copies = copies.join(differ, "digest", "left_anti").unionByName(differing)
    # Rows that repeat an id are told apart only among the rows that stay.
    again = Window.partitionBy("digest", "best", "group_size").orderBy("order")
    stay = copies.where("order = best").withColumn("kept", F.row_number().over(again) == 1)
    gone = copies.where("order <> best").withColumn("kept", F.lit(False))
    keep_id = F.when(F.col("best") != NO_ID, F.col("best") * sign)
    found = stay.unionByName(gone).select("id", keep_id.alias("keep_id"), "group_size", "kept", "digest")
    return alone.unionByName(found).select("id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("digest"))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows in order of digest, slice and order key: whether each has the bytes of the first row of its
    slice, whose bytes go on where the digest is cut into slices."""
    held: tuple[tuple[bytes, int], bytes] | None = None
    for b in batches:
        same, first = [], []
        for digest, part, folded, cut in zip(*(b.column(c) for c in ("digest", "slice", "folded", "cut"))):
            key, data = (digest.as_py(), part.as_py()), folded.as_py()
            new = held is None or held[0] != key
            if new:
                held = key, data
            same.append(new or held[1] == data)
            first.append(data if new and cut.as_py() else None)
        yield pa.record_batch({"id": b.column("id"), "order": b.column("order"), "digest": b.column("digest"), "same": pa.array(same, pa.bool_()), "first": pa.array(first, pa.binary())})
    held = None
    release()


def _probed(size: int, sent):
    """Each row's digest and, where the filter lets it pass, its folded bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filters = sent.value
        for b in batches:
            _, off = utf8(b.column("text"))
            for i, j in chunks(off, CHUNK):
                part = b.slice(i, j - i)
                data, at = utf8(part.column("text"))
                at = at.tolist()
                folded = data.tobytes().translate(_FOLD)
                texts = [folded[x:y] for x, y in zip(at, at[1:])]
                digests = [hashlib.sha256(x).digest()[:size] for x in texts]
                shards = np.array([d[0] % FILTER_SHARDS for d in digests])
                bits = np.array([8 * len(filters[s]) if s in filters else 8 for s in range(FILTER_SHARDS)])[shards]
                at, hit = _places(digests, bits), np.zeros(len(digests), bool)
                for s in np.unique(shards).tolist():
                    if s in filters:
                        own = np.flatnonzero(shards == s)
                        hit[own] = ((filters[s][at[own] >> 3] >> (at[own] & 7).astype(np.uint8)) & 1).all(axis=1)
                kept = [x if h else None for x, h in zip(texts, hit.tolist())]
                yield pa.record_batch({"id": part.column("id"), "order": part.column("order"), "row": part.column("row"), "digest": pa.array(digests, pa.binary()), "folded": pa.array(kept, pa.binary()), "hit": pa.array(hit)})
        release()

    return run


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """The rows of ``df`` that stay, with all its columns: one of each group of equal texts.

    Rows are matched by id and text, so others that share an id, or have none, are as they were.  An
    empty table gives no rows.
    """
    found = written(groups(df, id_col, text_col, keep).where("group_size > 1").select("id", "keep_id", "kept", "digest"), "dedup-groups")
    own = known_ids(found).withColumn("keep_id", F.coalesce("keep_id", F.lit(NO_ID)))
    # Of rows with the id that stays, all but one: those of equal bytes, or equal when folded.
    stays = own.where("id = keep_id").groupBy("id", "digest").agg(F.count("*").alias("rows"))
    gone = own.where("id <> keep_id").select("id", "digest").distinct()
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    folded = F.sha2(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), 256)
    told = bounded(written(gone.select(F.col("id").alias("__gone"), F.col("digest").alias("__digest")), "dedup-gone"))
    left = df.join(told, (key == F.col("__gone")) & (folded == F.col("__digest")), "left_anti")
    repeats = written(stays.where("rows > 1").select(F.col("id").alias("__again"), F.col("digest").alias("__digest")), "dedup-repeats")
    if repeats.isEmpty():
        return left
    again = (key == F.col("__again")) & (folded == F.col("__digest"))
    rest = left.join(bounded(repeats), again, "left_anti")
    some = left.join(bounded(repeats), again, "left_semi").withColumns({"__key": key, "__digest": folded})
    one = some.groupBy("__key", "__digest").agg(F.min(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("__row"))
    return rest.unionByName(one.select("__row.*"))
