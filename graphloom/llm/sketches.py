"""Document fingerprints: all shingle hashes below a fixed fraction of the hash range.

The number of hashes kept grows with the text, so the sketch of a union is the
union of the sketches, and the part of a small text that a much larger one
contains can be estimated from their sketches alone.  The smallest hash is kept
too where it lies above the threshold, so that a text with any word has a
fingerprint.
"""

from __future__ import annotations

import base64
import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunks, id_text, known_ids, lists, shown_ids, text_hash, utf8
from .shingles import shingles, words

WORDS = 5
#: The part of the hash range that is kept.
FRACTION = 1 / 4
CHUNK = 1 << 20
#: Characters whose pairs are made at once.
TOGETHER = 4 << 20
#: Ranges of ids for pairing neighbours, at most (their first ids come to the driver).
MOST_RANGES = 1 << 16
ROWS_PER_RANGE = 4096


def _limit(fraction: float) -> np.uint64:
    return np.uint64(min(int(fraction * 2.0**64), 2**64 - 1))


def sketch(texts: pa.Array, k: int = WORDS, fraction: float = FRACTION) -> list[np.ndarray]:
    """For each text its distinct hashes below the threshold, ascending; or its smallest hash."""
    data, off = utf8(texts)
    limit, out = _limit(fraction), []
    for i, j in chunks(off, CHUNK):
        h, bounds = shingles(*words(data[off[i] : off[j]], off[i : j + 1] - off[i]), k)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            x = h[a:b]
            low = np.unique(x[x < limit])
            out.append(low if len(low) or a == b else x.min(keepdims=True))
    return out


def containment(a: np.ndarray, b: np.ndarray, fraction: float = FRACTION) -> float:
    """The estimated part of the smaller sketch's shingles that the other has too (0 to 1).

    Where one has no hash below the threshold (a text of n shingles with chance (1 - fraction) ** n), no
    estimate can be made: 1 if the sketches are equal, else 0, also for a short text that is a part of
    the other.
    """
    limit = _limit(fraction)
    if not len(a) or not len(b) or a[0] >= limit or b[0] >= limit:
        return float(np.array_equal(a, b))
    return len(np.intersect1d(a, b, assume_unique=True)) / min(len(a), len(b))


def text_of(s: np.ndarray) -> str:
    """A sketch as a string (base64 of big-endian 64-bit hashes)."""
    return base64.b64encode(s.astype(">u8").tobytes()).decode()


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """One row per row of ``df``: id and hashes (ascending array; as signed 64-bit numbers).

    Words are runs of bytes other than ASCII white space.  A text of fewer than k words is one shingle;
    null, empty and blank texts have no hashes (but an id).  Texts of any length are used whole; repeated rows
    repeat.  An empty table gives no rows; other columns of ``df`` are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sketch(b.column("text"), k, fraction)
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.record_batch({"id": b.column("id"), "hashes": lists(flat.view(np.int64), np.cumsum([len(x) for x in found]), pa.int64())})

    return id_text(df, id_col, text_col).mapInArrow(run, "id long, hashes array<long>")


def _below(h: Column, fraction: float) -> Column:
    """Whether a hash, as a signed number, is below the threshold."""
    flipped = h.bitwiseXOR(F.lit(-(1 << 63)))
    return flipped < F.lit(int(_limit(fraction)) - (1 << 63))


def merged_hashes(prints: DataFrame, by: str, fraction: float = FRACTION) -> DataFrame:
    """The sketch of the union of texts, for each value of ``by``, as rows by, hash: the distinct hashes
    below the threshold, or (where no text has one) the smallest hash.  No group is brought together."""
    each = prints.select(by, F.explode("hashes").alias("hash")).distinct()
    low = each.where(_below(F.col("hash"), fraction))
    # As unsigned numbers: the sign bit flipped.
    flipped = F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))
    smallest = each.groupBy(by).agg(F.min(flipped).alias("m")).select(by, F.col("m").bitwiseXOR(F.lit(-(1 << 63))).alias("hash"))
    return low.unionByName(smallest.where(~_below(F.col("hash"), fraction)))


def merged(prints: DataFrame, by: str, fraction: float = FRACTION) -> DataFrame:
    """:func:`merged_hashes` with one row for each value of ``by``: by, hashes (ascending as unsigned
    numbers).  A row is as long as the sketch of the union; unions of very many texts stay as rows."""
    flipped = F.array_sort(F.collect_list(F.col("hash").bitwiseXOR(F.lit(-(1 << 63)))))
    out = merged_hashes(prints, by, fraction).groupBy(by).agg(flipped.alias("hashes"))
    return out.withColumn("hashes", F.transform("hashes", lambda h: h.bitwiseXOR(F.lit(-(1 << 63)))))


def contained(a: Column, b: Column, fraction: float = FRACTION) -> Column:
    """As :func:`containment`, of two hash columns."""
    sure = (F.size(a) > 0) & (F.size(b) > 0) & _below(F.element_at(a, 1), fraction) & _below(F.element_at(b, 1), fraction)
    return F.when(sure, F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise((a == b).cast("double"))


def _firsts(rows: DataFrame) -> list[tuple[int, int]]:
    """The first (id, h) of each range."""
    keys = rows.select("id", "h")
    n = min(MOST_RANGES, max(1, keys.count() // ROWS_PER_RANGE))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = [min(zip(b.column("id").to_pylist(), b.column("h").to_pylist())) for b in batches if len(b)]
        if low:
            i, h = min(low)
            yield pa.record_batch({"id": pa.array([i], pa.int64()), "h": pa.array([h], pa.int64())})

    return sorted({(r.id, r.h) for r in keys.repartitionByRange(n, "id", "h").mapInArrow(first, "id long, h long").collect()})


def with_next(df: DataFrame, make, schema: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``make(batch, texts, following)`` of all rows in order of id (ties by a hash of the text), where
    ``following`` has the text of the next row for each; after the last comes the first.  Rows with a
    null id (NO_ID for ``make``) come last.

    Rows are dealt to ranges of id and hash, so that an id that many rows share is spread; rows that repeat
    both are sent once by each batch, with their number.  The first row of each range is also sent to the
    range before.  A task holds one batch and a row.
    """
    rows = known_ids(id_text(df, id_col, text_col)).withColumn("h", text_hash("text"))
    begins = _firsts(rows)
    if not begins:
        return rows.limit(0).mapInArrow(lambda b: iter(()), schema)
    names = ["range", "halo", "id", "h", "times", "text"]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: dict[tuple[int, int], list[int]] = {}
            for i, key in enumerate(zip(b.column("id").to_pylist(), b.column("h").to_pylist())):
                found.setdefault(key, [i, 0])[1] += 1
            first, times = (list(x) for x in zip(*found.values())) if found else ([], [])
            at = [bisect_right(begins, k) - 1 for k in found]
            b = b.take(pa.array(first, pa.int64()))

            def sent(to: list[int], halo: bool, which: list[int]) -> pa.RecordBatch:
                own = b.take(pa.array(which, pa.int64()))
                return pa.record_batch([pa.array(to, pa.int64()), pa.array([halo] * len(to), pa.bool_()), own.column("id"), own.column("h"), pa.array([1 if halo else times[i] for i in which], pa.int64()), own.column("text")], names=names)

            yield sent(at, False, list(range(len(at))))
            edge = [i for i, k in enumerate(found) if begins[at[i]] == k]
            if edge:
                yield sent([(at[i] - 1) % len(begins) for i in edge], True, edge)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(out: list[tuple[int, str, str, int]]) -> pa.RecordBatch:
            ids, texts, following, times = (list(x) for x in zip(*out))
            return make(ids, texts, following).append_column("times", pa.array(times, pa.int64()))

        held: tuple[int, bool, int, str] | None = None
        for b in batches:
            out: list[tuple[int, str, str, int]] = []
            size = 0
            for r, halo, i, times, text in zip(*(b.column(c).to_pylist() for c in ("range", "halo", "id", "times", "text"))):
                if held is not None and held[0] == r and not held[1]:
                    out.append((held[2], held[3], text, 1))
                    size += len(text)
                if times > 1:
                    out.append((i, text, text, times - 1))
                    size += len(text)
                if size > TOGETHER:
                    yield made(out)
                    out, size = [], 0
                held = (r, halo, i, text)
            if out:
                yield made(out)

    dealt = rows.mapInArrow(deal, "range long, halo boolean, id long, h long, times long, text string")
    found = dealt.repartition("range").sortWithinPartitions("range", "halo", "id", "h").mapInArrow(pair, f"{schema}, times long")
    return found.withColumn("times", F.explode(F.array_repeat(F.lit(0), F.col("times").cast("int")))).drop("times")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many first code points of ``following`` (or all)."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


def edit_study(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness to each other and to the
    next text: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text counts as empty.  Rows with a null id come after all others; repeated ids are rows of their
    own, in the order of a hash of their texts.  A single row is its own next one.  An empty table gives no rows;
    other columns of ``df`` are not read.
    """

    def make(ids: list[int], texts: list[str], following: list[str]) -> pa.RecordBatch:
        changed = [edited(t, f) for t, f in zip(texts, following)]
        # A row's next text is mostly the following row, whose sketch is made anyway.
        own, new = sketch(pa.array(texts, pa.string()), k, fraction), sketch(pa.array(changed, pa.string()), k, fraction)
        odd = [i for i in range(len(ids)) if i + 1 == len(ids) or texts[i + 1] != following[i]]
        far = dict(zip(odd, sketch(pa.array([following[i] for i in odd], pa.string()), k, fraction)))
        return pa.record_batch(
            {
                "id": pa.array(ids, pa.int64()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64()),
                "edited_sha256": pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]),
                "fingerprint": pa.array([text_of(x) for x in own]),
                "edited_fingerprint": pa.array([text_of(x) for x in new]),
                "near_edited": pa.array([containment(a, b, fraction) for a, b in zip(own, new)], pa.float64()),
                "near_next": pa.array([containment(a, far[i] if i in far else own[i + 1], fraction) for i, a in enumerate(own)], pa.float64()),
            }
        )

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return shown_ids(with_next(df, make, schema, id_col, text_col))
