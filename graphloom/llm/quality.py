"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

The model is one of character n-grams, counted over all trusted texts but a
held-out fold.  A character has 21 bits, as many as a code point needs, so an
n-gram is a pair of numbers (the first characters in ``hi``, the last three in
``lo``) and its context and its suffix are shifts and masks of them.  Counts,
continuation counts and context totals are tables that are sharded by n-gram
and joined to give interpolated probabilities.

Each text is scored whole, by the same joins at any size: texts are dealt to
blocks of a number of bytes, the distinct n-grams of all blocks are joined with
the model's shards, and each block is scored with what comes back for it.  A
text is rejected if its perplexity is above a quantile of the perplexities of
held-out trusted texts of its language and about its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded, chunks, drop_written, kept, known_ids, lists, release, small_batches, text_hash, utf8, without, written
from .shingles import mix

ORDER = 5
BITS = 21
#: Characters in the low number of a pair.
LOW = 3
_CHAR = (1 << BITS) - 1
#: The probability below the unigrams: any of the characters that there can be.
FLOOR = 1.0 / (1 << BITS)
#: Characters whose n-grams are made at once.
CHUNK = 1 << 18
#: Bytes of the texts of one block, on average, before they are compressed.  A task holds a compressed block and a number for
#: each of its distinct n-grams.
BLOCK_BYTES = 32 << 20
#: Level of zstd for the texts of blocks, which are the larger part of what is shuffled.
TEXT_LEVEL = 5
QUANTILE = 0.995
#: A held-out text may be above its quantile by this part.
SLACK = 1.08
#: Held-out texts that a quantile is taken from, at least: of a language and length, and of the lengths nearest to it.
LEAST_TEXTS = 60
#: A text has fewer than 2 ** 31 characters.
LONGEST_BIN = 31
START, END = 2, 3


def pieces(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Code points, some CHUNK at once, with what comes before a text and after it; the places where an
    n-gram of order ORDER ends (one for each character and for the end of each text); and its text."""
    held, size = [], 0
    pad = "\x02" * (ORDER - 1)

    def made() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        points = np.frombuffer("".join([x for _, x in held]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sizes = np.array([len(x) for _, x in held], np.int64)
        begin = np.cumsum(sizes) - sizes
        inner = np.arange(len(points)) - np.repeat(begin, sizes)
        ends = np.flatnonzero(inner >= ORDER - 1)
        return points, ends, np.repeat([k for k, _ in held], sizes)[ends]

    for k, t in enumerate(texts):
        t = f"{pad}{t}\x03"
        for at in range(0, len(t) - (ORDER - 1), CHUNK):  # parts of a long text overlap by an n-gram's context
            part = t[at : at + CHUNK + ORDER - 1]
            held.append((k, part))
            size += len(part)
            if size >= CHUNK:
                yield made()
                held, size = [], 0
    if held:
        yield made()


def pairs(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams that end at ``ends``: hi and lo."""
    lo = points[ends] | points[ends - 1] << BITS | points[ends - 2] << 2 * BITS
    return points[ends - 3] | points[ends - 4] << BITS, lo


def distinct(points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct n-grams (hi, lo) that end at ``ends``, and how often they are there."""
    known, local = np.unique(points, return_inverse=True)
    bits = max(1, int(len(known) - 1).bit_length())
    if bits * ORDER > 63:  # more than 4096 different characters in a part
        hi, lo = pairs(points, ends)
        return merged(hi, lo, np.ones(len(hi), np.int64))
    key = np.zeros(len(ends), np.int64)
    for k in range(ORDER):
        key |= local[ends - k] << bits * k
    key, n = np.unique(key, return_counts=True)
    c = [known[(key >> bits * k) & ((1 << bits) - 1)] for k in range(ORDER)]
    return c[3] | c[4] << BITS, c[0] | c[1] << BITS | c[2] << 2 * BITS, n


def merged(hi: np.ndarray, lo: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair once, with the sum of its numbers."""
    order = np.lexsort((lo, hi))
    hi, lo, n = hi[order], lo[order], n[order]
    new = np.ones(len(hi), bool)
    new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
    first = np.flatnonzero(new)
    return hi[first], lo[first], np.add.reduceat(n, first) if len(first) else n


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The n-grams of parts of texts with their counts, which are added up before and after the shuffle."""
    for b in batches:
        _, off = utf8(b.column("text"))
        for i, j in chunks(off, CHUNK):
            for points, ends, _ in pieces(b.column("text").slice(i, j - i).to_pylist()):
                hi, lo, n = distinct(points, ends)
                yield pa.record_batch({"hi": pa.array(hi), "lo": pa.array(lo), "n": pa.array(n, pa.int64())})
    release()


def _last(chars: int, hi: str = "hi", lo: str = "lo") -> list[Column]:
    """hi, lo of the last ``chars`` characters of an n-gram."""
    high = F.col(hi).bitwiseAND(F.lit((1 << BITS * (chars - LOW)) - 1)) if chars > LOW else F.lit(0).cast("long")
    low = F.col(lo) if chars >= LOW else F.col(lo).bitwiseAND(F.lit((1 << BITS * chars) - 1))
    return [high.cast("long"), low.cast("long")]


def _before(hi: str = "hi", lo: str = "lo") -> list[Column]:
    """hi, lo of an n-gram without its last character."""
    low = F.shiftrightunsigned(lo, BITS).bitwiseOR(F.shiftleft(F.col(hi).bitwiseAND(F.lit(_CHAR)), BITS * (LOW - 1)))
    return [F.shiftright(hi, BITS), low]


def train(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Model tables of the column ``text``: probabilities (n, hi, lo, p) of all n-grams seen, and weights
    of what is below (n, hi, lo, rest) of all contexts seen."""
    counts = texts.select("text").mapInArrow(_counted, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))
    tables = {ORDER: written(counts, "ngrams")}
    for order in range(ORDER - 1, 0, -1):
        # Continuation counts: in how many different ways an n-gram is preceded.
        hi, lo = _last(order)
        tables[order] = written(tables[order + 1].groupBy(hi.alias("hi"), lo.alias("lo")).agg(F.count("*").alias("n")), "ngrams")
    lower: DataFrame | None = None
    grams, contexts = [], []
    for order in range(1, ORDER + 1):
        t = tables[order]
        many = {r["n"]: r["count"] for r in t.where("n <= 4").groupBy("n").count().collect()}
        d = discounts([many.get(k, 0) for k in (1, 2, 3, 4)])
        off = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        c_hi, c_lo = _before()
        t = t.withColumns({"c_hi": c_hi, "c_lo": c_lo, "off": F.least(off, F.col("n"))})
        sums = t.groupBy("c_hi", "c_lo").agg(F.sum("n").alias("total"), F.sum("off").alias("taken"))
        contexts.append(sums.select(F.lit(order).alias("n"), F.col("c_hi").alias("hi"), F.col("c_lo").alias("lo"), (F.col("taken") / F.col("total")).alias("rest")))
        t = t.join(sums, ["c_hi", "c_lo"])
        if lower is None:
            below = F.lit(FLOOR)
        else:
            b_hi, b_lo = _last(order - 1)
            t, below = t.withColumns({"b_hi": b_hi, "b_lo": b_lo}).join(lower, ["b_hi", "b_lo"]), F.col("p_below")
        p = (F.col("n") - F.col("off")) / F.col("total") + F.col("taken") / F.col("total") * below
        done = written(t.select("hi", "lo", p.alias("p")), "probabilities")
        lower = done.select(F.col("hi").alias("b_hi"), F.col("lo").alias("b_lo"), F.col("p").alias("p_below"))
        grams.append(done.select(F.lit(order).alias("n"), "hi", "lo", "p"))
    all_grams, all_contexts = grams[0], contexts[0]
    for g, c in zip(grams[1:], contexts[1:]):
        all_grams, all_contexts = all_grams.unionByName(g), all_contexts.unionByName(c)
    all_contexts = written(all_contexts, "contexts")
    drop_written(*tables.values())
    return all_grams, all_contexts


def discounts(many: list[int]) -> list[float]:
    """The three discounts of the modified method, from the numbers of n-grams seen 1 to 4 times;
    usual values where a count is missing."""
    n1, n2, n3, n4 = many
    if not (n1 and n2 and n3 and n4):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    out = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return [min(max(v, 0.05), k + 0.95) for k, v in enumerate(out)]


def _number(hi: np.ndarray, lo: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(hi.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * seed) + mix(lo))


class Table:
    """A value for each of a block's n-grams, all that are ever asked for.

    They are told apart by a 64-bit number, for which a seed is chosen that gives each its own.
    """

    def __init__(self, hi: np.ndarray, lo: np.ndarray, values: np.ndarray):
        for self.seed in range(64):
            number = _number(hi, lo, self.seed)
            order = np.argsort(number, kind="stable")
            self.numbers, self.values = number[order], values[order]
            if not (self.numbers[1:] == self.numbers[:-1]).any():
                break
        # Where to begin: by the first bits of the number.
        self.bits = max(1, int(len(hi)).bit_length())
        self.first = np.searchsorted(self.numbers, np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)).astype(np.int32)

    def get(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        number = _number(hi, lo, self.seed)
        at = self.first[(number >> np.uint64(64 - self.bits)).astype(np.int64)]
        more = np.flatnonzero(self.numbers[at] != number)
        while len(more):
            at[more] += 1
            more = more[self.numbers[at[more]] != number[more]]
        return self.values[at]


def blank(text: Column) -> Column:
    """Whether a text is null or has nothing but ASCII white space."""
    return ~F.coalesce(text, F.lit("")).rlike("[^ \\t-\\r]")


def scored(df: DataFrame, grams: DataFrame, contexts: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``df``: id, h (a hash of the text), chars and perplexity (per character, the end of
    the text included; null for a text that is null or has nothing but ASCII white space).

    A block is some batches of a partition that follow each other, so repeated rows and null ids are spread.  Its
    n-grams are gathered where it is read, and its texts travel once, compressed.  ``df`` is read twice and
    must give its rows in the same places, as files do; else a task fails.
    """
    small_batches(df)
    text = F.col(f"`{text_col}`")
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), text_hash(text_col).alias("h"), F.coalesce(text, F.lit("")).alias("text"))
    none = rows.where(blank(F.col("text"))).select("id", "h", F.length("text").cast("long").alias("chars"), F.lit(None).cast("double").alias("perplexity"))
    read = rows.where(~blank(F.col("text")))
    units = read.mapInArrow(_units(block_bytes), "block long, ids array<long>, hs array<long>, ends array<long>, size long, texts binary")
    wanted = written(read.mapInArrow(_of_blocks(block_bytes), "block long, hi long, lo long"), "block-ngrams")
    known = resolved(wanted.select("hi", "lo").distinct(), grams, contexts)
    per_block = wanted.join(known, ["hi", "lo"])
    found = units.groupBy("block").cogroup(per_block.groupBy("block")).applyInArrow(_scored_block, "id long, h long, chars long, perplexity double")
    return found.unionByName(none)


def _blocks(batches: Iterator[pa.RecordBatch], block_bytes: int) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch with the number of its block, its texts' bytes and their offsets."""
    number, size = TaskContext.get().partitionId() << 32, 0
    for b in batches:
        if not b.num_rows:
            continue
        data, off = utf8(b.column("text"))
        if size and size + len(data) > block_bytes:
            number, size = number + 1, 0
        size += len(data)
        yield number, b, data, off


def _units(block_bytes: int):
    """Each batch as a row: its block, ids and hashes, and the texts, compressed, with the end and size of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=TEXT_LEVEL)
        for block, b, data, off in _blocks(batches, block_bytes):
            raw = codec.compress(data.tobytes(), asbytes=True)
            one = np.array([b.num_rows])
            yield pa.record_batch({"block": pa.array([block], pa.int64()), "ids": pa.array([b.column("id").to_pylist()], pa.list_(pa.int64())), "hs": pa.array([b.column("h").to_pylist()], pa.list_(pa.int64())), "ends": lists(off[1:], one, pa.int64()), "size": pa.array([len(data)], pa.int64()), "texts": pa.array([raw], pa.binary())})
        release()

    return run


def _of_blocks(block_bytes: int):
    """The distinct n-grams of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, now = 0, -1

        def told() -> pa.RecordBatch:
            hi, lo, _ = merged(*(np.concatenate(x) for x in zip(*held)))
            return pa.record_batch({"block": pa.array(np.full(len(hi), now)), "hi": pa.array(hi), "lo": pa.array(lo)})

        for block, b, _, off in _blocks(batches, block_bytes):
            if held and block != now:
                yield told()
                held, size = [], 0
            now = block
            for i, j in chunks(off, CHUNK):
                for points, ends, _ in pieces(b.column("text").slice(i, j - i).to_pylist()):
                    held.append(distinct(points, ends))
                    size += len(held[-1][0])
                    if size > 1_000_000 and len(held) > 1:
                        held = [merged(*(np.concatenate(x) for x in zip(*held)))]
                        size = len(held[0][0]) // 2
        if held:
            yield told()
        held = []
        release()

    return run


def _parts(b: pa.RecordBatch | pa.Table, i: int) -> Iterator[tuple[list[str], np.ndarray]]:
    """The texts of a unit, some at once, and their places in it."""
    off = np.append(0, np.array(b.column("ends")[i].values))
    raw = pa.decompress(b.column("texts")[i].as_py(), int(b.column("size")[i].as_py()), "zstd", asbytes=True)
    for x, y in chunks(off, CHUNK):
        cut = off[x : y + 1].tolist()
        yield [raw[p:q].decode() for p, q in zip(cut, cut[1:])], np.arange(x, y)


def _scored_block(units: pa.Table, known: pa.Table) -> pa.Table:
    kinds = {"id": pa.int64(), "h": pa.int64(), "chars": pa.int64(), "perplexity": pa.float64()}
    if not units.num_rows:
        return pa.table({c: pa.array([], t) for c, t in kinds.items()})
    table = Table(known.column("hi").to_numpy(), known.column("lo").to_numpy(), known.column("log_p").to_numpy())
    out = []
    for i in range(units.num_rows):
        for texts, rows in _parts(units, i):
            n, logs = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for points, ends, row in pieces(texts):
                n += np.bincount(row, minlength=len(texts))
                logs += np.bincount(row, weights=table.get(*pairs(points, ends)), minlength=len(texts))
            at = pa.array(rows)
            found = [units.column(c)[i].values.take(at) for c in ("ids", "hs")]
            out.append(pa.table([*found, pa.array(n - 1), pa.array(np.exp(-logs / n))], names=list(kinds)))
    release()
    return pa.concat_tables(out)


def resolved(wanted: DataFrame, grams: DataFrame, contexts: DataFrame) -> DataFrame:
    """hi, lo, log_p of n-grams of order ORDER: joins with the model's shards from the longest n-gram down,
    each with those that no longer one has."""
    at = wanted.select("hi", "lo", F.col("hi").alias("k_hi"), F.col("lo").alias("k_lo"), F.lit(0.0).alias("log_p"))
    done: DataFrame | None = None
    for order in range(ORDER, 0, -1):
        g = grams.where(F.col("n") == order).select(F.col("hi").alias("k_hi"), F.col("lo").alias("k_lo"), "p")
        c = contexts.where(F.col("n") == order).select(F.col("hi").alias("c_hi"), F.col("lo").alias("c_lo"), "rest")
        tried = written(at.join(g, ["k_hi", "k_lo"], "left"), "looked-up")
        found = tried.where("p is not null").select("hi", "lo", (F.col("log_p") + F.log("p")).alias("log_p"))
        done = found if done is None else done.unionByName(found)
        c_hi, c_lo = _before("k_hi", "k_lo")
        left = tried.where("p is null").withColumns({"c_hi": c_hi, "c_lo": c_lo}).join(c, ["c_hi", "c_lo"], "left")
        s_hi, s_lo = _last(order - 1, "k_hi", "k_lo") if order > 1 else (F.lit(0).cast("long"), F.lit(0).cast("long"))
        at = left.select("hi", "lo", s_hi.alias("k_hi"), s_lo.alias("k_lo"), (F.col("log_p") + F.coalesce(F.log("rest"), F.lit(0.0))).alias("log_p"))
    return done.unionByName(at.select("hi", "lo", (F.col("log_p") + float(np.log(FLOOR))).alias("log_p")))


def quantiles(held: DataFrame, quantile: float) -> DataFrame:
    """own, lang, bin, cut: the quantile of ``held`` (lang, bin, perplexity) for each language and each
    length there can be, and (not ``own``) for each length over all languages.

    Where a bin has fewer than LEAST_TEXTS texts, those of the nearest bins (the longer one first) are taken
    with it until there are as many, or no more of the language.
    """
    both = held.withColumn("own", F.lit(True)).unionByName(held.withColumns({"own": F.lit(False), "lang": F.lit("")}))
    by = ["own", "lang"]
    # Languages times some twenty lengths.
    counts = written(both.groupBy(*by, "bin").agg(F.count("*").alias("n")), "held-out-counts")
    targets = counts.select(*by).distinct().withColumn("target", F.explode(F.sequence(F.lit(0), F.lit(LONGEST_BIN))))
    far = 2 * F.abs(F.col("bin") - F.col("target")) - (F.col("bin") > F.col("target")).cast("int")
    before = F.sum("n").over(Window.partitionBy(*by, "target").orderBy(far).rowsBetween(Window.unboundedPreceding, -1))
    near = counts.join(targets, by).withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < LEAST_TEXTS)
    pools = written(near.groupBy(*by, "target").agg(F.min("bin").alias("lo"), F.max("bin").alias("hi")), "pools")
    # Many lengths have the same bins about them: each such range is aggregated once.
    ranges = F.broadcast(pools.select(*by, "lo", "hi").distinct())
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    cuts = both.join(ranges, by).where(F.col("bin").between(F.col("lo"), F.col("hi"))).groupBy(*by, "lo", "hi").agg(cut.alias("cut"))
    return written(pools.join(cuts, [*by, "lo", "hi"]).select(*by, F.col("target").alias("bin"), "cut"), "quantiles")


def classified(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE, slack: float = SLACK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``df``: id, lang, perplexity, threshold and kept.

    Trusted are the texts whose id is in ``labels`` (doc_id, quality, toxic) with quality 1 and not
    toxic in all rows there are for it.  Three quarters of them (by a hash of the id) are counted, all
    of each; the rest give the quantiles of each language and length (in powers of two), with the lengths
    nearest to it where there are too few.  A language without such texts has the quantiles of all
    languages about its texts' lengths.  A null language is one of its own, and so is that of a row
    without an id; rows that repeat an id have its first language.  Texts that are null or have nothing but ASCII
    white space are rejected; without trusted texts all others are kept.  Repeated rows get equal results; an
    empty table gives no rows.
    """
    return _classified(df, labels, id_col, text_col, lang_col, quantile, slack, block_bytes).drop("h")


def _classified(df: DataFrame, labels: DataFrame, id_col: str, text_col: str, lang_col: str, quantile: float = QUANTILE, slack: float = SLACK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """As :func:`classified`, with h, a hash of the text."""
    small_batches(df)
    good = labels.groupBy(F.col("doc_id").cast("long").alias("good")).agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).where("q = 1 and coalesce(t, 0) = 0").select("good")
    good = bounded(written(good, "trusted"))
    fold = F.pmod(F.xxhash64("good", F.lit(29)), F.lit(4))
    ids = F.col(f"`{id_col}`").cast("long")
    text = F.col(f"`{text_col}`")
    trusted = df.where(~blank(text)).select(ids.alias("id"), text.alias("text")).join(good, F.col("id") == F.col("good")).where(fold > 0)
    grams, contexts = train(trusted)
    found = kept(scored(df, grams, contexts, id_col, text_col, block_bytes))
    langs = df.where(ids.isNotNull()).groupBy(ids.alias("id")).agg(F.min(F.coalesce(F.col(f"`{lang_col}`"), F.lit(""))).alias("lang"))
    # A null id has no language of its own, and no partner to wait for.
    sized = found.where("id is not null").join(langs, "id", "left").unionByName(found.where("id is null").withColumn("lang", F.lit("")))
    sized = sized.withColumn("bin", F.floor(F.log2(F.col("chars") + 1)).cast("int"))
    held = sized.join(good, F.col("id") == F.col("good")).where((fold == 0) & F.col("perplexity").isNotNull())
    cuts = quantiles(written(held.select("lang", "bin", "perplexity"), "held-out"), quantile)
    fine = F.broadcast(cuts.where("own").select("lang", "bin", F.col("cut").alias("fine")))
    overall = F.broadcast(cuts.where("not own").select("bin", F.col("cut").alias("all")))
    out = sized.join(fine, ["lang", "bin"], "left").join(overall, "bin", "left")
    threshold = F.coalesce("fine", "all") * slack
    out = out.withColumn("threshold", threshold)
    return out.select("id", "h", "lang", "perplexity", "threshold", (F.col("perplexity").isNotNull() & ((F.col("perplexity") <= F.col("threshold")) | F.col("threshold").isNull())).alias("kept"))


def filtered(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The rows of ``df`` that are kept, with all their columns.  Rows are matched by id (null as well) and
    text, so others that share an id are as they were.  An empty table gives no rows."""
    gone = known_ids(_classified(df, labels, id_col, text_col, lang_col, **options).where(~F.col("kept"))).select("id", "h").distinct()
    return without(df, written(gone, "rejected"), id_col, text_col)
