"""Shared folder, written tables and Arrow text access for the operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import drop_written, written

__all__ = ["BROADCAST_ROWS", "NO_ID", "bounded", "chunks", "documents", "drop_written", "forget", "id_text", "kept", "known_ids", "lists", "release", "shown_ids", "small_batches", "text_hash", "utf8", "without", "written"]


def kept(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept on the executors' disks for the plans that read it.

    For tables that come out the same when they are made again: what a lost executor held is then
    recomputed.  Tables with ids that Spark gives out, and loops, need :func:`written`; so do tables that are
    made from a kept one, as plans that hold each other grow large.
    """
    _kept.append(df.persist(StorageLevel.DISK_ONLY))
    return _kept[-1]


_kept: list[DataFrame] = []


def forget() -> None:
    """Free all that :func:`kept` holds.  Plans that still read it make it again."""
    for df in _kept:
        df.unpersist()
    _kept.clear()


#: Rows of a few numbers that may be broadcast (some tens of MB); larger sides are shuffled.
BROADCAST_ROWS = 500_000


def bounded(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it is counted to have ``most`` rows at most, else as it is.
    For written tables of a few fixed-size columns."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Bytes of an Arrow batch: texts can be long, so a number of rows would not bound a worker's memory.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> None:
    """From now on the session sends batches of at most BATCH_BYTES to Python workers."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def id_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Just the id and the text (null: empty), whatever else ``df`` carries."""
    small_batches(df)
    return df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


#: Stands for a null id inside an operator: after all others, and shown as null again.
NO_ID = (1 << 63) - 1


def known_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("id", F.coalesce("id", F.lit(NO_ID)))


def shown_ids(rows: DataFrame, *columns: str) -> DataFrame:
    return rows.withColumns({c: F.nullif(F.col(c), F.lit(NO_ID)) for c in columns or ("id",)})


def text_hash(text_col: str) -> Column:
    """64 bits of a text (null: empty), which tell rows apart that share an id."""
    return F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


def without(df: DataFrame, gone: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``df`` whose id (null: NO_ID) and text hash are not in the written table ``gone`` (id, h)."""
    told = bounded(gone.select(F.col("id").alias("__gone"), F.col("h").alias("__gone_h")))
    own = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID))
    return df.join(told, (own == F.col("__gone")) & (text_hash(text_col) == F.col("__gone_h")), "left_anti")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the row offsets into them (null: empty)."""
    if column.null_count:
        column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) else b"")
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw[:0], off - off[0] if len(off) else np.zeros(1, np.int64)


def chunks(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each, or of a single longer row."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def release() -> None:
    """Give freed memory back to the system at the end of a task: an idle worker stays alive."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def lists(values: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from flat values and cumulative ends (one per row)."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values, type=kind))
