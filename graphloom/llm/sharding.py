"""Balanced shards by vector bin packing.

Rows are grouped (by equal text), and each group has a vector: bytes, tokens
and rows.  The items that the packer sees are few at any input size:

* groups that are large against a shard are cut into slices of rows (dealt by the
  row's place, as ids may repeat), since one group may hold a third of all rows;
* all other groups are dealt by hash into crates, whose number grows with the
  input up to a bound.

The driver places the items, largest first, each in the shard where the dot
product of its vector with the residual capacity is highest, and the placement
(one row per item) is broadcast back.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import kept

#: Items of small groups: one for so many rows, within these bounds (the driver packs them).
ROWS_PER_CRATE, CRATES, MOST_CRATES = 64, 4096, 1 << 16
#: A group beyond this part of a shard's capacity, in any dimension, is cut into slices of that part.
SLICE_OF_SHARD = 1 / 64
#: Rows that are numbered in one task, on average.
ROWS_PER_LANE = 200_000


def place(vectors: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each item.  Largest items (in their largest dimension) go first; residual
    capacity starts at an equal share of each dimension's total."""
    total = np.maximum(vectors.sum(axis=0), 1e-12)
    v = vectors / total * shards
    residual = np.ones((shards, v.shape[1]))
    out = np.zeros(len(v), np.int32)
    for i in np.argsort(-v.max(axis=1), kind="stable"):
        s = int(np.argmax(residual @ v[i]))
        out[i] = s
        residual[s] -= v[i]
    return out


def tokens(text: Column) -> Column:
    """Runs of characters other than spaces and line ends: the token weight of a text (0 if there are none)."""
    return F.size(F.array_remove(F.split(text, "[ \n]+"), ""))


def assign(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: id, size (UTF-8 bytes plus 1), crc (of the UTF-8 bytes), tokens,
    shard (0 to shards-1) and slot (gapless from 0 in each shard).

    Null text counts as no bytes.  Equal texts share a shard unless their group is large against a
    shard.  Repeated rows, repeated ids and null ids are rows like others, with slots of their own.  An
    empty table gives no rows; other columns of ``df`` are not read.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = kept(
        df.select(F.col(f"`{id_col}`").cast("long").alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("crc"), tokens(text).cast("long").alias("tokens"), F.xxhash64(text).alias("group"), F.monotonically_increasing_id().alias("row")),
    )
    vector = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = rows.agg(*vector).first()
    limits = {k: max(1.0, (total[k] or 0) / shards * SLICE_OF_SHARD) for k in ("size", "tokens", "rows")}
    # At most 3 * shards / SLICE_OF_SHARD groups are beyond a limit: a proven bound.
    large = rows.groupBy("group").agg(*vector)
    slices = F.ceil(F.greatest(*[F.col(k) / F.lit(v) for k, v in limits.items()])).cast("int")
    large = large.withColumn("slices", slices).where("slices > 1").select("group", "slices")
    crates = min(MOST_CRATES, max(CRATES, int(total["rows"]) // ROWS_PER_CRATE))
    item = F.when(F.col("slices").isNotNull(), F.xxhash64("group", F.pmod(F.xxhash64("row"), F.col("slices")))).otherwise(F.pmod(F.xxhash64("group"), F.lit(crates)))
    dealt = rows.join(F.broadcast(large), "group", "left").withColumn("item", item).drop("slices")
    items = dealt.groupBy("item").agg(*vector).orderBy("item").collect()  # crates and slices: both bounded
    shard_of = place(np.array([[r["size"], r["tokens"], r["rows"]] for r in items], float).reshape(-1, 3), shards)
    spark = df.sparkSession
    placed = spark.createDataFrame([(int(r["item"]), int(s)) for r, s in zip(items, shard_of)], "item long, shard int")
    return numbered(dealt.join(F.broadcast(placed), "item"), int(total["rows"])).select("id", "size", "crc", "tokens", "shard", "slot")


def numbered(dealt: DataFrame, rows: int) -> DataFrame:
    """Add ``slot``: rows are dealt to lanes in proportion to their number, numbered there, and
    moved by the sizes of the lanes before, so no shard has to fit in one task."""
    lanes = max(1, rows // ROWS_PER_LANE)
    laned = dealt.withColumn("lane", F.pmod(F.xxhash64("row", F.lit(7)), F.lit(lanes)))
    counts = laned.groupBy("shard", "lane").count()
    before = Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "lane", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    inner = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("id", "row"))
    return laned.withColumn("inner", inner).join(offsets, ["shard", "lane"]).withColumn("slot", (F.col("base") + F.col("inner") - 1).cast("long"))
