"""From raw documents to packed training sequences, by five of the operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is written and read
again before the next one.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import exact_dedup, jaccard_join, packing, quality, suffix_dedup
from graphloom.llm.common import documents, drop_written, forget, written
from graphloom.llm.registry import tokenizer


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go (null and blank texts among them)."""
    forget()  # what the stage before kept: its rows are written
    return quality.filtered(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the one with the largest id stays (one without an id if there is no other)."""
    forget()  # what the stage before kept: its rows are written
    return exact_dedup.deduplicated(docs, keep="largest")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (five-word shingles, similarity 0.8 or more), the smallest id stays (null ids come last)."""
    forget()  # what the stage before kept: its rows are written
    return jaccard_join.representatives(docs)


def suffix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that are repeated go; so does a document of which nothing is left."""
    forget()  # what the stage before kept: its rows are written
    out = suffix_dedup.cleaned(docs)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096; one row per piece."""
    forget()  # what the stage before kept: its rows are written
    out = packing.packed(docs, tokenizer("word_bpe_49k.json"))
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.col("n").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset", F.crc32("ids").alias("ids_crc32"), "ids")


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage), ("suffix-array dedup", suffix_stage), ("packing", packing_stage)]

#: SQL cannot express the tokenizer, the language model and the classes of near copies.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    last: DataFrame | None = None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        drop_written(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
