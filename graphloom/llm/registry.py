"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, forget


def tokenizer(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


SHARDS = 16


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sharding

    out = sharding.assign(documents(spark, sf_dir), SHARDS)
    return out.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "tokens")


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sketches

    return sketches.edit_study(documents(spark, sf_dir)).withColumnRenamed("id", "doc_id")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import jaccard_join

    out = jaccard_join.classes(documents(spark, sf_dir), k=3, num=90, den=100)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import packing

    out = packing.packed(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))
    return out.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), F.col("n").alias("doc_tokens"), F.col("sequence").alias("sequence_id"), "offset")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import chat

    t = chat.Template()
    said = "</s>[INST] ok [/INST]"
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    kinds = dict(table.dtypes)
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    extra = extra.select(*[F.col(c).cast(kinds[c]) for c in table.columns])
    out = chat.formatted(table.unionByName(extra), t)
    out = out.withColumn("formatted", chat.joined(F.col("segments")))
    out = out.withColumn("read", chat.parsed(F.col("formatted"), t))
    said_all = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat.unescaped(s["text"], t)), "")
    return out.select(
        F.col("id").alias("conv_id"),
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(said_all, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import language_id

    docs = documents(spark, sf_dir)
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4))
    model = language_id.fit(docs.where(fold != 2))
    held_out = F.pmod(F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2
    return language_id.predicted(docs, model).select(F.col("id").alias("doc_id"), held_out.alias("held_out"), F.col("lang").alias("lang_pred"), "score")


def op7_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import sentence_pieces

    out = sentence_pieces.encoded(documents(spark, sf_dir), tokenizer("piece_bpe_32k.model"))
    return out.select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import quality

    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.classified(documents(spark, sf_dir), labels).withColumnRenamed("id", "doc_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import suffix_dedup

    out = suffix_dedup.stripped(documents(spark, sf_dir))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    all_gone = F.sha2(F.lit(""), 256)
    kept = F.when(F.col("kept").isNotNull(), F.sha2("kept", 256)).when(F.size("spans") > 0, all_gone).otherwise(F.lower(F.hex("digest")))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), kept.alias("kept_sha256"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from . import exact_dedup

    out = exact_dedup.groups(documents(spark, sf_dir), keep="largest")
    return out.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


OP10_SQL = """
WITH folded AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(t) AS text_sha256
FROM folded WINDOW g AS (PARTITION BY t)
"""


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END) AS x FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)
), both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(id, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.id, b.b FROM r JOIN both_ways b ON b.a = r.seen)
SELECT r.id AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.seen) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY r.id
"""

OP5_SQL = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '<|endoftext|>', '!E'), '<|turn|>', '!E'),
    '<</SYS>>', '!E'), '<|end|>', '!E'), '<<SYS>>', '!E'), '[/INST]', '!E'), '[INST]', '!E'), '</s>', '!E'), '<s>', '!E') AS esc FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(8 + length(role) + 1 + length(esc) + 8) AS BIGINT) AS formatted_chars,
  regexp_full_match(string_agg(role || ',', '' ORDER BY turn, role, text), '(system,)?(user,assistant,)+') AS valid
FROM e GROUP BY conv_id
"""


def _alone(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """The query, after what earlier ones kept on executors' disks has been freed."""

    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        forget()
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "op1_sharding": op1_sharding,
        "op2_fingerprints": op2_fingerprints,
        "op3_jaccard_join": op3_jaccard_join,
        "op4_packing": op4_packing,
        "op5_chat_format": op5_chat_format,
        "op6_language_id": op6_language_id,
        "op7_sentence_pieces": op7_sentence_pieces,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_exact_dedup": op10_exact_dedup,
        "pipeline": pipeline,
    }
    return {name: _alone(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": OP3_SQL, "op5_chat_format": OP5_SQL, "op10_exact_dedup": OP10_SQL}
