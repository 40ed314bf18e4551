"""The registered queries of this subpackage. Each is thin: it takes its table, calls the operator, and derives the
columns that are asked for."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_count, chat, decontaminate, fingerprint, html, jaccard_join, langid, packing, resampling, runtime, toxicity


def op1_gated_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text, by a network fitted on labelled rows that are not held out."""
    docs = runtime.table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, runtime.table(spark, sf_dir, "labels")))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weight of every whole text, and whether the Gumbel draw selects it."""
    docs = runtime.table(spark, sf_dir, "documents")
    return resampling.resample(docs, resampling.fit(docs, runtime.table(spark, sf_dir, "labels")))


def op3_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and their likeness."""
    rows = fingerprint.with_next(runtime.table(spark, sf_dir, "documents"))
    rows = rows.withColumn("edited", fingerprint.half_replaced(F.col("text"), F.col("next_text")))
    rows = rows.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        F.col("sketch").alias("s_text"),
        fingerprint.sketches(F.col("edited")).alias("s_edited"),
        F.col("next_sketch").alias("s_next_text"),
    )
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint.fingerprint(F.col("s_text")).alias("fingerprint"),
        fingerprint.fingerprint(F.col("s_edited")).alias("edited_fingerprint"),
        fingerprint.likeness(F.col("s_text"), F.col("s_edited")).alias("near_edited"),
        fingerprint.likeness(F.col("s_text"), F.col("s_next_text")).alias("near_next"),
    )


def op4_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every test item found in every whole text, within the error budget."""
    return decontaminate.matches(runtime.table(spark, sf_dir, "documents"), runtime.table(spark, sf_dir, "benchmark"))


def op5_rank_order_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, by profiles learned on rows that are not held out."""
    docs = runtime.table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.learn(docs))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of every whole text under five-word-shingle Jaccard of 0.75 or more."""
    return jaccard_join.join(runtime.table(spark, sf_dir, "documents"))


def op7_schema_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and conversation -7 formatted, and what is read back from the output."""
    control = r"\### Assistant: </turn> ok"
    rows = runtime.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("SELECT -7L AS conv_id, 0L AS turn, 'user' AS role, :t AS text UNION ALL SELECT -7L, 1L, 'assistant', :t", {"t": control})
    formatted = chat.formatted(chat.canonical_turns(chat.gathered(rows.unionByName(extra), "conv_id", "turn", "role", "text")))
    return chat.read_back(formatted).select(F.col("id").alias("conv_id"), "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op8_heap_bpe_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every whole text."""
    return bpe_count.token_counts(runtime.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), 4096)


def op9_min_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack(runtime.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 2048, 0)


def op10_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html.main_text(runtime.table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_gated_recurrent_toxicity,
        op2_importance_resampling,
        op3_order_minhash,
        op4_pigeonhole_decontamination,
        op5_rank_order_langid,
        op6_ngram_jaccard_join,
        op7_schema_chat,
        op8_heap_bpe_count,
        op9_min_bin_slack,
        op10_wrapper_extraction,
    )
}
#: The one operator whose result SQL can say.
ORACLES: dict[str, str] = {
    "op7_schema_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, replace(replace(text, '\', '\\'), '<|', '\<|') AS e, replace(replace(replace(role, '\', '\\'), '<|', '\<|'), '|', '\|') AS r FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(7 + length(r) + 2 + length(e) + 8) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id""",
}
