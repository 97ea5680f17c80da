"""Queries of the training-data operators, with production parameters."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import contamination, conversation_repair, embedding_dedup, hard_negatives, hash_forest, order_minhash, pii, quality, secrets, sentencepiece_codec, suffix_dedup, token_counts, toxicity
from .oracles import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def piece_model() -> str:
    """Path of the public SentencePiece model; set by LLM_PIECE_MODEL or taken
    from the installed package of public tokenizers."""
    if path := os.environ.get("LLM_PIECE_MODEL"):
        return path
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def q_contamination(spark, sf_dir):
    return contamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def q_sentencepiece(spark, sf_dir):
    return sentencepiece_codec.encode_decode(table(spark, sf_dir, "documents"), piece_model())


def q_toxicity(spark, sf_dir):
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def q_quality(spark, sf_dir):
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def q_secrets(spark, sf_dir):
    return secrets.scan(table(spark, sf_dir, "documents"))


def q_near_duplicates(spark, sf_dir):
    return order_minhash.classes(table(spark, sf_dir, "documents"))


def q_nearest(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return hash_forest.nearest(vectors, vectors.filter("vec_id % 100 = 0"))


def q_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def q_pii(spark, sf_dir):
    """The key is a setting of the deployment; the fallback is for tests."""
    key = os.environ.get("LLM_PII_KEY", "test key")
    return pii.replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"), key)


def q_token_counts(spark, sf_dir):
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = token_counts.derived_edits(table(spark, sf_dir, "documents"))
    return token_counts.count_edited(token_counts.build_trees(docs, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)


def q_conversations(spark, sf_dir):
    """Conversations of which the damage leaves nothing are there with zeros."""
    given = table(spark, sf_dir, "conversations")
    done = conversation_repair.digests(conversation_repair.repair(conversation_repair.damaged(given))).withColumnRenamed("conv_id", "_id")
    ids = given.select("conv_id").distinct()
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    joined = ids.join(done, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def q_near_vectors(spark, sf_dir):
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def q_hard_negatives(spark, sf_dir):
    """Labels of every seventh vector are first moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").withColumn("label", moved)
    return hard_negatives.mine(vectors, F.col("vec_id") % 100 == 0)


QUERIES = {
    "op1_pii_surrogates": q_pii,
    "op2_suffix_dedup": q_suffix_dedup,
    "op3_benchmark_decontamination": q_contamination,
    "op4_toxicity": q_toxicity,
    "op5_sentencepiece": q_sentencepiece,
    "op6_token_counts": q_token_counts,
    "op7_order_minhash": q_near_duplicates,
    "op8_hash_forest": q_nearest,
    "op9_secrets": q_secrets,
    "op10_quality": q_quality,
    "op11_conversation_repair": q_conversations,
    "op12_cover_tree": q_near_vectors,
    "op13_hard_negatives": q_hard_negatives,
}
