"""Corpus pipeline: stages over ``documents``, each written as Parquet and
reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldscope.llm import contamination, order_minhash, secrets, sentencepiece_codec, toxicity
from fieldscope.llm.common import Scratch
from fieldscope.llm.queries import piece_model, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of each class stays."""
    return order_minhash.representatives(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with benchmark passages go."""
    return contamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays."""
    return secrets.redact(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text."""
    return sentencepiece_codec.encode_decode(docs, piece_model())


STAGES = [
    ("toxicity", reject_toxic),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding and decoding", tokenize),
]

ORACLE_SQL = None  # trained scores, near-duplicate classes and token ids are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage is written and read again; the table
    before it, full texts with their secrets, is then removed."""
    tables, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        done = tables.keep(stage(spark, docs, sf_dir))
        tables.drop(docs)
        docs = done
    return docs
