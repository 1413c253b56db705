"""The corpus pipeline: five stages from raw documents to token ids.

Each stage is a function of (spark, docs, sf_dir). The first four return rows with the columns
of ``docs``; every stage's result is written and read again as the next one's input.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidforge.llm import bpe, language, minhash, mixing, secrets
from sidforge.llm.common import crc_remainder, table
from sidforge.session import materialize

VOCABULARY = "byte_bpe_50k.tiktoken"
# Cosine with the nearest language below which an endless text is in none of them. A shorter
# one has a lower cosine also with its own language, so its bound is lower: it starts at 0 for
# LEAST_EVIDENCE trigrams, and up to so many no text is rejected for its cosine.
LEAST_COSINE = 0.3
LEAST_EVIDENCE = 30
SHINGLE, PERCENT = 5, 80


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts far from every learned language.

    How far is far depends on the number of trigrams that count, so short and repetitive texts stay.

    Profiles are learned from the labelled rows of ``docs`` outside the held-out quarter.
    A null text goes, since it has no language.
    """
    held = F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False))
    prototypes = language.learn_prototypes(docs.where(~held).select("doc_id", "text", "lang"))
    found = language.identify(docs, prototypes, docs.columns, "_evidence")
    # Multiplied out, since a text without letters has no evidence.
    far = F.col("score") * F.col("_evidence") < LEAST_COSINE * (F.col("_evidence") - LEAST_EVIDENCE)
    known = (F.col("lang_pred") != language.UNKNOWN) & ~far
    return found.where(known).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-copies the document with the smallest id stays."""
    return minhash.drop_near_duplicates(docs, SHINGLE, PERCENT)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced and ``n_chars`` follows the text."""
    return secrets.redact_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mix_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text."""
    ranks = bpe.share_ranks(spark, public_tokenizers.path(VOCABULARY))
    coded = bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, ["doc_id", "lang", "source", "text"])
    same = F.col("decoded_sha256") == F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return coded.select("doc_id", "lang", "source", "n_tokens", "ids_sha256", same.alias("round_trip"))


STAGES = [
    ("language", keep_known_languages),
    ("near_duplicates", drop_near_copies),
    ("secrets", remove_secrets),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

# Random vectors, MinHash and merges have no SQL form; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
