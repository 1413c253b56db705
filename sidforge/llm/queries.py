"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sidforge.llm import (
    bpe, compress, dialogue, fingerprint, language, lines, minhash, mixing, neighbours, repeats, secrets, warc, whiten,
)
from sidforge.llm.oracle import ORACLE  # noqa: F401
from sidforge.llm.common import crc_remainder, table
from sidforge.session import scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

VOCABULARY = "byte_bpe_50k.tiktoken"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def sha256(text: str):
    return F.sha2(F.col(text).cast("binary"), 256)


@query
def op1_warc(spark, sf_dir):
    """Every page written to archives and read back."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = scratch_path(spark, "archives")
    warc.write_archives(warc.revisit_plan(pages), path)
    found = warc.payloads(warc.reassemble(warc.read_records(spark, path)))
    return found.select(
        warc.page_number("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.when(F.col("refers_to").isNotNull(), warc.page_number("refers_to")).alias("refers_to"),
    )


@query
def op2_fingerprint(spark, sf_dir):
    return fingerprint.fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op3_repeats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = repeats.remove_repeats(docs, ["doc_id"])
    return kept.select("doc_id", "n_words", "n_removed", sha256("kept_text").alias("kept_sha256"))


@query
def op4_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = bpe.share_ranks(spark, public_tokenizers.path(VOCABULARY))
    return bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, ["doc_id"])


@query
def op5_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(crc_remainder("doc_id", 5) == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").where(~held)
    model = compress.learn(docs.where(~held), labels)
    rated = compress.score(docs.withColumn("held_out", held), model, ["doc_id", "held_out"])
    return rated.withColumn("predicted", (F.col("score") >= compress.CUTOFF).cast("int"))


@query
def op6_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.select("doc_id", "source", mixing.token_count("text").alias("size")))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op7_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False))
    prototypes = language.learn_prototypes(docs.where(~held))
    return language.identify(docs.withColumn("held_out", held), prototypes, ["doc_id", "held_out"])


@query
def op8_secrets(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.span_columns(secrets.scan(docs, ["doc_id"]), ["doc_id"])


@query
def op9_neighbours(spark, sf_dir):
    return neighbours.link_vectors(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


@query
def op10_minhash(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op11_lines(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = lines.drop_repeated_lines(docs, ["doc_id"])
    return kept.select("doc_id", "n_lines", "n_dropped", sha256("kept_text").alias("kept_sha256"))


@query
def op12_conversations(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return dialogue.report(dialogue.repair(dialogue.damage(turns)), turns)


@query
def op13_whitening(spark, sf_dir):
    return whiten.whiten(table(spark, sf_dir, "embeddings"), ["vec_id"])
