"""Corpus pipeline: language ID, line dedup, SimHash near-dedup, source mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns rows of ``docs``' columns, the
last one each document's id counts and digests. Stages only narrow what their
predecessors kept: texts in no learned language go; repeated lines go from the
later texts; of each group of near-equal texts one document stays; sources are
mixed to their targets, a document taken twice being two rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialogmill.llm import bpe, langid, line_dedup, mixing, simhash
from dialogmill.llm.common import settled
from dialogmill.llm.queries import MIX_SEED, SHINGLE_WORDS


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a letter, or of no learned language with half the probability, go."""
    return langid.keep_known(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, to two edits, go; a text without a line left goes too."""
    return line_dedup.drop_near_lines(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, the one with the least doc_id."""
    return simhash.keep_first(docs, SHINGLE_WORDS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.apply_mix(docs, MIX_SEED)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, lang, source, n_tokens, ids_sha256, decoded_sha256) of whole texts."""
    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, pattern)
    decoded = bpe.decode(encoded.drop("text"), ranks, pattern)
    return decoded.select(
        "doc_id",
        "lang",
        "source",
        bpe.id_count().alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup_stage),
    ("simhash_dedup", simhash_dedup),
    ("mix_sources", mix_sources),
    ("encode_bpe", encode_bpe),
]

#: Trained networks and fingerprints are not SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
