"""A training-corpus pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; run() writes what a
stage returns as Parquet in the shared folder and reads it back for the next.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from caseweave.llm import langid, packing, quality, secrets, simhash
from caseweave.llm.common import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or a certified cutoff reject go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or too unlike every language learnt from lang, go."""
    return langid.keep_known(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: sets of five-word shingles with a similarity of
    0.8 or more. SimHashes at most two bits apart meet by ball hashing; sets further apart, which no
    ball of bounded size reaches, meet by bands of min-hashes. What meets is verified on the sets."""
    return simhash.one_of_each(docs, words=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is masked; no document goes."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), kept=100_000, batch_bytes=2 << 20)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("language id", language_id),
    ("simhash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("packing", pack_sequences),
]

#: SQL can't express the fingerprints, the language models or the vocabulary; tests/llm holds the
#: stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
