"""The corpus pipeline: quality rules, exact dedup, SimHash near-dedup, mixing to target weights, packing.

Each stage takes what the one before it kept, as a table read again from Parquet, and works on all of it. Every stage but the
last returns the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from diffmill.llm import exact_dedup, mixing, packing, quality_rules, simhash
from diffmill.llm.common import table, written

#: Texts of a similarity of 0.8 over five words are copies. Fingerprints over four words within nine bits are candidates, and so
#: are texts that share a band key of minimum hashes: these bring together the copies that lie more bits apart.
NEAR_WORDS, NEAR_RADIUS, NEAR_LEAST = 4, 9, 0.8
TOKENIZER = "word_bpe_49k.json"


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality_rules.drop_rejected(docs)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, also where rows repeat."""
    return exact_dedup.drop_exact_copies(docs, repeats=False)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.drop_near_copies(docs, NEAR_WORDS, NEAR_RADIUS, least=NEAR_LEAST)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the words that the mix takes of each source ask for."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path(TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("exact_dedup", drop_exact),
    ("simhash_near_dedup", drop_near),
    ("mixing", mix),
    ("packing", pack),
]

#: SQL can express neither near duplicates nor packing: tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
