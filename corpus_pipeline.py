"""A training corpus in five stages: rules, near copies, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and gives the columns of documents, but for the last, which
gives where each piece of a text lies in the packed sequences. run() writes what a stage gives as
Parquet below the shared folder and reads it again as the next one's docs.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm import near_copies, packing, quality_divergence, simhash, surrogates, unit_dedup
from logspark.llm.common import documents, importable, shared_folder
from logspark.llm.queries import KEY, word_ids


def _as_documents(docs: DataFrame, operator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What operator makes of docs, with the columns of docs; n_chars is that of the text as it is now. Other columns go by other
    names meanwhile, so that none is taken for one which the operator adds."""
    others = {c: f"own_{k}" for k, c in enumerate(c for c in docs.columns if c not in ("doc_id", "text"))}
    found = operator(docs.withColumnsRenamed(others)).select("doc_id", "text", *[F.col(v).alias(k) for k, v in others.items()])
    return found.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, null and blank ones among them; of repeated rows each is judged."""
    return quality_divergence.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, the one with the least doc_id.

    Near: SimHash fingerprints of five-word shingles differ in 3 bits or fewer, or the sets of these shingles
    have a Jaccard similarity of 0.8 or more, which lie about ten bits apart. Rows of one doc_id are one document: one of them stays,
    or none if any of their texts is a near copy of one with a lesser id. Rows without doc_id all stay."""
    importable(spark)
    return near_copies.drop_near_copies(docs, groups=simhash.near_groups(docs, size=near_copies.SIZE).select("doc_id", "component_id"))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines and passages go from all texts but the first that holds them; every document stays."""
    importable(spark)
    return _as_documents(docs, unit_dedup.without_repeats)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by surrogates; every row stays, null texts as they are."""
    return _as_documents(docs, lambda d: surrogates.with_surrogates(d, KEY))


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each token piece in sequences of 4096; a null or empty text is its end token."""
    importable(spark)
    return packing.packed(packing.token_pieces(docs, word_ids()))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("passage_dedup", passage_dedup),
    ("private_data", private_data),
    ("packed_sequences", packed_sequences),
]

#: SQL has neither the fingerprints nor the tokenizer; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    folder, docs = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}", documents(spark, sf_dir)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
