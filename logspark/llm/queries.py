"""The registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.llm import bpe, external_shuffle, imatch, importance, lexical_rank, mixing, packing, quality_divergence, simhash, surrogates, toxicity, unit_dedup, vector_codes
from logspark.llm.common import documents, importable, shared_folder
from logspark.llm.oracle import OP1, OP11, OP12, OP13


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


#: The queries' key of surrogates; whoever uses the operator passes a secret of their own.
KEY = "corpus-surrogates"


def word_ids() -> str:
    """Place of the vocabulary whose ids are packed."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_divergence.judged(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("class_distance", 9).alias("class_distance"), F.round("word_distance", 9).alias("word_distance"))


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return importance.resampled(docs, importance.good_texts(docs, labels(spark, sf_dir)))


def op3_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.edited_report(documents(spark, sf_dir))


def op4_unit_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unit_dedup.without_repeats(documents(spark, sf_dir)).select("doc_id", "text", "removed")


def op5_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.with_surrogates(documents(spark, sf_dir), KEY).select("doc_id", "text", "entities")


def op6_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    path = f"{shared_folder(spark)}/external-shuffle-{uuid.uuid4().hex}"
    external_shuffle.write_shards(external_shuffle.shuffled(documents(spark, sf_dir), "doc_id", size), path)
    found = spark.read.parquet(path)
    return found.select("doc_id", size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.token_pieces(documents(spark, sf_dir), word_ids()))


def op8_deobfuscated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, part = documents(spark, sf_dir), F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5
    model = toxicity.fit(toxicity.labelled(docs, labels(spark, sf_dir), part != 0), docs)
    return toxicity.scored(docs, model).select("doc_id", (part == 0).alias("held_out"), "score", "predicted")


def op9_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encoded(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_groups(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op11_lexical_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_rank.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("item_id", "rank", "doc_id", "score")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = vector_codes.coded(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return found.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.planned(documents(spark, sf_dir))
    return found.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def _with_workers(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        importable(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _with_workers(f) for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    """SQL has none of the other queries' hashes, tokenizers and models."""
    return {"op1_distribution_divergence": OP1, "op11_lexical_rank": OP11, "op12_vector_codes": OP12, "op13_source_mixing": OP13}
