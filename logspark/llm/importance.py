"""Importance resampling: documents drawn in proportion to how much likelier the target makes them.

Two bag-of-n-grams models over hashed words and word pairs, one of target texts and one of all raw
texts, give each document a log likelihood ratio. Gumbel noise, a hash of the document's id, is added,
and the k largest sums are the sample: draws without replacement in proportion to the ratio.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import batches, checkpointed, utf8
from logspark.operators import rank

BUCKETS = 10_000
MOST_BROADCAST = 2_000_000  # ids of good texts, 8 bytes each
NO_ID = -(1 << 63)  # stands for a null doc_id: it is the least


class _Hashes(dict):
    """Numbers of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 500_000:
            self.clear()
        self[word] = x = crc32(word)
        return x


def gram_buckets(text: bytes, hashes: dict, buckets: int = BUCKETS) -> np.ndarray:
    """Buckets of the lower-cased words of a text and of its word pairs, repeats included."""
    word = text.lower().split()
    one = np.fromiter(map(hashes.__getitem__, word), np.uint64, len(word))
    two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(20) if one.size else one
    return np.concatenate([one, two]) % np.uint64(buckets)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket comes up in all texts(text binary); one number a bucket reaches the driver."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros(buckets, np.int64), _Hashes()
        for frame in batches(frames):
            for text in frame.column(0).to_pylist():
                total += np.bincount(gram_buckets(text, hashes, buckets).astype(np.int64), minlength=buckets)
        at = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    found = np.zeros(buckets)
    for r in texts.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        found[r.bucket] = r.n
    return found


def log_ratios(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, log_ratio, noise) of every row of docs; null and empty texts have the ratio 0."""
    raw, aim = bucket_counts(docs.select(utf8(F.col("text")).alias("text")), buckets), bucket_counts(target.select(utf8(F.col("text")).alias("text")), buckets)
    # Both smoothed alike: the target by a thousandth part of the raw model, the raw one by one a bucket.
    raw_share = (raw + 1) / (raw + 1).sum()
    aim_share = (aim + 1000 * raw_share) / (aim.sum() + 1000)
    ratio = np.log(aim_share / raw_share)

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = _Hashes()
        for frame in batches(frames):
            found = [float(ratio[gram_buckets(x, hashes, buckets).astype(np.int64)].sum()) for x in frame.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(found, pa.float64())], ["doc_id", "log_ratio"])

    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = docs.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(run, "doc_id long, log_ratio double")
    return scored.withColumn("noise", -F.log(-F.log(uniform)))


def least_of_top(values: DataFrame, k: int, fits: int = 50_000) -> tuple[float, int] | None:
    """The k-th largest (key, doc_id) of values, or None for all: exact counts between sampled splitters cut it out, until so few
    rows are left that one task may sort them. Ties of any number make no difference."""
    if k >= values.count():
        return None
    part, by = values.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), (("key", True), ("doc_id", True))
    span = rank.span_of(part, k, k, by, fits)
    inside = part.where(rank.within(part, by, span))
    if span.size > fits:  # equal in both, however many
        last = inside.first()
    else:
        last = inside.orderBy(*rank.ordered(by)).limit(k - span.skipped).agg(F.min(F.struct("key", "doc_id")).alias("x")).first().x
    return last.key, None if last.doc_id == NO_ID else last.doc_id


def resampled(docs: DataFrame, target: DataFrame, share: float = 0.8, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, log_ratio, key, kept) of every row of docs: kept for the share of them with the largest keys.

    Rows that repeat a doc_id have equal noise; where such ties lie on the boundary all are kept. A
    null doc_id has noise too. An empty target gives every text the ratio 0."""
    found = checkpointed(log_ratios(docs, target, buckets).select("doc_id", "log_ratio", (F.col("log_ratio") + F.col("noise")).alias("key")))
    last = least_of_top(found, math.ceil(share * found.count()))
    return found.withColumn("kept", F.lit(True) if last is None else _from(last))


def _from(last: tuple[float, int]) -> Column:
    key, doc = F.col("key"), F.col("doc_id")
    tied = F.lit(True) if last[1] is None else doc.isNotNull() & (doc >= last[1])
    return (key > last[0]) | ((key == last[0]) & tied)


def good_texts(docs: DataFrame, labels: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """(text) of all documents labelled as of good quality. Up to most_broadcast ids go to the texts; more meet them in a shuffle."""
    good = labels.where("quality = 1 and doc_id is not null").select("doc_id").distinct()
    few = good.count() <= most_broadcast
    return docs.join(F.broadcast(good) if few else good, "doc_id", "left_semi").select("text")
