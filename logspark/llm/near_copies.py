"""Near copies by the Jaccard similarity of the sets of word shingles of texts.

Texts with equal sets are one node. Candidates come from MinHash: texts that agree in `ROWS` minima
of one of `BANDS` bands share a bucket, in which each is compared with the bucket's leader. A pair links
if the Jaccard similarity of the whole sets, counted exactly, reaches the threshold. Two texts of
similarity 0.8 share no bucket with a probability of (1 - 0.8^4)^24, about 3 in a million.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import batches, checkpointed, utf8
from logspark.llm.components import component_roots

SIZE, SIMILARITY, ROWS, BANDS = 5, 0.8, 4, 24
LEADERS = 6  # bands that choose their leaders alike: a text of a large group is compared with so many others


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """Ascending distinct hashes of the shingles of `size` words; A-Z are lower-cased.

    Fewer words than `size`: one shingle of all; no words: none."""
    word = text.lower().split()
    if len(word) <= size:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(word))] if word else [], np.uint64)
    digest = xxhash.xxh3_64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(x)) for x in zip(*(word[i:] for i in range(size)))), np.uint64, len(word) - size + 1))


def _factors(n: int) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(f"minhash {i}") | 1 for i in range(n)], np.uint64)


def minima(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Least of the hashes under each of the mixes that the factors give."""
    least = np.full(factors.size, 2**64 - 1, np.uint64)
    for at in range(0, found.size, 1024):
        x = found[at : at + 1024, None] * factors
        x ^= x >> np.uint64(31)
        x *= np.uint64(0x9E3779B97F4A7C15)
        np.minimum(least, x.min(0), out=least)
    return least


def band_keys(text: bytes, size: int, factors: np.ndarray) -> tuple[int, list[int]]:
    """Digest of the set of shingles, and one key for each band."""
    found = shingles(text, size)
    least = minima(found, factors).reshape(-1, ROWS)
    return xxhash.xxh3_64_intdigest(found.tobytes()), [xxhash.xxh3_64_intdigest(x.tobytes()) for x in least]


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = np.intersect1d(a, b, assume_unique=True).size
    return both / (a.size + b.size - both) if a.size + b.size else 1.0


def _keyed(docs: DataFrame, size: int) -> DataFrame:
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        factors = _factors(ROWS * BANDS)
        for frame in batches(frames):
            found = [band_keys(x, size, factors) for x in frame.column(1).to_pylist()]
            node = np.array([x[0] for x in found], np.uint64).view(np.int64)
            keys = np.array([x[1] for x in found], np.uint64).view(np.int64).reshape(-1)
            offsets = np.arange(0, BANDS * (len(found) + 1), BANDS, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(node), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))], ["doc_id", "node", "keys"])

    return docs.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(run, "doc_id long, node long, keys array<long>")


def near_links(docs: DataFrame, keyed: DataFrame, least: float = SIMILARITY, size: int = SIZE) -> DataFrame:
    """(u, v): links between nodes whose sets of shingles are at least so similar, counted over the sets themselves."""
    nodes = keyed.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys"))
    nodes = checkpointed(nodes)
    banded = nodes.select("node", F.posexplode("keys").alias("band", "key"))
    rank = F.xxhash64("node", F.col("band") % LEADERS)
    leaders = banded.groupBy("band", "key").agg(F.min(F.struct(rank.alias("r"), F.col("node").alias("n")))["n"].alias("leader"), F.count("*").alias("k")).where("k > 1").drop("k")
    pairs = banded.join(leaders, ["band", "key"]).where("node <> leader")
    pairs = checkpointed(pairs.select(F.least("node", "leader").alias("u"), F.greatest("node", "leader").alias("v")).distinct())
    needed = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes.select("node", "doc_id"), "node")
    # Repeated doc_ids may have several texts: the node tells which one is meant.
    held = docs.select("doc_id", utf8(F.col("text")).alias("text")).join(needed.select("doc_id").distinct(), "doc_id", "left_semi")

    def sets(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            found = [shingles(x, size) for x in frame.column(0).to_pylist()]
            node = np.array([xxhash.xxh3_64_intdigest(x.tobytes()) for x in found], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(node), frame.column(0)], ["node", "text"])

    texts = held.select("text").mapInArrow(sets, "node long, text binary").groupBy("node").agg(F.min("text").alias("text"))
    texts = checkpointed(texts)
    both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("a")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("b")), "v")

    def near(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            a, b = frame.column(2).to_pylist(), frame.column(3).to_pylist()
            mask = pa.array([similarity(shingles(x, size), shingles(y, size)) >= least for x, y in zip(a, b)], pa.bool_())
            yield frame.select(["u", "v"]).filter(mask)

    return both.select("u", "v", "a", "b").mapInArrow(near, "u long, v long")


def drop_near_copies(docs: DataFrame, least: float = SIMILARITY, size: int = SIZE, groups: DataFrame | None = None) -> DataFrame:
    """The documents of docs without near copies: of each group that links join, the one with the least doc_id stays.

    groups(doc_id, component_id): near-duplicates found otherwise, whose links count too. Texts without words are copies of each other. Of rows that repeat a doc_id one stays. Rows without
    doc_id all stay: nothing names them."""
    named = docs.where("doc_id is not null")
    keyed = checkpointed(_keyed(named, size))
    roots = component_roots(near_links(named, keyed, least, size))
    rooted = keyed.select("doc_id", "node").join(roots, "node", "left").select("doc_id", F.coalesce("root", "node").alias("root"))
    if groups is not None:  # a group found otherwise is one more node, linked to the groups of its documents
        both = rooted.join(groups.where("doc_id is not null"), "doc_id").select(F.col("root").alias("u"), F.xxhash64("component_id", F.lit(1)).alias("v"))
        wider = component_roots(both).select(F.col("node").alias("root"), F.col("root").alias("wide"))
        rooted = rooted.join(wider, "root", "left").select("doc_id", F.coalesce("wide", "root").alias("root"))
    stay = rooted.groupBy("root").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    kept = docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(docs.columns).union(docs.where("doc_id is null"))
