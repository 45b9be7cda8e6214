"""SimHash fingerprints and the near-duplicate groups that they link.

Texts with equal fingerprints are one node. Two nodes link when their fingerprints differ in at
most `radius` bits. The comparison is exact: fingerprints are cut into blocks, and two of them within
the radius agree in all but `radius` blocks, so they meet in a bucket of the blocks where they
agree. Inside a bucket the fingerprints lie sorted by population count in tiles; tile pairs whose
population counts differ beyond the radius are skipped, the others are compared with exclusive-or
and bit counts in numpy. A bucket of more than one tile is dealt out by tile pairs to many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import batches, checkpointed, utf8
from logspark.llm.components import component_roots

TILE = 4096  # fingerprints of a bucket that one task compares at once


def fingerprint_of(text: bytes, size: int = 3) -> int:
    """Fingerprint of a text: majority vote of the XXH64 (seed 42) of its shingles of `size` words.

    A-Z are lower-cased. Fewer words than `size`: one shingle of all; no words: 0."""
    word = text.lower().split()
    if not word:
        return 0
    if len(word) <= size:
        return xxhash.xxh64_intdigest(b" ".join(word), 42)
    n, digest = len(word) - size + 1, xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(b" ".join(x), 42) for x in zip(*(word[i:] for i in range(size)))), ">u8", n)
    votes = np.zeros(64, np.int64)
    for at in range(0, n, 8192):
        votes += np.unpackbits(hashes[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint long) for every row of docs."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            found = np.array([fingerprint_of(x, size) for x in frame.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(run, "doc_id long, fingerprint long")


def block_masks(radius: int, blocks: int) -> list[int]:
    """Signed 64-bit masks: every choice of all but `radius` of the blocks."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    part = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    full = [sum(x) for x in combinations(part, blocks - radius)]
    return [x - (1 << 64) if x >> 63 else x for x in full]


def blocks_for(n: int, radius: int) -> int:
    """Least number of blocks for which a bucket of n spread fingerprints holds 256 or fewer on average."""
    blocks = radius + 1
    while n > 256 * 2 ** (64 * (blocks - radius) / blocks) and blocks < 2 * radius + 4:
        blocks += 1
    return blocks


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of i[k] and j[k] in label, which holds each item's least known class mate."""
    while i.size:
        a, b = label[i], label[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        apart = low < high
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(label, high[apart], low[apart])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up


def tile_links(fps: np.ndarray, side: np.ndarray | None, radius: int, tile: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that join what lies within the radius in fps; at most one for each fingerprint.

    side: where given, only pairs of a True and a False item count."""
    n = fps.size
    weight = np.bitwise_count(fps)
    order = np.argsort(weight, kind="stable")
    f, w, s = fps[order], weight[order].astype(np.int64), None if side is None else side[order]
    label = np.arange(n)
    for a in range(0, n, tile):
        ea = min(a + tile, n)
        for b in range(a, n, tile):
            if w[b] - w[ea - 1] > radius:
                break
            eb = min(b + tile, n)
            near = np.bitwise_count(f[a:ea, None] ^ f[None, b:eb]) <= radius
            if s is not None:
                near &= s[a:ea, None] != s[None, b:eb]
            if a == b:
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            _forest(label, i + a, j + b)
    moved = np.nonzero(label != np.arange(n))[0]
    return order[moved], order[label[moved]]


def _bucket_links(bucket: np.ndarray, fps: np.ndarray, side: np.ndarray, cross: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within whole buckets. bucket: ascending bucket number of each fingerprint."""
    start = np.nonzero(np.r_[True, bucket[1:] != bucket[:-1]])[0]
    sizes = np.diff(np.r_[start, bucket.size])
    us, vs = [np.empty(0, np.uint64)], [np.empty(0, np.uint64)]
    small = np.repeat((sizes <= 64) & ~cross[start], sizes)
    label, at = np.arange(bucket.size), np.nonzero(small)[0]
    for lag in range(1, int(sizes[(sizes <= 64)].max(initial=0))):
        at = at[at + lag < bucket.size]
        at = at[bucket[at] == bucket[at + lag]]
        if not at.size:
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + lag]) <= radius]
        _forest(label, near, near + lag)
    moved = np.nonzero(label != np.arange(bucket.size))[0]
    us.append(fps[moved])
    vs.append(fps[label[moved]])
    for k in np.nonzero((sizes > 64) | cross[start])[0]:
        part = slice(start[k], start[k] + sizes[k])
        i, j = tile_links(fps[part], side[part] if cross[start[k]] else None, radius)
        us.append(fps[part][i])
        vs.append(fps[part][j])
    return np.concatenate(us), np.concatenate(vs)


def _units(n: Column, fp: Column, radius: int, tile: int) -> Column:
    """Tile pairs that a fingerprint takes part in: one unit for a bucket of a single tile."""
    parts = F.ceil(n / tile).cast("long")
    own = F.bit_count(fp).cast("long") * parts + F.pmod(F.xxhash64(fp), parts)

    def pair(other: Column) -> Column:
        return F.struct(F.least(own, other).alias("a"), F.greatest(own, other).alias("b"), (own <= other).alias("first"))

    spread = F.flatten(
        F.transform(
            F.sequence(F.lit(-radius), F.lit(radius)),
            lambda d: F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda s: pair((F.bit_count(fp) + d) * parts + s)),
        )
    )
    one = F.array(F.struct(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.lit(True).alias("first")))
    return F.when(n <= tile, one).otherwise(spread)


def near_links(fps: DataFrame, radius: int = 3, tile: int = TILE) -> DataFrame:
    """(u, v): links between distinct fingerprints that join all within the radius of each other.

    fps: one row per distinct `fingerprint`. Of a bucket of k fingerprints come fewer than k links,
    enough to connect whatever is connected in it."""
    masks = block_masks(radius, blocks_for(fps.count(), radius))
    key = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)]))
    keyed = fps.select("fingerprint", key.alias("k")).select("fingerprint", "k.band", "k.key")
    full = keyed.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = (
        keyed.join(full, ["band", "key"])
        .select("band", "key", "fingerprint", F.explode(_units(F.col("n"), F.col("fingerprint"), radius, tile)).alias("t"))
        .select("band", "key", "t.a", "t.b", "t.first", "fingerprint")
        .repartition("band", "key", "a", "b")
        .sortWithinPartitions("band", "key", "a", "b")
    )

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def linked(x: list[np.ndarray]) -> pa.RecordBatch:
            change = np.zeros(x[0].size, bool)
            for c in x[:4]:
                change[1:] |= c[1:] != c[:-1]
            u, v = _bucket_links(np.cumsum(change), x[5].view(np.uint64), x[4].astype(bool), x[2] != x[3], radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for frame in frames:
            if not frame.num_rows:
                continue
            x = [c.to_numpy(zero_copy_only=False) for c in frame.columns]
            x = x if rest is None else [np.concatenate(p) for p in zip(rest, x)]
            last = np.all([c == c[-1] for c in x[:4]], axis=0)
            cut = x[0].size - int(last.sum())  # the last bucket may go on in the next batch
            rest = [c[cut:] for c in x]
            if cut:
                yield linked([c[:cut] for c in x])
        if rest is not None:
            yield linked(rest)

    return dealt.mapInArrow(run, "u long, v long")


def near_groups(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for every row of docs(doc_id, text, ...).

    component_id is the least doc_id that can be reached over links, itself included. A null text
    counts as empty: fingerprint 0, linked like any other. Rows without doc_id are linked too;
    component_id is null where no row of the group has one. Repeated rows are each returned."""
    found = checkpointed(fingerprints(docs, size))
    nodes = checkpointed(found.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    roots = component_roots(near_links(nodes, radius))
    rooted = nodes.join(roots, nodes.fingerprint == roots.node, "left").select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    groups = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(groups, "root").select("fingerprint", "component_id")
    return found.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def drop_near_copies(docs: DataFrame, radius: int = 3, size: int = 3) -> DataFrame:
    """The documents of docs without near copies: of each group the one with the least doc_id stays.

    Of rows that repeat a doc_id one stays. Rows without doc_id all stay: nothing names them."""
    groups = near_groups(docs.where("doc_id is not null"), radius, size)
    stay = groups.where("doc_id = component_id").select("doc_id").distinct()
    kept = docs.join(stay, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.select(docs.columns).union(docs.where("doc_id is null"))
