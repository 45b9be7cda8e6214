"""Byte-level BPE with a segment tree over byte positions.

A leaf holds the rank of the pair that starts at its position, with the position behind it, so that
the root holds the leftmost pair of the least rank. A merge changes up to three leaves: its own, the
one it swallows and its left neighbour; each change moves up the tree in logarithmic time. Short
pieces are merged many at a time, in numpy, each in a tree of its own; long ones one by one.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import Seen, batches

#: White space as Unicode has it, which is narrower than Python's.
_WS = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Stretches across which no match of the pattern reaches.
_STRETCH = re.compile(rf" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+")
NONE, SHIFT = np.int64(1 << 62), 32
LONGEST = 64  # bytes of a piece that is merged together with others


class Ranks:
    """A rank file: tokens by id, and the id that a pair of ids merges into."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {i: t for t, i in self.ids.items()}
        self.bytes = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {(self.ids[t[:k]] << SHIFT) | self.ids[t[k:]]: i for t, i in self.ids.items() for k in range(1, len(t)) if t[:k] in self.ids and t[k:] in self.ids}
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.merged = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of merged pairs; NONE where there are none. Negative ids have no pairs."""
        key = (left << SHIFT) | right
        at = np.minimum(np.searchsorted(self.keys, key), self.keys.size - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.merged[at], NONE)


@lru_cache(maxsize=2)
def ranks(path: str) -> Ranks:
    return Ranks(path)


def merge_one(piece: bytes, r: Ranks) -> list[int]:
    """Token ids of one piece."""
    n, none = len(piece), int(NONE)
    size = 1 << max(1, (n - 1).bit_length())
    ids, after, ahead = [int(r.bytes[b]) for b in piece], [*range(1, n), -1], [-1, *range(n - 1)]

    def leaf(i: int) -> int:
        pair = r.pairs.get((ids[i] << SHIFT) | ids[after[i]]) if after[i] >= 0 else None
        return none if pair is None else (pair << SHIFT) | i

    tree = [none] * (2 * size)
    tree[size : size + n] = map(leaf, range(n))
    for k in range(size - 1, 0, -1):
        tree[k] = min(tree[2 * k], tree[2 * k + 1])

    def put(i: int, value: int) -> None:
        k = size + i
        tree[k] = value
        while k > 1:
            k >>= 1
            low = min(tree[2 * k], tree[2 * k + 1])
            if tree[k] == low:
                return
            tree[k] = low

    while tree[1] < none:
        i, new = tree[1] & ((1 << SHIFT) - 1), tree[1] >> SHIFT
        gone, before = after[i], ahead[i]
        ids[i], after[i] = new, after[gone]
        if after[gone] >= 0:
            ahead[after[gone]] = i
        ids[gone] = -1
        put(gone, none)
        put(i, leaf(i))
        if before >= 0:
            put(before, leaf(before))
    return [x for x in ids if x >= 0]


def merge_many(pieces: list[bytes], size: int, r: Ranks) -> list[bytes]:
    """Token ids, as little-endian unsigned 32-bit integers, of pieces of at most `size` bytes, a power of two."""
    lengths = np.array([len(x) for x in pieces])
    raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in pieces), np.uint8).reshape(-1, size)
    place = np.arange(size)
    ids = np.where(place < lengths[:, None], r.bytes[raw], -1)
    after = np.where(place + 1 < lengths[:, None], place + 1, size)  # size: there is none
    ahead = np.broadcast_to(place - 1, ids.shape).copy()
    ids = np.hstack([ids, np.full((len(pieces), 1), -1)])
    tree = np.full((len(pieces), 2 * size), NONE)
    pair = r.look_up(ids[:, :-1], ids[:, 1:])
    tree[:, size:] = np.where(pair < NONE, (pair << SHIFT) | place, NONE)
    for k in range(size - 1, 0, -1):
        tree[:, k] = np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1])

    def put(row: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
        k = at + size
        tree[row, k] = value
        while k.size and k[0] > 1:
            k = k >> 1
            tree[row, k] = np.minimum(tree[row, 2 * k], tree[row, 2 * k + 1])

    def paired(row: np.ndarray, at: np.ndarray) -> np.ndarray:
        new = r.look_up(ids[row, at], ids[row, after[row, at]])
        return np.where(new < NONE, (new << SHIFT) | at, NONE)

    row = np.nonzero(tree[:, 1] < NONE)[0]
    while row.size:
        top = tree[row, 1]
        at, new = top & ((1 << SHIFT) - 1), top >> SHIFT
        gone = after[row, at]
        following = after[row, gone]
        ids[row, at], ids[row, gone], after[row, at] = new, -1, following
        inner = following < size
        ahead[row[inner], following[inner]] = at[inner]
        put(row, gone, np.full(row.size, NONE))
        put(row, at, paired(row, at))
        before = ahead[row, at]
        inner = before >= 0
        put(row[inner], before[inner], paired(row[inner], before[inner]))
        row = row[tree[row, 1] < NONE]
    live = ids[:, :-1] >= 0
    flat = ids[:, :-1][live].astype("<u4").tobytes()
    ends = np.cumsum(live.sum(1) * 4).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


class Encoder:
    """Token ids, as bytes, of texts: each match of the pattern is merged by itself.

    What has been merged is kept by stretch and by piece, up to a bound."""

    def __init__(self, path: str, pattern: str, most: int = 96 << 20):
        self.ranks, self.pattern, self.most = ranks(path), regex.compile(pattern), most  # most: bytes of each of the three
        self.stretches, self.pieces, self.size = Seen(), {}, 0

    def merge(self, pieces: list[bytes]) -> dict[bytes, bytes]:
        out, sized = {}, {}
        for x in pieces:
            if len(x) > LONGEST:
                out[x] = np.array(merge_one(x, self.ranks), "<u4").tobytes()
            else:
                sized.setdefault(1 << max(1, (len(x) - 1).bit_length()), []).append(x)
        for size, group in sized.items():
            for at in range(0, len(group), 8192):
                part = group[at : at + 8192]
                out.update(zip(part, merge_many(part, size, self.ranks)))
        return out

    def learn(self, stretches: list[str]) -> None:
        parted = [[p.encode() for p in self.pattern.findall(x)] for x in stretches]
        new = self.merge(list({p for x in parted for p in x}.difference(self.pieces)))
        self.pieces |= new
        self.size += sum(map(len, new)) + sum(map(len, new.values())) + Seen.KEPT * len(new)
        for x, p in zip(stretches, parted):
            self.stretches.keep(x, b"".join(map(self.pieces.__getitem__, p)))

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.stretches.size > self.most:
            self.stretches = Seen(dict(self.stretches))
        if self.size > self.most:
            self.pieces, self.size = {}, 0
        seen, parted = self.stretches, [_STRETCH.findall(x) for x in texts]
        out, again = [], []
        for i, x in enumerate(parted):
            before = seen.missed
            out.append(b"".join(map(seen.__getitem__, x)))
            if seen.missed > before:
                again.append(i)
        if again:
            self.learn(list(seen.new))
            seen.new.clear()
            for i in again:
                out[i] = b"".join(map(seen.__getitem__, parted[i]))
        return out


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker, so that later tasks know what earlier ones have merged."""
    return Encoder(path, pattern)


def decode(ids: bytes, r: Ranks) -> bytes:
    return b"".join(map(r.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoded(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids binary]) of every row; a null text counts as empty.

    decoded_sha256 is that of the bytes that the ids decode to. Repeated rows are each returned."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, pattern)
        for frame in batches(frames, 256):
            ids = encode(frame.column(1).to_pylist())
            columns = [frame.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()), pa.array([hashlib.sha256(decode(x, encode.ranks)).hexdigest() for x in ids], pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(ids, pa.binary())] * with_ids], [x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, schema)
