"""Compression of vectors to codes: each is cut into equal parts, each part named by its nearest of a few entries.

The entries of a part position's codebook come from Lloyd's rounds: assign every part to its nearest entry, replace each
entry by the mean of its parts. Rounds keep, for every part, its entry and the exact distance. In the next round only
entries that moved can matter to a part whose own entry stayed: it is compared with those alone; where its own
entry moved, all are compared again. Whole numbers throughout, ties go to the lower index, so this gives
what comparing everything would.

Each round is one pass of the tasks over the vectors, which leaves their state and the sums of the entries in
a table in the shared folder; the codebooks, a fixed number of entries, are all that goes through the driver.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import batches, remove, shared_folder, spare_prefix

SCALE = 4096.0
#: From this size on whole-number components could overflow 64 bits when distances are summed.
MOST = 1 << 28
MOST_BROADCAST = 200_000  # labels
SALTS = 64


class Codebooks:
    """entries: (parts, entries, components) whole numbers; moved: which of them aren't what they were a round ago."""

    def __init__(self, entries: np.ndarray, moved: np.ndarray) -> None:
        self.entries, self.moved = entries, moved

    def after(self, sums: np.ndarray, counts: np.ndarray) -> Codebooks:
        """Each entry replaced by the mean of its parts, rounded down; those without parts stay."""
        used = counts > 0
        new = np.where(used[..., None], sums // np.maximum(counts, 1)[..., None], self.entries)
        return Codebooks(new, (new != self.entries).any(axis=2))

    def digest(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of each row's nearest entry, the lower of equals, and the squared distance."""
    d = np.empty((x.shape[0], entries.shape[0]), np.int64)
    for k, e in enumerate(entries):
        d[:, k] = ((x - e) ** 2).sum(axis=1)
    at = d.argmin(axis=1)
    return at, d[np.arange(at.size), at]


def reassign(x: np.ndarray, codes: np.ndarray, far: np.ndarray, books: Codebooks) -> None:
    """Brings codes and far, of x (vectors, parts, components), up to date in place."""
    for p in range(x.shape[1]):
        moved = np.flatnonzero(books.moved[p])
        if not moved.size:
            continue
        lost = books.moved[p][codes[:, p]]
        if lost.any():
            codes[lost, p], far[lost, p] = nearest(x[lost, p], books.entries[p])
        stay = np.flatnonzero(~lost)
        if stay.size:
            at, d = nearest(x[stay, p], books.entries[p][moved])
            at, have = moved[at], far[stay, p]
            better = (d < have) | ((d == have) & (at < codes[stay, p]))
            codes[stay[better], p], far[stay[better], p] = at[better], d[better]


def whole_components(vector: str) -> Column:
    """floor(4096 x) of each component x; null for a vector that is null, or holds a null or a number that isn't finite."""
    x = F.col(vector)
    finite = F.forall(x, lambda c: F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False)))
    return F.when(x.isNotNull() & finite, F.transform(x, lambda c: F.floor(c.cast("double") * SCALE).cast("long")))


def _rows(batch: pa.RecordBatch, name: str, width: int, kind: type) -> np.ndarray:
    """A list column of equal lengths as (rows, width)."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(kind, copy=True).reshape(batch.num_rows, width)


def _lists(rows: np.ndarray) -> pa.ListArray:
    """(rows, width) as a list column."""
    return pa.ListArray.from_arrays(np.arange(rows.shape[0] + 1, dtype=np.int32) * rows.shape[1], pa.array(rows.ravel()))


def _round(pre: str, books: Codebooks, schema: pa.Schema, first: bool):
    """A pass over (row, x, codes, far): the same with codes and far by these codebooks, and at the end of the task a row with the
    sums and numbers of each entry's parts."""
    parts, entries, width = books.entries.shape
    x_, codes_, far_, sums_ = (pre + n for n in ("x", "codes", "far", "sums"))

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        rows = 0
        for b in batches(frames, 4096):
            x = _rows(b, x_, parts * width, np.int64)
            if x.size and max(x.max(), -x.min()) >= MOST:
                raise ArithmeticError(f"components of {MOST / SCALE:.0f} or more don't fit 64 bits")
            x = x.reshape(-1, parts, width)
            if first:
                codes, far = np.empty(x.shape[:2], np.int64), np.empty(x.shape[:2], np.int64)
                for p in range(parts):
                    codes[:, p], far[:, p] = nearest(x[:, p], books.entries[p])
            else:
                codes, far = _rows(b, codes_, parts, np.int64), _rows(b, far_, parts, np.int64)
                reassign(x, codes, far, books)
            for p in range(parts):
                counts[p] += np.bincount(codes[:, p], minlength=entries)
                for j in range(width):  # whole numbers below 2**53 stay exact
                    sums[p, :, j] += np.bincount(codes[:, p], weights=x[:, p, j], minlength=entries).astype(np.int64)
            rows += b.num_rows
            lists = {codes_: _lists(codes.astype(np.int32)), far_: _lists(far), sums_: pa.nulls(b.num_rows, pa.list_(pa.int64()))}
            yield pa.record_batch([lists.get(f.name, b.column(f.name) if f.name in b.schema.names else None) for f in schema], schema=schema)
        if rows:
            told = pa.array([np.concatenate([sums.ravel(), counts.ravel()])], pa.list_(pa.int64()))
            yield pa.record_batch([told if f.name == sums_ else pa.nulls(1, f.type) for f in schema], schema=schema)

    return run


def coded(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6) -> DataFrame:
    """(key, code, error, label, label_error, codebooks_sha256) of the vectors whose components are all finite numbers.

    code: the entry of each part, two hex digits a part (more beyond 256 entries); error: the squared distances of all parts, in steps of 1/4096;
    label_error: the errors of all vectors with that label, nulls being one. The codebooks begin with the vectors of
    the smallest keys, null keys last, equal keys by their components; with fewer than `entries` vectors there are so many entries.

    Vectors are as long as that of the smallest key which has components; where the length doesn't part evenly, the last part is
    filled up with zeros. A vector of another length, the empty one too, has no code and no error but is returned. Repeated
    rows are coded each. Other columns are left out, whatever their names; no vectors, no rows. Components from
    65,536 on are an error, for their sums might not fit 64 bits."""
    spark, pre = vectors.sparkSession, spare_prefix(vectors)
    kept = vectors.select(F.col(key), F.col(label), whole_components(vector).alias(f"{pre}x")).where(F.col(f"{pre}x").isNotNull())
    start = kept.where(F.size(f"{pre}x") > 0).orderBy(F.asc_nulls_last(key), f"{pre}x")
    length = start.select(F.size(f"{pre}x")).first()
    length = length[0] if length else parts
    starts = np.array([r[0] for r in start.where(F.size(f"{pre}x") == length).select(f"{pre}x").limit(entries).collect()], np.int64)
    width = -(-length // parts)
    if not len(starts):
        starts = np.zeros((1, length), np.int64)
    padded = np.zeros((len(starts), parts * width), np.int64)
    padded[:, :length] = starts
    first = padded.reshape(-1, parts, width).transpose(1, 0, 2)
    books = Codebooks(np.ascontiguousarray(first), np.ones(first.shape[:2], bool))
    x = F.col(f"{pre}x") if width * parts == length else F.concat(f"{pre}x", F.array(*[F.lit(0).cast("long")] * (width * parts - length)))
    state = kept.where(F.size(f"{pre}x") == length).select(key, label, x.alias(f"{pre}x"))
    names = {key: kept.schema[key].dataType.simpleString(), label: kept.schema[label].dataType.simpleString(), f"{pre}x": "array<bigint>", f"{pre}codes": "array<int>", f"{pre}far": "array<bigint>", f"{pre}sums": "array<bigint>"}
    layout = ", ".join(f"`{n}` {t}" for n, t in names.items())
    folder, before = f"{shared_folder(spark)}/vector-codes-{uuid.uuid4().hex}", None
    for k in range(rounds + 1):
        path = f"{folder}/{k}"
        state.mapInArrow(_passes(pre, books, layout, k == 0), layout).write.parquet(path)
        if before:
            remove(spark, before)
        before, table = path, spark.read.schema(layout).parquet(path)
        state = table.where(F.col(f"{pre}sums").isNull()).drop(f"{pre}sums")
        if k < rounds:
            books = books.after(*_summed(table, f"{pre}sums", books.entries.shape))
    error = F.aggregate(f"{pre}far", F.lit(0).cast("long"), lambda a, b: a + b)
    digits = max(2, len(f"{entries - 1:x}"))
    code = F.array_join(F.transform(f"{pre}codes", lambda c: F.lower(F.lpad(F.hex(c.cast("long")), digits, "0"))), "")
    found = state.select(key, label, code.alias("code"), error.alias("error"))
    odd = kept.where(F.size(f"{pre}x") != length).select(key, label, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return _with_label_errors(found.unionByName(odd), label, pre).select(key, "code", "error", label, "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _passes(pre: str, books: Codebooks, layout: str, first: bool):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return _round(pre, books, to_arrow_schema(StructType.fromDDL(layout)), first)


def _summed(table: DataFrame, name: str, shape: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray]:
    """Sums and counts over the tasks' rows: one number for each component of an entry, whatever the number of vectors."""
    each = table.where(F.col(name).isNotNull()).select(F.posexplode(name).alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v"))
    flat = np.zeros(shape[0] * shape[1] * (shape[2] + 1), np.int64)
    for i, v in each.collect():
        flat[i] = v
    n = shape[0] * shape[1] * shape[2]
    return flat[:n].reshape(shape), flat[n:].reshape(shape[:2])


def _with_label_errors(found: DataFrame, label: str, pre: str) -> DataFrame:
    """found with label_error. Sums are made before the shuffle; labels too many to broadcast are repeated SALTS times, so that a
    very common one is met in many tasks."""
    sums = found.groupBy(F.col(label).alias(f"{pre}label")).agg(F.sum("error").alias("label_error"))
    same = F.col(label).eqNullSafe(F.col(f"{pre}label"))
    if sums.count() <= MOST_BROADCAST:
        return found.join(F.broadcast(sums), same, "left")
    spread = sums.withColumn(f"{pre}salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = found.withColumn(f"{pre}deal", F.pmod(F.xxhash64(F.col("code"), F.col("error")), F.lit(SALTS)).cast("int"))
    return dealt.join(spread, same & (F.col(f"{pre}deal") == F.col(f"{pre}salt")), "left")
