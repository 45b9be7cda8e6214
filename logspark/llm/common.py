"""What several text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.session import checkpointed, importable, remove, shared_folder  # noqa: F401  for the modules of this subpackage

#: The six ASCII blanks that part words; a word is a run of anything else.
BLANKS = " \t\n\x0b\x0c\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def spare_prefix(df: DataFrame) -> str:
    """What no column of df begins with, for the names of helper columns."""
    prefix = "__"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def last_at_most(n: int, reached: Callable[[Column], Column]) -> Column:
    """How many of n ascending items are reached, by bisection; reached(i) tells of item i, from 0 on, and is null beyond n."""
    steps = [1 << k for k in reversed(range(max(1, n).bit_length()))]
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, step: F.when(reached(at + step - 1), at + step).otherwise(at))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def words(text: Column) -> Column:
    """Array of the words of a text; none for null and blank texts."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(bare) > 0, F.split(bare, BLANK_RUN)).otherwise(F.array().cast("array<string>"))


def utf8(text: Column) -> Column:
    """The bytes of a text, empty for null: Python tasks get them without decoding."""
    return F.coalesce(text, F.lit("")).cast("binary")


def batches(frames: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into slices of at most so many rows, so that Python lists of texts stay small."""
    for frame in frames:
        for at in range(0, frame.num_rows, rows):
            yield frame.slice(at, rows)


class Seen(dict):
    """Ids by word, in two generations: when the young one is full it becomes the old one, and whatever is
    used of that moves back. Words in neither are noted and stand for no ids meanwhile."""

    KEPT = 170  # bytes that Python adds to two such objects in a dictionary

    def __init__(self, old: dict | None = None) -> None:
        self.old, self.new, self.missed, self.size = old or {}, {}, 0, 0

    def keep(self, word: str | bytes, ids: bytes) -> None:
        self[word] = ids
        self.size += len(word) + len(ids) + self.KEPT

    def __missing__(self, word: str | bytes) -> bytes:
        if (ids := self.old.get(word)) is not None:
            self.keep(word, ids)
            return ids
        self.new[word] = None
        self.missed += 1
        return b""
