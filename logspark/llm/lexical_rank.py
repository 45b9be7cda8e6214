"""Ranked lexical search without an index: all documents are scanned for the terms of all items at once.

The terms of the items make one Aho-Corasick automaton that is broadcast. Every term stands in it between two blanks, and
a text is scanned with all its separators as blanks, so only whole terms are found; how often each is, the scan
tells directly. Outputs of the automaton are numbers of terms, which lead to the items that hold them. One scan counts in
how many documents each term is, a second one scores: a task keeps the best few documents of each item.

Items are taken in blocks, so that an automaton is bounded whatever their number: a block has BLOCK_BYTES of terms, or the one
item that has more.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import batches, checkpointed, utf8

#: A term is a run of anything but these ASCII characters: all except digits and letters.
SEPARATORS = bytes(c for c in range(128) if not chr(c).isalnum())
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes: separators become blanks and A-Z small; those of other characters stay.
_PLAIN = bytes.maketrans(SEPARATORS + UPPER.encode(), b" " * len(SEPARATORS) + LOWER.encode())
BLOCK_BYTES = 16 << 20
KEPT_ROWS = 1 << 18  # candidates that a task gathers before it cuts them down to the best of each item
_second = itemgetter(1)


class Block:
    """The terms of a block of items, and for each term the items that hold it and how often."""

    def __init__(self, rows: list) -> None:
        """rows: (item number, term, times)."""
        self.terms = sorted({r[1] for r in rows})
        number = {t: k for k, t in enumerate(self.terms)}
        by_term = sorted((number[t], i, q) for i, t, q in rows)
        self.items = np.array(sorted({i for i, _, _ in rows}), np.int64)
        place = {i: k for k, i in enumerate(self.items.tolist())}
        self.item = np.array([place[i] for _, i, _ in by_term], np.int64)
        self.times = np.array([q for _, _, q in by_term], np.int64)
        counts = np.bincount([k for k, _, _ in by_term], minlength=len(self.terms))
        self.start = np.concatenate([[0], np.cumsum(counts)])
        self.weight: np.ndarray | None = None
        self.n = self.length = 0


_automata: dict = {}


def automaton(block: Broadcast):
    """The automaton of a broadcast block, built once in each worker."""
    if block.value is not _automata.get("of"):
        import ahocorasick

        a = ahocorasick.Automaton()
        for k, term in enumerate(block.value.terms):
            a.add_word(f" {term.encode().decode('latin-1')} ", k)
        a.make_automaton()
        _automata.update(of=block.value, a=a)
    return _automata["a"]


def scanned(frames: Iterator[pa.RecordBatch], block: Broadcast) -> Iterator[tuple]:
    """(key, number of terms, {term: times}) of every text(key, text as bytes)."""
    a = automaton(block)
    for b in batches(frames):
        for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            plain = text.translate(_PLAIN)
            n = _terms_in(plain)
            yield key, n, Counter(map(_second, a.iter(f" {plain.decode('latin-1')} "))) if n else {}


def _terms_in(plain: bytes) -> int:
    held = np.frombuffer(plain, np.uint8) != 32
    return int(held[0]) + int(np.count_nonzero(held[1:] & ~held[:-1])) if held.size else 0


def _counting(block: Broadcast):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents that hold each term; -1: documents with terms; -2: all their terms."""
        df, n, length = np.zeros(len(block.value.terms), np.int64), 0, 0
        for _, terms, found in scanned(frames, block):
            n, length = n + (terms > 0), length + terms
            df[list(found)] += 1
        held = np.flatnonzero(df)
        yield pa.record_batch({"term": np.r_[held, -1, -2], "n": np.r_[df[held], n, length]})

    return run


class _Best:
    """The best documents of each item so far, equal scores by the lower key, null keys last."""

    def __init__(self, items: int, top: int) -> None:
        self.top, self.least, self.held = top, np.ones(items, np.int64), 0
        self.parts: list[tuple] = []

    def offer(self, key: int | None, scores: np.ndarray) -> None:
        items = np.flatnonzero(scores >= self.least)
        if items.size:
            same = np.full(items.size, 0 if key is None else key, np.int64)
            self.parts.append((items, scores[items], np.full(items.size, key is None), same))
            self.held += items.size
            if self.held > max(KEPT_ROWS, 4 * self.top * self.least.size):
                self.cut()

    def cut(self) -> tuple:
        none = tuple(np.empty(0, t) for t in (np.int64, np.int64, bool, np.int64))
        items, scores, absent, keys = columns = [np.concatenate(c) for c in zip(none, *self.parts)]
        order = np.lexsort((keys, absent, -scores, items))
        items = items[order]
        first = np.searchsorted(items, items, "left")
        keep = order[np.arange(items.size) - first < self.top]
        cut = tuple(c[keep] for c in columns)
        last = np.flatnonzero(np.bincount(cut[0], minlength=self.least.size) >= self.top)
        if last.size:
            ends = np.searchsorted(cut[0], last, "right") - 1
            self.least[last] = cut[1][ends]
        self.parts, self.held = [cut], cut[0].size
        return cut


def _scoring(block: Broadcast, top: int):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = block.value
        best = _Best(q.items.size, top)
        for key, terms, found in scanned(frames, block):
            if not found:
                continue
            m = 75 + 25 * terms * q.n // q.length
            at, tf = np.fromiter(found.keys(), np.int64, len(found)), np.fromiter(found.values(), np.int64, len(found))
            each = q.weight[at] * (1_000_000_000 * tf // (1000 * tf + 12 * m))
            sizes = q.start[at + 1] - q.start[at]
            places = np.repeat(q.start[at] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
            scores = np.zeros(q.items.size, np.int64)
            np.add.at(scores, q.item[places], np.repeat(each, sizes) * q.times[places])
            best.offer(key, scores)
        items, scores, absent, keys = best.cut()
        yield pa.record_batch({"no": q.items[items], "doc": pa.array(keys, mask=absent), "score": scores})

    return run


def _terms_of(items: DataFrame, key: str, text: str) -> DataFrame:
    """(no, item, term, times): numbered items and their terms. Rows that are equal in key and text count once; other texts with
    the same key, or without one, are put together as one item."""
    one = items.select(F.col(key).alias("item"), F.col(text).alias("text")).where("text is not null").distinct()
    each = one.select("item", F.explode(F.regexp_extract_all("text", F.lit(f"({TERM})"))).alias("term"))
    counted = each.groupBy("item", F.translate("term", UPPER, LOWER).alias("term")).agg(F.count("*").alias("times"))
    return counted


def _block_rows(items: DataFrame, key: str, text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """Terms of items with their block's number, and the number of blocks; no item is in two. Kept in the shared folder."""
    terms = checkpointed(_terms_of(items, key, text))
    sizes = terms.groupBy("item").agg(F.sum(F.octet_length("term") + 8).alias("bytes"))
    total = sizes.agg(F.sum("bytes")).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes)) if total > block_bytes else 1
    return terms.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks))), blocks


def ranked(documents: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item, rank from 1, doc, score): the `top` documents that score best for each item, equal scores by the lower key.

    Keys are whole numbers; every row of documents is one document, and null keys come last among equal scores. Null, blank
    and empty texts have no terms: they are in no result, as are documents without a term of the item; an item without
    such documents has no rows. Rows of items with equal keys, null too, are one item; equal rows count once. Texts of any length are
    scanned whole, one after the other. Other columns are left out, whatever their names."""
    spark = documents.sparkSession
    texts = documents.select(F.col(doc).cast("long"), utf8(F.col(text)))
    rows, blocks = _block_rows(items, item, item_text, block_bytes)
    found = [_block_ranked(texts, rows.where(F.col("block") == k), top) for k in range(blocks)]
    kind = {item: items.schema[item].dataType.simpleString(), "rank": "int", doc: documents.schema[doc].dataType.simpleString(), "score": "bigint"}
    found = [f for f in found if f is not None]
    if not found:
        return spark.createDataFrame([], ", ".join(f"`{n}` {t}" for n, t in kind.items()))
    every = reduce(DataFrame.unionByName, found)
    return every.select(*[F.col(f"r_{i}").cast(t).alias(n) for i, (n, t) in enumerate(kind.items())])


def _block_ranked(texts: DataFrame, rows: DataFrame, top: int) -> DataFrame | None:
    """The results of one block of items. What comes to the driver are its terms, bounded by the block's bytes."""
    context = texts.sparkSession.sparkContext
    held = rows.select("item", "term", "times").collect()
    if not held:
        return None
    names = list({r[0] for r in held})
    number = {name: k for k, name in enumerate(names)}
    block = Block([(number[r[0]], r[1], r[2]) for r in held])
    counts = texts.mapInArrow(_counting(context.broadcast(block)), "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    told = dict(counts.collect())  # a row for each term of the block
    block.n, block.length = told.get(-1, 0), told.get(-2, 0)
    block.weight = np.array([math.floor(1000 * math.log((2 * block.n + 2) / (2 * told.get(k, 0) + 1))) for k in range(len(block.terms))], np.int64)
    best = texts.mapInArrow(_scoring(context.broadcast(block), top), "no long, doc long, score long")
    order = (F.desc("score"), F.asc_nulls_last("doc"))
    cut = best.withColumn("lot", F.pmod(F.spark_partition_id(), F.lit(64)))
    cut = _first(cut, top, ["no", "lot"], order)
    first = _first(cut, top, ["no"], order)
    item = F.get(F.array(*map(F.lit, names)), F.col("no").cast("int")) if len(names) <= 2000 else None
    if item is None:
        mapped = texts.sparkSession.createDataFrame([(k, n) for k, n in enumerate(names)], f"no long, item {rows.schema['item'].dataType.simpleString()}")
        first = first.join(F.broadcast(mapped), "no")
        item = F.col("item")
    return first.select(item.alias("r_0"), F.col("rank").alias("r_1"), F.col("doc").alias("r_2"), F.col("score").alias("r_3"))


def _first(rows: DataFrame, top: int, keys: list[str], order: tuple[Column, ...]) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
