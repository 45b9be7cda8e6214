"""The newest n rows, and rows at deep offsets, without sorting everything in one task.

Splitters are drawn from the rows: those of the least hashes are a sample, and its values near the wanted ranks, with some
of all the others, cut the rows into ranges. One pass counts the rows of each range exactly, which tells where
the wanted ranks lie; only those ranges are ranked. If they still hold too many rows they are cut again. Each cut divides by
thousands, whatever the values have in common, so it takes two or four passes, not one for each letter.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

MOST_RANKED = 200_000
SAMPLE = 20_000  # rows whose sort columns are drawn
NEAR, EVEN = 100, 50  # splitters around a wanted rank, and over all
By = tuple[tuple[str, bool], ...]  # columns and whether they go down; all in one direction, the last telling rows apart


@dataclass(frozen=True)
class Span:
    """Rows after the splitter `low`, up to `high` and with it, in some order; None: no bound. skipped rows lie before it, size in it."""

    low: tuple | None
    high: tuple | None
    skipped: int
    size: int


def _key(rows: DataFrame, by: By) -> list[Column]:
    """The sort columns as values that come back from the driver unchanged: times as microseconds."""
    return [F.unix_micros(c) if rows.schema[c].dataType.typeName() == "timestamp" else F.col(c) for c, _ in by]


def _struct(columns: list[Column]) -> Column:
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate(columns)])


def _literal(rows: DataFrame, by: By, value: tuple) -> Column:
    kinds = [rows.select(k.alias("k")).schema["k"].dataType for k in _key(rows, by)]
    return _struct([F.lit(v).cast(t) for v, t in zip(value, kinds)])


def within(rows: DataFrame, by: By, span: Span) -> Column:
    """Whether a row lies in a span. The first column is compared by itself too: scans skip files and row groups by that."""
    key, down, name = _struct(_key(rows, by)), by[0][1], by[0][0]
    plain = (lambda v: F.timestamp_micros(F.lit(v))) if rows.schema[name].dataType.typeName() == "timestamp" else F.lit
    out = F.lit(True)
    for value, least in ((span.low, not down), (span.high, down)):
        if value is None:
            continue
        at = _literal(rows, by, value)
        out &= (key < at if down else key > at) if value is span.low else (key >= at if down else key <= at)
        if value[0] is not None:  # nulls come before all values going up
            out &= F.col(name) >= plain(value[0]) if least else F.col(name).isNull() | (F.col(name) <= plain(value[0]))
    return out


def _sampled(part: DataFrame, by: By) -> tuple[list[tuple], int]:
    """Values of some rows in the order `by`, each once, and about how many rows there are."""
    seen = Observation()
    keys = [k.alias(f"k{i}") for i, k in enumerate(_key(part, by))]
    drawn = part.select(*keys).observe(seen, F.count(F.lit(1)).alias("n")).orderBy(F.xxhash64(*[f"k{i}" for i in range(len(by))])).limit(SAMPLE)
    order = [F.desc(f"k{i}") if down else F.asc(f"k{i}") for i, (_, down) in enumerate(by)]
    values = list(dict.fromkeys(tuple(r) for r in drawn.orderBy(*order).collect()))
    return values, seen.get["n"] if values else 0


def _chosen(values: list[tuple], ranks: tuple[int, ...], n: int) -> list[tuple]:
    """Splitters among sampled values: close ones where the wanted ranks should lie, and some over all."""
    last, places = len(values) - 1, set()
    spread = 3 * math.sqrt(len(values)) + 2
    for r in ranks:
        middle = r / max(1, n) * last
        places |= {min(last, max(0, round(middle + spread * (2 * k / NEAR - 1)))) for k in range(NEAR + 1)}
    places |= {round(last * k / EVEN) for k in range(EVEN + 1)}
    return [values[p] for p in sorted(places)]


def _counts(part: DataFrame, by: By, splitters: list[tuple]) -> list[int]:
    """Rows up to the first splitter, then up to the second, ..., and after the last."""
    every = F.array(*[_literal(part, by, s) for s in splitters])
    key, down, n = F.col("key"), by[0][1], len(splitters)
    steps = [1 << k for k in reversed(range(n.bit_length()))]

    def onward(at: Column, step: Column) -> Column:
        """Bisection: at splitters are known to lie before the row."""
        s = F.get(every, at + step - 1)
        return F.when((at + step <= n) & (s > key if down else s < key), at + step).otherwise(at)

    place = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), onward)
    found = part.select(_struct(_key(part, by)).alias("key")).groupBy(place.alias("b")).agg(F.count("*").alias("n")).collect()  # a row for each splitter
    out = [0] * (n + 1)
    for b, size in found:
        out[b] = size
    return out


def span_of(rows: DataFrame, first: int, last: int, by: By, most_ranked: int = MOST_RANKED) -> Span:
    """A span that holds the rows of ranks first to last, from 1, in the order `by`: of at most most_ranked rows more than those, but
    where rows are equal. Where ranks lie beyond the end, so does the span."""
    if len({down for _, down in by}) > 1:
        raise ValueError("columns must all go up or all go down")
    span, size = Span(None, None, 0, -1), None
    while True:
        part = rows.where(within(rows, by, span))
        values, n = _sampled(part, by)
        if n <= most_ranked or not values:
            return Span(span.low, span.high, span.skipped, n)
        splitters = _chosen(values, (first - span.skipped, last - span.skipped), n)
        counts = _counts(part, by, splitters)
        low = high = None
        before, total = 0, 0
        for b, c in enumerate(counts):
            if total + c < first - span.skipped and b < len(splitters):
                before, low = total + c, splitters[b]
            total += c
            if total >= last - span.skipped:
                high = splitters[b] if b < len(splitters) else None
                break
        inside = total - before
        span = Span(low or span.low, high or span.high, span.skipped + before, inside)
        if inside <= max(most_ranked, last - first + 1) or inside == size:
            return span
        size = inside


def ordered(by: By) -> list[Column]:
    return [F.desc(c) if down else F.asc(c) for c, down in by]


def newest(rows: DataFrame, n: int, name: str = "timestamp", ties: str = "id", most_ranked: int = MOST_RANKED) -> DataFrame:
    """The n rows with the latest `name`, ties by the larger `ties`; all rows if there are no more."""
    if n <= 0:
        return rows.where(F.lit(False))
    by = ((name, True), (ties, True))
    edge = span_of(rows, n, n, by, most_ranked)
    ahead = rows.where(F.lit(False)) if edge.low is None else rows.where(within(rows, by, Span(None, edge.low, 0, 0)))
    return ahead.unionByName(rows.where(within(rows, by, edge)).orderBy(*ordered(by)).limit(n - edge.skipped))


def page_at(rows: DataFrame, offset: int, size: int, by: By = (("timestamp", True), ("id", True)), most_ranked: int = MOST_RANKED) -> DataFrame:
    """Rows offset .. offset + size - 1 in the order `by`: only the span that holds them is sorted."""
    span = span_of(rows, offset + 1, offset + size, by, most_ranked)
    return rows.where(within(rows, by, span)).orderBy(*ordered(by)).offset(offset - span.skipped).limit(size)


def numbered(small: DataFrame, *order: Column) -> DataFrame:
    """A limited result with its order as column pos, from 1."""
    return small.withColumn("pos", F.row_number().over(Window.orderBy(*order)))


def days_before(now: datetime, days: int) -> datetime:
    return now - timedelta(days=days)
