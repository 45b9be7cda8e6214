"""Sorting, paging and fetching of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.operators.filters import Filter, filtered
from logspark.operators.rank import numbered, page_at

#: Names that a caller may sort by, and their columns.
SORT_FIELDS = {"timestamp": "timestamp", "severity": "severity", "hostname": "hostname", "appName": "app_name", "app_name": "app_name", "sourceIP": "source_ip", "source_ip": "source_ip", "protocol": "protocol", "message": "message"}
DEEP = 100_000  # rows: pages that end beyond this are found by rank


def order_by(sort_field: str = "timestamp", direction: str = "desc") -> tuple[tuple[str, bool], ...]:
    """(column, descending), ids breaking ties; an unknown field is timestamp, any direction but asc is descending."""
    return tuple((c, direction != "asc") for c in (SORT_FIELDS.get(sort_field, "timestamp"), "id"))


def order(sort_field: str = "timestamp", direction: str = "desc") -> list[Column]:
    return [F.desc(c) if down else F.asc(c) for c, down in order_by(sort_field, direction)]


def page_of(rows: DataFrame, offset: int, size: int, sort_field: str, direction: str, deep: int) -> DataFrame:
    """Rows of a page, unordered: deep ones are found by counting, so that no task sorts all that comes before."""
    if offset + size > deep:
        return page_at(rows, offset, size, order_by(sort_field, direction))
    return rows.orderBy(*order(sort_field, direction)).offset(offset).limit(size)


def page_bounds(page: int, size: int) -> tuple[int, int]:
    """(offset, size) with pages from 1 and sizes from 1 to 1000, else 100."""
    size = size if 1 <= size <= 1000 else 100
    return (max(page, 1) - 1) * size, size


def count_filtered(messages: DataFrame, f: Filter) -> DataFrame:
    return filtered(messages, f).agg(F.count("*").alias("total"))


def page_count(total: int, size: int) -> int:
    return max(1, -(-total // size))


def query_page(messages: DataFrame, f: Filter = Filter(), page: int = 1, size: int = 100, sort_field: str = "timestamp", direction: str = "desc", deep: int = DEEP) -> DataFrame:
    """One page of the filtered messages, with pos counting from 1 within it; past the end it's empty."""
    offset, size = page_bounds(page, size)
    return numbered(page_of(filtered(messages, f), offset, size, sort_field, direction, deep), *order(sort_field, direction))


def regex_page(messages: DataFrame, f: Filter, page: int = 1, size: int = 100, sort_field: str = "timestamp", direction: str = "desc", deep: int = DEEP) -> DataFrame:
    """Like query_page: the page's ids are found on few columns, then its rows are fetched whole."""
    offset, size = page_bounds(page, size)
    few = filtered(messages, f).select("id", SORT_FIELDS.get(sort_field, "timestamp"))
    ids = page_of(few, offset, size, sort_field, direction, deep).select("id")
    return numbered(fetch(messages, ids), *order(sort_field, direction))


def fetch(messages: DataFrame, ids: DataFrame) -> DataFrame:
    """The messages with these ids, at most a page of them."""
    return messages.join(F.broadcast(ids.select("id").distinct()), "id", "left_semi")


def with_hits(messages: DataFrame, hits: DataFrame) -> DataFrame:
    """The messages whose id is among precomputed hits, of any number."""
    return messages.join(hits.select("id"), "id", "left_semi")


def recent(messages: DataFrame, f: Filter = Filter(), size: int = 10_000) -> DataFrame:
    """The last `size` messages by arrival, then filtered; pos counts from the oldest."""
    last = messages.orderBy(F.desc("received_at"), F.desc("seq")).limit(size)
    return numbered(filtered(last, f), F.col("received_at"), F.col("seq"))
