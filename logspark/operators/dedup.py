"""One message for each id: the first to arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_by_id(messages: DataFrame, *order: str) -> DataFrame:
    """Minima of whole rows, summed up before the shuffle: an id with very many copies is one row a task."""
    order = order or ("seq",)
    rest = [c for c in messages.columns if c not in ("id", *order)]
    first = messages.groupBy("id").agg(F.min(F.struct(*order, *rest)).alias("m"))
    return first.select("id", "m.*").select(messages.columns)


def not_yet(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Insert or ignore: what of `new`, first by id, isn't in `existing` yet."""
    return first_by_id(new).join(existing.select("id"), "id", "left_anti").select(new.columns)
