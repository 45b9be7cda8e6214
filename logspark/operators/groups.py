"""Messages grouped by a field, and the first of each group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.operators.filters import Filter, filtered
from logspark.operators.query import order

#: Names that a caller may group by, and their columns.
GROUP_FIELDS = {"severity": "severity_label", "severity_label": "severity_label", "hostname": "hostname", "appName": "app_name", "app_name": "app_name", "sourceIP": "source_ip", "source_ip": "source_ip"}


def group_key(field: str) -> Column | None:
    """The key to group by, absent values under one name; None for a field that can't be grouped by."""
    if (name := GROUP_FIELDS.get(field)) is None:
        return None
    return F.when(F.col(name) == "", "Unknown" if name == "severity_label" else "unknown").otherwise(F.col(name))


def summary(messages: DataFrame, field: str, f: Filter = Filter()) -> DataFrame:
    """(key, count) of the filtered messages, the largest group first; empty for an unknown field."""
    if (key := group_key(field)) is None:
        return messages.limit(0).select(F.lit("").alias("key"), F.lit(0).cast("long").alias("count"))
    return filtered(messages, f).groupBy(key.alias("key")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "key")


def shares(groups: DataFrame) -> DataFrame:
    """Groups with a bar's width, of 100 at most, and the total over all groups: one window over few rows."""
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    width = F.least(F.lit(100.0), F.round(F.col("count") * 100.0 / F.max("count").over(every), 6))
    return groups.select("key", "count", width.alias("width"), F.sum("count").over(every).alias("total"))


def top_of_each(messages: DataFrame, field: str, k: int = 500, f: Filter = Filter(), sort_field: str = "timestamp", direction: str = "desc") -> DataFrame:
    """The first k messages of each group in the given order, with key and pos; none for an unknown field."""
    if (key := group_key(field)) is None:
        return messages.where(F.lit(False)).withColumns({"key": F.lit(""), "pos": F.lit(0)})
    keyed = filtered(messages, f).withColumn("key", key)
    return keyed.withColumn("pos", F.row_number().over(Window.partitionBy("key").orderBy(*order(sort_field, direction)))).where(F.col("pos") <= k)
