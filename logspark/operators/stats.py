"""Dashboard figures."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.functions.labels import SEVERITIES, severity_code

BYTES_A_MESSAGE = 560
TEXTS = ("id", "severity_label", "facility_label", "hostname", "app_name", "proc_id", "msg_id", "message", "raw_message", "source_ip", "protocol", "structured_data")


def totals(messages: DataFrame) -> DataFrame:
    """(severity_label, count); the row without a label is the total."""
    return messages.rollup("severity_label").agg(F.count("*").alias("count"))


def severity_distribution(messages: DataFrame) -> DataFrame:
    """Levels that occur, the most severe first, with their share of the largest."""
    counts = messages.where(F.col("severity_label").isin(*SEVERITIES)).groupBy("severity_label").agg(F.count("*").alias("count"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = F.round(F.col("count") / F.greatest(F.lit(1), F.max("count").over(every)), 6)
    return counts.select(severity_code(F.col("severity_label")).alias("pos"), "severity_label", "count", share.alias("share")).orderBy("pos")


def top_sources(messages: DataFrame, n: int = 10) -> DataFrame:
    """The n sources that sent the most: host names, addresses where there is none."""
    source = F.coalesce(F.nullif("hostname", F.lit("")), F.col("source_ip"))
    return messages.groupBy(source.alias("hostname")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "hostname").limit(n)


def text_bytes() -> Column:
    """The bytes of the texts of messages, all together."""
    size = sum((F.octet_length(c) for c in TEXTS[1:]), F.octet_length(TEXTS[0]))
    return F.coalesce(F.sum(size.cast("long")), F.lit(0))


def storage(messages: DataFrame) -> DataFrame:
    """(message_count, text_bytes, oldest) of the messages' texts."""
    return messages.agg(F.count("*").alias("message_count"), text_bytes().alias("text_bytes"), F.min("timestamp").alias("oldest"))


def size_text(size_mb: Column) -> Column:
    """A size in megabytes as text in KB, MB or GB."""
    return F.when(size_mb < 1, F.format_string("%.0f KB", size_mb * 1024)).when(size_mb < 1024, F.format_string("%.1f MB", size_mb)).otherwise(F.format_string("%.1f GB", size_mb / 1024))


def capacity(messages: DataFrame, count: int = 1_000_000, size_mb: int = 500, days: int = 7) -> DataFrame:
    """What `count` messages take and how many fit into `size_mb`, at the fixed and at the measured size of one."""
    s = storage(messages).select("message_count", (F.col("text_bytes") / F.greatest(F.lit(1), "message_count")).alias("each"))
    return s.select(
        F.round(F.col("each"), 6).alias("measured_bytes"), F.lit(BYTES_A_MESSAGE).alias("fixed_bytes"),
        F.floor(F.lit(count) * BYTES_A_MESSAGE / (1 << 20) + 0.5).cast("long").alias("fixed_mb"), F.floor(F.lit(count) * F.col("each") / (1 << 20) + 0.5).cast("long").alias("measured_mb"),
        F.floor(F.lit(size_mb) * (1 << 20) / BYTES_A_MESSAGE).cast("long").alias("fixed_fit"), F.floor(F.lit(size_mb) * (1 << 20) / F.greatest(F.lit(1.0), "each")).cast("long").alias("measured_fit"),
        F.lit(10 * 86_400 * days).cast("long").alias("at_10_a_second"), F.lit(100 * 86_400 * days).cast("long").alias("at_100_a_second"),
    )


def buffer_usage(messages: DataFrame, size: int = 10_000) -> DataFrame:
    used = F.least(F.count("*"), F.lit(size).cast("long"))
    return messages.agg(used.alias("used"), F.lit(size).cast("long").alias("size"), F.floor(used * 100.0 / size + 0.5).cast("long").alias("percent"))


def rate(messages: DataFrame, seconds: int = 10, step: int = 1, chained: bool | None = None) -> DataFrame:
    """Messages a second over sliding windows, by arrival; works on streams too.

    chained: messages are counted by step first, and windows sum these counts, so what is repeated and shuffled are a row
    a second and task, not messages. None: so in batches, not in streams, where it needs append mode."""
    if chained is None:
        chained = not messages.isStreaming
    length, slide = f"{seconds} seconds", f"{step} seconds"
    if chained:
        counted = messages.groupBy(F.window("received_at", f"{math.gcd(seconds, step)} seconds").alias("s")).agg(F.count("*").alias("n"))
        found = counted.groupBy(F.window(F.window_time("s"), length, slide).alias("w")).agg(F.sum("n").alias("count"))
    else:
        found = messages.groupBy(F.window("received_at", length, slide).alias("w")).agg(F.count("*").alias("count"))
    return found.select("w", "count", (F.col("count") / float(seconds)).alias("rate"))


def tumbling(messages: DataFrame, width: str = "1 hour") -> DataFrame:
    """Messages of each level by tumbling window of arrival; works on streams too."""
    return messages.groupBy(F.window("received_at", width).alias("w"), "severity_label").agg(F.count("*").alias("count"))
