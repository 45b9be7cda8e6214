"""What a clean-up keeps: by age, then by number, then by size."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.operators.rank import days_before, newest
from logspark.operators.stats import storage


def by_age(messages: DataFrame, now: datetime, days: int = 7) -> DataFrame:
    return messages.where(F.col("timestamp") >= F.lit(days_before(now, days))) if days > 0 else messages


def by_count(messages: DataFrame, most: int = 1_000_000) -> DataFrame:
    """The newest `most` messages; 0 keeps all."""
    return newest(messages, most) if most > 0 else messages


def by_size(messages: DataFrame, most_mb: float = 500) -> DataFrame:
    """All if they fit, else without the oldest tenth, at least 1000."""
    if most_mb <= 0:
        return messages
    s = storage(messages).first()
    if s.text_bytes <= most_mb * (1 << 20):
        return messages
    return newest(messages, max(0, s.message_count - max(s.message_count // 10, 1000)))


def apply(messages: DataFrame, now: datetime, days: int = 7, most: int = 1_000_000, most_mb: float = 500) -> DataFrame:
    return by_size(by_count(by_age(messages, now, days), most), most_mb)
