"""Clean-up of the message store: what is too old, too many or too large goes.

A clean-up finds one cut in the order of (timestamp, id) and writes it down in a small file that appears at once: from then
on read_store() shows what lies at or after the cut. Only then whole days before it are deleted, folder by folder, and the
day that the cut runs through may be rewritten. Whatever breaks off, the store can be read, as it was or as it shall be.
Counts of days tell the day of the cut, so only that day's rows are looked at.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.operators import stats
from logspark.operators.idindex import IdIndex
from logspark.operators.rank import newest
from logspark.session import children, exists, get_json, new_folder, put_json, remove
from logspark.sources.lines import Cut, cut_of, read_store, stored_days

LAST = 1 << 62  # microseconds: after everything


@dataclass(frozen=True)
class Limits:
    """0: no limit. A store beyond most_mb loses its oldest tenth, at least 1000 messages; measure: its files (disk) or the texts of its messages (text)."""

    days: int = 7
    most: int = 1_000_000
    most_mb: float = 500
    measure: str = "disk"


def _micros(t: datetime) -> int:
    t = t.replace(tzinfo=timezone.utc) if t.tzinfo is None else t.astimezone(timezone.utc)
    return (t - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def _newest_from(rows: DataFrame, n: int) -> Cut | None:
    """Where the newest n rows begin; None if there are no more. A count of each day, then the rows of one day."""
    if n <= 0:
        return Cut(LAST, "")
    left = n
    for day, size in sorted(rows.groupBy("event_date").agg(F.count("*").alias("n")).collect(), reverse=True):
        if size > left:
            of_day = rows.where(F.col("event_date") == F.lit(day)).select("timestamp", "id")
            if not left:
                return Cut(_micros(datetime(day.year, day.month, day.day) + timedelta(days=1)), "")
            first = newest(of_day, left).agg(F.min(F.struct(F.unix_micros("timestamp").alias("t"), "id")).alias("m")).first().m
            return Cut(first.t, first.id)
        left -= size
    return None


def _size_mb(spark: SparkSession, path: str, rows: DataFrame, cut: Cut, measure: str) -> float:
    if measure == "text":
        return stats.storage(rows).first().text_bytes / (1 << 20)
    sizes = stored_days(spark, path)
    whole = sum(n for day, n in sizes.items() if day > cut.day)
    if not (edge := sizes.get(cut.day)):
        return whole / (1 << 20)
    of_day = read_store(spark, path).where(F.col("event_date") == F.lit(cut.day).cast("date"))
    share = of_day.agg(F.avg(cut.kept().cast("int"))).first()[0] or 0.0
    return (whole + share * edge) / (1 << 20)


def find_cut(spark: SparkSession, path: str, now: datetime, limits: Limits = Limits()) -> Cut:
    """Where the store shall begin: by age, then by number, then by size, each looking at what the one before leaves."""
    cut = cut_of(spark, path) or Cut(-LAST, "")
    rows = read_store(spark, path)
    if limits.days > 0:
        cut = max(cut, Cut(_micros(now - timedelta(days=limits.days)), ""))
    if limits.most > 0 and (found := _newest_from(rows.where(cut.kept()), limits.most)):
        cut = max(cut, found)
    if limits.most_mb > 0:
        left = rows.where(cut.kept())
        if _size_mb(spark, path, left, cut, limits.measure) > limits.most_mb:
            n = left.count()
            if found := _newest_from(left, max(0, n - max(n // 10, 1000))):
                cut = max(cut, found)
    return cut


def clean(spark: SparkSession, path: str, now: datetime, limits: Limits = Limits(), ids: IdIndex | None = None, postings: str | None = None) -> Cut:
    """Cuts the store and deletes the days before, also of its indexes. Messages of the cut-off time that come later stay hidden."""
    cut = find_cut(spark, path, now, limits)
    if cut != cut_of(spark, path):
        numbers = [int(n.removesuffix(".json")) for n in children(spark, f"{path}/_retention") if n.endswith(".json")]
        put_json(spark, f"{path}/_retention/{max(numbers, default=0) + 1:08d}.json", {"t": cut.t, "id": cut.id})
    vacuum(spark, path)
    if ids:
        ids.drop_before(cut.day)
    if postings:
        _drop_days(spark, postings, cut.day)
    return cut


def _drop_days(spark: SparkSession, path: str, day: str) -> None:
    for name in stored_days(spark, path):
        if name < day:
            remove(spark, f"{path}/event_date={name}")
    spark.catalog.refreshByPath(path)


def vacuum(spark: SparkSession, path: str) -> None:
    """Deletes the days that lie before the cut whole. May break off and run again."""
    if cut := cut_of(spark, path):
        _drop_days(spark, path, cut.day)


def rewrite_cut_day(spark: SparkSession, path: str) -> None:
    """Writes the day of the cut without what is cut off: beside first, which readers take as the day while its folder is replaced."""
    cut, note = cut_of(spark, path), f"{path}/_retention/day.rewrite"
    if cut is None:
        return
    if not exists(spark, note):
        beside = new_folder(spark, "cut-day")
        read_store(spark, path).where(F.col("event_date") == F.lit(cut.day).cast("date")).write.parquet(beside)
        put_json(spark, note, {"day": cut.day, "beside": beside})
    told = get_json(spark, note)
    rows = spark.read.parquet(told["beside"])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
    remove(spark, note)
    remove(spark, told["beside"])
    spark.catalog.refreshByPath(path)
