"""The message store's writing side, and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.render import export_lines, export_rows
from logspark.operators.dedup import first_by_id, not_yet
from logspark.operators.idindex import IdIndex
from logspark.session import exists, get_json, new_folder, put_json, remove
from logspark.sources.lines import read_store


def with_date(messages: DataFrame) -> DataFrame:
    return messages.withColumn("event_date", F.to_date("timestamp"))


def append(messages: DataFrame, path: str, by_day: bool = False, index: IdIndex | None = None) -> None:
    """Messages whose ids aren't in the store yet; of new ones that share an id the first.

    index: look for ids there, see there; else in the store. by_day: look only through the days that the new ones lie on.
    That is enough, and cheaper, where an id tells its day: parse() makes ids of the line and its arrival."""
    spark, new = messages.sparkSession, with_date(messages)
    if index is not None:
        _append_indexed(new, path, index)
        return
    try:
        old = read_store(spark, path)
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        first_by_id(new).write.partitionBy("event_date").parquet(path)
        return
    if by_day:
        days = [r[0] for r in new.select("event_date").distinct().collect()]
        old = old.where(F.col("event_date").isin(days))
    not_yet(new, old).write.mode("append").partitionBy("event_date").parquet(path)


def _append_indexed(new: DataFrame, path: str, index: IdIndex) -> None:
    """Store first, index second; a note tells of an append between the two, whose days the next one takes up from the store."""
    spark, note = new.sparkSession, f"{index.path}/pending.json"
    if exists(spark, note):
        days = get_json(spark, note)
        stored = read_store(spark, path).where(F.col("event_date").cast("string").isin(days)).select("id", "event_date") if exists(spark, path) else None
        if stored is not None:
            index.add(stored.join(index.known(stored), "id", "left_anti"))
        remove(spark, note)
    beside = new_folder(spark, "appended")
    first = first_by_id(new)
    first.join(index.known(first), "id", "left_anti").select(new.columns).write.parquet(beside)
    fresh = spark.read.schema(new.schema).parquet(beside)
    put_json(spark, note, [str(r[0]) for r in fresh.select("event_date").distinct().collect()])
    fresh.write.mode("append").partitionBy("event_date").parquet(path)
    index.add(fresh.select("id", "event_date"))
    remove(spark, note)
    remove(spark, beside)


def compact(spark: SparkSession, path: str, into: str, files_a_day: int = 1) -> None:
    """The store with few files a day, written to another place; a day's rows are spread by id."""
    rows = read_store(spark, path)
    rows.repartition("event_date", F.pmod(F.xxhash64("id"), F.lit(files_a_day))).write.partitionBy("event_date").parquet(into)


def write_csv(messages: DataFrame, path: str, bom: bool = True, single: bool = False) -> None:
    """Nine columns with a header; the byte order mark stands before its first name."""
    rows = export_rows(messages)
    rows = rows.withColumnRenamed("Timestamp", "﻿Timestamp") if bom else rows
    options = {"header": True, "quote": '"', "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    (rows.coalesce(1) if single else rows).write.options(**options).csv(path)


def write_text(messages: DataFrame, path: str) -> None:
    export_lines(messages).write.text(path)
