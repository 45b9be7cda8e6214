"""Dashboards from counts that are kept: by minute, level and source, batch by batch.

Every batch writes the counts of its own messages to a folder of its number, so one that runs again replaces what it wrote.
Counts of batches simply add up. A dashboard reads them alone, no query keeps all sources in its state, and old batches are
put together from time to time.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logspark.session import children, get_json, put_json, remove

LAYOUT = "minute timestamp, severity_label string, source string, count long"


def counted(messages: DataFrame, width: str = "minute") -> DataFrame:
    """(minute, severity_label, source, count) of arrivals; a source is a host name, or an address where there is none."""
    source = F.coalesce(F.nullif("hostname", F.lit("")), F.col("source_ip"))
    return messages.groupBy(F.date_trunc(width, "received_at").alias("minute"), "severity_label", source.alias("source")).agg(F.count("*").alias("count"))


def keep(messages: DataFrame, path: str, checkpoint: str, show=None, trigger: dict | None = None) -> StreamingQuery:
    """Keeps the counts of a stream at path; after each batch show(levels, top sources) is called, if given.

    Streams with checkpoints of their own may share a path."""
    spark, run = messages.sparkSession, hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def each(batch: DataFrame, number: int) -> None:
        if number > _merged(spark, path, run)["upto"]:
            counted(batch).coalesce(8).write.mode("overwrite").parquet(f"{path}/{run}/{number:09d}")
        if show:
            every = read(spark, path)
            show(totals(every), top_sources(every))

    return messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def _merged(spark: SparkSession, path: str, run: str) -> dict:
    """What the last merge says: up to which batch the folder holds everything."""
    told = sorted(n for n in children(spark, f"{path}/{run}/_merged") if n.endswith(".json"))
    return get_json(spark, f"{path}/{run}/_merged/{told[-1]}") if told else {"upto": -1, "folder": None}


def _folders(spark: SparkSession, path: str, run: str) -> tuple[list[str], dict]:
    """The folders that hold a run's counts: of the last merge, and of batches since."""
    merged = _merged(spark, path, run)
    since = [n for n in children(spark, f"{path}/{run}") if n.isdigit() and int(n) > merged["upto"]]
    return [f"{path}/{run}/{n}" for n in sorted(since)] + ([merged["folder"]] if merged["folder"] else []), merged


def read(spark: SparkSession, path: str) -> DataFrame:
    """All counts that are kept; the same minute, level and source may come several times."""
    found = [f for run in children(spark, path) for f in _folders(spark, path, run)[0]]
    return spark.read.schema(LAYOUT).parquet(*found) if found else spark.createDataFrame([], LAYOUT)


def merge(spark: SparkSession, path: str) -> None:
    """Puts the batches of each run together: summed up beside, then a note switches to the sum at once, then the old ones go."""
    for run in children(spark, path):
        folders, merged = _folders(spark, path, run)
        upto = max([int(n) for n in children(spark, f"{path}/{run}") if n.isdigit()], default=-1)
        if len(folders) < 2:
            continue
        folder = f"{path}/{run}/sum-{upto:09d}"
        every = spark.read.schema(LAYOUT).parquet(*folders).groupBy("minute", "severity_label", "source").agg(F.sum("count").alias("count"))
        every.write.mode("overwrite").parquet(folder)
        put_json(spark, f"{path}/{run}/_merged/{upto:09d}.json", {"upto": upto, "folder": folder})
        for f in folders:
            remove(spark, f)


def between(counts: DataFrame, first: str, end: str) -> DataFrame:
    """Counts of the minutes from first on and before end."""
    return counts.where((F.col("minute") >= F.lit(first).cast("timestamp")) & (F.col("minute") < F.lit(end).cast("timestamp")))


def totals(counts: DataFrame) -> DataFrame:
    """(severity_label, count); the row without a label is the total. No rows where nothing was counted."""
    return counts.rollup("severity_label").agg(F.sum("count").alias("count"))


def top_sources(counts: DataFrame, n: int = 10) -> DataFrame:
    return counts.groupBy(F.col("source").alias("hostname")).agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "hostname").limit(n)
