"""Raw lines from files and streams, the message store, alert rules."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logspark.schema import MESSAGE, RULE
from logspark.session import children, exists, get_json, importable
from logspark.sources.tail import LineSource

KAFKA_BITS = 20  # of a line's seq are its partition's


def raw_lines(texts: DataFrame, protocol: str, source_ip: Column | None = None, received_at: Column | None = None, seq: Column | None = None, id: Column | None = None) -> DataFrame:
    """Raw lines of texts(value, ...): empty ones are skipped, each carries where it came from and when; id, if given, tells it from all others."""
    return texts.where(F.length("value") > 0).select(
        (F.monotonically_increasing_id() if seq is None else seq).alias("seq"), F.col("value").alias("raw"),
        (F.lit("") if source_ip is None else source_ip).alias("source_ip"), F.lit(protocol).alias("protocol"), (F.current_timestamp() if received_at is None else received_at).alias("received_at"),
        *([] if id is None else [id.alias("id")]),
    )


def read_lines(spark: SparkSession, paths: str | list[str], protocol: str, source_ip: str = "") -> DataFrame:
    """Lines of text files; a file's time of change is their arrival."""
    return raw_lines(spark.read.text(paths), protocol, F.lit(source_ip), F.col("_metadata.file_modification_time"))


def _place_id(*place: str) -> Column:
    """An id of a line by where it stands and what it says: the same whenever it is read again."""
    return F.sha2(F.concat_ws("\x1f", *[F.col(p).cast("string") for p in (*place, "value")]), 256)


def stream_lines(spark: SparkSession, path: str, protocol: str, source_ip: str = "", names: str = "*", settle: float = 0) -> DataFrame:
    """Lines of a folder's files as they come and grow. seq is the byte at which a line begins in its file, and the id is of file, byte
    and text: equal lines are different messages, and a line that is read again is the same one. settle: see LineSource."""
    importable(spark)
    spark.dataSource.register(LineSource)
    texts = spark.readStream.format("lines").option("names", names).option("settle", str(settle)).load(path)
    return raw_lines(texts, protocol, F.lit(source_ip), F.col("modified"), F.col("place"), _place_id("file", "place"))


def stream_files(spark: SparkSession, path: str, protocol: str, source_ip: str = "") -> DataFrame:
    """The same by Spark's own source of text files, for stores that stream_lines can't open. That source tells no places of lines: seq is
    the time of arrival, and equal lines of one file have one id, so the ids don't do for leaving out repeats."""
    arrival = F.col("_metadata.file_modification_time")
    return raw_lines(spark.readStream.text(path), protocol, F.lit(source_ip), arrival, F.unix_micros(arrival))


def kafka_seq(offset: Column, partition: Column) -> Column:
    """An order of a topic's lines that no two share: by offset, then partition. More than a million partitions are an error."""
    return F.when(partition < (1 << KAFKA_BITS), F.shiftleft(offset.cast("long"), KAFKA_BITS) + partition).otherwise(F.raise_error(F.lit("too many partitions for seq")).cast("long"))


def stream_kafka(spark: SparkSession, servers: str, topic: str, protocol: str = "UDP") -> DataFrame:
    """Lines of a Kafka topic whose keys are senders' addresses; needs the Kafka connector on the cluster."""
    return kafka_lines(spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load(), protocol)


def kafka_lines(records: DataFrame, protocol: str = "UDP") -> DataFrame:
    """Lines of Kafka records(key, value, topic, partition, offset, timestamp); ids are of topic, partition and offset."""
    texts = records.select(F.col("value").cast("string").alias("value"), F.col("key").cast("string").alias("sender"), "timestamp", "topic", "partition", "offset")
    return raw_lines(texts, protocol, F.coalesce("sender", F.lit("")), F.col("timestamp"), kafka_seq(F.col("offset"), F.col("partition")), _place_id("topic", "partition", "offset"))


def stream_socket(spark: SparkSession, host: str, port: int, protocol: str = "TCP") -> DataFrame:
    """Lines of a socket, for trying things out."""
    texts = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return raw_lines(texts, protocol, F.lit(host), F.current_timestamp(), F.unix_micros(F.current_timestamp()))


def union_transports(*lines: DataFrame) -> DataFrame:
    """The lines of all transports; a line's seq makes room for theirs, so that no two lines share one and each
    transport's order stays."""
    both = lambda a, b: a.unionByName(b, allowMissingColumns=True)  # noqa: E731  not every transport has ids
    return reduce(both, [d.withColumn("seq", F.col("seq") * len(lines) + k) for k, d in enumerate(lines)])


@dataclass(frozen=True, order=True)
class Cut:
    """Where a store begins: at a microsecond and, among the messages of that time, an id."""

    t: int
    id: str

    @property
    def day(self) -> str:
        seconds = min(max(self.t // 1_000_000, -62_135_596_800), 253_402_300_799)  # of the years 1 to 9999
        return (datetime(1970, 1, 1) + timedelta(seconds=seconds)).date().isoformat()

    def kept(self) -> Column:
        """Whether a message lies at or after the cut; days are compared first, so that whole ones aren't opened."""
        day, t = F.col("event_date"), F.unix_micros("timestamp")
        edge = (t > self.t) | ((t == self.t) & (F.col("id") >= self.id))
        return (day >= F.lit(self.day).cast("date")) & ((day > F.lit(self.day).cast("date")) | edge)


def stored_days(spark: SparkSession, path: str) -> dict[str, int]:
    """The days that a store or an index has folders of, and their bytes."""
    return {n.removeprefix("event_date="): size for n, size in children(spark, path).items() if n.startswith("event_date=")}


def cut_of(spark: SparkSession, path: str) -> Cut | None:
    """The cut of the last clean-up, if there was one."""
    told = sorted(n for n in children(spark, f"{path}/_retention") if n.endswith(".json"))
    return Cut(**get_json(spark, f"{path}/_retention/{told[-1]}")) if told else None


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Messages of a store with their event_date, without what clean-ups have cut off."""
    layout = T.StructType([*MESSAGE.fields, T.StructField("event_date", T.DateType())])
    rows = spark.read.schema(layout).parquet(path)
    if exists(spark, note := f"{path}/_retention/day.rewrite"):
        told = get_json(spark, note)
        rows = rows.where(F.col("event_date") != F.lit(told["day"]).cast("date")).unionByName(spark.read.schema(layout).parquet(told["beside"]))
    cut = cut_of(spark, path)
    return rows.where(cut.kept()) if cut else rows


def read_rules(spark: SparkSession, path: str) -> list[dict]:
    """Alert rules of a configuration file {..., "alerts": [...]}, in order."""
    found = spark.read.schema(f"alerts array<{RULE.simpleString()}>").option("multiLine", True).json(path).select(F.inline("alerts"))
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in found.collect()]  # a configuration of a few rows
