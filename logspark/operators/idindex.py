"""Which ids a store holds, kept beside it, so that insert-or-ignore neither reads nor shuffles the store.

The ids lie in a table bucketed by id, in a folder for each day. Beside it stand Bloom filters, one for each bucket, day and
append. New ids first meet the filters of their own buckets, which are a thirtieth of the ids; nearly all that are really
new end there. What a filter lets through is looked for in the buckets of those days alone: bucket meets bucket, the ids
that are stored aren't shuffled.
"""

from __future__ import annotations

import hashlib
from datetime import date
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.session import children, exists, get_json, importable, new_folder, put_json, remove

BUCKETS = 64
BITS_AN_ID, PROBES = 16, 8  # a filter lets one in two thousand strange ids through
MOST_LITERALS = 64  # ids that are named in the plan, so that their buckets alone are read
MOST_BROADCAST = 200_000
_FILTERS = "bucket int, bits binary, event_date date"


class IdIndex:
    """The ids of a store, in the folder `path`; buckets holds for a new one, an old one keeps its own number."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path = spark, path
        if exists(spark, f"{path}/layout.json"):
            self.buckets = get_json(spark, f"{path}/layout.json")["buckets"]
        else:
            self.buckets = buckets
            put_json(spark, f"{path}/layout.json", {"buckets": buckets})
        self.table = "ids_" + hashlib.sha256(path.encode()).hexdigest()[:16]
        if not spark.catalog.tableExists(self.table):
            spark.sql(f"CREATE TABLE {self.table} (id STRING, event_date DATE) USING parquet PARTITIONED BY (event_date) CLUSTERED BY (id) SORTED BY (id) INTO {self.buckets} BUCKETS LOCATION '{path}/ids'")
        if exists(spark, f"{path}/ids"):
            spark.catalog.recoverPartitions(self.table)

    def bucket(self, name: str = "id") -> Column:
        """The bucket of an id, by the same hash as the table's."""
        return F.pmod(F.hash(name), F.lit(self.buckets))

    def ids(self) -> DataFrame:
        return self.spark.table(self.table)

    def filters(self) -> DataFrame:
        return self.spark.read.schema(_FILTERS).parquet(f"{self.path}/filters")

    def known(self, new: DataFrame) -> DataFrame:
        """(id) of new(id, ...) that the index holds, each once."""
        if not exists(self.spark, f"{self.path}/filters"):
            return new.select("id").limit(0)
        maybe = self.passed(new)
        days = [r[0] for r in maybe.select("event_date").distinct().collect()]  # at most the days of the store
        if not days:
            return new.select("id").limit(0)
        stored = self.ids().where(F.col("event_date").isin(days))
        few = maybe.select("id").distinct().limit(MOST_BROADCAST + 1).collect() if maybe.count() <= MOST_LITERALS else None
        if few:
            return stored.where(F.col("id").isin([r[0] for r in few])).select("id").distinct()
        wanted = maybe.select("id").distinct().repartition(self.buckets, "id")
        return stored.select("id").join(wanted.hint("shuffle_hash"), "id", "left_semi").distinct()

    def passed(self, new: DataFrame) -> DataFrame:
        """(id, event_date) of new ids and the days whose filters let them through; kept in the shared folder."""
        importable(self.spark)
        asked = new.select("id", self.bucket().alias("bucket"))
        buckets = [r[0] for r in asked.select("bucket").distinct().collect()]
        filters = self.filters().where(F.col("bucket").isin(buckets))
        met = asked.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_let_through, "id string, event_date date")
        path = new_folder(self.spark, "passed-ids")
        met.write.parquet(path)
        return self.spark.read.parquet(path)

    def add(self, new: DataFrame) -> None:
        """The ids of new(id, event_date): to their buckets and days, with a filter for each such cell. Only cells of new ids are written."""
        importable(self.spark)
        keyed = new.select("id", "event_date").repartition(self.buckets, "id")
        self._write_filters(keyed, "append")  # first: an id with a filter alone is just looked for in vain
        keyed.write.insertInto(self.table)
        self._refresh()

    def _write_filters(self, keyed: DataFrame, mode: str) -> None:
        cells = keyed.withColumn("bucket", self.bucket()).groupBy("bucket", "event_date").applyInPandas(_filter_of, _FILTERS)
        rows = cells.repartition("event_date").sortWithinPartitions("event_date", "bucket")
        rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(f"{self.path}/filters")

    def _refresh(self) -> None:
        self.spark.catalog.refreshTable(self.table)
        self.spark.catalog.refreshByPath(f"{self.path}/filters")

    def merge_day(self, day: str) -> None:
        """The files that many appends left for a day, put together: one file and one filter a bucket, each id once."""
        beside = new_folder(self.spark, "merged-ids")
        self.ids().where(F.col("event_date") == F.lit(day).cast("date")).distinct().write.parquet(beside)
        keyed = self.spark.read.schema("id string, event_date date").parquet(beside).repartition(self.buckets, "id")
        self._write_filters(keyed, "overwrite")
        keyed.createOrReplaceTempView(f"merged_{self.table}")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (event_date = DATE'{date.fromisoformat(day)}') SELECT id FROM merged_{self.table}")
        self.spark.catalog.dropTempView(f"merged_{self.table}")
        remove(self.spark, beside)
        self._refresh()

    def drop_before(self, day: str) -> None:
        """Forgets the ids of all days before this one: whole folders go."""
        for part in ("ids", "filters"):
            for name in children(self.spark, f"{self.path}/{part}"):
                if name.startswith("event_date=") and name.removeprefix("event_date=") < day:
                    remove(self.spark, f"{self.path}/{part}/{name}")
        self._refresh()


def _digests(ids: list[str]) -> np.ndarray:
    """(ids, 2): two halves of a digest of each id."""
    return np.frombuffer(b"".join(hashlib.blake2b(i.encode(), digest_size=16).digest() for i in ids), np.uint64).reshape(-1, 2)


def _places(digests: np.ndarray, size: int) -> np.ndarray:
    """(ids, PROBES) bits of a filter of `size` bits."""
    with np.errstate(over="ignore"):
        return ((digests[:, :1] + np.arange(PROBES, dtype=np.uint64) * (digests[:, 1:] | np.uint64(1))) % np.uint64(size)).astype(np.int64)


def _filter_of(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
    """A Bloom filter of one cell's ids."""
    size = max(64, -(-len(p) * BITS_AN_ID // 64) * 64)
    bits = np.zeros(size, bool)
    bits[_places(_digests(p.id.tolist()), size).ravel()] = True
    return pd.DataFrame({"bucket": [key[0]], "bits": [np.packbits(bits).tobytes()], "event_date": [key[1]]})


def _let_through(asked: pa.Table, filters: pa.Table) -> pa.Table:
    """The ids of a bucket that its filters let through, with those filters' days; one filter is opened at a time."""
    ids = asked.column("id").to_pylist()
    digests, found, days = _digests(ids), [], []
    for day, packed in zip(filters.column("event_date").to_pylist(), filters.column("bits").to_pylist()):
        held = np.frombuffer(packed, np.uint8)
        at = _places(digests, held.size * 8)
        hit = np.flatnonzero(((held[at >> 3] >> (7 - (at & 7))) & 1).all(axis=1))
        found += [ids[i] for i in hit]
        days += [day] * hit.size
    return pa.table({"id": pa.array(found, pa.string()), "event_date": pa.array(days, pa.date32())})
