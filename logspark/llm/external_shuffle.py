"""Two-pass shuffle of a table into shards: scatter into memory-sized buckets, then shuffle each bucket.

The first pass sends each record to a bucket by seeded hashes: the shard by rendezvous hashing of its
key, so that one more shard takes records only into itself, and within the shard a bucket of about
`bucket_bytes`. The second pass is a Fisher-Yates shuffle of each bucket: its records are numbered in the order of
their hashes, shuffle() draws a permutation of the numbers, and the records are put in that order and written. Only
numbers are held in memory, records are sorted and may spill. shuffle() is seeded by the number of the partition, and bucket k
is dealt to partition k by number, so the order depends on the bucket alone, whatever the plan.
Built-in functions only; whole records are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import checkpointed

ADDED = ("shard", "bucket", "slot", "grown_shard")
MOST_PARTS = 20_000  # partitions; more buckets than that share them, one after the other


def shard_of(key: Column, shards: int, seed: int) -> Column:
    """The shard whose hash with the key is the largest."""
    each = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(key, F.lit(seed), s).alias("h"), s.alias("s")))
    return F.array_max(each)["s"]


def shuffled(records: DataFrame, key: str, size: str | Column, shards: int = 16, seed: int = 7, bucket_bytes: int = 64 << 20) -> DataFrame:
    """records with shard, bucket, slot (gapless from 0 in each shard) and grown_shard (with one more shard).

    size: a record's bytes. The order within a shard is uniformly random and depends on the seed and the
    records alone, whatever the plan; buckets follow one another by their numbers. Records with the same
    key, or none, share a shard but are scattered over its buckets by all their columns. Repeated rows each
    get a slot of their own, their copies dealt in equal numbers to the buckets. Own columns named like the
    four added ones are replaced, any other name is kept; an empty table stays empty."""
    own = [c for c in records.columns if c not in ADDED]
    total = records.agg(F.sum(size)).first()[0] or 0
    buckets = max(1, -(-total // (shards * bucket_bytes)))
    packed = records.select(F.struct(*own).alias("row"), F.xxhash64(F.lit(seed), *own).alias("lot"))
    dealt, repeated = _dealt(packed, buckets)
    keyed = dealt.withColumn("shard", shard_of(F.col("row")[key], shards, seed))
    keyed = keyed.withColumn("gid", (F.col("shard") * buckets + F.col("bucket")).cast("int"))
    parts = min(shards * buckets, MOST_PARTS)
    sizes = checkpointed(keyed.groupBy("gid", "shard").agg(F.sum("copies").alias("n")))  # a row for each bucket
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("gid").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("gid", "n", F.coalesce(before, F.lit(0)).alias("start"))
    drawn = starts.repartitionById(parts, "gid").sortWithinPartitions("gid")
    drawn = drawn.select("gid", "start", F.posexplode(F.shuffle(F.sequence(F.lit(1), F.col("n").cast("int")), seed)).alias("at", "i"))
    scattered = keyed.repartitionById(parts, "gid")
    if repeated:
        scattered = scattered.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    else:
        scattered = scattered.withColumn("copy", F.lit(1))
    numbered = scattered.withColumn("i", F.row_number().over(Window.partitionBy("gid").orderBy("lot", "copy")))
    mixed = numbered.join(drawn, ["gid", "i"])
    added = {"slot": F.col("start") + F.col("at"), "grown_shard": shard_of(F.col("row")[key], shards + 1, seed)}
    return mixed.withColumns(added).select("row.*", *ADDED)


def _dealt(packed: DataFrame, buckets: int) -> tuple[DataFrame, bool]:
    """packed(row, lot) with bucket and copies, and whether any are more than one.

    Identical rows are counted before the shuffle, and their copies dealt in turn over the buckets."""
    twice = packed.groupBy("lot").agg(F.count("*").alias("n")).where("n > 1").select("lot")
    repeated = twice.count()
    one = packed.select("row", "lot", F.pmod("lot", F.lit(buckets)).alias("bucket"), F.lit(1).alias("copies"))
    if not repeated:
        return one, False
    twice = F.broadcast(twice) if repeated <= 1_000_000 else twice
    many = packed.join(twice, "lot", "left_semi").groupBy("lot", "row").agg(F.count("*").alias("n"))
    many = many.select("row", "lot", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(buckets)) - 1)).alias("k"))
    copies = F.floor((F.col("n") - 1 - F.col("k")) / buckets).cast("int") + 1
    spread = many.select("row", "lot", F.pmod(F.pmod("lot", F.lit(buckets)) + F.col("k"), F.lit(buckets)).alias("bucket"), copies.alias("copies"))
    return one.join(twice, "lot", "left_anti").unionByName(spread), True


def write_shards(placed: DataFrame, path: str) -> None:
    """A folder for each shard, and in it a file for each bucket, which holds its records in the order of their slots.

    A bucket lies in one task already: nothing is shuffled again, only sorted within."""
    placed.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
