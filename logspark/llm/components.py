"""Connected components of a link table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import checkpointed


def _large_star(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the least node of its neighbourhood."""
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Each node's smaller neighbours, and itself, are linked to the least of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def component_roots(links: DataFrame) -> DataFrame:
    """(node, root): for each node of links(u, v), the least node of its component; the root itself isn't listed.

    Only links are shuffled, never whole components into a task: minima are summed up before the
    shuffle, and a round cuts its lineage with a checkpoint. Self-links and repeats are allowed."""
    links = checkpointed(links.where("u <> v").distinct())
    state = None
    while True:
        links = checkpointed(_small_star(_large_star(links)))
        new = links.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(new) == state:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(new)
