"""Mixing of sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Every source gets a share of the mix by its weight. A source whose share would need more than `most_epochs`
repetitions is clamped there, and what it can't take is dealt again to the others by their weights, until no
share is above its clamp. A source's target is then whole repetitions of all its documents, and a rest of words
from one repetition more: its documents in the order of seeded hashes, the last of them by its first words only.

Built-in functions only. Texts are read once, to count their words and hash them; from then on rows of a few
numbers are used. The rest's boundary is found by counting ranges of hashes, so no source is sorted in a task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import BLANK_RUN, BLANKS, checkpointed, spare_prefix

WORD = r"[^\x20\x09-\x0D]+"
#: By the order of the sources' names, over and over.
WEIGHTS = (5.0, 2.0, 1.0)
#: Hashes are the first 60 bits of an MD5, which SQL elsewhere has too.
HASH_BITS = 60
MOST_BROADCAST = 100_000  # sources
SALTS = 64


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def seeded_hash(seed: int, *parts: Column) -> Column:
    """60 bits of a document, from its columns; nulls count as empty, behind a mark."""
    told = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(p.cast("string"), F.lit("\x01")) for p in parts])
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources(source, ...), a row each, with rank from 0 by code point, null last: sorted in ranges, numbered by offsets."""
    placed = checkpointed(sources.orderBy(F.asc_nulls_last("source")).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted(placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # a row for each range
    starts, before = {}, 0
    for p, n in sizes:
        starts[p], before = before, before + n
    start = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])[part] if starts else F.lit(0)
    return placed.withColumn("rank", start + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at")


def weight_of(rank: Column, weights: tuple[float, ...] = WEIGHTS) -> Column:
    return F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))


def water_filled(sources: DataFrame, total: float, most_epochs: float) -> DataFrame:
    """sources(size, weight, ...), a row each, with target.

    Every round deals what the clamped sources leave to the others by weight and clamps those above; it ends
    when none is. Only sums over the table come to the driver."""
    cap = F.col("size") * float(most_epochs)
    level = 0.0
    while True:
        clamped = cap <= F.col("weight") * level if level else F.lit(False)
        s = sources.agg(F.sum(F.when(clamped, cap)).alias("taken"), F.sum(F.when(~clamped, F.col("weight"))).alias("open")).first()
        if not s.open:
            return sources.withColumn("target", cap)
        higher = (total - (s.taken or 0.0)) / s.open
        if higher <= level * (1 + 1e-12):
            return sources.withColumn("target", F.when(clamped, cap).otherwise(F.least(cap, F.col("weight") * level)))
        level = higher


def planned(docs: DataFrame, source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most_epochs: float = 2.0, seed: int = 13) -> DataFrame:
    """docs with size (words of the text), source_size, target (both of the source), taken (words that the mix takes of the
    document), copies (whole repetitions) and part (words of one more).

    The mix takes share times all words. The words taken of a source are its target, rounded, but for less than a word
    a copy where the last document stands many times. Null and blank texts have size 0 and aren't taken; null is a source, the last;
    rows that are equal in all columns are taken alike; documents without ids count by themselves. Own columns named like the six
    are replaced, any other name is kept; an empty table gives an empty one. The same seed takes the same words
    whatever the plan."""
    pre = spare_prefix(docs)
    own = [c for c in docs.columns if c not in ("size", "source_size", "target", "taken", "copies", "part")]
    keys = [F.col(c) for c in own if c != text and docs.schema[c].dataType.typeName() in ("string", "long", "integer", "short", "byte")]
    lot = seeded_hash(seed, *keys, F.md5(F.col(text).cast("binary")))
    counted = docs.select(*own, word_count(F.col(text)).alias(f"{pre}size"), lot.alias(f"{pre}lot"))
    plan = source_plan(counted.select(F.col(source).alias("source"), F.col(f"{pre}size").alias("size"), F.col(f"{pre}lot").alias("lot")), weights, share, most_epochs)
    names = [c for c in plan.columns if c != "source"]
    renamed = plan.select(F.col("source").alias(f"{pre}source"), *[F.col(c).alias(f"{pre}{c}") for c in names if c != "size"], F.col("size").alias(f"{pre}source_size"))
    met = _met(counted, renamed, source, pre)
    size, last = F.col(f"{pre}size"), F.col(f"{pre}lot") == F.col(f"{pre}edge")
    split = F.when(F.col(f"{pre}group") == size, F.col(f"{pre}rest")).otherwise(F.floor(size * (F.col(f"{pre}rest") / F.col(f"{pre}group"))))
    copies = F.col(f"{pre}epochs") + F.when(F.col(f"{pre}lot") < F.col(f"{pre}edge"), 1).otherwise(0)
    part = F.when(last, split).otherwise(0).cast("long")
    return met.select(*own, size.alias("size"), F.col(f"{pre}source_size").alias("source_size"), F.col(f"{pre}target").alias("target"),
                      (size * copies + part).cast("long").alias("taken"), copies.cast("int").alias("copies"), part.alias("part"))


def source_plan(docs: DataFrame, weights: tuple[float, ...], share: float, most_epochs: float) -> DataFrame:
    """A row for each source of docs(source, size, lot): size, target, epochs, and of the repetition that is not whole the hash
    of its last document (edge), the words of all documents with that hash (group) and those taken of them (rest)."""
    few = checkpointed(docs)  # three numbers a document: read again below in place of the texts
    sources = ranked(few.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    found = sources.agg(F.sum("size"), F.max("n")).first()
    total, most = found[0] or 0, found[1] or 0
    filled = water_filled(sources.withColumn("weight", weight_of(F.col("rank"), weights)), share * total, most_epochs)
    want = F.least(F.round("target").cast("long"), F.floor(F.col("size") * float(most_epochs)).cast("long"))
    epochs = F.when(F.col("size") > 0, F.floor(want / F.col("size"))).otherwise(0).cast("long")
    plan = filled.select("source", "size", "target", epochs.alias("epochs"), (want - epochs * F.col("size")).alias("left"))
    plan = checkpointed(plan)
    bits = min(HASH_BITS - 1, max(1, math.ceil(math.log2(max(2, most)) / 2)))
    return _with_edges(few, plan, F.shiftright("lot", HASH_BITS - bits))


def _with_edges(few: DataFrame, plan: DataFrame, range_of: Column) -> DataFrame:
    """plan with the edges. The words of each range of hashes are summed up, the running sum tells which range holds the
    edge, and the documents of that one alone are summed up by hash: both about the root of the number of documents."""
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    open_ = plan.where("left > 0").select(F.col("source").alias("o_source"), F.col("left").alias("o_left"))

    def crossing(sums: DataFrame, left: str) -> DataFrame:
        """Of sums(source, at, words, left) the row of each source in which the running sum reaches left, with what comes before it."""
        w = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = sums.withColumn("upto", F.sum("words").over(w))
        return run.where((F.col("upto") >= F.col(left)) & (F.col("upto") - F.col("words") < F.col(left)))

    ranges = few.where("size > 0").groupBy("source", range_of.alias("at")).agg(F.sum("size").alias("words"))
    ranges = ranges.join(open_, ranges["source"].eqNullSafe(open_["o_source"]))
    edge_range = crossing(ranges, "o_left").select(F.col("source").alias("r_source"), F.col("at").alias("r_at"), (F.col("o_left") - (F.col("upto") - F.col("words"))).alias("r_left"))
    edge_range = checkpointed(edge_range)
    near = few.where("size > 0").withColumn("at", range_of)
    few_sources = edge_range.count() <= MOST_BROADCAST
    of_range = near.join(F.broadcast(edge_range) if few_sources else edge_range, near["source"].eqNullSafe(edge_range["r_source"]) & (near["at"] == edge_range["r_at"]))
    lots = of_range.groupBy("source", F.col("lot").alias("at"), "r_left").agg(F.sum("size").alias("words"))
    edges = crossing(lots, "r_left").select(F.col("source").alias("e_source"), F.col("at").alias("edge"), F.col("words").alias("group"), (F.col("r_left") - (F.col("upto") - F.col("words"))).alias("rest"))
    met = plan.join(edges, plan["source"].eqNullSafe(edges["e_source"]), "left")
    return checkpointed(met.select("source", "size", "target", "epochs", F.coalesce("edge", F.lit(-1)).alias("edge"), F.coalesce("group", F.lit(0)).alias("group"), F.coalesce("rest", F.lit(0)).alias("rest")))


def _met(counted: DataFrame, plan: DataFrame, source: str, pre: str) -> DataFrame:
    """counted with the plan of each row's source. So many sources that they can't be broadcast are repeated SALTS times, and
    a source's documents are dealt over its copies, so that none lands in one task whole."""
    key = f"{pre}source"
    if plan.count() <= MOST_BROADCAST:
        return counted.join(F.broadcast(plan), F.col(source).eqNullSafe(F.col(key)), "left")
    spread = plan.withColumn(f"{pre}salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = counted.withColumn(f"{pre}deal", F.pmod(F.col(f"{pre}lot"), F.lit(SALTS)).cast("int"))
    return dealt.join(spread, F.col(source).eqNullSafe(F.col(key)) & (F.col(f"{pre}deal") == F.col(f"{pre}salt")), "left")


def repeated(mix: DataFrame, text: str = "text") -> DataFrame:
    """The rows of the mix itself: each document of planned() as often as it is taken, with repetition from 1. The last, if it
    is in part, has the text up to its last word taken."""
    times = F.col("copies") + F.when(F.col("part") > 0, 1).otherwise(0)
    out = mix.where(times > 0).withColumn("repetition", F.explode(F.sequence(F.lit(1), times)))
    bare, part = F.btrim(F.col(text), F.lit(BLANKS)), F.col("part").cast("int")
    after = F.get(F.split(bare, BLANK_RUN, part + 1), part)  # what follows the words taken
    beginning = F.btrim(F.substring(bare, F.lit(1), F.length(bare) - F.length(F.coalesce(after, F.lit("")))), F.lit(BLANKS))
    return out.withColumn(text, F.when(F.col("repetition") > F.col("copies"), beginning).otherwise(F.col(text))).drop("copies", "part", "taken")
