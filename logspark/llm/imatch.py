"""I-Match fingerprints over randomised lexicons, and the likeness of two of them.

The lexicon holds the terms whose document frequency lies in a band. Random subsets of it, by seeded
hashes, at several rates, give each text one signature each: a hash of the distinct terms that the
text has in the subset. The hash is one of the set (exclusive-or of two hashes of each term, and their
number), so the terms need not be gathered to be sorted. A text without any term of the lexicon gets one signature
of all its terms. Built-in functions only.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import checkpointed, last_at_most, words

#: (rate: a subset holds one in so many terms, number of subsets): coarse ones tell short texts, fine ones long texts.
LEVELS = ((1, 1), (4, 4), (16, 8), (64, 12), (256, 16), (1024, 16))
REST = 63  # number of the signature of texts without terms of the lexicon
NO_ID = -(1 << 63)  # stands for a null doc_id, so that joins need no null-safe keys
MOST_BROADCAST = 200_000  # terms, about 20 MB with their subsets
MOST_PARTS = 65_536


def _terms(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def subsets(term: Column) -> Column:
    """Numbers of the subsets of the lexicon that hold a term, given by its hash."""
    every, number = [], 0
    for rate, n in LEVELS:
        for k in range(number, number + n):
            every.append(F.when(F.pmod(F.xxhash64(term, F.lit(k)), F.lit(rate)) == 0, F.lit(k)))
        number += n
    return F.array_compact(F.array(*every))


def lexicon(docs: DataFrame, least: float = 1 / 2000, most: float = 0.1) -> DataFrame:
    """(term, subsets): hashes of the terms in the band of document frequencies, as shares of the documents.

    Documents have A distinct terms on average, so no more than A / least terms can be in the band."""
    n = docs.count()
    df = docs.select(F.explode(_terms(F.col("text"))).alias("t")).select(F.xxhash64("t").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return df.where((F.col("df") >= max(2.0, n * least)) & (F.col("df") <= max(2.0, n * most))).select("term", subsets(F.col("term")).alias("subsets"))


def signatures(texts: DataFrame, keys: list[str], terms: DataFrame) -> DataFrame:
    """(*keys, codes): the codes of each text, ascending; a code is the subset's number above 32 bits of its hash.

    texts(*keys, text) should come partitioned by the leading keys, then nothing is shuffled."""
    terms = checkpointed(terms)
    if terms.count() <= MOST_BROADCAST:
        terms = F.broadcast(terms)
    each = texts.select(*keys, F.explode_outer(_terms(F.col("text"))).alias("t")).select(*keys, F.xxhash64("t").alias("term"))
    found = each.join(terms, "term", "left").select(*keys, "term", F.explode_outer("subsets").alias("subset"))
    # Exclusive-or of two independent hashes, and the count: of any number of terms, without overflow.
    mixed = [F.bit_xor(F.xxhash64("term", F.lit(seed))).alias(name) for seed, name in ((1, "a"), (2, "b"))]
    hashed = found.groupBy(*keys, "subset").agg(*mixed, F.count("*").alias("c"))
    low = F.xxhash64("a", "b", "c").bitwiseAND(F.lit(0xFFFFFFFF))
    code = F.shiftleft(F.coalesce("subset", F.lit(REST)).cast("long"), 32).bitwiseOR(low)
    codes = hashed.groupBy(*keys).agg(F.sort_array(F.collect_list(code)).alias("codes"))
    inside = F.filter("codes", lambda x: x < F.lit(REST << 32))
    return codes.select(*keys, F.when(F.size(inside) > 0, inside).otherwise(F.col("codes")).alias("codes"))


def written(codes: Column) -> Column:
    """Codes as text: ten hexadecimal digits for each, two of them the subset's number."""
    return F.array_join(F.transform(codes, lambda x: F.lpad(F.lower(F.hex(x)), 10, "0")), " ")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the largest share of equal signatures over the levels; 1 for equal fingerprints.

    At each level it's the share of the subsets in which either text has terms, at least four."""
    both, either = F.array_intersect(a, b), F.array_distinct(F.transform(F.concat(a, b), lambda x: F.shiftright(x, 32).cast("int")))

    def share(low: int, high: int) -> Column:
        same = F.size(F.filter(both, lambda x: (x >= F.lit(low << 32)) & (x < F.lit(high << 32))))
        told = F.size(F.filter(either, lambda x: (x >= low) & (x < high)))
        return same / F.greatest(told, F.lit(4))

    ends = list(accumulate(n for _, n in LEVELS))
    shares = [share(low, high) for low, high in zip([0, *ends], ends)]
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(*shares))


def range_heads(ids: DataFrame, parts: int) -> list[tuple[int, int]]:
    """The least (doc_id, text_hash) of each of about `parts` ranges with equal numbers of ids, ascending."""
    ranged = ids.repartitionByRange(parts, "doc_id", "text_hash")
    heads = ranged.groupBy(F.spark_partition_id().alias("part")).agg(F.min(F.struct("doc_id", "text_hash")).alias("head"))
    return sorted((r.doc_id, r.text_hash) for r in heads.select("head.*").collect())  # one row a range


def with_next(docs: DataFrame, heads: list[tuple[int, int]]) -> DataFrame:
    """docs(doc_id, text_hash, ...) dealt into the ranges that start at heads, with part and guest.

    The first of each range is also a guest at the end of the range before, so that each row finds the
    next one in its own range: texts are shuffled once. Windows over ORDER need no other shuffle."""
    listed = [F.split(F.lit(",".join(str(h[k]) for h in heads)), ",").cast("array<bigint>") for k in (0, 1)]

    def reached(i: Column) -> Column:
        first, second = F.get(listed[0], i), F.get(listed[1], i)
        return (F.col("doc_id") > first) | ((F.col("doc_id") == first) & (F.col("text_hash") >= second))

    part, n = last_at_most(len(heads), reached) - 1, len(heads)
    placed = docs.withColumn("own", part)
    head = (F.col("doc_id") == F.get(listed[0], F.col("own"))) & (F.col("text_hash") == F.get(listed[1], F.col("own")))
    stay = F.struct(F.col("own").alias("part"), F.lit(False).alias("guest"))
    visit = F.struct(F.pmod(F.col("own") + (n - 1), F.lit(n)).alias("part"), F.lit(True).alias("guest"))
    return placed.select("*", F.inline(F.when(head, F.array(stay, visit)).otherwise(F.array(stay)))).drop("own")


def next_of(name: str) -> Column:
    return F.lead(name).over(Window.partitionBy("part").orderBy("guest", "doc_id", "text_hash"))


def edited_text(text: Column, following: Column) -> Column:
    """text with its last quarter replaced by as much of the start of what follows."""
    n = F.length(text)
    q = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - q), F.substring(following, F.lit(1), q))


def edited_report(docs: DataFrame, least: float = 1 / 2000, most: float = 0.1, part_bytes: int = 8 << 20) -> DataFrame:
    """Fingerprints of every text and of its edited text, with likenesses; see edited_text and likeness.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). The next
    document is the one with the next larger (doc_id, hash of the text); the first follows the last. A
    null text counts as empty. Rows that repeat doc_id and text are one document, returned once for each
    row; a null doc_id ranks first. Ranges of ids hold about part_bytes of texts, but there are no more than
    MOST_PARTS of them, which spill if they must."""
    docs = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    terms = lexicon(docs, least, most)
    docs = docs.withColumn("text_hash", F.xxhash64("text"))
    ids = checkpointed(docs.select("doc_id", "text_hash", F.octet_length("text").alias("bytes")).groupBy("doc_id", "text_hash").agg(F.count("*").alias("n"), F.first("bytes").alias("bytes")))
    total = ids.agg(F.sum("bytes").alias("bytes"), F.max("n").alias("n")).first()
    repeats = (total.n or 0) > 1
    if repeats:
        docs = docs.groupBy("doc_id", "text_hash", "text").agg(F.count("*").cast("int").alias("n"))
    heads = range_heads(ids, min(MOST_PARTS, max(16, (total.bytes or 0) // part_bytes)))
    placed = with_next(docs, heads or [(NO_ID, 0)]).withColumn("next", next_of("text"))
    texts = placed.withColumn("edited", edited_text(F.col("text"), F.coalesce("next", F.lit(""))))
    own = ["part", "guest", "doc_id", "text_hash", *(["n"] if repeats else [])]
    both = texts.select(*own, F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("which", "text"))
    keys = [*own, "n_chars", "edited_sha256"]
    sides = signatures(both, [*keys, "which"], terms)
    pick = lambda k: F.max(F.when(F.col("which") == k, F.col("codes")))
    pairs = sides.groupBy(*keys).agg(pick(0).alias("codes"), pick(1).alias("edited_codes")).withColumn("next_codes", next_of("codes")).where(~F.col("guest"))
    codes, edited = F.col("codes"), F.col("edited_codes")
    if repeats:
        pairs = pairs.withColumn("n", F.explode(F.sequence(F.lit(1), F.col("n"))))
    return pairs.select(F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), "n_chars", "edited_sha256", written(codes).alias("fingerprint"), written(edited).alias("edited_fingerprint"), likeness(codes, edited).alias("near_edited"), likeness(codes, F.col("next_codes")).alias("near_next"))
