"""Full-text search by a stored index: where each token stands, so that a query reads its own tokens and no texts.

The index is a table of postings, a row for each place of a token: (token, field, id, place), in a folder for each day. What is
appended lies in ranges of tokens, sorted, so that files and row groups tell by their bounds whether they hold a token or a
beginning; a token that is in every message is cut into several ranges by id. A query reads the postings of its
tokens, puts those of a message together and evaluates terms, beginnings, phrases and NEAR on their places.
Where a query needs a rare token, the others' postings are first cut down to the messages that hold it.

Appending postings twice changes no result, so a batch that runs again does no harm; postings of messages that the store
has no more are left out by the join with it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.search import BOTH, Join, Near, Phrase, Query, boolean_query, clumped, tokens, words_query
from logspark.session import new_folder, remove

BYTES_A_FILE = 128 << 20  # of text
RARE = 1_000_000  # postings of a token whose messages may be broadcast, as hashes of 8 bytes
Atom = tuple[str, bool]  # a token, and whether it may go on


def postings_of(rows: DataFrame, columns: tuple[str, ...] = BOTH, key: str = "id", day: Column | None = None) -> DataFrame:
    """(event_date, token, field, id, place) of the texts of rows; field counts the columns, place the tokens of a text from 0.

    Null and blank texts have none; equal rows have equal postings."""
    day = F.lit(None).cast("date") if day is None else day
    texts = F.array(*[F.struct(F.lit(i).cast("byte").alias("field"), F.split(F.btrim(tokens(F.col(c))), " ").alias("words")) for i, c in enumerate(columns)])
    each = rows.select(day.alias("event_date"), F.col(key).alias("id"), F.explode(texts).alias("t"))
    placed = each.select("event_date", "id", "t.field", F.posexplode("t.words").alias("place", "token"))
    return placed.where("token <> ''").select("event_date", "token", "field", "id", "place")


def _written(postings: DataFrame, path: str, files: int) -> None:
    ranged = postings.repartitionByRange(files, "event_date", "token", "id").sortWithinPartitions("event_date", "token", "id", "place")
    ranged.write.mode("append").partitionBy("event_date").parquet(path)


def append(rows: DataFrame, path: str, columns: tuple[str, ...] = BOTH, key: str = "id", day: Column | None = None, bytes_a_file: int = BYTES_A_FILE) -> None:
    """Adds the postings of rows to the index at path; what it holds already is neither read nor written."""
    size = rows.agg(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0)).cast("long"))).first()[0] or 0
    _written(postings_of(rows, columns, key, day), path, max(1, -(-size // bytes_a_file)))


def merge_day(spark: SparkSession, path: str, day: str, files: int = 1) -> None:
    """The postings of one day in few files again, after many small appends. The new files are written beside and take the old ones'
    place in one overwrite of that day's folder."""
    have = postings(spark, path).where(F.col("event_date") == F.lit(day).cast("date")).distinct()
    beside = new_folder(spark, "merged-postings")
    _written(have, beside, files)
    merged = spark.read.parquet(beside)
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
    remove(spark, beside)


def postings(spark: SparkSession, path: str) -> DataFrame:
    kind = spark.read.parquet(path).schema["id"].dataType.simpleString()
    return spark.read.schema(f"token string, field tinyint, id {kind}, place int, event_date date").parquet(path)


def _atoms(asked: Query) -> set[Atom]:
    if isinstance(asked, Phrase):
        return {(w, asked.prefix and k == len(asked.words) - 1) for k, w in enumerate(asked.words)}
    if isinstance(asked, Near):
        return {(w, False) for p in asked.phrases for w in p}
    return set().union(*map(_atoms, asked.sides))


def _needed(asked: Query) -> set[Atom]:
    """Atoms without which nothing matches."""
    if not isinstance(asked, Join):
        return _atoms(asked)
    if asked.word == "OR":
        return set.intersection(*map(_needed, asked.sides))
    return set().union(*map(_needed, asked.sides if asked.word == "AND" else asked.sides[:1]))


def _is(atom: Atom) -> Column:
    return F.col("token").startswith(atom[0]) if atom[1] else F.col("token") == atom[0]


def _placed(asked: Query) -> set[Atom]:
    """Atoms whose places matter."""
    if isinstance(asked, Phrase):
        return _atoms(asked) if len(asked.words) > 1 else set()
    return _atoms(asked) if isinstance(asked, Near) else set().union(*map(_placed, asked.sides))


def _truth(asked: Query, there: dict[Atom, Column], places: dict[tuple[Atom, int], Column], fields: int) -> Column:
    def starts(words: list[Atom], field: int) -> Column:
        """Where these tokens stand in a row, in one field."""
        back = lambda c, k: F.transform(c, lambda p: p - k) if k else c
        moved = [back(places[w, field], k) for k, w in enumerate(words)]
        return reduce(F.array_intersect, moved)

    if isinstance(asked, Phrase):
        words = [(w, asked.prefix and k == len(asked.words) - 1) for k, w in enumerate(asked.words)]
        if len(words) == 1:
            return there[words[0]]
        return reduce(lambda a, b: a | b, [F.size(starts(words, f)) > 0 for f in range(fields)]) if words else F.lit(False)
    if isinstance(asked, Near):
        if not asked.phrases or not all(asked.phrases):
            return F.lit(False)
        lengths = [len(p) for p in asked.phrases]
        in_field = lambda f: clumped([starts([(w, False) for w in p], f) for p in asked.phrases], lengths, asked.gap)
        return reduce(lambda a, b: a | b, map(in_field, range(fields)))
    how = {"AND": lambda a, b: a & b, "OR": lambda a, b: a | b, "NOT": lambda a, b: a & ~b}[asked.word]
    return reduce(how, [_truth(s, there, places, fields) for s in asked.sides])


def hits(index: DataFrame, asked: Query, fields: int = len(BOTH), rare: int = RARE) -> DataFrame:
    """(event_date, id) of what matches a query, by postings alone; filters on event_date go before this.

    Postings of the query's tokens are shuffled by id, and no others. If some token that must be there has no more than
    `rare` postings, those of the others are first cut down to its messages, by hashes of their ids that are broadcast."""
    atoms = sorted(_atoms(asked))
    if not atoms:
        return index.limit(0).select("event_date", "id")
    found = index.where(reduce(lambda a, b: a | b, map(_is, atoms)))
    needed = sorted(_needed(asked))
    if len(atoms) > 1 and needed:
        counts = found.agg(*[F.count_if(_is(a)).alias(f"n{k}") for k, a in enumerate(needed)]).first()
        least, k = min((n or 0, k) for k, n in enumerate(counts))
        if least <= rare:
            hashed = found.where(_is(needed[k])).select(F.xxhash64("id").alias("h")).distinct()
            found = found.join(F.broadcast(hashed), F.xxhash64("id") == F.col("h"), "left_semi")
    held = {a: f"t{k}" for k, a in enumerate(atoms)}
    kept = {(a, f): f"p{atoms.index(a)}_{f}" for a in sorted(_placed(asked)) for f in range(fields)}
    each = [F.max(_is(a)).alias(name) for a, name in held.items()]
    each += [F.collect_set(F.when(_is(a) & (F.col("field") == f), F.col("place"))).alias(name) for (a, f), name in kept.items()]
    together = found.groupBy("event_date", "id").agg(*each)
    truth = _truth(asked, {a: F.col(n) for a, n in held.items()}, {k: F.col(n) for k, n in kept.items()}, fields)
    return together.where(truth).select("event_date", "id")


def query_of(text: str, mode: str = "fts") -> Query | None:
    """The query of a reader's text in mode fts or words; a QuerySyntaxError for what can't be read, None without words."""
    return words_query(text) if mode == "words" else boolean_query(text)


def found_by(rows: DataFrame, index: DataFrame, text: str, mode: str = "fts", key: str = "id", fields: int = len(BOTH)) -> DataFrame:
    """The rows that match, texts of all others unread by the search: what comes out of hits(), joined by id. No words: all rows."""
    asked = query_of(text, mode)
    if asked is None:
        return rows
    return rows.join(hits(index, asked, fields).select(F.col("id").alias("h_id")), F.col(key) == F.col("h_id"), "left_semi")
