"""Which files of a store can match a text or regular expression: a summary of the three-letter runs in each file.

Beside the store lies a table of (gram, file): every run of three lower-case characters that a message or raw line of the file
holds. The literal parts of a pattern must stand in a matching text, so must their grams in its file. Files that lack one of
them aren't read, all others are read and searched as ever; files that the summary doesn't know yet are read too.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.search import BOTH
from logspark.operators.filters import in_either, regex_match, valid_pattern
from logspark.session import exists

#: What a regular expression may hold at one place: an escape, a class, a counted repeat, or one character.
_PART = re.compile(r"\\(?P<escaped>[^A-Za-z0-9])|\\[A-Za-z0-9]|\[\^?\]?(?:\\.|[^\]\\])*\]|(?P<count>\{\d+(?:,\d*)?\})|(?P<char>.)", re.S)


def literal_runs(pattern: str) -> list[str]:
    """Texts that every match of a regular expression holds, lower-cased; none where it has alternatives or flags.

    Groups are left out with all that is in them, and so is a character that may be absent."""
    if "|" in pattern or "(?" in pattern or "&&" in pattern or re.search(r"\[[^\]]*\[", pattern) or re.search(r"(?<!\\)(?:\\\\)*\\[^dDwWsSbBtnrf\W_]", pattern):
        return []
    runs, run, depth = [], "", 0
    for m in _PART.finditer(pattern):
        c = m["escaped"] or m["char"]
        if m["escaped"] is None and c in ("(", ")"):
            depth += 1 if c == "(" else -1
            runs, run = [*runs, run], ""
        elif depth:
            continue
        elif m["count"] or (m["escaped"] is None and c in ("?", "*", "+")):
            runs, run = [*runs, run[:-1]], run[-1:] if c == "+" else ""
            if c == "+":  # it stands at least once, but not right before what follows the first time
                runs, run = [*runs[:-1], runs[-1] + run], ""
        elif c is None or (m["escaped"] is None and c in ".^$"):
            runs, run = [*runs, run], ""
        else:
            run += c
    return [r.lower() for r in [*runs, run] if len(r) >= 3]


def grams(text: str) -> set[str]:
    return {text[i : i + 3] for i in range(len(text) - 2)}


def _grams_of(columns: tuple[str, ...]) -> Column:
    """Distinct grams of a row's texts."""
    each = [F.lower(F.coalesce(F.col(c), F.lit(""))) for c in columns]
    cut = [F.when(F.length(t) >= 3, F.transform(F.sequence(F.lit(1), F.length(t) - 2), _cutter(t))) for t in each]
    return F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in cut]))


def _cutter(text: Column):
    return lambda i: F.substring(text, i, F.lit(3))


def update(spark: SparkSession, store: str, path: str, columns: tuple[str, ...] = BOTH) -> None:
    """Adds the files of the store that the summary at path doesn't know yet."""
    files = _files(spark, store)
    new = sorted(files - _known(spark, path))
    if not new:
        return
    rows = spark.read.option("basePath", store).parquet(*new)
    each = rows.select(F.col("_metadata.file_path").alias("file"), F.explode(_grams_of(columns)).alias("gram")).distinct()
    # A file without a gram is known too, by the empty one.
    every = each.unionByName(spark.createDataFrame([(f, "") for f in new], "file string, gram string"))
    every.repartitionByRange(max(1, len(new) // 256), "gram", "file").sortWithinPartitions("gram", "file").write.mode("append").parquet(path)


def _files(spark: SparkSession, store: str) -> set[str]:
    return {_plain(f) for f in spark.read.parquet(store).inputFiles()}


def _plain(file: str) -> str:
    """One spelling of a file's address: those with an empty authority come in two."""
    return re.sub(r"^file:/+", "file:///", file)


def _known(spark: SparkSession, path: str) -> set[str]:
    if not exists(spark, path):
        return set()
    return {_plain(r.file) for r in _summary(spark, path).where("gram = ''").collect()}  # a row for each file, as the listing on the driver has


def _summary(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("file string, gram string").parquet(path)


def possible_files(spark: SparkSession, store: str, path: str, runs: list[str]) -> list[str]:
    """Files of the store that may hold all these runs of characters: those with all their grams, and unknown ones."""
    files, wanted = _files(spark, store), sorted(set().union(*map(grams, runs)) if runs else set())
    if not wanted or not exists(spark, path):
        return sorted(files)
    held = _summary(spark, path).where(F.col("gram").isin(wanted)).groupBy("file").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(wanted))
    return sorted(files & ({_plain(r.file) for r in held.collect()} | (files - _known(spark, path))))


def matching(spark: SparkSession, store: str, path: str, search: str, mode: str = "text", on_invalid: str = "ignore") -> DataFrame:
    """The messages of a store whose text holds a literal (mode text) or matches a regular expression (regex); the same as by a scan."""
    if mode == "text" or (on_invalid == "literal" and not valid_pattern(spark, search)):
        runs = [search.lower()]
    else:
        runs = literal_runs(search) if valid_pattern(spark, search) else []
    test = in_either(search) if mode == "text" else regex_match(spark, search, on_invalid)
    rows, files = spark.read.parquet(store), possible_files(spark, store, path, runs)
    if not files:
        return rows.where(F.lit(False))
    return spark.read.schema(rows.schema).option("basePath", store).parquet(*files).where(test)
