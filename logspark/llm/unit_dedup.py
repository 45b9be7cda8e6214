"""Substring de-duplication by hashing units: lines, and runs of segments inside lines.

A text is cut into lines, and each line into segments at the words of least hash of every 2 * `cut`
words in a row, so that a passage is cut at the same words wherever it stands and has a cut among any
2 * `cut` of its words: one inside lines of run_words + 4 * cut words or more is always found. Digests of the normalised units (lower case,
single blanks; 128 bits) are grouped over all documents; of each digest the earliest occurrence is kept, by
(doc_id, hash of the text, position). Removed are repeats of lines of at least `line_words` words,
and repeats of consecutive segments of at least `run_words` words together, with the blanks after them, and
the line end of lines of which nothing is left. Spans are code points of the original text, which is
what is left put together with what the spans hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import batches, spare_prefix

LINE_WORDS, RUN_WORDS, CUT = 4, 24, 6
_WORD = re.compile(r"\S+")
NO_ID = -(1 << 63)  # stands for a null doc_id: it ranks first


class _Cuts(dict):
    """Hash of each word, by which lines are cut; what has been seen is kept, up to a bound.

    A word starts a segment where its hash is the least (of equal ones the last) of some `window` words
    in a row of its line: any `window` words have a cut, and a passage has the same cuts wherever it
    stands, from the first to the last one that its own words make."""

    def __init__(self, cut: int, most: int = 500_000):
        self.window, self.most = 2 * cut, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = x = xxhash.xxh3_64_intdigest(word) >> 32 << 32
        return x

    def starts(self, sizes: list[int], found: list[str]) -> list[int]:
        """Ascending places of the words that start a segment; sizes: the words of each line."""
        n = len(found)
        if n < self.window:
            return []
        last = np.uint64(0xFFFFFFFF)
        least = np.fromiter(map(self.__getitem__, found), np.uint64, n) | (last - np.arange(n, dtype=np.uint64))
        width = 1
        while width < self.window:
            step = min(width, self.window - width)
            least = np.minimum(least[:-step], least[step:])
            width += step
        line = np.repeat(np.arange(len(sizes)), sizes)
        whole = line[: least.size] == line[self.window - 1 :]
        return np.unique(last - (least[whole] & last)).tolist()


def lines(text: str, cuts: _Cuts) -> Iterator[tuple[int, str, list[str], list[int]]]:
    """(start, line, lower-cased words, number of words up to the end of each segment) of lines with words."""
    at, every, words = 0, [], []
    for line in text.split("\n"):
        if found := line.lower().split():
            every.append((at, line, found))
            words += found
        at += len(line) + 1
    starts, k, first = cuts.starts([len(x[2]) for x in every], words), 0, 0
    for at, line, found in every:
        ends, last = [], first + len(found)
        while k < len(starts) and starts[k] < last:
            if starts[k] > first:
                ends.append(starts[k] - first)
            k += 1
        ends.append(len(found))
        yield at, line, found, ends
        first = last


def units(text: str, cuts: _Cuts, line_words: int = LINE_WORDS) -> tuple[list[bytes], list[int]]:
    """Digests and places of the units of a text; ~place for those that repeat one before them in it.

    Segments have the places 0, 2, 4, ... in order; a line of line_words words or more is a unit too,
    at the place of its first segment plus 1. A line of one segment is listed once, as a line if
    it is long enough for that."""
    digests, places, digest, place = [], [], xxhash.xxh3_128_digest, 0
    for _, _, found, ends in lines(text, cuts):
        whole = len(found) >= line_words
        if whole:
            digests.append(digest(" ".join(found), 1))
            places.append(place + 1)
        if len(ends) > 1 or not whole:
            a = 0
            for b in ends:
                digests.append(digest(" ".join(found[a:b])))
                a = b
            places += range(place, place + 2 * len(ends), 2)
        place += 2 * len(ends)
    if len(set(digests)) < len(digests):
        seen: set[bytes] = set()
        for i, d in enumerate(digests):
            if d in seen:
                places[i] = ~places[i]
            seen.add(d)
    return digests, places


def unit_table(docs: DataFrame, keys: list[str], line_words: int = LINE_WORDS, cut: int = CUT) -> DataFrame:
    """(a, b, *keys, place) of every unit of every text of docs(*keys, text); a and b are its digest. Null texts have none."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = _Cuts(cut)
        for frame in batches(frames):
            digests, places, counts = [], [], []
            for text in frame.column("text").to_pylist():
                d, p = units(text, cuts, line_words)
                digests += d
                places += p
                counts.append(len(d))
            row = pa.array(np.repeat(np.arange(frame.num_rows), counts))
            found = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            columns = [pa.array(found[:, 0]), pa.array(found[:, 1]), *(frame.column(k).take(row) for k in keys), pa.array(places, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b", *keys, "place"])

    return docs.where("text is not null").select(*keys, "text").mapInArrow(run, ", ".join(["a long, b long", *(f"{k} long" for k in keys), "place int"]))


def spans(text: str, repeated: list[int], cuts: _Cuts, line_words: int = LINE_WORDS, run_words: int = RUN_WORDS) -> list[tuple[int, int]]:
    """Ascending spans to remove from a text: repeated lines, and runs of repeated segments long enough.

    repeated: the places of its units that repeat others, see units()."""
    gone, out, place, run, size = set(repeated), [], 0, [], 0

    def close() -> None:
        nonlocal run, size
        if size >= run_words:
            out.extend(run)
        run, size = [], 0

    for at, line, found, ends in lines(text, cuts):
        every = range(place, place + 2 * len(ends), 2)
        whole = place + 1 in gone
        if whole or not gone.isdisjoint(every):
            word = [(m.start() + at, m.end() + at) for m in _WORD.finditer(line)]
            if whole:
                out.append((word[0][0], word[-1][1]))
            a = 0
            for x, b in zip(every, ends):
                if x in gone or whole:
                    run.append((word[a][0], word[b - 1][1]))
                    size += b - a
                else:
                    close()
                a = b
        else:
            close()
        place += 2 * len(ends)
    close()
    return with_blanks(text, _merged(out))


def _merged(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending spans that neither overlap nor touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(found):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def with_blanks(text: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ascending spans, each within a line, with the blanks after them, or before them at a line's end.

    A line of which only blanks would be left goes whole, with its line end."""
    out, k = [], 0
    while k < len(found):
        start = text.rfind("\n", 0, found[k][0]) + 1
        end = text.find("\n", found[k][1])
        end = len(text) if end < 0 else end
        of_line = []
        while k < len(found) and found[k][0] < end:
            of_line.append(found[k])
            k += 1
        left = "".join(text[a:b] for a, b in zip([start, *(e for _, e in of_line)], [*(s for s, _ in of_line), end]))
        if not left.strip():
            out.append((start, min(end + 1, len(text))))
            continue
        longer = []
        for s, e in of_line:
            while e < end and text[e] in " \t":
                e += 1
            longer.append((s, e))
        longer = _merged(longer)
        s, e = longer[-1]
        while e == end and s > start and text[s - 1] in " \t":
            s -= 1
        out += [*longer[:-1], (s, e)]
    return _merged(out)


def without(text: str, gone: list[tuple[int, int]]) -> str:
    """text without ascending spans."""
    return "".join(text[a:b] for a, b in zip([0, *(e for _, e in gone)], [*(s for s, _ in gone), len(text)]))


def repeated_places(docs: DataFrame, keys: list[str], line_words: int = LINE_WORDS, cut: int = CUT) -> DataFrame:
    """(*keys, places): the units of each text that repeat an earlier one; keys rank the texts.

    Digests are counted before the shuffle, so that a line in a third of all documents is one row of each
    task; the join with their first texts is one that Spark may split where it's uneven."""
    every = unit_table(docs, keys, line_words, cut)
    key = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    first = every.groupBy("a", "b").agg(F.min(key).alias("first"), F.count("*").alias("n")).where("n > 1").select("a", "b", "first")
    again = every.join(first, ["a", "b"]).where((F.col("place") < 0) | (key > F.col("first")))
    place = F.when(F.col("place") < 0, F.bitwise_not("place")).otherwise(F.col("place"))
    return again.select(*keys, place.alias("place")).groupBy(*keys).agg(F.collect_list("place").alias("places"))


def without_repeats(docs: DataFrame, line_words: int = LINE_WORDS, run_words: int = RUN_WORDS, cut: int = CUT) -> DataFrame:
    """docs with the cut text in `text`, and `removed`: array of (start, end) in the original text.

    Every row is returned. Null texts stay null, with no spans; an exact copy of an earlier document
    becomes empty, whoever it is from: copies are to be dropped first. Rows that repeat both doc_id and text
    are one occurrence and get the same result. A null doc_id ranks first. Own columns named `removed` are
    replaced, any other name is kept."""
    names, p = [c for c in docs.columns if c not in ("text", "removed")], spare_prefix(docs)
    ranked = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    # Where every doc_id stands once, it ranks the texts alone and their hashes needn't be shuffled with the units.
    unique = not docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
    keys = ["doc_id"] if unique else ["doc_id", "text_hash"]
    flags = repeated_places(ranked, keys, line_words, cut).withColumnsRenamed({k: p + k for k in keys}).withColumnRenamed("places", p + "places")
    keyed = docs.select(*names, "text").withColumn(p + "own", F.coalesce("doc_id", F.lit(NO_ID)))
    same = keyed[p + "own"] == flags[p + "doc_id"]
    found = keyed.join(flags, same if unique else same & (F.xxhash64(keyed.text) == flags[p + "text_hash"]), "left")
    own = [f for f in docs.schema.fields if f.name in names]

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = _Cuts(cut)
        for frame in batches(frames):
            texts, gone = frame.column("text").to_pylist(), []
            for i, x in enumerate(frame.column(p + "places").to_pylist()):
                gone.append(spans(texts[i], x, cuts, line_words, run_words) if x else [])
                if gone[-1]:
                    texts[i] = without(texts[i], gone[-1])
            cut_out = pa.array([[{"start": s, "end": e} for s, e in x] for x in gone], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
            yield pa.RecordBatch.from_arrays([*(frame.column(n) for n in names), pa.array(texts, pa.string()), cut_out], [*names, "text", "removed"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own), "text string, removed array<struct<start:int,end:int>>"])
    return found.select(*names, "text", p + "places").mapInArrow(run, schema)
