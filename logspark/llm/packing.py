"""Packing token pieces into sequences of a fixed length: exact complements first, then best fit.

Pieces of one length are alike, so the plan is made on the counts of the lengths alone, at most one
number for each length up to the capacity, whatever the number of pieces. It's a list of runs: so
many pieces of one length, from this rank on, go into consecutive sequences at this offset. Pieces
get their ranks within their length by Spark, in salted groups, and look up their run.
"""

from __future__ import annotations

import json
import os
import re
import string
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logspark.llm.common import Seen, batches, checkpointed, last_at_most, utf8

CAPACITY, END_ID = 4096, 1


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: What a tokenizer does to texts if it may be given words without their case and the signs at their end.
_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}
_SIGNS = string.punctuation.encode()
#: ASCII and the letters U+00C0 to U+00FF, which NFC leaves alone and no lower case joins; without signs at the end, a letter or a digit is the last.
_PLAIN = re.compile(rb"[!-~]*+(?:\xc3[\x80-\xbf][!-~]*+)*+(?<![\x97\xb7])")


#: Letters alone, which _RULES keep together.
_LETTERS = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


def _last_tokens(path: str) -> np.ndarray | None:
    """By id, whether a token is the last of a run of letters, a digit or a run of signs; None for a tokenizer of other rules."""
    with open(path, encoding="utf-8") as lines:
        made = json.load(lines)
    suffix = made["model"].get("end_of_word_suffix")
    if not suffix or any(made.get(k) != v for k, v in _RULES.items()) or not all("<|" in x["content"] for x in made["added_tokens"]):
        return None
    last = np.zeros(1 + max([*made["model"]["vocab"].values(), *(x["id"] for x in made["added_tokens"])]), bool)
    last[[i for token, i in made["model"]["vocab"].items() if token.endswith(suffix)]] = True
    return last


class _Held(Seen):
    """A word in neither generation is noted with bytes to be filled in, which stand for its ids meanwhile."""

    def __missing__(self, word: bytes) -> bytes | bytearray:
        if (ids := self.old.get(word)) is not None:
            self.keep(word, ids)
            return ids
        if (ids := self.new.get(word)) is None:
            ids = self.new[word] = bytearray()
        return ids


class WordIds:
    """Token ids, as bytes, of texts under a tokenizer that never joins across ASCII blanks.

    Each word is looked up once among those seen; what is new in some texts goes to the tokenizer together, under
    _RULES in lower case and without the signs at its end, as these have tokens of their own."""

    def __init__(self, path: str, most: int = 96 << 20):
        self.path, self.most, self.seen, self.last = path, most, _Held(), _last_tokens(path)  # most: bytes of either generation

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        if self.seen.size > self.most:
            self.seen = _Held(dict(self.seen))
        found = [list(map(self.seen.__getitem__, text.split())) for text in texts]
        self.fill()
        return [b"".join(x) for x in found]

    def fill(self) -> None:
        """Give the words that are new their ids."""
        seen, words, made = self.seen, self.seen.new, []
        seen.new = {}  # from here on of what is to be learnt
        for word, held in words.items():
            core, signs = self.cut(word)
            if core == word:
                seen.new[word] = held
            else:
                made.append((word, held, core, signs))
        made = [(word, held, seen[core], seen[signs]) for word, held, core, signs in made]
        letters: list[tuple[bytes, bytearray]] = []
        others: list[tuple[bytes, bytearray]] = []
        for x in seen.new.items():
            (letters if self.last is not None and _LETTERS.fullmatch(x[0]) else others).append(x)
        for new, learn in ((letters, self.learn_letters), (others, self.learn)):
            for at in range(0, len(new), 512):
                learn(new[at : at + 512])
        seen.new = {}
        for word, held, core, signs in made:
            held += core
            held += signs
            seen.keep(word, bytes(held))

    def cut(self, word: bytes) -> tuple[bytes, bytes]:
        """What of a word is to be learnt, and the signs behind it, whose ids follow."""
        core = word.rstrip(_SIGNS)
        if self.last is not None and core and (small := core.lower()) != word and _PLAIN.fullmatch(core) and b"<|" not in word:
            return small, word[len(core) :]
        return word, b""

    def learn(self, new: list[tuple[bytes, bytearray]]) -> None:
        """Encode words as one text, a word a line, and tell their ids apart by where the tokens stand."""
        found = [w.decode() for w, _ in new]
        made = _tokenizer(self.path).encode("\n".join(found), add_special_tokens=False)
        ends = np.cumsum([len(w) + 1 for w in found])
        upto = np.searchsorted([b for _, b in made.offsets], ends)  # tokens that end before the line does
        self.keep(new, made.ids, upto)

    def learn_letters(self, new: list[tuple[bytes, bytearray]]) -> None:
        """The same for words of letters alone, told apart by the token that ends each."""
        text = b"\n".join([w for w, _ in new]).decode()
        ids = _tokenizer(self.path).encode_batch_fast([text], add_special_tokens=False)[0].ids
        upto = np.flatnonzero(self.last[ids]) + 1
        if upto.size == len(new):
            self.keep(new, ids, upto)
        else:
            self.learn(new)

    def keep(self, new: list[tuple[bytes, bytearray]], ids: list[int], upto: np.ndarray) -> None:
        raw, a, keep = np.array(ids, "<u4").tobytes(), 0, self.seen.keep
        for (word, held), b in zip(new, (4 * upto).tolist()):
            held += (own := raw[a:b])
            keep(word, own)
            a = b


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One for each Python worker, so that later tasks know the words of earlier ones."""
    return WordIds(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids binary]): the ids of each text and end_id, cut every `capacity` ids.

    A null or empty text has end_id alone. Repeated rows each give their pieces."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    end, size = np.array([end_id], "<u4").tobytes(), 4 * capacity

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(path)
        for frame in batches(frames, 256):
            rows: list[tuple] = []
            for i, ids in enumerate(encode(frame.column(1).to_pylist())):
                ids += end
                rows += [(i, at // size, at // 4, ids[at : at + size]) for at in range(0, len(ids), size)]
            row, piece, start, ids = map(list, zip(*rows)) if rows else ([], [], [], [])
            columns = [frame.column(0).take(pa.array(row, pa.int32())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *[pa.array(ids, pa.binary())] * with_ids], [x.split()[0] for x in schema.split(", ")])

    return docs.select("doc_id", utf8(F.col("text")).alias("text")).mapInArrow(run, schema)


class _Plan:
    """Runs (length, first rank, first sequence, offset) for counts of pieces by length."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.runs, self.sequences = capacity, [], 0
        self.left = np.zeros(capacity + 1, np.int64)
        for length, n in counts.items():
            self.left[length] = n
        self.used = np.zeros(capacity + 1, np.int64)
        self.pairs, self.stale = np.zeros(capacity + 1, bool), 1 << 30

    def emit(self, times: int, lengths: list[int]) -> None:
        offset = 0
        for x in lengths:
            self.runs.append((x, int(self.used[x]), self.sequences, offset))
            self.used[x] += times
            offset += x
        self.sequences += times

    def take(self, lengths: list[int]) -> bool:
        """Consume the combination as often as the counts allow; False if they don't allow it once."""
        need: dict[int, int] = {}
        for x in lengths:
            need[x] = need.get(x, 0) + 1
        times = int(min(self.left[x] // n for x, n in need.items()))
        if times:
            self.emit(times, lengths)
            for x, n in need.items():
                self.left[x] -= n * times
            self.stale += 1
        return times > 0

    def index_pairs(self) -> None:
        """pairs[s]: whether two lengths that are left add up to s."""
        there = int.from_bytes(np.packbits(self.left > 0, bitorder="little").tobytes(), "little")
        sums, bits = 0, np.nonzero(self.left > 0)[0]
        for a in bits.tolist():
            sums |= there << a
        raw = (sums & ((1 << (self.capacity + 1)) - 1)).to_bytes(self.capacity // 8 + 1, "little")
        self.pairs, self.stale = np.unpackbits(np.frombuffer(raw, np.uint8), bitorder="little")[: self.capacity + 1].astype(bool), 0

    def pair(self, total: int, seed: list[int]) -> bool:
        """Take seed with two lengths that add up to total, the longest possible first."""
        a = np.arange(total - 1, (total - 1) // 2, -1)
        return any(self.take([*seed, x, total - x]) for x in a[(self.left[a] > 0) & (self.left[total - a] > 0)].tolist())

    def triple(self, gap: int, length: int) -> bool:
        """Take length with three others that fill the gap. All third lengths are tried: lengths only run out, so
        an old index lists every pair there is; it's renewed where the first ones that it lists fail."""
        if self.stale >= 32:
            self.index_pairs()
        a = np.arange(gap - 2, (gap - 1) // 3, -1)
        a = a[a > 0]
        for some in ((64, None) if self.stale else (None,)):
            if any(self.pair(gap - x, [length, x]) for x in a[(self.left[a] > 0) & self.pairs[gap - a]].tolist()[:some]):
                return True
            if some:
                self.index_pairs()
        return False

    def exact(self) -> None:
        """Fill the gap beside each length, the longest first, by one, two or three others exactly."""
        for length in range(self.capacity, 0, -1):
            gap = self.capacity - length
            while self.left[length] > 0:
                if gap == 0:
                    done = self.take([length])
                elif self.take([length, gap]) or self.pair(gap, [length]):
                    done = True
                else:
                    done = self.triple(gap, length)
                if not done:
                    break

    def best_fit(self) -> None:
        """What is left, the longest first, each into the open sequence that it fills the most."""
        open_: dict[int, list[tuple[int, list[int]]]] = {}
        full: list[tuple[int, list[int]]] = []
        have = np.zeros(self.capacity + 1, bool)

        def put(times: int, lengths: list[int], gap: int) -> None:
            if gap:
                open_.setdefault(gap, []).append((times, lengths))
                have[gap] = True
            else:
                full.append((times, lengths))

        for length in np.nonzero(self.left > 0)[0][::-1].tolist():
            n = int(self.left[length])
            while n:
                fits = np.nonzero(have[length:])[0]
                if not fits.size:
                    break
                gap = length + int(fits[0])
                times, lengths = open_[gap].pop()
                have[gap] = bool(open_[gap])
                m = min(n, times)
                if times > m:
                    put(times - m, lengths, gap)
                put(m, [*lengths, length], gap - length)
                n -= m
            each = self.capacity // length
            if n >= each:
                put(n // each, [length] * each, self.capacity - each * length)
            if n % each:
                put(1, [length] * (n % each), self.capacity - (n % each) * length)
            self.left[length] = 0
        for times, lengths in [*full, *(x for group in open_.values() for x in group)]:
            self.emit(times, lengths)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Runs (length, first rank, first sequence, offset): rank r of a length from first rank on goes to
    sequence first sequence + r - first rank at this offset, until the next run of the length."""
    made = _Plan(counts, capacity)
    made.exact()
    made.best_fit()
    return made.runs


def packed(pieces: DataFrame, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """pieces(length, ...) with sequence_id and offset; every row is placed, none is cut.

    length must lie in 1..capacity. Rows that `order` leaves tied take their places in any order.
    Own columns named sequence_id or offset are replaced. An empty table stays empty."""
    pieces = checkpointed(pieces.drop("sequence_id", "offset"))
    spark, own = pieces.sparkSession, pieces.columns
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # a row for each length
    runs: dict[int, list] = {}
    for length, first, sequence, offset in plan(counts, capacity):
        runs.setdefault(length, []).append((first, sequence, offset))
    table = spark.createDataFrame([(k, sorted(v)) for k, v in runs.items()], "length long, __runs array<struct<first:long,sequence:long,offset:long>>")
    salts = max(16, sum(counts.values()) // 100_000)
    salted = pieces.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    sizes = salted.groupBy("length", "__salt").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("length").orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "__salt", F.coalesce(before, F.lit(0)).alias("__before"))
    within = F.row_number().over(Window.partitionBy("length", "__salt").orderBy(*order))
    ranked = salted.withColumn("__rank", within).join(starts, ["length", "__salt"]).withColumn("__rank", F.col("__before") + F.col("__rank") - 1)
    at = last_at_most(max(map(len, runs.values()), default=1), lambda i: F.get("__runs", i)["first"] <= F.col("__rank"))
    found = ranked.join(F.broadcast(table), "length").withColumn("__run", F.element_at("__runs", at))
    return found.select(*own, (F.col("__run.sequence") + F.col("__rank") - F.col("__run.first")).alias("sequence_id"), F.col("__run.offset").alias("offset"))
