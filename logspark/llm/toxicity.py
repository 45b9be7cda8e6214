"""Toxicity of texts whose words may be disguised.

A disguised word is what a noisy channel has made of plain ones: look-alike characters, also of other
scripts, separators or blanks between letters, letters repeated, blanks left out. Viterbi decoding over the
lattice of what each character may stand for, word ends included, under a trigram model of letters, restores
them; the words as restored are then scored. Letters are counted in all documents, weights of words and word
beginnings over labelled texts.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from heapq import nlargest
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logspark.llm.common import batches, checkpointed

#: Letters that a character may stand for besides itself.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "*": "aeiou", "#": "aeiou", "%": "aeiou"}
#: Cyrillic and Greek letters by the Latin ones they look like.
LOOKS |= dict(zip("авгекмнорстухіѕјԁԛԝ", ("a", "b", "r", "e", "k", "m", "h", "o", "p", "c", "t", "y", "x", "i", "s", "j", "d", "q", "w"))) | dict(zip("αβεικνορτυχω", ("a", "b", "e", "i", "k", "v", "o", "p", "t", "u", "x", "w")))
#: Characters that may part the letters of a word, or words.
PARTERS = ".-_*~'`,/\\"
SPACED = re.compile(r"(?<!\S)\S(?:[ \t._*-]{1,2}[^\s.]){2,}(?![^\s.,;:!?])")
_ENDS = re.compile(r"^[^\w@$!|+€£(]+|[^\w@$+€£]+$")
_BARE = re.compile(r"^[\W_]+|[\W_]+$")
_UNSEEN = re.compile("[\u00ad\u0300-\u036f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u20d0-\u20ff\ufe00-\ufe0f\ufeff]")
_THRICE = re.compile(r"(.)\1\1", re.S)
_AGAIN = re.compile(r"(\S)\1{3,}")
LOOK_COST, DROP_COST, REPEAT_COST, WIDE_COST = 1.5, 1.0, 0.4, 3.0
STRETCH = 512  # characters after which what all live paths share is written out
LETTER_BUCKETS = 1 << 19  # of hashed trigrams, of any script: the model is as large whatever the corpus
FEWEST = 7
LEAST_JOINED = 4  # letters of a word that is looked for in pieces
SAMPLE = 12_000  # labelled texts the weights are fitted on, at most
PRIOR = 4
START = "^^"


def _bucket(gram: str) -> int:
    return crc32(gram.encode("utf-8", "surrogatepass")) % LETTER_BUCKETS


class Letters:
    """Trigram model of letters of any script, with words' beginnings and ends, by hashed counts of trigrams."""

    def __init__(self, counts: dict[str, int] | None = None, tri: np.ndarray | None = None, bi: np.ndarray | None = None):
        self.tri, self.bi = (np.zeros(LETTER_BUCKETS) if x is None else x for x in (tri, bi))
        self.seen: dict[str, float] = {}
        for k, n in (counts or {}).items():
            self.add(k, n)

    def add(self, gram: str, n: float) -> None:
        self.tri[_bucket(gram)] += n
        self.bi[_bucket(gram[:2])] += n

    def cost(self, two: str, c: str) -> float:
        if (x := self.seen.get(two + c)) is None:
            if len(self.seen) >= 1_000_000:
                self.seen.clear()
            x = self.seen[two + c] = -math.log((self.tri[_bucket(two + c)] + 0.05) / (self.bi[_bucket(two)] + 0.05 * 40))
        return x


def trigrams(word: str) -> list[str]:
    marked = f"^^{word}$"
    return [marked[i : i + 3] for i in range(len(word) + 1)]


def folded(text: str) -> str:
    """Lower case; full-width and other compatible forms as plain ones, without marks and what can't be seen."""
    return text.lower() if text.isascii() else _UNSEEN.sub("", unicodedata.normalize("NFKC", text)).lower()


def disguised(word: str) -> bool:
    """Whether a folded word, bare of what surrounds it, is worth decoding."""
    if len(word) < 3:
        return False
    if word.isalpha():
        return bool(_THRICE.search(word)) or (not word.isascii() and any("a" <= c <= "z" for c in word) and any(c in LOOKS for c in word))
    return any(map(str.isalpha, word)) and any(c in LOOKS or c in PARTERS for c in word)


def ways(c: str, before: str) -> tuple[list[tuple[str, float]], float | None, float | None]:
    """What a character stands for: (letters and their costs, cost of nothing, cost of a word's end); None: not that.

    c may be blanks: one of them is nothing or an end alike, more are rather an end."""
    if c.isspace():
        return [], (0.0 if len(c) == 1 else WIDE_COST), 0.0
    found = [(c, 0.0)] if c.isalpha() else []
    found += [(x, LOOK_COST) for x in LOOKS.get(c, "")]
    parts = c in PARTERS
    drop = REPEAT_COST if c == before else DROP_COST if parts else None if found else LOOK_COST
    return found, drop, DROP_COST if parts else None


def restore(written: str, letters: Letters) -> str:
    """The likeliest plain words behind folded characters: the cheapest path through their lattice, of any length.

    A state is the last two letters of the word it is in. Characters that stand more than three times in a row
    count as three. Paths are links back from their last letters and share their beginnings; what all share is written out on the way."""
    best: dict[str, tuple[float, tuple | None]] = {START: (0.0, None)}
    before, done = "", []
    for i, c in enumerate(re.findall(r"\s+|\S", _AGAIN.sub(r"\1\1\1", written))):
        into: dict[str, tuple[float, tuple | None]] = {}
        found, drop, end = ways(c, before)
        for two, (cost, out) in best.items():
            for x, extra in found:
                total = cost + extra + letters.cost(two, x)
                if total < into.get(two[1] + x, (math.inf,))[0]:
                    into[two[1] + x] = (total, (out, x))
            if drop is not None and cost + drop < into.get(two, (math.inf,))[0]:
                into[two] = (cost + drop, out)
            if end is not None and two != START and (total := cost + end + letters.cost(two, "$")) < into.get(START, (math.inf,))[0]:
                into[START] = (total, (out, " "))
        best, before = into or best, c
        if i % STRETCH == STRETCH - 1:
            told, best = _settled(best)
            done += told
    _, two = min((cost + (letters.cost(two, "$") if two != START else 0.0), two) for two, (cost, _) in best.items())
    return "".join([*done, *_letters_of(best[two][1])]).strip()


def _settled(best: dict[str, tuple[float, tuple | None]]) -> tuple[list[str], dict[str, tuple[float, tuple | None]]]:
    """The letters with which all live paths begin, and the paths without them."""
    ends, chain = [out for _, out in best.values()], []
    node = ends[0]
    while node is not None:
        chain.append(node)
        node = node[0]
    place = {id(n): len(chain) - k for k, n in enumerate(chain)}
    shared = len(chain)
    for out in ends[1:]:
        while out is not None and id(out) not in place:
            out = out[0]
        shared = min(shared, 0 if out is None else place[id(out)])
    if not shared:
        return [], best
    last = chain[len(chain) - shared]

    def rest(out: tuple | None) -> tuple | None:
        tail, new = [], None
        while out is not last:
            tail.append(out[1])
            out = out[0]
        for x in reversed(tail):
            new = (new, x)
        return new

    return _letters_of(last), {two: (cost, rest(out)) for two, (cost, out) in best.items()}


def _letters_of(out: tuple | None) -> list[str]:
    found = []
    while out is not None:
        out, x = out
        found.append(x)
    return found[::-1]


#: What a character looks like, one letter for all that may be taken for each other; parters look like nothing.
_SHAPE = {ord(c): x[0].replace("l", "i") for c, x in LOOKS.items() if len(x) < 3} | {ord("l"): "i"} | dict.fromkeys(map(ord, PARTERS))
_TWICE = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """A folded word by what its characters look like, letters that are repeated once: equal for all that may be the same word."""
    return _TWICE.sub(r"\1", word.translate(_SHAPE))


def plain_words(text: str) -> set[str]:
    """Distinct folded words of a text, without what surrounds them."""
    return {_ENDS.sub("", w) for w in set(folded(text).split())} - {""}


def features(word: str) -> Iterable[str]:
    """A word and its beginnings of 4 to 8 letters, then of 12, 16, 24, 32, ..."""
    yield word
    k = 4
    while k < len(word):
        yield f"{word[:k]}*"
        k += 1 if k < 8 else 1 << (k.bit_length() - 2)


def labelled(docs: DataFrame, labels: DataFrame, usable: Column, most: int = SAMPLE) -> DataFrame:
    """(text, toxic) of at most `most` usable labelled rows, chosen by a hash of their ids."""
    some = labels.where(usable & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    some = some.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "toxic").limit(most)
    return docs.select("doc_id", "text").where("text is not null").join(F.broadcast(some), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


class Model:
    """Shares of toxic texts among those with a feature, the letters of words, and what a text's words mean together."""

    def __init__(self, base: float, shares: dict[str, float], letters: Letters, weights: tuple[float, ...] | None = None):
        odds = math.log(base / (1 - base))
        self.base, self.letters, self.weights = base, letters, weights or (odds, 1.0, 0.0, 0.0, 0.0, 0.0)
        self.gains = {k: math.log(v / (1 - v)) - odds for k, v in shares.items()}
        self.whole = {shape(k) for k, v in shares.items() if v > 0.5 and k.isalpha() and len(k) >= LEAST_JOINED}
        self.begun = {w[:k] for w in self.whole for k in range(1, len(w))}
        firsts = {w[0] for w in self.whole}
        self.firsts = firsts | {chr(c) for c, x in _SHAPE.items() if x is None or x in firsts}
        begin: dict[int, dict[str, float]] = {}
        for k, g in self.gains.items():
            if k.endswith("*"):
                begin.setdefault(len(k) - 1, {})[k[:-1]] = g
        self.begin = sorted(begin.items())

    def best(self, word: str) -> float:
        """The largest gain of a plain word's features; 0 if none tells."""
        x, n = max(0.0, self.gains.get(word, 0.0)), len(word)
        for k, known in self.begin:
            if k >= n:
                break
            if (y := known.get(word[:k])) is not None and y > x:
                x = y
        return x

    def gain(self, word: str) -> float:
        """By how much a folded word, or what it is restored to, raises the log odds of a toxic text; 0 if it tells nothing."""
        if word.isalpha() and word.isascii() and not _THRICE.search(word):
            return self.best(word)  # nothing to take off or to restore
        if word.isalnum():
            plain = bare = word
        elif not (plain := _ENDS.sub("", word)):
            return 0.0
        else:
            bare = _BARE.sub("", plain)
        forms = {bare, plain}
        if disguised(plain):
            for w in [*forms]:
                forms.update(restore(w, self.letters).split())
        return max(map(self.best, forms))


def pieces(words: list[str], gains: _Gains) -> Iterator[str]:
    """Neighbouring words that together look like one which is toxic more often than not, in the order of the text."""
    shapes, begun, whole, firsts = gains.shapes, gains.model.begun, gains.model.whole, gains.model.firsts
    for i in [i for i, w in enumerate(words) if w[0] in firsts and shapes[w] in begun]:
        s, j = shapes[words[i]], i + 1
        while s in begun and j < len(words):
            more = shapes[words[j]]
            s, j = s + (more[1:] if more[:1] == s[-1] else more), j + 1
            if s in whole:
                yield " ".join(words[i:j])


def traits(text: str, gains: _Gains) -> list[float]:
    """1, the three largest gains of the text's distinct words, the sum of all, and the logarithm of their number. A text counts
    as if it had FEWEST words or more: that an empty one has none isn't taken as telling.

    Words in pieces are decoded together, runs of single characters and neighbours that look like a toxic word, and count as what they are read as."""
    low = folded(text)
    written = low.split()
    words = set(written)
    runs = [m[0] for m in SPACED.finditer(low) if any(map(str.isalpha, m[0]))]
    whole = [*pieces(written, gains)]
    if runs or whole:
        times = Counter(written)
        for run in [*runs, *whole]:
            read = restore(run, gains.model.letters).split()
            if read != run.split():  # its pieces aren't words, unless they stand elsewhere too
                times.subtract(run.split())
            words.update(read)
        words -= {w for w, n in times.items() if n <= 0 and w not in gains.model.gains}
    every = [*map(gains.__getitem__, words), 0.0, 0.0, 0.0]
    total = math.fsum(every)
    return [1.0, *nlargest(3, every), math.fsum(every), math.log1p(max(FEWEST, len(words)))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; the first, constant column is not held back."""
    w, hold = np.zeros(x.shape[1]), ridge * np.r_[1e-6, np.ones(x.shape[1] - 1)]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w + np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(hold), x.T @ (y - p) - hold * w)
    return w


def letter_counts(docs: DataFrame) -> tuple[np.ndarray, np.ndarray, int]:
    """Hashed trigrams and bigrams of letters in the words of all texts(text), and the number of words, summed by Spark.

    Words of any script count; what reaches the driver is a number for each bucket."""

    def counted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        total, n = np.zeros(2 * LETTER_BUCKETS, np.int64), 0

        def add() -> int:
            tri: Counter[str] = Counter()
            for w, k in words.items():
                if w.isalpha():
                    for g in trigrams(w):
                        tri[g] += k
            for g, k in tri.items():
                total[_bucket(g)] += k
                total[LETTER_BUCKETS + _bucket(g[:2])] += k
            known = sum(k for w, k in words.items() if w.isalpha())
            words.clear()
            return known

        for frame in batches(frames):
            for text in frame.column(0).to_pylist():
                words.update(text.lower().split())
            if len(words) > 300_000:
                n += add()
        n += add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[at, -1], pa.int64()), pa.array(np.r_[total[at], n], pa.int64())], ["k", "n"])

    found = docs.select("text").where("text is not null").mapInArrow(counted, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
    grams, n = np.zeros(2 * LETTER_BUCKETS), 0
    for r in found.toLocalIterator():
        if r.k < 0:
            n = r.n
        else:
            grams[r.k] = r.n
    return grams[:LETTER_BUCKETS], grams[LETTER_BUCKETS:], n


def fit(sample: DataFrame, docs: DataFrame) -> Model:
    """Letters are counted in all docs, more in words that tell. Shares are counted over seven tenths of the
    distinct texts of the sample, summed by Spark; what a text's words mean together is then weighed on the other three
    tenths. A text with conflicting labels is toxic. Without labelled texts of both kinds the weights stay at their start."""

    def counted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            texts, toxic = Counter(), Counter()
            for text, t in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist()):
                every = {f for w in plain_words(text) for f in features(w)}
                texts.update(every)
                if t:
                    toxic.update(every)
            yield pa.RecordBatch.from_arrays([pa.array(texts.keys(), pa.string()), pa.array(texts.values(), pa.int64()), pa.array([toxic[x] for x in texts], pa.int64())], ["feature", "n", "t"])

    sample = checkpointed(sample.groupBy("text").agg(F.max("toxic").alias("toxic")))
    part = F.pmod(F.xxhash64("text", F.lit(2)), F.lit(10))
    counting, weighing = sample.where(part < 7), sample.where(part >= 7)
    totals = counting.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    base = ((totals.t or 0) + 0.5) / (totals.n + 2)
    sums = counting.mapInArrow(counted, "feature string, n long, t long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    # As if seen in PRIOR more texts of the base share; what isn't twice as toxic as the base tells nothing.
    share = (F.col("t") + PRIOR * base) / (F.col("n") + PRIOR)
    words = sums.where("t >= 2").select("feature", share.alias("share")).where(F.col("share") > min(0.5, 2 * base))
    shares = {r.feature: r.share for r in words.collect()}  # words of a bounded sample
    tri, bi, n = letter_counts(docs)
    letters, bonus = Letters(None, tri, bi), 1 + n // 6000
    for word, p in shares.items():  # words that tell are as good as frequent ones
        if not word.endswith("*") and word.isalpha() and p > 0.5:
            for k in trigrams(word):
                letters.add(k, bonus)
    model = Model(base, shares, letters)
    held = weighing.mapInArrow(_traits_of(model), "toxic int, traits array<double>").collect()  # six numbers of each text of a bounded sample
    y = np.array([r.toxic for r in held], float)
    if y.size and 0 < y.sum() < y.size:
        model.weights = tuple(logistic(np.array([r.traits for r in held]), y).tolist())
    return model


def _traits_of(model: Model):
    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = _Gains(model)
        for frame in batches(frames):
            found = [traits(x, gains) for x in frame.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([frame.column(1), pa.array(found, pa.list_(pa.float64()))], ["toxic", "traits"])

    return run


class _Gains(dict):
    """model.gain of words, kept up to a bound."""

    def __init__(self, model: Model, most: int = 500_000):
        self.model, self.most, self.shapes = model, most, _Shapes()

    def __missing__(self, word: str) -> float:
        x = self.model.gain(word)
        if len(word) <= 100:  # others come once
            if len(self) >= self.most:
                self.clear()
            self[word] = x
        return x


class _Shapes(dict):
    """shape() of words, kept up to a bound."""

    def __missing__(self, word: str) -> str:
        x = shape(word)
        if len(word) <= 100:
            if len(self) >= 500_000:
                self.clear()
            self[word] = x
        return x


def score(text: str, gains: _Gains) -> float:
    """Probability of a toxic text."""
    z = sum(w * x for w, x in zip(gains.model.weights, traits(text, gains)))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every row; a null text counts as empty. Only the text is looked at."""

    def run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = _Gains(model)
        for frame in batches(frames):
            s = pd.Series([score(x, gains) for x in frame.column(1).to_pylist()], dtype="float64")
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(s), pa.array((s >= 0.5).astype("int32"))], ["doc_id", "score", "predicted"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, "doc_id long, score double, predicted int")
