"""Full-text search as column predicates over a normalised token string.

A text's tokens, lower-cased, without accents, stand between single blanks, with one at either end.
A term is then a substring ` term `, a prefix ` term`, a phrase ` a b `. Operators are upper case:
NOT binds tighter than AND, AND tighter than OR; terms side by side are AND-ed first of all. The token
string is worked out once for a row, however many terms look at it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

BOTH = ("message", "raw_message")
Test = Callable[[list[Column]], Column]  # of the token strings of the columns
_MARKS = "".join(map(chr, range(0x300, 0x370)))


def _folds() -> dict[str, str]:
    """Latin letters with marks, and the letters they are without them; marks by themselves are nothing."""
    parted = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, 0x2000)}
    return {c: d[0] for c, d in parted.items() if len(d) > 1 and d[0].isascii() and d[0].isalpha()}


_FOLDS = _folds()
_TABLE = str.maketrans(_FOLDS | dict.fromkeys(_MARKS, ""))


class QuerySyntaxError(ValueError):
    """The query can't be read; callers show an empty page."""


@dataclass(frozen=True)
class Phrase:
    """Tokens in a row within one column; prefix: the last one may go on. No tokens match nothing."""

    words: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class Near:
    """Phrases within one column, in any order, at most `gap` tokens apart."""

    phrases: tuple[tuple[str, ...], ...]
    gap: int


@dataclass(frozen=True)
class Join:
    """AND, OR, or NOT: the first side without the second."""

    word: str
    sides: tuple[Query, ...]


Query = Phrase | Near | Join


def tokens(text: Column) -> Column:
    folded = F.lower(F.translate(text, "".join(_FOLDS) + _MARKS, "".join(_FOLDS.values())))  # what has no counterpart goes
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(folded, r"[^\p{L}\p{N}\p{M}\p{Co}]+", " ")), F.lit(" "))


def token_list(text: str) -> list[str]:
    """The same tokens of a query's text."""
    plain = text.translate(_TABLE).lower()
    held = lambda c: unicodedata.category(c)[0] in "LNM" or unicodedata.category(c) == "Co"
    return "".join(c if held(c) else " " for c in plain).split()


def _tested(test: Test, columns: tuple[str, ...]) -> Column:
    """test of the columns' token strings, each worked out once; an absent text has no tokens."""
    held = F.struct(*[tokens(F.coalesce(F.col(c), F.lit(""))).alias(f"t{i}") for i, c in enumerate(columns)])
    return F.exists(F.array(held), lambda x: test([x[f"t{i}"] for i in range(len(columns))]))


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _phrase(words: list[str], prefix: bool) -> Test:
    if not words:
        return lambda _: F.lit(False)
    needle = " " + " ".join(words) + ("" if prefix else " ")
    return lambda held: _any([c.contains(needle) for c in held])


def clumped(places: list[Column], lengths: list[int], gap: int) -> Column:
    """Whether phrases that begin at these places have one of each near together: for a place that may be the last, the others
    begin before it and end at most `gap` tokens before it."""
    held = F.struct(*[p.alias(f"p{i}") for i, p in enumerate(places)])

    def by_last(every: Column) -> Column:
        def before(i: int, last: Column) -> Column:
            return F.exists(every[f"p{i}"], lambda s: s.between(last - gap - lengths[i], last))

        def near(last: Column) -> Column:
            return reduce(lambda a, b: a & b, [before(i, last) for i in range(len(places))])

        return _any([F.exists(every[f"p{j}"], near) for j in range(len(places))])

    return F.exists(F.array(held), by_last)


def _near(phrases: list[list[str]], gap: int) -> Test:
    """All phrases in one column, in any order, with at most `gap` tokens from the end of each to the start of the last.

    Places of each phrase are listed; for each place that may be the last, the others must have one near before it."""
    if not phrases or not all(phrases):
        return lambda _: F.lit(False)

    def places(found: Column, words: list[str]) -> Column:
        at = F.sequence(F.lit(0), F.size(found))
        return F.filter(at, lambda i: reduce(lambda a, b: a & b, [F.coalesce(F.get(found, i + k) == w, F.lit(False)) for k, w in enumerate(words)]))

    def clump(found: Column) -> Column:
        return clumped([places(found, w) for w in phrases], [len(w) for w in phrases], gap)

    def test(held: list[Column]) -> Column:
        all_there = lambda c: reduce(lambda a, b: a & b, [c.contains(f" {' '.join(w)} ") for w in phrases])
        return _any([F.when(all_there(c), F.exists(F.array(F.split(F.btrim(c), " ")), clump)).otherwise(False) for c in held])

    return test


def words_query(query: str) -> Query | None:
    """Every word of the query begins a token; None for a query without words."""
    parts = [re.sub("[\"'()*:^{}]", "", w) or w for w in query.split()]
    each = tuple(Phrase(tuple(token_list(w)), True) for w in parts)
    return Join("AND", each) if each else None


def words_match(query: str, columns: tuple[str, ...] = BOTH) -> Column:
    """Every word of the query begins a token of either column; a word without tokens matches nothing."""
    asked = words_query(query)
    return F.lit(True) if asked is None else matched(asked, columns)


def _test(asked: Query) -> Test:
    if isinstance(asked, Phrase):
        return _phrase(list(asked.words), asked.prefix)
    if isinstance(asked, Near):
        return _near([list(w) for w in asked.phrases], asked.gap)
    return joined(asked, _test, lambda test: test)


def joined(asked: Join, of: Callable[[Query], object], call: Callable) -> Callable[..., Column]:
    """The predicate of a Join from those of its sides; call makes of(side) a function of what is tested."""
    sides = [call(of(s)) for s in asked.sides]
    how = {"AND": lambda a, b: a & b, "OR": lambda a, b: a | b, "NOT": lambda a, b: a & ~b}[asked.word]
    return lambda held: reduce(how, [side(held) for side in sides])


def matched(asked: Query, columns: tuple[str, ...] = BOTH) -> Column:
    """Whether a row's columns match a query, by their token strings."""
    return _tested(_test(asked), columns)


_NEAR = re.compile(r'((?:[^",]|"[^"]*")*)(?:,\s*(\d+)\s*)?')
_ITEM = re.compile(r'\s*(?:(NEAR)\(([^()]*)\)|"((?:[^"]|"")*)"\s*(\*?)|([()])|([^\s()"*]+)(\*?))')


def boolean_match(query: str, columns: tuple[str, ...] = BOTH) -> Column:
    """Predicate for a boolean query: terms, prefix*, "phrases", AND, OR, NOT, brackets, NEAR(a b, n)."""
    return matched(boolean_query(query), columns)


def boolean_query(query: str) -> Query:
    """A boolean query as it is to be evaluated."""
    items, at = [], 0
    while query[at:].strip():
        if not (m := _ITEM.match(query, at)):
            raise QuerySyntaxError(query)
        at = m.end()
        if m[1]:
            if not (near := _NEAR.fullmatch(m[2])):
                raise QuerySyntaxError(query)
            phrases = tuple(tuple(token_list(q if q else w)) for q, w in re.findall(r'"([^"]*)"|([^\s"]+)', near[1]))
            items.append(Near(phrases, int(near[2] or 10)))
        elif m[3] is not None:
            items.append(Phrase(tuple(token_list(m[3])), bool(m[4])))
        elif m[5] or m[6] in ("AND", "OR", "NOT"):
            items.append(m[5] or m[6])
        elif not re.fullmatch(r"[\w\x80-\U0010ffff]+", m[6]):
            raise QuerySyntaxError(query)
        else:
            items.append(Phrase(tuple(token_list(m[6])), bool(m[7])))

    def side_by_side() -> Query:
        out = None
        while items and (not isinstance(items[0], str) or items[0] == "("):
            x = items.pop(0)
            if isinstance(x, str):
                x = either()
                if not items or items.pop(0) != ")":
                    raise QuerySyntaxError(query)
            out = x if out is None else Join("AND", (out, x))
        if out is None:
            raise QuerySyntaxError(query)
        return out

    def chain(below: Callable[[], Query], word: str) -> Callable[[], Query]:
        def run() -> Query:
            out = below()
            while items and isinstance(items[0], str) and items[0] == word:
                items.pop(0)
                out = Join(word, (out, below()))
            return out

        return run

    either = chain(chain(chain(side_by_side, "NOT"), "AND"), "OR")
    found = either()
    if items:
        raise QuerySyntaxError(query)
    return found
