"""Message filters as predicates; all that are given hold together."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.search import QuerySyntaxError, boolean_match, words_match

LONGEST_PATTERN = 200  # bytes
#: Java has what linear-time engines lack: back references and looking around.
_BEYOND = re.compile(r"\\[1-9]|\\k<|\(\?(?:[=!>]|<[=!])|[*+?}]\+")


def contains_text(name: str, needle: str) -> Column:
    return F.lower(F.col(name)).contains(needle.lower())


def in_either(needle: str) -> Column:
    """Case-insensitive literal in message or raw_message."""
    return contains_text("message", needle) | contains_text("raw_message", needle)


def any_of(query: str) -> Column:
    """Any of the parts of a query between ` OR `, as literals without quotes and stars."""
    parts = [p for x in query.split(" OR ") if (p := re.sub("['\"*]", "", x).strip())]
    return reduce(lambda a, b: a | b, map(in_either, parts), F.lit(False)) if parts else F.lit(True)


def valid_pattern(spark: SparkSession, pattern: str) -> bool:
    """Whether a pattern may be run: short enough, without constructs that need backtracking by design, and one that Java compiles."""
    if len(pattern.encode()) > LONGEST_PATTERN or _BEYOND.search(pattern):
        return False
    try:
        spark._jvm.java.util.regex.Pattern.compile(f"(?i){pattern}")
    except Exception:  # noqa: BLE001  the gateway wraps Java's error
        return False
    return True


def regex_match(spark: SparkSession, pattern: str, on_invalid: str = "ignore") -> Column:
    """Pattern, case-insensitive, anywhere in message or raw_message. on_invalid: literal, ignore or never."""
    if valid_pattern(spark, pattern):
        return F.col("message").rlike(f"(?i){pattern}") | F.col("raw_message").rlike(f"(?i){pattern}")
    return {"literal": in_either(pattern), "ignore": F.lit(True), "never": F.lit(False)}[on_invalid]


def parse_date(text: str) -> datetime | None:
    """RFC 3339, a date, or a date with hours and minutes; None for anything else."""
    if re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)", text) or re.fullmatch(r"\d{4}-\d\d-\d\d(T\d\d:\d\d)?", text):
        try:
            found = datetime.fromisoformat(text.replace(",", "."))
        except ValueError:
            return None
        return found.replace(tzinfo=timezone.utc) if found.tzinfo is None else found.astimezone(timezone.utc)
    return None


@dataclass(frozen=True)
class Filter:
    """What a reader asks for; empty fields ask for nothing. mode: text, words, fts, regex or any."""

    severities: tuple[int, ...] = field(default=())
    facilities: tuple[int, ...] = field(default=())
    hostname: str = ""
    app_name: str = ""
    source_ip: str = ""
    search: str = ""
    mode: str = "text"
    date_from: str = ""
    date_to: str = ""
    on_invalid: str = "ignore"


def date_range(date_from: str, date_to: str, name: str = "timestamp") -> list[Column]:
    """From and to, both included; a `to` at midnight means that whole day."""
    out, start, end = [], parse_date(date_from), parse_date(date_to)
    if start:
        out.append(F.col(name) >= F.lit(start))
    if end:
        midnight = (end.hour, end.minute, end.second) == (0, 0, 0)
        out.append(F.col(name) < F.lit(end + timedelta(days=1)) if midnight else F.col(name) <= F.lit(end))
    return out


def search(spark: SparkSession, query: str, mode: str, on_invalid: str = "ignore") -> Column:
    if mode == "words":
        return words_match(query)
    if mode == "fts":
        try:
            return boolean_match(query)
        except QuerySyntaxError:
            return F.lit(False)
    if mode == "regex":
        return regex_match(spark, query, on_invalid)
    return any_of(query) if mode == "any" else in_either(query)


def predicate(spark: SparkSession, f: Filter) -> Column:
    """One predicate for the whole filter, the cheap parts first; true for an empty filter."""
    parts = [F.col(c).isin(*v) for c, v in (("severity", f.severities), ("facility", f.facilities)) if v]
    parts += date_range(f.date_from, f.date_to)
    parts += [contains_text(c, v) for c, v in (("hostname", f.hostname), ("app_name", f.app_name), ("source_ip", f.source_ip)) if v]
    if f.search:
        parts.append(search(spark, f.search, f.mode, f.on_invalid))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filtered(messages: DataFrame, f: Filter) -> DataFrame:
    return messages.where(predicate(messages.sparkSession, f))
