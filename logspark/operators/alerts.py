"""Alert rules: which messages they match, when they fire, what is told."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logspark.functions.labels import SEVERITIES
from logspark.operators.filters import in_either, valid_pattern
from logspark.operators.rank import numbered
from logspark.schema import RULE
from logspark.session import checkpointed, importable

KEEP = 500
#: Signs by severity name, and the one for any other.
ICONS = dict(zip(SEVERITIES, ("\U0001f6a8", "⚠️", "\U0001f525", "❌", "⚠️", "ℹ️", "ℹ️", "\U0001f41b")))
BELL = "\U0001f514"
_FIRE = ["rule_id", "t", "seq", "id"]
_FIRES = "rule_id string, t long, seq long, id string"
_WAYS = "rule_id string, b long, lead long, upto long, out long"
MANY = 24  # literal patterns that are looked for one by one
FAN = 64  # buckets that a task puts together


def rules_frame(spark: SparkSession, rules: list[dict]) -> DataFrame:
    """Rules with their position in the list; those with a regular expression that can't be run are left out."""
    base = {"id": "", "name": "", "enabled": True, "pattern": "", "useRegex": False, "minSeverity": -1, "hostname": "", "appName": "", "cooldown": 0}
    rows = [({**base, **r}, i) for i, r in enumerate(rules)]
    usable = [(*(r[f.name] for f in RULE), i) for r, i in rows if not r["useRegex"] or not r["pattern"] or valid_pattern(spark, r["pattern"])]
    return spark.createDataFrame(usable, "id string, name string, enabled boolean, pattern string, useRegex boolean, minSeverity int, hostname string, appName string, cooldown int, pos int")


def _matched(rule: dict) -> Column:
    """Whether a rule matches a message: literals only, so that a pattern is compiled once."""
    tests = [F.lit(True)] if rule["minSeverity"] < 0 else [F.col("severity") <= rule["minSeverity"]]
    tests += [F.lower(F.col(c)).contains(rule[k].lower()) for c, k in (("hostname", "hostname"), ("app_name", "appName")) if rule[k]]
    if rule["pattern"] and rule["useRegex"]:
        tests.append(F.col("message").rlike(f"(?i){rule['pattern']}") | F.col("raw_message").rlike(f"(?i){rule['pattern']}"))
    elif rule["pattern"]:
        tests.append(in_either(rule["pattern"]))
    return reduce(lambda a, b: a & b, tests)


def matches(messages: DataFrame, rules: DataFrame, many: int = MANY) -> DataFrame:
    """Messages by enabled rules they match, with rule_id, rule_name, rule_pos and cooldown.

    The rules are a configuration, rows that people write: each becomes a predicate, and nothing is joined. If more than `many` of
    them have a literal pattern, all these are looked for in one pass over each text, see _literal_rules."""
    known = [r.asDict() for r in rules.where("enabled").collect()]
    literal = [r for r in known if r["pattern"] and not r["useRegex"]]
    together = literal if len(literal) > many else []
    alone = [r for r in known if r not in together]
    rule = lambda r: F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["name"]).alias("rule_name"), F.lit(r["pos"]).alias("rule_pos"), F.lit(r["cooldown"]).alias("cooldown"))
    none = F.array().cast("array<struct<rule_id:string,rule_name:string,rule_pos:int,cooldown:int>>")
    found = F.array_compact(F.array(*[F.when(_matched(r), rule(r)) for r in alone])) if alone else none
    if together:
        found = F.concat(found, _literal_rules(messages.sparkSession, together))
    return messages.select(*messages.columns, F.inline(found))


def _literal_rules(spark: SparkSession, rules: list[dict]) -> Column:
    """The matching ones of rules with literal patterns. One Aho-Corasick automaton of all patterns runs over the lower-cased
    texts, in Arrow batches; what it finds is then held against the rules' other conditions."""
    importable(spark)
    patterns = [r["pattern"].lower() for r in rules]
    numbers: dict[str, list[int]] = {}
    for k, p in enumerate(patterns):
        numbers.setdefault(p, []).append(k)

    @F.pandas_udf("array<int>")
    def hit(texts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for p, of in numbers.items():
            automaton.add_word(p, of)
        automaton.make_automaton()
        for message, raw in texts:
            yield pd.Series([sorted({k for text in two for _, of in automaton.iter(text) for k in of}) for two in zip(message, raw)])

    row = lambda r: F.struct(F.lit(r["id"]).alias("rule_id"), F.lit(r["name"]).alias("rule_name"), F.lit(r["pos"]).alias("rule_pos"), F.lit(r["cooldown"]).alias("cooldown"), F.lit(r["minSeverity"]).alias("s"), F.lit(r["hostname"].lower()).alias("h"), F.lit(r["appName"].lower()).alias("a"))
    every = F.array(*map(row, rules))
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    maybe = F.transform(hit(low("message"), low("raw_message")), lambda k: F.get(every, k))
    kept = F.filter(maybe, lambda r: ((r.s < 0) | (F.col("severity") <= r.s)) & low("hostname").contains(r.h) & low("app_name").contains(r.a))
    return F.transform(kept, lambda r: F.struct(r.rule_id.alias("rule_id"), r.rule_name.alias("rule_name"), r.rule_pos.alias("rule_pos"), r.cooldown.alias("cooldown")))


def fire_places(t: np.ndarray, cooldown: int, start: int = 0) -> np.ndarray:
    """Places in ascending times that fire, from place start on: the next is the first a cooldown or more later."""
    out = []
    while start < t.size:
        out.append(start)
        start = int(np.searchsorted(t, t[start] + cooldown, "left"))
    return np.array(out, np.int64)


def _timed(hits: DataFrame) -> DataFrame:
    """(rule_id, t, c, seq, id): the first hit of each rule at each time; no other hit of that time can fire.

    Minima are summed up before the shuffle, so a burst is one row a task."""
    importable(hits.sparkSession)
    first = F.min(F.struct("seq", "id")).alias("first")
    timed = hits.where("cooldown > 0").groupBy("rule_id", F.unix_micros("received_at").alias("t"), (F.col("cooldown").cast("long") * 1_000_000).alias("c")).agg(first)
    return timed.select("rule_id", "t", "c", "first.seq", "first.id")


def _with_fires(hits: DataFrame, fires: DataFrame) -> DataFrame:
    """The hits that fire: those of fires, each once even where a hit is repeated, and all of rules without a cooldown."""
    f = fires.select(F.col("rule_id").alias("f_rule"), F.col("t").alias("f_t"), F.col("seq").alias("f_seq"), F.col("id").alias("f_id"))
    same = (hits.rule_id == f.f_rule) & (F.unix_micros(hits.received_at) == f.f_t) & (hits.seq == f.f_seq) & (hits.id == f.f_id)
    told = hits.where("cooldown > 0").join(f, same, "left_semi")
    by = ["rule_id", "received_at", "seq", "id"]
    once = told.groupBy(*by).agg(F.min(F.struct(*[c for c in hits.columns if c not in by])).alias("m")).select(*by, "m.*")
    return once.select(hits.columns).unionByName(hits.where("cooldown <= 0"))


def _by_rule(timed: DataFrame) -> DataFrame:
    """Fires among timed hits, each rule's times in one task."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("t")
        return p.iloc[fire_places(p.t.to_numpy(), int(p.c.iloc[0]))][_FIRE]

    return timed.groupBy("rule_id").applyInPandas(run, _FIRES)


def fired_by_rule(hits: DataFrame) -> DataFrame:
    """Hits that fire, each rule's times in one task: for rules with few hits."""
    return _with_fires(hits, _by_rule(_timed(hits)))


def after(hits: DataFrame, since: dict[str, int]) -> DataFrame:
    """The hits that may still fire where rules have fired before; since: the microsecond from which on each may again."""
    if not since:
        return hits
    again = F.create_map(*[F.lit(x) for kv in since.items() for x in kv])[F.col("rule_id")]
    return hits.where((F.col("cooldown") <= 0) | again.isNull() | (F.unix_micros("received_at") >= again))


def exits(t: np.ndarray, cooldown: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """What a bucket makes of the time from which on its rule may fire again, as (upto, out): of that time it makes the
    out of the first upto that isn't before it, and leaves it as it is after the last.

    t: the bucket's ascending times; end: where its first cooldown ends. Who comes from before enters by then or at the next hit."""
    after = np.searchsorted(t, t + cooldown, "left")
    last = np.where(after < t.size, after, np.arange(t.size))
    while not np.array_equal(ahead := last[last], last):
        last = ahead
    return _classes(t, t[last] + cooldown, end)


def _classes(upto: np.ndarray, out: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """One row for each distinct out, of rows that can be reached."""
    n = min(upto.size, int(np.searchsorted(upto, end, "left")) + 1)
    upto, out = upto[:n], out[:n]
    keep = np.r_[out[1:] != out[:-1], True][:n]
    return upto[keep], out[keep]


def passed(since: np.ndarray, upto: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The times from which on a rule may fire again, after a bucket with these exits."""
    i = np.searchsorted(upto, since, "left")
    return np.where(i < upto.size, out[np.minimum(i, upto.size - 1)], since)


def _entries(ways: DataFrame, buckets: int, start: int = -(1 << 62)) -> DataFrame:
    """(rule_id, b, since): from when on each bucket's rule may fire again, as the bucket begins.

    ways(rule_id, b, lead, upto, out): the exits of each bucket; lead is where its first cooldown ends. FAN buckets in
    a row are put together until one is left for each rule; then each takes its entry apart again. No task sees more than FAN buckets."""

    def parts(p: pd.DataFrame) -> list[tuple[int, pd.DataFrame]]:
        return list(p.sort_values(["b", "upto"]).groupby("b", sort=True))

    def together(p: pd.DataFrame) -> pd.DataFrame:
        upto, out = np.empty(0, np.int64), np.empty(0, np.int64)
        for _, of in parts(p):
            u, o = of.upto.to_numpy(), of.out.to_numpy()
            upto, out = np.r_[upto, u], np.r_[passed(out, u, o), o]
        lead = int(p.lead.min())
        upto, out = _classes(upto, out, lead)
        return pd.DataFrame({"rule_id": p.rule_id.iloc[0], "b": int(p.b.iloc[0]) // FAN, "lead": lead, "upto": upto, "out": out})

    def apart(p: pd.DataFrame, since: int) -> pd.DataFrame:
        rows = []
        for b, of in parts(p):
            rows.append((p.rule_id.iloc[0], b, since))
            since = int(passed(np.array([since]), of.upto.to_numpy(), of.out.to_numpy())[0])
        return pd.DataFrame(rows, columns=["rule_id", "b", "since"])

    entry = "rule_id string, b long, since long"
    if buckets <= FAN:
        return ways.groupBy("rule_id").applyInPandas(lambda p: apart(p, start), entry)
    group = F.floor(F.col("b") / FAN).cast("long").alias("g")
    higher = checkpointed(ways.groupBy("rule_id", group).applyInPandas(together, _WAYS))
    above = _entries(higher, -(-buckets // FAN), start).withColumnRenamed("b", "g")
    both = ways.withColumn("g", group).groupBy("rule_id", "g").cogroup(above.groupBy("rule_id", "g"))
    return both.applyInPandas(lambda p, e: apart(p, int(e.since.iloc[0])) if len(p) else pd.DataFrame({"rule_id": [], "b": [], "since": []}), entry)


def fired(hits: DataFrame, rows: int = 500_000, width: int | None = None) -> DataFrame:
    """Hits that fire; the same as fired_by_rule, but a rule with more than `rows` times, or any if `width` is given, has its time
    line cut into buckets.

    A bucket is `width` cooldowns, from one up, chosen for each rule by how dense its hits are: busy rules have many
    buckets. A bucket alone tells what it makes of any time from which on its rule may fire again; see _entries.
    From its true entry each bucket then marks its fires."""
    timed = checkpointed(_timed(hits))
    every = timed.groupBy("rule_id", "c").agg(F.min("t").alias("first"), F.max("t").alias("last"), F.count("*").alias("n")).collect()  # a row for each rule
    span = [r for r in every if width or r.n > rows]
    if not every:
        return hits
    if not span:
        return _with_fires(hits, _by_rule(timed))
    many = F.col("rule_id").isin([r.rule_id for r in span])
    few, timed = timed.where(~many), timed.where(many)
    wide = {r.rule_id: r.c * (width or int(max(1, min(4096, rows * (r["last"] - r["first"] + 1) // (r.n * r.c))))) for r in span}
    buckets = max((r["last"] - r["first"]) // wide[r.rule_id] + 1 for r in span)
    of_rule = lambda f: F.create_map(*[F.lit(x) for r in span for x in (r.rule_id, f(r))])[F.col("rule_id")]
    first, long = of_rule(lambda r: r["first"]), of_rule(lambda r: wide[r.rule_id])
    b = F.floor((F.col("t") - first) / long).cast("long")
    dealt = timed.withColumn("b", b).withColumn("lead", first + F.col("b") * long + F.col("c"))

    def ways(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("t")
        upto, out = exits(p.t.to_numpy(), int(p.c.iloc[0]), int(p.lead.iloc[0]))
        return pd.DataFrame({"rule_id": p.rule_id.iloc[0], "b": int(p.b.iloc[0]), "lead": int(p.lead.iloc[0]), "upto": upto, "out": out})

    def marked(p: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("t")
        t = p.t.to_numpy()
        return p.iloc[fire_places(t, int(p.c.iloc[0]), int(np.searchsorted(t, int(e.since.iloc[0]), "left")))][_FIRE] if len(p) else p[_FIRE]

    least = checkpointed(dealt.select("rule_id", "b", "c", "lead", "t").groupBy("rule_id", "b").applyInPandas(ways, _WAYS))
    fires = dealt.groupBy("rule_id", "b").cogroup(_entries(least, buckets).groupBy("rule_id", "b")).applyInPandas(marked, _FIRES)
    return _with_fires(hits, fires.unionByName(_by_rule(few)) if len(span) < len(every) else fires)


def events(fires: DataFrame) -> DataFrame:
    """Alert events of fires; several rules may fire on one message, in the rules' order. An event's id is of rule and message."""
    return fires.select(F.concat_ws(":", "rule_id", "id").alias("id"), F.col("rule_id").alias("ruleId"), F.col("rule_name").alias("ruleName"), "message", F.col("severity_label").alias("severity"), "hostname", F.col("received_at").alias("timestamp"), "seq", "rule_pos")


def history(new: DataFrame, old: DataFrame | None = None, keep: int = KEEP) -> DataFrame:
    """The last `keep` events, with pos in firing order."""
    every = new if old is None else old.unionByName(new)
    by = ("timestamp", "seq", "rule_pos")
    return numbered(every.orderBy(*map(F.desc, by)).limit(keep), *map(F.col, by))


def notifications(alerts: DataFrame) -> DataFrame:
    """(id, title, body) of events."""
    signs = F.create_map(*[F.lit(x) for kv in ICONS.items() for x in kv])
    host = F.when(F.col("hostname") == "", "unknown host").otherwise(F.col("hostname"))
    text = F.when(F.length("message") > 120, F.concat(F.substring("message", 1, 117), F.lit("..."))).otherwise(F.col("message"))
    return alerts.select("id", F.concat(F.coalesce(F.try_element_at(signs, "severity"), F.lit(BELL)), F.lit(" "), "ruleName").alias("title"), F.concat("severity", F.lit(" on "), host, F.lit("\n"), text).alias("body"))
