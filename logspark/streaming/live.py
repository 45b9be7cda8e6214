"""Live paths: ingest, de-duplication, rates, totals and alert cooldown as streaming queries."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from logspark.functions.parse import parse
from logspark.operators import alerts, stats, textindex
from logspark.operators.idindex import IdIndex
from logspark.session import children, importable, remove
from logspark.sources.sinks import append, with_date


def _started(writer, trigger: dict | None) -> StreamingQuery:
    return writer.trigger(**(trigger or {"processingTime": "10 seconds"})).start()


def deduplicated(messages: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The first message of each id within the delay; older state is dropped."""
    return messages.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["id"])


def ingest(lines: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, ignore_known: bool = False, ids: IdIndex | None = None, postings: str | None = None) -> StreamingQuery:
    """Raw lines, parsed, into the store. ignore_known: leave out messages whose ids it holds, batch by batch, so that
    a batch that runs again adds nothing; ids: the same by an index of ids. postings: keep the full-text index there too."""
    if not (ignore_known or ids or postings):
        writer = with_date(parse(lines)).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("event_date")
        return _started(writer, trigger)

    def each(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        if postings:  # first: postings of messages that aren't stored do no harm, and may be written twice
            textindex.append(batch, postings, day=F.to_date("timestamp"))
        append(batch, path, by_day=True, index=ids)
        batch.unpersist()

    return _started(parse(lines).writeStream.option("checkpointLocation", checkpoint).foreachBatch(each), trigger)


def rates(messages: DataFrame, seconds: int = 10, step: int = 1, delay: str = "1 minute", chained: bool = False) -> DataFrame:
    """Sliding rates. chained: seconds and windows are two states, one after the other, for append mode: a window comes out once it's past."""
    return stats.rate(messages.withWatermark("received_at", delay), seconds, step, chained)


def level_counts(messages: DataFrame, width: str = "1 second", delay: str = "1 minute") -> DataFrame:
    return stats.tumbling(messages.withWatermark("received_at", delay), width)


def running_totals(messages: DataFrame) -> DataFrame:
    """Counts by level and source since the start; for complete or update mode."""
    source = F.coalesce(F.nullif("hostname", F.lit("")), F.col("source_ip"))
    return messages.groupBy("severity_label", source.alias("source")).agg(F.count("*").alias("count"))


def dashboard(messages: DataFrame, checkpoint: str, show, n: int = 10, trigger: dict | None = None) -> StreamingQuery:
    """Calls show(levels, top sources) with the running totals after each batch."""

    def each(batch: DataFrame, _: int) -> None:
        levels = batch.groupBy("severity_label").agg(F.sum("count").alias("count"))
        top = batch.groupBy("source").agg(F.sum("count").alias("count")).orderBy(F.desc("count"), "source").limit(n)
        show(levels, top)

    return _started(running_totals(messages).writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(each), trigger)


class Cooldown(StatefulProcessor):
    """State of a rule: its last fire. It expires once the rule may fire again, by the clock of arrivals, so idle rules hold none."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        p = pd.concat([x.sort_values(["t", "seq", "id"]).drop_duplicates(["t", "seq", "id"]) for x in rows])
        p = p.sort_values(["t", "seq", "id"]).drop_duplicates(["t", "seq", "id"])
        t, c = p.t.to_numpy(), int(p.c.iloc[0])
        if c > 0:
            held = self.last.get()
            since = int(held[0]) + c if held is not None else None
            out = p.iloc[alerts.fire_places(t, c, 0 if since is None else int(t.searchsorted(since, "left")))]
        else:
            out = p
        if c > 0 and len(out):
            last = int(out.t.iloc[-1])
            self.last.update((last,))
            self.handle.registerTimer((last + c) // 1000 + 1)
        yield out[["rule_id", "t", "seq", "id"]]

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A timer of an earlier fire finds a later one, whose own timer is still to come."""
        if len(list(self.handle.listTimers())) == 0:
            self.last.clear()
        return iter([])

    def close(self) -> None:
        pass


def cooled(messages: DataFrame, rules: DataFrame, delay: str = "1 hour") -> DataFrame:
    """(rule_id, t in microseconds, seq, id) of fires, hit by hit as they come; messages later than delay are left out.

    A task takes the hits of a rule that one batch brings: limit batches at the source, or see fire_batches."""
    importable(messages.sparkSession)
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    hits = alerts.matches(messages.withWatermark("received_at", delay), rules).select("rule_id", F.unix_micros("received_at").alias("t"), "seq", "id", (F.col("cooldown").cast("long") * 1_000_000).alias("c"), "received_at")
    return hits.groupBy("rule_id").transformWithStateInPandas(Cooldown(), "rule_id string, t long, seq long, id string", "append", "eventtime")


def fire_batches(messages: DataFrame, rules: DataFrame, path: str, checkpoint: str, trigger: dict | None = None, rows: int = 500_000, width: int | None = None) -> StreamingQuery:
    """Hits that fire, batch by batch into path/fires, with the last fire of each rule in path/last.

    A burst of one rule is cut over many tasks as in alerts.fired. A batch that runs again starts from the state before
    it and writes the same once more, in place of what it wrote; hits earlier than a rule's last fire and its cooldown don't fire."""
    spark = messages.sparkSession

    def each(batch: DataFrame, number: int) -> None:
        states = sorted(int(n.removeprefix("batch=")) for n in children(spark, f"{path}/last") if n.startswith("batch="))
        before = [n for n in states if n < number]
        last = {r.rule_id: r.t for r in spark.read.parquet(f"{path}/last/batch={before[-1]}").collect()} if before else {}  # a row for each rule
        cooldowns = {r.id: r.cooldown * 1_000_000 for r in rules.collect()}
        hits = alerts.matches(batch, rules)
        fires = alerts.fired(alerts.after(hits, {k: t + cooldowns[k] for k, t in last.items() if k in cooldowns}), rows, width)
        fires.write.mode("overwrite").parquet(f"{path}/fires/batch={number}")
        new = spark.read.schema(fires.schema).parquet(f"{path}/fires/batch={number}").groupBy("rule_id").agg(F.max(F.unix_micros("received_at")).alias("t"))
        now = last | {r.rule_id: r.t for r in new.collect()}
        spark.createDataFrame(list(now.items()), "rule_id string, t long").coalesce(1).write.mode("overwrite").parquet(f"{path}/last/batch={number}")
        for n in before[:-1]:
            remove(spark, f"{path}/last/batch={n}")

    return _started(messages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each), trigger)
