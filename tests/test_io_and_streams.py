import json

from pyspark.sql import functions as F

from logspark.functions.parse import parse
from logspark.operators import alerts, stats
from logspark.plans.catalog import hits
from logspark.plans.messages import RULES, lines_of, messages
from logspark.sources import lines, sinks
from logspark.streaming import live
from tests.conftest import SF_DIR

NOW = {"availableNow": True}


def parts(spark, tmp_path, n=3):
    """The messages as n files, as a stream would find them."""
    m = messages(spark, SF_DIR)
    for i in range(n):
        m.where(F.col("seq") % n == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return m, spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def ran(query):
    query.awaitTermination(180)
    assert query.exception() is None and not query.isActive


def test_store(spark, tmp_path):
    m, path = messages(spark, SF_DIR), str(tmp_path / "store")
    sinks.append(m.where("seq < 60"), path)
    sinks.append(m.where("seq < 100"), path)
    stored = lines.read_store(spark, path)
    assert stored.drop("event_date").exceptAll(m.where("seq < 100")).count() == 0 and stored.count() == 100
    sinks.compact(spark, path, str(tmp_path / "compact"))
    assert lines.read_store(spark, str(tmp_path / "compact")).count() == 100


def test_ids_are_unique_over_days(spark, tmp_path):
    m, path = messages(spark, SF_DIR).where("seq < 20"), str(tmp_path / "store")
    sinks.append(m, path)
    later = m.withColumn("timestamp", F.col("timestamp") + F.expr("interval 40 days"))
    sinks.append(later.unionByName(later.withColumn("id", F.concat("id", F.lit("x")))), path)
    stored = lines.read_store(spark, path)
    assert stored.count() == 40 and stored.select("id").distinct().count() == 40
    assert stored.where("id not like '%x'").drop("event_date").exceptAll(m).count() == 0


def test_lines_of_transports_have_one_order(spark):
    m = messages(spark, SF_DIR)
    each = [lines.raw_lines(m.where(F.col("protocol") == p).withColumn("value", F.col("raw_message")), p) for p in ("UDP", "TCP", "TLS")]
    both = lines.union_transports(*each)
    assert both.count() == both.select("seq").distinct().count() == m.count()


def test_stream_appends_what_is_not_known(spark, tmp_path):
    m = messages(spark, SF_DIR).where("version = 1 and seq < 200")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(r.raw for r in lines_of(m).collect()))
    for k in range(2):  # a second run without the first one's checkpoint reads the same file again
        ran(live.ingest(lines.stream_lines(spark, str(tmp_path / "in"), "UDP"), str(tmp_path / "store"), str(tmp_path / f"cp{k}"), NOW, ignore_known=True))
        assert lines.read_store(spark, str(tmp_path / "store")).count() == m.count()


def test_exports(spark, tmp_path):
    m = messages(spark, SF_DIR).where("seq < 5").withColumn("message", F.concat(F.lit('say "x", '), F.col("message")))
    sinks.write_csv(m, str(tmp_path / "csv"), single=True)
    text = next((tmp_path / "csv").glob("part-*")).read_text(encoding="utf-8")
    assert text.startswith("﻿Timestamp,Severity") and '"say ""x"", ' in text and text.count("\n") == 6
    sinks.write_text(m, str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == 5


def test_read_lines(spark, tmp_path):
    (tmp_path / "log.txt").write_text("<13>x\n\n<14>y\n")
    got = parse(lines.read_lines(spark, str(tmp_path / "log.txt"), "TCP", "10.0.0.9")).collect()
    assert sorted((r.severity, r.message, r.source_ip) for r in got) == [(5, "x", "10.0.0.9"), (6, "y", "10.0.0.9")]


def test_rules_from_configuration(spark, tmp_path):
    (tmp_path / "config.json").write_text(json.dumps({"server": {"port": 514}, "alerts": RULES}, indent=1))
    found = lines.read_rules(spark, str(tmp_path / "config.json"))
    assert [r["id"] for r in found] == [r["id"] for r in RULES]
    m = messages(spark, SF_DIR)
    assert alerts.matches(m, alerts.rules_frame(spark, found)).count() == hits(m).count()


def test_stream_ingest(spark, tmp_path):
    m = messages(spark, SF_DIR)
    for i in range(2):
        (tmp_path / f"in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(r.raw for r in lines_of(m.where(f"version = 1 and seq % 4 = {2 * i + 1}")).collect()))
    ran(live.ingest(lines.stream_lines(spark, str(tmp_path / "in"), "UDP"), str(tmp_path / "store"), str(tmp_path / "cp"), NOW))
    got = lines.read_store(spark, str(tmp_path / "store"))
    assert sorted(r.message for r in got.collect()) == sorted(r.message for r in m.where("version = 1").collect())


def test_stream_dedup_rate_and_levels(spark, tmp_path):
    m, stream = parts(spark, tmp_path)
    ran(live.deduplicated(stream.union(stream), "40 days").writeStream.format("parquet").option("path", str(tmp_path / "d")).option("checkpointLocation", str(tmp_path / "c1")).trigger(**NOW).start())
    assert spark.read.schema(m.schema).parquet(str(tmp_path / "d")).select("id").exceptAll(m.select("id")).count() == 0
    for name, f, batch in (("r", lambda d: live.rates(d, delay="40 days"), stats.rate(m)), ("t", lambda d: live.level_counts(d, "1 hour", "40 days"), stats.tumbling(m))):
        ran(f(stream).writeStream.format("memory").queryName(f"out_{name}").outputMode("complete").option("checkpointLocation", str(tmp_path / name)).trigger(**NOW).start())
        assert spark.table(f"out_{name}").exceptAll(batch).count() == 0 and spark.table(f"out_{name}").count() == batch.count()


def test_stream_dashboard(spark, tmp_path):
    m, stream = parts(spark, tmp_path)
    seen = []
    ran(live.dashboard(stream, str(tmp_path / "c"), lambda a, b: seen.append((a.collect(), b.collect())), trigger=NOW))
    assert [tuple(r) for r in seen[-1][1]] == [tuple(r) for r in stats.top_sources(m).collect()]
    assert sum(r["count"] for r in seen[-1][0]) == m.count()


def test_stream_cooldown(spark, tmp_path):
    m = messages(spark, SF_DIR)
    for i, (a, b) in enumerate(((0, 300), (300, 700), (700, 10**9))):  # by arrival, as a stream is
        m.where(f"seq >= {a} and seq < {b}").coalesce(1).write.parquet(str(tmp_path / f"in{i}"))
    rules, got = alerts.rules_frame(spark, RULES), []
    for i in range(3):  # a restart each time: the state stays in the checkpoint
        stage = tmp_path / "in"
        stage.mkdir(exist_ok=True)
        for p in (tmp_path / f"in{i}").glob("part-*"):
            p.rename(stage / f"{i}-{p.name}")
        stream = spark.readStream.schema(m.schema).parquet(str(stage))
        ran(live.cooled(stream, rules).writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda d, _: got.extend(d.collect())).trigger(**NOW).start())
    want = alerts.fired(hits(m)).select("rule_id", "seq").collect()
    assert sorted((r.rule_id, r.seq) for r in got) == sorted((r.rule_id, r.seq) for r in want)
