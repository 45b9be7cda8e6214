"""Cooldown in streams against the batch operator: bursts, restarts, late and repeated messages."""

import random

import pytest
from pyspark.sql import functions as F

from logspark.operators import alerts
from logspark.plans.catalog import hits
from logspark.plans.messages import RULES, messages
from logspark.streaming import live
from tests.conftest import SF_DIR
from tests.test_io_and_streams import NOW, ran


def staged(tmp_path, d, k):
    """d as the next files of a folder that a stream reads."""
    d.coalesce(1).write.parquet(str(tmp_path / f"stage{k}"))
    (tmp_path / "in").mkdir(exist_ok=True)
    for p in (tmp_path / f"stage{k}").glob("part-*"):
        p.rename(tmp_path / "in" / f"{k}-{p.name}")


def fires_of(spark, path):
    return sorted((r.rule_id, r.seq) for r in spark.read.parquet(f"{path}/fires").collect())


def test_repeated_hits_fire_once(spark):
    m = messages(spark, SF_DIR)
    twice = hits(m.unionByName(m))
    once = sorted((r.rule_id, r.seq) for r in alerts.fired(hits(m)).where("cooldown > 0").collect())
    for f in (alerts.fired, alerts.fired_by_rule, lambda h: alerts.fired(h, width=3)):
        assert sorted((r.rule_id, r.seq) for r in f(twice).where("cooldown > 0").collect()) == once
    free = alerts.fired(twice).where("cooldown <= 0").count()
    assert free == 2 * alerts.fired(hits(m)).where("cooldown <= 0").count()


def test_busy_and_idle_rules_together(spark):
    h = hits(messages(spark, SF_DIR))
    want = sorted((r.rule_id, r.seq) for r in alerts.fired_by_rule(h).collect())
    for rows in (1, 30, 60, 10**6):
        assert sorted((r.rule_id, r.seq) for r in alerts.fired(h, rows).collect()) == want


@pytest.mark.parametrize("width", [None, 2])
def test_fire_batches(spark, tmp_path, width):
    m, rules, path = messages(spark, SF_DIR), alerts.rules_frame(spark, RULES), str(tmp_path / "alerts")
    for k, (a, b) in enumerate(((0, 300), (300, 310), (310, 10**9))):  # a restart each time
        staged(tmp_path, m.where(f"seq >= {a} and seq < {b}"), k)
        ran(live.fire_batches(spark.readStream.schema(m.schema).parquet(str(tmp_path / "in")), rules, path, str(tmp_path / "cp"), NOW, width=width))
    assert fires_of(spark, path) == sorted((r.rule_id, r.seq) for r in alerts.fired(hits(m)).collect())


def test_fire_batches_again_and_late(spark, tmp_path):
    """The last batch runs again, as after a crash before its commit; then what is late or known already brings nothing more."""
    m, rules, path = messages(spark, SF_DIR), alerts.rules_frame(spark, RULES[:1]), str(tmp_path / "alerts")
    start = lambda: ran(live.fire_batches(spark.readStream.schema(m.schema).parquet(str(tmp_path / "in")), rules, path, str(tmp_path / "cp"), NOW))
    for k, (a, b) in enumerate(((0, 500), (500, 10**9))):
        staged(tmp_path, m.where(f"seq >= {a} and seq < {b}"), k)
        start()
    want = fires_of(spark, path)
    assert want == sorted((r.rule_id, r.seq) for r in alerts.fired(hits(m).where("rule_id = 'r1'")).collect())
    for p in (tmp_path / "cp" / "commits").glob("*1*"):
        p.unlink()
    start()
    assert fires_of(spark, path) == want
    staged(tmp_path, m.where("seq % 3 = 0"), 2)
    start()
    assert fires_of(spark, path) == want


def test_burst_of_one_rule(spark, tmp_path):
    """A burst is cut into buckets of bounded size and fires as the plain operator says."""
    draw = random.Random(7)
    times = sorted(draw.randrange(10**9) for _ in range(4000))
    rows = [(k, str(k), t) for k, t in enumerate(times)]
    base = messages(spark, SF_DIR).limit(1).drop("seq", "id", "received_at")
    m = spark.createDataFrame(rows, "seq long, id string, t long").withColumn("received_at", F.timestamp_micros(F.col("t") + 1_700_000_000_000_000)).drop("t").crossJoin(F.broadcast(base))
    rules = alerts.rules_frame(spark, [{"id": "b", "name": "burst", "cooldown": 3}])
    staged(tmp_path, m, 0)
    ran(live.fire_batches(spark.readStream.schema(m.schema).parquet(str(tmp_path / "in")), rules, str(tmp_path / "a"), str(tmp_path / "cp"), NOW, rows=50))
    want, since = [], -1
    for k, _, t in rows:
        if t >= since:
            want.append(("b", k))
            since = t + 3_000_000
    assert fires_of(spark, str(tmp_path / "a")) == want


def test_cooled_state_expires(spark, tmp_path):
    """One fire in a cooldown over restarts; once arrivals are past it the state is gone, and the rule fires again."""
    base = messages(spark, SF_DIR).limit(1).drop("seq", "id", "received_at")
    rules, got = alerts.rules_frame(spark, [{"id": "a", "name": "a", "cooldown": 60}]), []
    at = lambda *s: spark.createDataFrame([(i, str(i), i) for i in s], "seq long, id string, s long").withColumn("received_at", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s").crossJoin(F.broadcast(base))
    for k, seconds in enumerate(((0, 0, 10, 59), (20, 61, 130), (4000,), (8000, 8030), (8059, 8060))):
        d = at(*seconds)
        staged(tmp_path, d, k)
        stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
        ran(live.cooled(stream, rules, "10 seconds").writeStream.outputMode("append").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(lambda x, _: got.extend(x.collect())).trigger(**NOW).start())
    assert sorted(r.seq for r in got) == [0, 61, 130, 4000, 8000, 8060]
    state = spark.read.format("statestore").option("path", str(tmp_path / "c")).option("stateVarName", "last").load()
    assert state.count() <= 1
