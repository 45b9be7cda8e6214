import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from logspark.operators import alerts, dedup, groups, query, rank, retention, stats
from logspark.operators.filters import Filter
from logspark.plans.catalog import hits
from logspark.plans.messages import RULES, messages
from tests.conftest import SF_DIR


@pytest.fixture(scope="module")
def m(spark):
    return messages(spark, SF_DIR).cache()


def ids(d):
    return sorted(r.id for r in d.select("id").collect())


@pytest.mark.parametrize("most", [200_000, 3])
@pytest.mark.parametrize("n", [0, 1, 137, 999, 10**6])
def test_newest_is_global_sort(m, n, most):
    assert ids(rank.newest(m, n, most_ranked=most)) == ids(m.orderBy(F.desc("timestamp"), F.desc("id")).limit(n))


def test_newest_with_all_times_equal(m):
    same = m.withColumn("timestamp", F.lit(datetime(2024, 1, 1)))
    assert ids(rank.newest(same, 10, most_ranked=5)) == ids(same.orderBy(F.desc("id")).limit(10))


@pytest.mark.parametrize("page,size", [(1, 10), (7, 100), (10, 100), (11, 100), (1, 1000), (1000, 1)])
def test_deep_page_is_shallow_page(m, page, size):
    deep, shallow = (query.query_page(m, page=page, size=size, deep=d).select("pos", "id").collect() for d in (0, 10**9))
    assert sorted(deep) == sorted(shallow)


@pytest.mark.parametrize("most", [200_000, 7])
@pytest.mark.parametrize("sort_field,direction", [("timestamp", "asc"), ("severity", "desc"), ("hostname", "asc"), ("message", "desc"), ("protocol", "asc")])
def test_page_at_any_order(m, sort_field, direction, most):
    by = query.order_by(sort_field, direction)
    want = [r.id for r in m.orderBy(*query.order(sort_field, direction)).select("id").collect()]
    for offset, size in ((0, 10), (497, 20), (990, 50), (1000, 5)):
        assert sorted(ids(rank.page_at(m.select("id", by[0][0]), offset, size, by, most))) == sorted(want[offset : offset + size])


def test_page_bounds():
    assert query.page_bounds(0, 0) == (0, 100) and query.page_bounds(3, 1001) == (200, 100) and query.page_count(0, 10) == 1 and query.page_count(101, 100) == 2


def test_recent_filters_after_the_cut(m):
    got = query.recent(m, Filter(severities=(7,)), 50).orderBy("pos").collect()
    last = sorted(m.collect(), key=lambda r: (r.received_at, r.seq))[-50:]
    assert [r.id for r in got] == [r.id for r in last if r.severity == 7]


def test_plans(m, spark):
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    source = messages(spark, SF_DIR)
    assert "TakeOrderedAndProject" in plan(stats.top_sources(source)) and "WindowGroupLimit" in plan(groups.top_of_each(source, "hostname", 5))
    assert "Join" not in plan(hits(source)) and "Exchange" not in plan(hits(source)) and "SinglePartition" not in plan(retention.by_age(source, datetime(2024, 1, 31, tzinfo=timezone.utc), 7))


def test_unknown_group_is_empty(m):
    assert groups.summary(m, "nothing").count() == 0
    none = groups.top_of_each(m, "nothing", 5)
    assert none.count() == 0 and none.columns == [*m.columns, "key", "pos"]


def test_sources_and_rate(spark):
    rows = [(i, f"host-{k}" if k < 15 else "", "192.168.1.100", datetime(2024, 1, 1, 0, 0, 5)) for i, k in enumerate([0] * 5 + [1] * 15 + list(range(2, 16)))]
    d = spark.createDataFrame(rows, "seq int, hostname string, source_ip string, received_at timestamp")
    top = stats.top_sources(d).collect()
    assert len(top) == 10 and [(r.hostname, r["count"]) for r in top[:3]] == [("host-1", 15), ("host-0", 5), ("192.168.1.100", 1)]
    assert {r.rate for r in stats.rate(d.limit(20)).collect()} == {2.0} and stats.rate(d.limit(20)).count() == 10
    assert stats.buffer_usage(d.limit(3), 8).first().percent == 38


def test_retention_off_and_size(m):
    assert retention.by_age(m, datetime(2030, 1, 1, tzinfo=timezone.utc), 0).count() == retention.by_count(m, 0).count() == retention.by_size(m, 0).count() == m.count()
    assert retention.by_size(m, 0.0001).count() == max(0, m.count() - max(m.count() // 10, 1000))


def test_first_by_id_ignores_order_of_rows(m):
    again = m.withColumn("seq", F.col("seq") + 10**6).withColumn("message", F.lit("later"))
    assert dedup.first_by_id(again.union(m)).exceptAll(m).count() == 0
    assert dedup.not_yet(m, m).count() == 0


RULE_CASES = [
    ({"pattern": "disk full"}, {"message": "volume 3: Disk Full"}, 1), ({"pattern": "disk full"}, {"message": "volume 3 mounted"}, 0), ({"pattern": "disk full"}, {"raw_message": "<11>DISK FULL"}, 1),
    ({"pattern": r"port (22|23)\b", "useRegex": True}, {"message": "knock at PORT 23"}, 1), ({"pattern": r"port (22|23)\b", "useRegex": True}, {"message": "port 230"}, 0), ({"pattern": "(unclosed", "useRegex": True}, {"message": "(unclosed"}, 0),
    ({"minSeverity": 2}, {"severity": 2}, 1), ({"minSeverity": 2}, {"severity": 3}, 0), ({"minSeverity": 0}, {"severity": 0}, 1), ({"minSeverity": -1}, {"severity": 7}, 1),
    ({"hostname": "EDGE"}, {"hostname": "edge-router-9"}, 1), ({"hostname": "edge"}, {"hostname": "core-router-9"}, 0), ({"appName": "dhcp"}, {"app_name": "isc-DHCPd"}, 1), ({"appName": "dhcp"}, {"app_name": "named"}, 0),
    ({"enabled": False}, {}, 0), ({}, {}, 1), ({"pattern": "full", "hostname": "edge"}, {"message": "full", "hostname": "core"}, 0),
]


@pytest.mark.parametrize("rule,message,want", RULE_CASES)
def test_rule(spark, rule, message, want):
    base = {"seq": 1, "severity": 5, "hostname": "", "app_name": "", "message": "", "raw_message": ""} | message
    d = spark.createDataFrame([tuple(base.values())], "seq long, severity int, hostname string, app_name string, message string, raw_message string")
    assert alerts.matches(d, alerts.rules_frame(spark, [{"id": "a", **rule}])).count() == want


def matched(spark, seconds, cooldown):
    rows = [(i, str(i), datetime.fromtimestamp(1_700_000_000 + s, timezone.utc), "a", cooldown) for i, s in enumerate(seconds)]
    return spark.createDataFrame(rows, "seq long, id string, received_at timestamp, rule_id string, cooldown int")


@pytest.mark.parametrize("fired", [alerts.fired, alerts.fired_by_rule])
def test_cooldown(spark, fired):
    got = lambda s, c: sorted(s[r.seq] for r in fired(matched(spark, s, c)).collect())
    assert got([0, 30, 60, 90, 119, 120], 60) == [0, 60, 120]
    assert got([0, 0], 60) == [0] and got([0, 0], 0) == [0, 0]


@pytest.mark.parametrize("width", [1, 2, 16])
def test_buckets_give_what_rules_give(m, width):
    a, b = alerts.fired(hits(m), width=width), alerts.fired_by_rule(hits(m))
    assert sorted(a.select("rule_id", "seq").collect()) == sorted(b.select("rule_id", "seq").collect())


def greedy(seconds, cooldown):
    out = []
    for s in sorted(seconds):
        if not out or s >= out[-1] + cooldown:
            out.append(s)
    return out


@pytest.mark.parametrize("cooldown,every", [(1, 1), (7, 1), (60, 3), (600, 1), (5, 20)])
def test_busy_rule_in_many_buckets(spark, monkeypatch, cooldown, every):
    """One rule that matches all rows, its time line cut into buckets of one cooldown that are put together two by two."""
    monkeypatch.setattr(alerts, "FAN", 2)
    pick = random.Random(cooldown)
    seconds = sorted({pick.randrange(0, 1500 * every, every) + (every > 3) * pick.randrange(3) for _ in range(700)} | {50_000, 50_001})
    got = alerts.fired(matched(spark, seconds, cooldown), rows=1)
    assert sorted(seconds[r.seq] for r in got.collect()) == greedy(seconds, cooldown)


def test_hits_that_share_a_seq(spark):
    rows = [(1, "b", datetime(2024, 1, 1, 0, 0, 0), "a", 60), (1, "c", datetime(2024, 1, 1, 0, 0, 30), "a", 60), (1, "a", datetime(2024, 1, 1, 0, 0, 0), "a", 60), (2, "d", datetime(2024, 1, 1, 0, 1, 0), "a", 60)]
    d = spark.createDataFrame(rows, "seq long, id string, received_at timestamp, rule_id string, cooldown int")
    for fired in (alerts.fired, alerts.fired_by_rule):
        assert sorted(r.id for r in fired(d).collect()) == ["a", "d"]


def test_no_rules(m):
    none = alerts.rules_frame(m.sparkSession, [])
    assert alerts.matches(m, none).count() == 0 and alerts.fired(alerts.matches(m, none)).count() == 0


def test_history_keeps_the_newest(m):
    rules = alerts.rules_frame(m.sparkSession, [{"id": "a", "name": "x"}, {"id": "b", "name": "y"}])
    every = alerts.events(alerts.fired(alerts.matches(m, rules)))
    kept = alerts.history(every, every.limit(0), 500).orderBy("pos").collect()
    assert len(kept) == 500 and kept[-1].ruleId == "b" and kept[-2].ruleId == "a" and len(RULES) == 5


def test_notification(spark):
    d = spark.createDataFrame([("1", "r", "x" * 121, "Error", ""), ("2", "r", "x" * 120, "Odd", "h")], "id string, ruleName string, message string, severity string, hostname string")
    a, b = alerts.notifications(d).orderBy("id").collect()
    assert a.title == "❌ r" and a.body == "Error on unknown host\n" + "x" * 117 + "..." and b.title == "\U0001f514 r" and b.body.endswith("x" * 120)


def test_empty_messages(m):
    none = m.limit(0)
    assert rank.newest(none, 5).count() == 0 and query.query_page(none).count() == 0 and stats.storage(none).first().message_count == 0 and alerts.fired(hits(none)).count() == 0


@pytest.mark.parametrize("down", [True, False])
def test_spans_of_odd_values(spark, m, down, monkeypatch):
    """Common beginnings, nulls, ties of any number: few passes, exact ranks."""
    monkeypatch.setattr(rank, "SAMPLE", 60)
    draw = random.Random(4)
    rows = [(None if draw.random() < 0.1 else "common beginning of many a message, " * 3 + draw.choice(["a", "ab", "ü", "z"]) * draw.randint(0, 3), i // 2) for i in range(2000)]
    d = spark.createDataFrame(rows, "v string, k long").repartition(3)
    by = (("v", down), ("k", down))
    want = [tuple(r) for r in d.orderBy(*rank.ordered(by)).collect()]
    for offset, size in ((0, 5), (900, 40), (1995, 20), (3000, 5)):
        got = [tuple(r) for r in rank.page_at(d, offset, size, by, 5).collect()]
        assert got == want[offset : offset + size]


def test_deep_page_takes_few_jobs(spark):
    """Texts that share their first 120 letters."""
    d = spark.range(60_000).select(F.concat(F.lit("x" * 120), F.sha2(F.col("id").cast("string"), 256)).alias("message"), F.col("id").cast("string").alias("id")).cache()
    d.count()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("deep", "page by text")
    try:
        got = rank.page_at(d, 30_000, 10, (("message", False), ("id", False)), 1000).collect()
        assert len(tracker.getJobIdsForGroup("deep")) < 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r.id for r in got] == [r.id for r in d.orderBy("message", "id").offset(30_000).limit(10).collect()]
